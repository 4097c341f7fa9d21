"""Ranked lexical search: exact top-k documents for each item of a query set, by dual-tree search.

**Scores.**  Terms are runs of digits, letters and characters from U+0080 on, A-Z lower-cased.  N documents have a term,
L is the number of all their terms, n that of one document, df the documents that hold a term, tf its places in one
document.  A term weighs floor(1000 * ln((2N + 2) / (2df + 1))); with m = 25 + (75 * n * N) div L a document scores the
sum, over an item's terms with repeats, of weight * ((10^9 * tf) div (1000 * tf + 8 * m)), in 64-bit integers.

**Search.**  Texts are read once: each row keeps its length and the places of the items' terms.  A task takes documents
in blocks and builds a tree over each, neighbours in it being alike, and there is one tree over the items.  Every tree
node holds the largest value that any of its members has in each coordinate (term), so the product of two nodes bounds
the score of every pair below them.  A pair of nodes is left out as a whole when its bound is below the weakest kth
score of its items; otherwise the search goes down in both trees, and pairs of leaves are scored exactly.  Nothing is
approximate: a bound equal to the kth score is followed, as a smaller id wins a tie.

**Thresholds.**  The kth scores over one document in ``SEED`` (by a hash of its row) are found first and sent to all tasks.
They are scores of real documents, hence lower bounds of the final ones; what passes them is some ``k * SEED`` rows an
item, whatever the size of the table, and each task sends its k best of those.

Items are taken in blocks of about ``BLOCK_BYTES`` of text, for each of which all texts are read; of a block's items, groups
of at most ``CELLS`` items x terms are searched at a time.  Only a block's terms and a group's weights and thresholds
are ever sent to the tasks.

Defined results: a null or empty text has no term, such a document ranks nowhere and does not count, such an item has no
rows; an item with terms that no document holds has none either; each row of items is an item of its own and each row
of documents a document of its own, repeated or not; equal scores rank by ascending id, null ids last, rows that agree
in both in any order; an empty table gives no rows; only the named columns are read.  Whole texts are read, however
long; a document keeps one entry for each different term it shares with the items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructType

from tambo.llm.common import checkpointed, like_type

#: Text bytes of the items that one search takes, about.
BLOCK_BYTES = 1 << 20
#: One document in so many gives the first thresholds.
SEED = 64
#: Cells (documents x terms, items x terms) of the arrays that a task holds for a block of documents and a group of items.
CELLS = 1 << 20
#: Members of a leaf, and children of a node above, in both trees.
LEAF, FAN = 8, 4
#: Beyond this sum float64 products would not be whole numbers any more.
EXACT = 1 << 53

#: Bytes that are no part of a term become blanks, A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ------------------------------------------------------------------ trees
class Tree:
    """Members in an order that puts like ones side by side, and coordinate maxima of nodes level by level, root first."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.rows, self.leaf, self.fan = rows, leaf, fan
        levels, width = [rows], leaf
        while len(levels[-1]) > 1 or len(levels) == 1:
            below = levels[-1]
            starts = np.arange(0, len(below), width)
            levels.append(np.maximum.reduceat(below, starts, axis=0))
            width = fan
        self.levels = levels[:0:-1]

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of the next level (members, below the last) under the given ones."""
        width = self.fan if level + 1 < len(self.levels) else self.leaf
        size = len(self.levels[level + 1]) if level + 1 < len(self.levels) else len(self.rows)
        found = (nodes[:, None] * width + np.arange(width)).ravel()
        return found[found < size]


def likeness_order(rows: np.ndarray) -> np.ndarray:
    """An order of sparse rows by their largest coordinates, so that rows that share rare terms are neighbours."""
    if not rows.shape[1]:
        return np.arange(len(rows))
    first = rows.argmax(axis=1)
    rest = rows.copy()
    rest[np.arange(len(rows)), first] = 0
    return np.lexsort((rows.sum(axis=1), rest.argmax(axis=1), first))


class Queries:
    """A group of items as a matrix over the group's terms, weighted, and the tree over them.

    ``items`` holds an array of term numbers and one of weights (times repeats) for each item.
    """

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        used = np.unique(np.concatenate([t for t, _ in items]))
        self.width = len(used)
        #: The group's column of each term of the block, -1 for terms of other groups.
        self.column = np.full(n_terms, -1, np.int64)
        self.column[used] = np.arange(len(used))
        exact = np.zeros((len(items), len(used)), np.int64)
        for i, (terms, weights) in enumerate(items):
            exact[i, self.column[terms]] = weights
        self.order = likeness_order(exact)
        self.rows = exact[self.order]
        self.tree = Tree(self.rows.astype(np.float64))
        #: Whether no score reaches 2^53 (impacts are at most 10^9 div 1000), so that float64 sums are whole numbers.
        self.whole = int(exact.sum(axis=1).max()) < EXACT // 1_000_000
        #: Bounds are rounded up by more than the error of their sums.
        self.slack = 1.0 if self.whole else 1.0 + 1e-9

    def search(self, impacts: np.ndarray, kth: np.ndarray, take: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """Calls ``take`` with (document row, item row, score) of every pair that may be among an item's k best.

        ``kth`` holds each item row's kth score so far and is read anew at every step down, so ``take`` may raise it.
        """
        docs, items = Tree(impacts), self.tree
        live = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while live:
            d, i, some_docs, some_items = live.pop()
            bound = docs.levels[d][some_docs] @ items.levels[i][some_items].T * self.slack
            under = self.weakest(i, some_items, kth)
            keep = (bound >= under) & (bound > 0)
            some_docs, some_items = some_docs[keep.any(axis=1)], some_items[keep.any(axis=0)]
            if not len(some_docs):
                continue
            last_d, last_i = d + 1 == len(docs.levels), i + 1 == len(items.levels)
            if last_d and last_i:
                self.score(docs, items, d, i, some_docs, some_items, keep[keep.any(axis=1)][:, keep.any(axis=0)], kth, take)
            elif not last_i and (last_d or len(some_docs) > len(some_items)):
                # Groups of items part, each with the document nodes that it still needs.
                for one in some_items:
                    live.append((d, i + 1, some_docs, items.children(i, np.array([one]))))
            else:
                live.append((d + 1, i, docs.children(d, some_docs), some_items))

    def weakest(self, level: int, nodes: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The weakest kth score among the items under each node."""
        size = self.tree.leaf * self.tree.fan ** (len(self.tree.levels) - 1 - level)
        return np.array([kth[n * size:(n + 1) * size].min() for n in nodes], np.float64)

    def score(self, docs: Tree, items: Tree, d: int, i: int, some_docs: np.ndarray, some_items: np.ndarray,
              keep: np.ndarray, kth: np.ndarray, take: Callable) -> None:
        """Exact scores of the members of leaves, the documents' leaves taken best bound first."""
        for at, one in enumerate(some_items):
            members = items.children(i, np.array([one]))
            rows = docs.children(d, some_docs[keep[:, at]])
            if self.whole:
                scores = (docs.rows[rows] @ items.rows[members].T).astype(np.int64)
            else:
                scores = docs.rows[rows].astype(np.int64) @ self.rows[members].T
            r, c = np.nonzero((scores >= kth[members]) & (scores > 0))
            take(rows[r], members[c], scores[r, c])


# ------------------------------------------------------------------ one task
class Best:
    """The k best (score, id) of each item so far, and its kth score where k are known."""

    def __init__(self, start: np.ndarray, k: int):
        self.k, self.kth = k, start.copy()
        self.found: list[list[tuple]] = [[] for _ in start]

    def add(self, items: np.ndarray, ids: list, scores: np.ndarray) -> None:
        touched = set()
        for i, doc, score in zip(items.tolist(), ids, scores.tolist()):
            self.found[i].append((-score, doc is None, doc if doc is not None else 0))
            touched.add(i)
        for i in touched:
            if len(self.found[i]) > self.k:
                self.found[i] = sorted(self.found[i])[:self.k]
            if len(self.found[i]) == self.k:
                self.kth[i] = max(self.kth[i], -max(self.found[i])[0])


def impacts_of(n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, width: int, n_docs: int, total: int) -> np.ndarray:
    """Documents x terms: (10^9 * tf) div (1000 * tf + 8 * m), in float64 (below 2^53)."""
    m = 25 + (75 * n * n_docs) // total
    out = np.zeros((len(n), width))
    out[at, term] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
    return out


def search_task(items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, total: int, start: np.ndarray, k: int):
    """mapInArrow function over (doc, n, terms, tfs): the k best documents of a partition for each item of a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, kind = Queries(items, n_terms), None
        best = Best(start[queries.order], k)
        step = max(LEAF, CELLS // queries.width)
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids, n = part.column(0).to_pylist(), part.column(1).to_numpy()
                at = np.repeat(np.arange(len(ids)), part.column(2).value_lengths().to_numpy())
                term, tf = queries.column[part.column(2).flatten().to_numpy()], part.column(3).flatten().to_numpy()
                at, term, tf = at[term >= 0], term[term >= 0], tf[term >= 0].astype(np.int64)
                impacts = impacts_of(n, at, term, tf, queries.width, n_docs, total)
                order = likeness_order(impacts * queries.tree.levels[0])
                queries.search(impacts[order], best.kth,
                               lambda rows, items, scores: best.add(items, [ids[x] for x in order[rows].tolist()], scores))
        rows = [(int(queries.order[i]), None if none else doc, -score)
                for i, found in enumerate(best.found) for score, none, doc in found]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())],
                                             ["item", "doc", "score"])
    return run


def term_places(number: dict[bytes, int]):
    """mapInArrow function over (doc, text): the length in terms and the items' terms with their frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lengths, places, counts = [], [], []
                for text in part.column(1).to_pylist():
                    terms = terms_of(text)
                    found = Counter(filter(known.__contains__, terms))
                    lengths.append(len(terms))
                    places.append([number[t] for t in found])
                    counts.append(list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths, pa.int64()), pa.array(places, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int32()))], ["doc", "n", "terms", "tfs"])
    return run


# ------------------------------------------------------------------ the whole search
def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, seed: int = SEED) -> DataFrame:
    """(item_id, rank, doc, score): each item's k highest-scoring documents, ranks from 1."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    results = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = own.collect()        # one block of the query set, about block_bytes of text
        found = search_block(base, [r["item_id"] for r in rows], [terms_of(r["text"]) for r in rows],
                             asked.schema["item_id"].dataType, k, seed)
        results = found if results is None else results.unionByName(found)
    return results


def groups(items: list[list[bytes]], cells: int) -> Iterator[list[int]]:
    """Runs of items, none empty, with at most ``cells`` items x terms in each, or of one item."""
    members: list[int] = []
    terms: set[bytes] = set()
    for i, own in enumerate(items):
        if members and (len(members) + 1) * len(terms.union(own)) > cells:
            yield members
            members, terms = [], set()
        members.append(i)
        terms.update(own)
    if members:
        yield members


def search_block(base: DataFrame, ids: list, items: list[list[bytes]], id_type: DataType, k: int, seed: int) -> DataFrame:
    spark, doc_sql = base.sparkSession, like_type(base, "doc")
    ids, items = [i for i, terms in zip(ids, items) if terms], [terms for terms in items if terms]
    number = {t: i for i, t in enumerate(sorted({t for terms in items for t in terms}))}
    index = checkpointed(base.mapInArrow(term_places(number), f"doc {doc_sql}, n bigint, terms array<int>, tfs array<int>"))
    n_docs, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.filter(F.size("terms") > 0)
    weight = {r["term"]: term_weight(n_docs, r["count"])        # a row for each term of the block
              for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    names = StructType().add("item_id", id_type).add("rank", IntegerType()).add("doc", base.schema["doc"].dataType).add("score", LongType())
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    results = spark.createDataFrame([], names)
    for members in groups(items, CELLS):
        counts = [Counter(number[t] for t in items[i]) for i in members]
        own = [(np.array(list(c), np.int64), np.array([n * weight.get(t, 0) for t, n in c.items()], np.int64)) for c in counts]

        def ranked(rows: DataFrame, start: np.ndarray) -> DataFrame:
            task = search_task(own, len(number), n_docs, total, start, k)
            found = rows.mapInArrow(task, f"item int, doc {doc_sql}, score bigint")
            return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

        start = np.zeros(len(members), np.int64)
        if seed > 1:
            sample = held.filter(F.pmod(F.xxhash64("doc", "n"), F.lit(seed)) == 0)
            for row in ranked(sample, start).filter(F.col("rank") == k).select("item", "score").collect():    # a row an item
                start[row["item"]] = row["score"]
        asked = spark.createDataFrame([(i, ids[m]) for i, m in enumerate(members)], StructType().add("item", IntegerType()).add("item_id", id_type))
        results = results.unionByName(ranked(held, start).join(F.broadcast(asked), "item").select("item_id", "rank", "doc", "score"))
    return results
