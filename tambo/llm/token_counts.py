"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of arrays.

A text is cut at the vocabulary's special strings and by its pre-token pattern.
Pre-tokens not seen before are counted together: their byte symbols stand end
to end in one array (ragged rows), and each round every row merges all
occurrences of its lowest-rank pair at once, until no row has a pair of the
vocabulary; the symbols that survive are its tokens.  A merged symbol takes
part in higher ranks only, so this equals merging one occurrence at a time.
A row of more than ``LONG`` bytes would need a round over all its symbols for
each rank that it holds: its places are kept by rank instead, and a round visits
those of the lowest rank and their neighbours alone, so one very long word costs
about its length.  Counts of short pre-tokens are remembered per worker, up to
``CACHE`` of them.

The vocabulary file is read where it is installed on each executor; its path is
a parameter.

Defined results: null counts as empty and has 0 tokens; a special string is one
token; texts are never cut, and neither is a very long word; repeated rows each get a row; an empty table gives
no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import like_type

#: Pre-tokens of the byte-level vocabulary (a fixed value of its file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered pre-tokens per worker, and the longest one remembered.
CACHE, CACHE_CHARS = 400_000, 64
#: Bytes of new pre-tokens merged together, about.
MERGE_BYTES = 1 << 19
#: Bytes of a pre-token beyond which its places are kept by rank.
LONG = 1024


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: itself where printable, else the
    next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def every_other(at: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
    """The places without those that overlap the one kept before them; ``overlaps`` says it of each place but the first."""
    if not overlaps.any():
        return at
    count = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.concatenate(([True], ~overlaps)), count, 0))
    return at[(count - run) % 2 == 0]


class Vocabulary:
    """Merge ranks as sorted arrays, and the counts seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = np.array([ids[symbols[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(ids.values()) + 2
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.none = len(merges)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, rows: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte row."""
        out, long = np.zeros(len(rows), np.int64), np.array([len(r) > LONG for r in rows], bool)
        for which, merged in ((~long, self.merge_rows), (long, self.merge_long)):
            if which.any():
                out[which] = merged([rows[i] for i in np.flatnonzero(which)])
        return out

    def merge_rows(self, rows: list[bytes]) -> np.ndarray:
        """Tokens of each row: every round goes over all symbols that are left."""
        out = np.zeros(len(rows), np.int64)
        length = np.array([len(r) for r in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), length)
        symbol = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        while len(symbol):
            # Rank of each symbol's pair with the one after it in its row.
            rank = np.full(len(symbol), self.none, np.int64)
            inside = np.flatnonzero(row[1:] == row[:-1])
            rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
            heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            count = np.diff(heads, append=len(row))
            least = np.minimum.reduceat(rank, heads)
            done = least == self.none
            out[row[heads[done]]] = count[done]
            here = np.repeat(least, count)
            take = (rank == here) & (here < self.none)
            # Of pairs that overlap (runs of one symbol), every other one, from the left.
            at = np.flatnonzero(take)
            at = every_other(at, np.diff(at) == 1)
            symbol[at] = self.merged[rank[at]]
            stay = np.repeat(~done, count)
            stay[at + 1] = False
            symbol, row = symbol[stay], row[stay]
        return out

    def merge_long(self, rows: list[bytes]) -> np.ndarray:
        """Tokens of each row: every round goes over the places of one rank, the lowest there is in any row."""
        # Rows end to end with a symbol of no pair before, between and behind them; neighbours by index.
        symbol = np.concatenate([np.array([-1])] + [np.append(self.of_byte[np.frombuffer(r, np.uint8)], -1) for r in rows])
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        rank = np.append(self.rank(symbol[:-1], symbol[1:]), self.none)
        alive = symbol >= 0
        ends = np.flatnonzero(~alive)
        places: dict[int, list[int]] = {}
        ranks: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            for r, i in zip(rank[at].tolist(), at.tolist()):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(i)

        file(np.arange(len(symbol)))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.array(places.pop(r), np.int64))
            at = at[rank[at] == r]              # others have been merged away since they were filed
            if not len(at):
                continue
            at = every_other(at, after[at[:-1]] == at[1:])
            gone = after[at]
            symbol[at] = self.merged[r]
            alive[gone], rank[gone] = False, self.none
            after[at] = after[gone]
            before[after[at]] = at
            beside = np.unique(np.concatenate((at, before[at])))
            rank[beside] = self.rank(symbol[beside], symbol[after[beside]])
            file(beside)
        return np.add.reduceat(alive, ends[:-1], dtype=np.int64)

    def learn(self, tokens: set[str]) -> dict[str, int]:
        """Tokens of each new pre-token."""
        new, lo, fresh = list(tokens), 0, {}
        coded = [t.encode("utf-8", "surrogatepass") for t in new]
        while lo < len(new):
            hi, room = lo, MERGE_BYTES
            while hi < len(new) and (hi == lo or room >= len(coded[hi])):
                room -= len(coded[hi])
                hi += 1
            fresh.update(zip(new[lo:hi], self.merge(coded[lo:hi]).tolist()))
            lo = hi
        return fresh

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, parts = [], []
        for i, text in enumerate(texts):
            cut = self.special.split(text) if self.special else [text]
            out.append(len(cut) - 1)
            parts += [(i, p) for p in cut if p]
        words = [self.words.findall(p) for _, p in parts]
        every = set().union(*words)
        if len(self.seen) + len(every) > CACHE:
            self.seen = {}
        missing = every - self.seen.keys()
        self.seen.update(self.learn(missing))
        for (i, _), ws in zip(parts, words):
            out[i] += sum(map(self.seen.__getitem__, ws))
        for token in missing:
            if len(token) > CACHE_CHARS:
                del self.seen[token]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_bytes, n_tokens, over_limit) per row."""
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                counts = pa.array(vocab.count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), counts], ["doc", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"doc {like_type(rows, 'doc')}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
