"""SimHash near-duplicate detection with a pigeonring candidate filter.

**Fingerprints.**  Words are maximal runs without ASCII white space (0x20,
0x09-0x0D) after A-Z is lower-cased; a shingle is ``k`` consecutive words joined
by one space, repeats included.  A text of fewer than ``k`` words has one
shingle, its whole word sequence; a text without words (null or empty as well)
has none and gets fingerprint zero, which links like any other.  A bit is 1 when
it is set in more than half of the shingle hashes (XXH64, seed 42).

**Links.**  Distinct fingerprints link at ``max_bits`` or fewer differing bits.
The 64 bits are cut into ``segments`` on a ring.  If two fingerprints differ in
at most d of 64 bits, some segment starts a chain whose first l segments
differ in at most floor(l * d / segments) bits, for every l.  From that start:

* the first segments, whose budget is 0, agree;
* of the segments up to the last with budget 1, all but one agree.

So pairs meet under a key (start, which segment may differ, bits that must
agree), the join condition checks the whole chain, and a full Hamming check
follows.  Equal fingerprints are one row throughout.  A key shared by more than
``HOT_KEY`` fingerprints is not joined with itself: its members, which can only
differ in the key's free bits, are linked to the least member of every class
that agrees outside some ``max_bits`` of the free bits.  That is exact as well
and grows in proportion to the members.

**Components.**  ``tambo.llm.components``; the id of a component is its smallest
document id.

Defined results: repeated rows each get their row and are always together; a
null id is linked like others but never names a component that has another id;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed, like_type, own_names, text_key
from tambo.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles hashed and counted at a time: bounds memory for one very long text.
BLOCK = 1 << 16
#: Distinct fingerprints under one key beyond which classes are formed instead of pairs.
HOT_KEY = 4096


# ------------------------------------------------------------------ fingerprints
def shingle_bounds(norm: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every ``k``-word shingle of a text whose words are split by one space."""
    if not norm:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(norm)]))
    if len(starts) <= k:
        return starts[:1], ends[-1:]
    return starts[: len(starts) - k + 1], ends[k - 1:]


def simhash(data: bytes | None, k: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    norm = b" ".join(data.translate(LOWER).split()) if data else b""
    starts, ends = shingle_bounds(norm, k)
    total = len(starts)
    if total == 0:
        return 0
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, total, BLOCK):
        spans = zip(starts[lo:lo + BLOCK].tolist(), ends[lo:lo + BLOCK].tolist())
        hashes = np.frombuffer(b"".join([digest(norm[i:j], SEED) for i, j in spans]), np.uint8).reshape(-1, 8)
        # Digests are big-endian: the last byte holds bits 0 to 7.
        ones += np.unpackbits(hashes[:, ::-1], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return int(weights[2 * ones > total].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, fp) per row: fp as signed long, key tells apart rows of one id."""
    rows = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, k) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc", "key", "fp"])

    return rows.mapInArrow(run, f"doc {like_type(rows, 'doc')}, key bigint, fp bigint")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ links
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Ring:
    """Budgets and keys of the pigeonring filter for one distance bound and segment count."""

    def __init__(self, max_bits: int, segments: int):
        if 64 % segments or not 0 <= max_bits < segments:
            raise ValueError("segments must divide 64 and exceed max_bits")
        self.width, self.segments = 64 // segments, segments
        self.budgets = [length * max_bits // segments for length in range(1, segments + 1)]
        exact = [i for i, b in enumerate(self.budgets) if b == 0]
        loose = [i for i, b in enumerate(self.budgets) if b == 1]
        free = combinations(loose, max(len(loose) - 1, 0))
        #: Segments, counted from a chain's start, that agree; one tuple per choice.
        self.choices = [tuple(exact) + rest for rest in free]

    def mask(self, parts) -> int:
        return sum(((1 << self.width) - 1) << (self.width * p) for p in parts)


def rotated(fp: Column, bits: int) -> Column:
    if bits == 0:
        return fp
    return F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def links(distinct: DataFrame, max_bits: int = 3, segments: int = 8, hot_key: int = HOT_KEY) -> DataFrame:
    """Distinct ``fp`` values -> links (a, b), enough to connect all that differ in ``max_bits`` bits or fewer."""
    ring = Ring(max_bits, segments)
    entries = []
    for start in range(segments):
        turned = rotated(F.col("fp"), start * ring.width)
        for c, parts in enumerate(ring.choices):
            entries.append(F.struct(F.lit(start * len(ring.choices) + c).alias("tag"), F.lit(c).alias("choice"),
                                    turned.alias("turned"),
                                    turned.bitwiseAND(F.lit(_signed(ring.mask(parts)))).alias("key")))
    keyed = distinct.select("fp", F.inline(F.array(*entries)))
    shared = checkpointed(keyed.groupBy("tag", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = keyed.drop("choice").join(shared.filter(F.col("n") <= hot_key).drop("n"), ["tag", "key"])
    other = met.select("tag", "key", F.col("fp").alias("fp2"), F.col("turned").alias("turned2"))
    differ = F.col("turned").bitwiseXOR(F.col("turned2"))
    chain = F.col("fp") < F.col("fp2")
    for length, budget in enumerate(ring.budgets, 1):
        chain &= F.bit_count(differ.bitwiseAND(F.lit(_signed(ring.mask(range(length)))))) <= budget
    same_key = (F.col("x.tag") == F.col("y.tag")) & (F.col("x.key") == F.col("y.key"))
    pairs = met.alias("x").join(other.alias("y"), same_key & chain)
    pairs = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
    found = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    hot = shared.filter(F.col("n") > hot_key).drop("n")
    if hot.isEmpty():
        return found.distinct()
    return found.union(hot_links(keyed.join(hot, ["tag", "key"]), ring, max_bits)).distinct()


def hot_links(members: DataFrame, ring: Ring, max_bits: int) -> DataFrame:
    """Star links inside crowded keys: members that agree outside some ``max_bits`` of the free bits are a class."""
    masks = []
    for parts in ring.choices:
        fixed = ring.mask(parts)
        free = [b for b in range(64) if not fixed >> b & 1]
        masks.append(F.array(*[F.lit(_signed(~sum(1 << b for b in some) & (1 << 64) - 1))
                               for some in combinations(free, min(max_bits, len(free)))]))
    chosen = F.get(F.array(*masks), F.col("choice"))
    rows = members.select("tag", "fp", "turned", F.posexplode(chosen).alias("m", "mask"))
    rows = rows.select("tag", "m", F.col("turned").bitwiseAND(F.col("mask")).alias("class"), "fp")
    least = rows.groupBy("tag", "m", "class").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(least, ["tag", "m", "class"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")


# ------------------------------------------------------------------ operator
def classes(rows: DataFrame, max_bits: int, segments: int, hot_key: int) -> DataFrame:
    """(fp, component) per distinct fingerprint of ``rows`` (doc, fp)."""
    nodes = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    groups = components(links(nodes.select("fp"), max_bits, segments, hot_key))
    labelled = nodes.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    names = labelled.groupBy("label").agg(F.min("least").alias("component"))
    return labelled.join(names, "label").select("fp", "component")


def near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = 3, segments: int = 8, id_col: str = "doc_id",
                    text_col: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """(doc, key, fp, component) per row; component is the smallest document id reachable over links."""
    rows = checkpointed(fingerprints(docs, k, id_col, text_col))
    return rows.join(classes(rows, max_bits, segments, hot_key), "fp").select("doc", "key", "fp", "component")


def drop_near_duplicates(docs: DataFrame, k: int = 3, max_bits: int = 3, segments: int = 8, id_col: str = "doc_id",
                         text_col: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest (id, text key), nulls last.

    Rows that agree in id and text are one document; of those any one stays.
    """
    rows = checkpointed(fingerprints(docs, k, id_col, text_col))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "key")
    # The first row of each fingerprint, found before the join: copies in any number are one row there.
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    best = classes(rows, max_bits, segments, hot_key).join(first, "fp")
    # A component whose rows all have null ids has no smallest id; such components are told apart by fingerprint.
    best = best.groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("alone")).agg(F.min("first").alias("first"))
    own_doc, own_key = own_names(docs, "doc", "key")
    chosen = best.select(F.col("first.doc").alias(own_doc), F.col("first.key").alias(own_key)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(own_doc)) & (text_key(F.col(text_col)) == F.col(own_key))
    return docs.join(chosen, same).dropDuplicates([own_doc, own_key]).select(*[f"`{c}`" for c in docs.columns])
