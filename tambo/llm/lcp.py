"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, the phrases into longer phrases,
and so on for ``LEVELS`` rounds.  One round:

1. a run of one symbol becomes one symbol (its name hashes symbol and length),
   so neighbours differ;
2. deterministic coin tossing: each symbol is labelled with the lowest bit in
   which it differs from the symbol before it (position and value); labels of
   neighbours differ again, and a few repeats leave labels below 6;
3. a phrase begins at every local maximum of the labels; its name hashes its
   symbols in order.

A boundary depends on a few neighbouring symbols only, so equal substrings have
equal phrases except near their ends, at whatever offset they stand.

The fingerprint is the bottom-``SKETCH`` sketch of the names of the last round:
its smallest distinct 32-bit values, as sorted hex.  The likeness of two
fingerprints is the share of the smallest values of their union that both hold,
an estimate of the Jaccard likeness of the phrase sets (exact when both texts
have at most ``SKETCH`` phrases).

``edited`` gives each row the text it would have if its last third were
overwritten by the beginning of the next document (descending id).  Rows are
dealt to ranges of ids and sorted there; each range also gets a copy of the
first row of the next one, so no row is far from its neighbour and texts are
shuffled once.

Defined results: null counts as empty; an empty text has the empty fingerprint,
of likeness 1 to another empty one and 0 to any other; equal texts have equal
fingerprints; rows of one id are ordered by a hash of their text, identical
rows are interchangeable; null ids come last; a single row is its own next
document; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import like_type

LEVELS = 3
SKETCH = 64
#: Bytes parsed at a time, about (a longer text is parsed whole): bounds memory.
BLOCK_BYTES = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE_NAMES = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))


def toss(previous: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Twice the lowest differing bit's position, plus that bit of the current symbol."""
    differ = previous ^ current
    bit = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    return (bit * 2 + ((current >> bit.astype(current.dtype)) & current.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def _table(size: int) -> np.ndarray:
    """toss() of every pair of labels below ``size``; equal labels do not occur next to each other."""
    label = np.arange(size, dtype=np.uint8)
    out = toss(np.repeat(label, size), np.tile(label, size)).reshape(size, size)
    out[label, label] = 0
    return out


FROM_256, FROM_128, FROM_16, FROM_8 = _table(256), _table(128), _table(16), _table(8)
with np.errstate(over="ignore"):
    #: Added to a symbol by its place in a phrase; labels below 6 keep phrases shorter than this.
    STEPS = (np.arange(64, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15)


def _again(labels: np.ndarray, heads: np.ndarray, table: np.ndarray) -> np.ndarray:
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[heads] = labels[heads] ^ 1
    return table[before, labels]


def phrases(names: np.ndarray, heads: np.ndarray, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One round over several texts: symbol names and each text's first index -> the same of the phrases.

    Every text has at least one symbol.  ``symbols`` may give the symbols in a
    narrower type, to be tossed in place of their names.
    """
    symbols = names if symbols is None else symbols
    first = np.empty(len(names), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
    first[heads] = True
    if not first.all():
        at = np.flatnonzero(first)
        length = np.diff(at, append=len(names))
        heads = np.searchsorted(at, heads)
        names, symbols = names[at], symbols[at]
        runs = np.flatnonzero(length > 1)
        names[runs] = mix(names[runs] ^ mix(length[runs].astype(U)))
        if symbols.dtype == U:
            symbols = names
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[heads] = symbols[heads] ^ symbols.dtype.type(1)
    labels = FROM_256[before, symbols] if symbols.dtype == np.uint8 else _again(toss(before, symbols), heads, FROM_128)
    labels = _again(_again(labels, heads, FROM_16), heads, FROM_8)
    top = np.empty(len(names), bool)
    np.greater(labels[1:], labels[:-1], out=top[1:])
    top[:-1] &= labels[:-1] > labels[1:]
    top[heads[1:] - 1] = False                  # the last symbol of a text has none after it
    top[-1] = False
    top[heads] = True
    starts = np.flatnonzero(top)
    length = np.diff(starts, append=len(names))
    offset = np.arange(len(names)) - np.repeat(starts, length)
    named = np.add.reduceat(mix(names + STEPS.take(offset, mode="clip")), starts)
    return mix(named ^ length.astype(U)), np.searchsorted(starts, heads)


def sketches(texts: list[bytes], levels: int = LEVELS, size: int = SKETCH) -> list[np.ndarray]:
    """Smallest distinct 32-bit phrase names of each text, sorted; empty for an empty text."""
    out = [np.empty(0, np.uint32)] * len(texts)
    filled = [i for i, t in enumerate(texts) if t]
    lo = 0
    while lo < len(filled):
        hi, room = lo, BLOCK_BYTES
        while hi < len(filled) and (hi == lo or room >= len(texts[filled[hi]])):
            room -= len(texts[filled[hi]])
            hi += 1
        group = [texts[i] for i in filled[lo:hi]]
        symbols = np.frombuffer(b"".join(group), np.uint8)
        names = BYTE_NAMES[symbols]
        heads = np.cumsum([0] + [len(t) for t in group[:-1]])
        with np.errstate(over="ignore"):
            for level in range(levels):
                names, heads = phrases(names, heads, None if level else symbols)
        names = (names >> U(32)).astype(np.uint32)
        for i, part in zip(filled[lo:hi], np.split(names, heads[1:])):
            out[i] = np.unique(part)[:size]
        lo = hi
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    if not len(a) and not len(b):
        return 1.0
    one, two = set(a.tolist()), set(b.tolist())
    least = sorted(one | two)[:size]
    return sum(x in one and x in two for x in least) / len(least)


def fingerprints(docs: DataFrame, levels: int = LEVELS, size: int = SKETCH, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc, fingerprint) per row."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_text(s) for s in sketches([t or b"" for t in batch.column(1).to_pylist()], levels, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc", "fingerprint"])

    return rows.mapInArrow(run, f"doc {like_type(rows, 'doc')}, fingerprint string")


# ------------------------------------------------------------------ edited texts
def id_ranges(docs: DataFrame, ranges: int, id_col: str) -> list:
    """Upper bounds of ranges of ids (ascending), about equal in rows.  Any bounds give the same result."""
    shares = [i / ranges for i in range(1, ranges)]
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    bounds = ids.agg(F.percentile_approx("id", F.array(*[F.lit(s) for s in shares]) if shares else F.lit(0.5), 10_000)
                     .alias("b")).first()["b"]
    return sorted(set(bounds if isinstance(bounds, list) else [bounds] if bounds is not None else []))


def with_next(docs: DataFrame, ranges: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, head, doc, tie, text) in ranges: each range, in descending order of ids, ends with a copy (``head`` = 1)
    of the first row of the range after it, the last range with a copy of the first row of all."""
    bounds = id_ranges(docs, ranges, id_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    above = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("doc").cast("long")))
    ranged = rows.withColumn("range", F.when(F.col("doc").isNull(), -1).otherwise(above))
    first = F.max(F.struct(F.col("doc").isNotNull().alias("some"), "doc", "tie")).alias("first")
    tops = [(r["range"], r["first"]["doc"], r["first"]["tie"]) for r in
            ranged.select("range", "doc", "tie").groupBy("range").agg(first).orderBy(F.desc("range")).collect()]
    # At most ranges + 1 rows; their texts stay on the executors.
    to = [(tops[i - 1][0], doc, tie) for i, (_, doc, tie) in enumerate(tops)]
    if not to:
        return ranged.select("range", F.lit(0).alias("head"), "doc", "tie", "text")
    heads = docs.sparkSession.createDataFrame(to, f"to_range int, doc2 {like_type(rows, 'doc')}, tie2 bigint")
    heads = ranged.join(F.broadcast(heads), F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("tie") == F.col("tie2")))
    heads = heads.dropDuplicates(["to_range"]).select(F.col("to_range").alias("range"), F.lit(1).alias("head"), "doc", "tie", "text")
    return ranged.select("range", F.lit(0).alias("head"), "doc", "tie", "text").union(heads)


def edited_likeness(docs: DataFrame, levels: int = LEVELS, size: int = SKETCH, rows_per_range: int = 20_000,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ranges = max(12, -(-docs.count() // rows_per_range))
    rows = with_next(docs, ranges, id_col, text_col)
    # One range a partition: hashed, several would meet in one.
    placed = (rows.repartitionById(ranges + 1, (F.col("range") + 1).cast("int"))
                  .sortWithinPartitions(F.desc("range"), "head", F.col("doc").desc_nulls_last(), F.desc("tie"))
                  .select("range", "head", "doc", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                                                     # (doc, text, sketch) that waits for its next row
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                head, doc = part.column(1).to_pylist(), part.column(2).to_pylist()
                text = part.column(3).to_pylist()
                own = sketches([t.encode() for t in text], levels, size)
                out = []
                for h, d, t, s in zip(head, doc, text, own):
                    if last is not None:
                        out.append((*last, t, s))
                    last = None if h else (d, t, s)
                changed = [edit(t, following) for _, t, _, following, _ in out]
                raw = [t.encode() for t in changed]
                prints = sketches(raw, levels, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], batch.column(2).type),
                    pa.array([len(o[1]) for o in out], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                    pa.array([as_text(o[2]) for o in out], pa.string()),
                    pa.array([as_text(s) for s in prints], pa.string()),
                    pa.array([likeness(o[2], s, size) for o, s in zip(out, prints)], pa.float64()),
                    pa.array([likeness(o[2], o[4], size) for o in out], pa.float64()),
                ], ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.mapInArrow(run, f"doc {like_type(placed, 'doc')}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The last floor(n / 3) code points replaced by the first as many (or all) of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]
