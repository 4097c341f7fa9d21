"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. The rows are fixed in their partitions (checkpoint) and counted per partition.
2. How many rows each partition sends to each shard is drawn at once: rows of
   the matrix sum to the partition counts, columns to the shard sizes (at most
   one apart), and its law is that of a uniform permutation (a chain of
   hypergeometric draws).  The matrix has partitions x shards entries.
3. Each partition is put in random order; position against the running sums of
   its matrix row names the shard.
4. Rows are exchanged and permuted again: inside a shard a row falls into one of
   several random buckets (their number grows with the shard), is ordered by a
   random key there, and its slot is the bucket's offset plus its position.

The keys are hashes of (seed, partition, position), so retried tasks repeat them.

Defined results: every input row gets exactly one shard and slot, repeated rows
one each; slots of a shard run from 0 without gaps; an empty table gives no
rows; fewer rows than shards leave the last shards empty; null columns are
carried along, whatever the columns' names.  The columns added are ``shard`` and
``slot``; input columns of those two names are an error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed, own_names

#: Rows of one random bucket of a shard, about: what one task orders.
BUCKET_ROWS = 100_000
#: numpy draws hypergeometrics of populations below this size only.
NUMPY_LIMIT = 1_000_000_000
#: Matrix entries up to which it is broadcast (8 bytes each).
MAX_BROADCAST_CELLS = 2_000_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good items in ``sample`` draws without replacement, for populations of any size.

    Beyond numpy's limit: ratio of uniforms over the log-gamma form of the law.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))

    def log_p(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    mode = min(max((good + 1) * (sample + 1) // (total + 2), low), high)
    centre = sample * good / total + 0.5
    spread = math.sqrt(max(sample * (good / total) * (bad / total) * (total - sample) / (total - 1), 0.0) + 0.5)
    width, top = 1.7155277699214135 * spread + 0.8989161620588988, log_p(mode)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u)
        if low <= k <= high and 2.0 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows per (partition, shard) of a uniform permutation: exact row and column sums."""
    rng = np.random.default_rng(seed)
    left = shard_sizes(sum(counts), shards)
    out = []
    for count in counts:
        row, need, pool = [], count, sum(left)
        for s in range(shards):
            pool -= left[s]
            take = hypergeometric(rng, left[s], pool, need)
            row.append(take)
            need -= take
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 to the shard's size - 1)."""
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    spark = df.sparkSession
    fixed = checkpointed(df)
    pid, sums_of, at, draw, pos, bucket, before_it, place = own_names(df, "pid", "sums", "at", "draw", "pos", "bucket", "before", "place")
    counts = {r["pid"]: r["count"] for r in fixed.groupBy(F.spark_partition_id().alias("pid")).count().collect()}
    pids = sorted(counts)
    matrix = communication_matrix([counts[p] for p in pids], shards, seed)
    sums = [(p, np.cumsum(row).tolist()) for p, row in zip(pids, matrix)]
    lookup = spark.createDataFrame(sums, f"`{pid}` int, `{sums_of}` array<bigint>")
    lookup = F.broadcast(lookup) if len(pids) * shards <= MAX_BROADCAST_CELLS else lookup

    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keyed = fixed.withColumns({pid: F.spark_partition_id(), at: in_partition})
    keyed = keyed.withColumn(draw, F.xxhash64(F.lit(seed), pid, at))
    placed = keyed.sortWithinPartitions(draw, at).withColumn(pos, in_partition)
    sent = placed.join(lookup, pid).withColumn("shard", F.size(F.filter(sums_of, lambda s: s <= F.col(pos))))

    buckets = max(1, math.ceil(max(shard_sizes(sum(counts.values()), shards), default=0) / BUCKET_ROWS))
    sent = sent.withColumn(draw, F.xxhash64(F.lit(seed + 1), pid, at)).withColumn(bucket, F.pmod(F.col(draw), F.lit(buckets)))
    sizes = sent.groupBy("shard", bucket).agg(F.count("*").alias(place))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", bucket, F.coalesce(F.sum(place).over(before), F.lit(0)).alias(before_it))
    inside = Window.partitionBy("shard", bucket).orderBy(draw, pid, at)
    ranked = sent.withColumn(place, F.row_number().over(inside)).join(offsets, ["shard", bucket])
    return ranked.select(*[f"`{c}`" for c in df.columns], "shard", (F.col(before_it) + F.col(place) - 1).alias("slot"))
