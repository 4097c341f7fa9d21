"""Consecutive ids for the rows of a frame, without a global window.

The rows are stored once, each with its partition and place, so that recomputation
after a lost executor cannot renumber them; a row's id is its partition's
offset plus its place in the partition.  The store is parquet: the count and
all later readers take the columns they need.  Only one count per partition (and
group) reaches the driver; the offsets are joined back as a frame of that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tambo.session import stored_once


def numbered(rows: DataFrame, id_col: str, after: int) -> DataFrame:
    """``rows`` with ids ``after`` + 1, ``after`` + 2, ... in partition order, whatever the number of partitions.

    Sorted rows keep their order in the ids; empty input gives no rows.
    """
    one = rows.withColumn("_group", F.lit(0))
    return _with_ids(one, "_group", id_col, {0: after}).select(id_col, *rows.columns)


def numbered_within(rows: DataFrame, group: str, order: list[str], id_col: str, after: dict) -> DataFrame:
    """``rows`` with ids that run on within each value of ``group``, in ``order``, behind ``after`` of that value (or 0).

    One sort and one store serve all groups.
    """
    return _with_ids(rows.orderBy(group, *order), group, id_col, after).select(id_col, *rows.columns)


def ranked(rows: DataFrame, order: list[Column], rank_col: str) -> DataFrame:
    """``rows`` with their places 1, 2, ... in ``order``, which should leave no ties: a range exchange and the partitions'
    offsets instead of a window that takes all rows into one task."""
    return numbered(rows.orderBy(*order), rank_col, 0).select(*rows.columns, rank_col)


def _with_ids(rows: DataFrame, group: str, id_col: str, after: dict) -> DataFrame:
    """Rows of one group must stand together within each partition."""
    spark = rows.sparkSession
    fixed = stored_once(rows.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    tagged = fixed.withColumns({"_pid": F.shiftright("_place", 33).cast("int"),
                                "_at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = tagged.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()
    starts, given = [], dict(after)
    for r in sorted(parts, key=lambda r: r["_pid"]):
        last = given.get(r[group], 0)
        starts.append((r[group], r["_pid"], last + 1 - r["first"]))
        given[r[group]] = last + r["n"]
    kind = fixed.schema[group].dataType.simpleString()
    offsets = spark.createDataFrame(starts, f"{group} {kind}, _pid int, _start long")      # a row per partition and group
    return tagged.join(F.broadcast(offsets), [group, "_pid"]).withColumn(id_col, F.col("_start") + F.col("_at"))
