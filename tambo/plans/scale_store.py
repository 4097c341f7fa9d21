"""The scale's survey rows as a stored table with upsert on (fecha, producto).

Rows are kept in ``buckets`` directories by a hash of the key, so a product that holds a third of all rows is spread by
its times.  An upsert reads and rewrites the buckets that its rows fall into and no other; the rewritten buckets and the
untouched ones become the next committed state together (``tambo.plans.manifest``), so a failed upsert changes nothing
and of two at the same time one raises ``Conflict``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tambo.operators import scale as B
from tambo.plans import manifest
from tambo.session import checkpoint_dir

TABLE = "ventas_balanza"
#: Entries of the state beside the buckets: how many there are, and the largest id given so far.
BUCKETS, LAST_ID = f"{TABLE}.cubos", f"{TABLE}.id"
SCHEMA = ("id long, fecha timestamp, producto string, unidad_may string, equiv_may double, may_min double, may_prom double, "
          "may_max double, unidad_min string, equiv_min double, min_min double, min_prom double, min_max double, created_at timestamp")


def _entry(bucket: int) -> str:
    return f"{TABLE}/{bucket}"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("fecha", "producto"), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, state: manifest.State, buckets: list[int]) -> DataFrame:
    found = [os.path.join(root, TABLE, d) for b in buckets for d in state.get(_entry(b), [])]
    return spark.read.schema(SCHEMA).parquet(*found) if found else spark.createDataFrame([], SCHEMA)


def upsert_stored(spark: SparkSession, root: str, incoming: DataFrame, buckets: int = 16) -> int:
    """Upserts sale rows (``scale.scale_pair_sales``) into the stored table; the number of the committed state.

    ``buckets`` counts for a new table only.  Rows whose key is null in part share a bucket and are never equal to others.
    """
    checkpoint_dir(spark)
    base = manifest.newest(spark, root)
    state = manifest.state_of(spark, root, base)
    buckets = int(state[BUCKETS][0]) if BUCKETS in state else buckets
    last = int(state[LAST_ID][0]) if LAST_ID in state else 0
    fresh = B.latest_per_key(incoming).withColumn("cubo", _bucket(buckets)).checkpoint(eager=True)
    touched = sorted(r["cubo"] for r in fresh.select("cubo").distinct().collect())       # at most ``buckets`` rows
    if not touched:
        return base
    merged = B.scale_upsert(_read(spark, root, state, touched), fresh.drop("cubo"), after=last)
    name = manifest.new_name("carga")
    path = os.path.join(root, TABLE, name)
    (merged.withColumn("cubo", _bucket(buckets)).repartition(len(touched), "cubo")
           .write.mode("errorifexists").partitionBy("cubo").parquet(path))
    given = spark.read.parquet(path).agg(F.max("id")).first()[0]
    state |= {_entry(b): [f"{name}/cubo={b}"] for b in touched}
    state |= {BUCKETS: [str(buckets)], LAST_ID: [str(max(last, given))]}
    return manifest.commit(spark, root, base, state)


def read_stored(spark: SparkSession, root: str) -> DataFrame:
    """The whole stored table."""
    state = manifest.state_of(spark, root, manifest.newest(spark, root))
    return _read(spark, root, state, list(range(int(state[BUCKETS][0]) if BUCKETS in state else 0)))
