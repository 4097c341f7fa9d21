"""Registered queries: one per operator row of the survey inventory.

Each entry takes (spark, sf_dir) and returns a DataFrame built from the driver
tables.  ``finish`` gives every output the same comparable shape as its DuckDB
oracle: doubles rounded to 4 dp, integers as long, decimals as double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tambo.operators import facts as FX
from tambo.operators import metrics as M
from tambo.operators import quality as Q
from tambo.sources import fixtures as FIX

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
RAW: dict[str, Query] = {}          # the same queries without the comparison rounding (bench)


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # 6 dp first: last-bit differences of reordered sums cannot flip a 4-dp tie.
            c = F.round(F.round(c.cast("double"), 6), 4)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        RAW[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ shared stages
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate(FIX.wide_survey(spark, sf_dir))


def facts_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.unpivot_channels(Q.ok_rows(validated(spark, sf_dir)), normalise=True)


def facts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.unpivot_channels(Q.ok_rows(validated(spark, sf_dir)), normalise=False)


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.to_semantic(facts_normalised(spark, sf_dir))


# ------------------------------------------------------------------ metrics
@register("top10_products")
def q_top10_products(spark, sf_dir):
    return M.top_products(semantic(spark, sf_dir), 10)


def queries() -> dict[str, Query]:
    from tambo import registry_more  # noqa: F401  (registers the remaining keys)
    return dict(REGISTRY)
