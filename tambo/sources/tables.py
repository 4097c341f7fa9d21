"""Reading the driver tables (parquet) with column pruning left to Catalyst."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fact_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A row-heavy input as it is stored.

    With the session option ``spark.tambo.spreadScans`` set to true (off by
    default) its rows are dealt round-robin over the cores, for inputs whose
    files cannot be split.
    """
    df = table(spark, sf_dir, name)
    if spark.conf.get("spark.tambo.spreadScans", "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
