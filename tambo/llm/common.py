"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tambo.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, fixed in the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    """64-bit key of a nullable text; null and empty differ."""
    return F.xxhash64(text.isNull(), text)


def like_type(df: DataFrame, column: str) -> str:
    """The SQL type of a column, for schemas of mapInArrow results."""
    return df.schema[column].dataType.simpleString()


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores at its end as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
