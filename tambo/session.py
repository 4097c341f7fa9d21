"""SparkSession helpers.

The checkpoint folder is read from ``spark.checkpoint.dir``, which a cluster
sets to a shared location.  When it is unset, a private temporary folder is
used in local mode only; on a cluster that is an error, because executors could
not read what the driver's own disk holds.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tambo") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, ANSI kept on."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session; the context's own folder is set to it when it has none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tambo-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub folder of the checkpoint folder (never reused, never cleared)."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once, written as parquet to a fresh scratch folder and read back.

    For rows that several jobs read: each reads its own columns of fixed, splittable files instead of computing all rows again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
