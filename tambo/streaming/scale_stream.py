"""Continuous scale-sales feed (B5) with Structured Streaming.

Sales arrive as files (parquet or CSV) in an input folder.  Each micro-batch
is handled by ``foreachBatch``:

1. deduplicate the batch by ``event_id`` and drop sales already stored
   (anti join against the raw store, touched days only), then append the new
   sales to the raw store, partitioned by sale day.  A sale without an id is
   known by its content (time, market, channel, product, weight, price), so
   equal ones without an id are one sale;
2. find the touched (day, product) groups and recompute their survey rows
   from *all* stored sales of those groups (the k-th wholesale + k-th retail
   pairing of ``tambo.operators.scale``);
3. replace the touched days of the sales table: rows of untouched groups of
   those days are kept, touched groups are replaced whole (a late sale that is
   earlier than the others changes the row time, so a key upsert would leave
   the old key behind), using dynamic partition overwrite.

The same day rule of the application ("same calendar day") is kept by whole
day recomputation, so late data needs no watermark or state store.  Replaying
a batch is idempotent: stored sales are skipped, the batch's groups are always
recomputed and give the same rows, so a batch that failed between the two
writes is completed by its replay.  New content is checkpointed before any overwrite, so no job reads
the files it replaces.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tambo import schemas as S
from tambo.operators import scale as B
from tambo.session import checkpoint_dir

ROW_COLUMNS = [*B.PAIR_COLUMNS, "creado_ts", "creado_id"]


CONTENT = ["ts", "mercado", "canal", "producto", "peso", "precio"]


def with_sale_key(sales: DataFrame) -> DataFrame:
    """``_sale``: the event id, or for a sale without one its content."""
    content = F.sha2(F.to_json(F.struct(*CONTENT)), 256)
    return sales.withColumn("_sale", F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("sha256 "), content)))


class ScaleSalesSink:
    """foreachBatch handler maintaining ``<root>/raw`` and ``<root>/ventas``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.raw_path = os.path.join(root, "raw")
        self.table_path = os.path.join(root, "ventas")
        checkpoint_dir(spark)

    def _read(self, path: str, schema: str) -> DataFrame:
        """The stored table, or an empty frame before the first write (any file system)."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def raw(self) -> DataFrame:
        return self._read(self.raw_path, "event_id long, ts timestamp, mercado string, canal string, "
                                         "producto string, peso double, precio double, dia date")

    def table(self) -> DataFrame:
        schema = ("fecha timestamp, producto string, unidad_may string, equiv_may double, may_min double, "
                  "may_prom double, may_max double, unidad_min string, equiv_min double, min_min double, "
                  "min_prom double, min_max double, creado_ts timestamp, creado_id long, dia date")
        return self._read(self.table_path, schema)

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        cat = B.catalogue(self.spark)
        sales = with_sale_key(batch).dropDuplicates(["_sale"]).withColumn("dia", F.to_date("ts")).checkpoint(eager=True)
        # Days of one batch: bounded by the calendar.  As literals they prune the stores' partitions.
        days = [r["dia"] for r in sales.select("dia").distinct().collect()]
        if not days:
            return
        touched = F.col("dia").isin([d for d in days if d is not None]) | F.col("dia").isNull()
        stored = self.raw().filter(touched)
        new = sales.join(with_sale_key(stored).select("_sale"), "_sale", "left_anti").checkpoint(eager=True)
        if not new.isEmpty():
            new.drop("_sale").write.mode("append").partitionBy("dia").parquet(self.raw_path)

        # Groups of the whole batch, not of its new sales: a batch that failed after the append is made good.
        groups = sales.select("dia", "producto").distinct()
        group_sales = self.raw().filter(touched).join(groups, ["dia", "producto"], "left_semi").drop("dia")
        fresh = B.scale_pair_sales(group_sales, cat).withColumn("dia", F.to_date("creado_ts"))
        kept = self.table().filter(touched).join(groups, ["dia", "producto"], "left_anti")
        out = kept.select(*ROW_COLUMNS, "dia").unionByName(fresh.select(*ROW_COLUMNS, "dia")) \
                  .checkpoint(eager=True)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("dia").parquet(self.table_path))


def start_scale_stream(spark: SparkSession, input_dir: str, root: str, checkpoint_location: str,
                       fmt: str = "parquet", available_now: bool = True):
    """Start the feed: file source -> foreachBatch(ScaleSalesSink)."""
    reader = spark.readStream.schema(S.SCALE_SALE_SCHEMA)
    src = reader.parquet(input_dir) if fmt == "parquet" else reader.option("header", True).csv(input_dir)
    writer = src.writeStream.foreachBatch(ScaleSalesSink(spark, root)) \
                .option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def current_sales_table(spark: SparkSession, root: str) -> DataFrame:
    """The upserted sales table: latest version per (fecha, producto) (W6 over the stream's rows)."""
    return B.latest_per_key(ScaleSalesSink(spark, root).table())
