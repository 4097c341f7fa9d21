"""Survey-shaped inputs derived from the driver tables.

``W`` (typed wide survey) and ``X`` (the same survey as text, with header-like
rows and non-numeric price text) come from ``lineitem`` joined to ``part``;
``E`` (scale sales) comes from ``events``.  Each expression is plain SQL so the
DuckDB oracle repeats it as a CTE.  The join is left to the optimizer: AQE
broadcasts ``part`` only when its runtime size is under the threshold,
otherwise it shuffles both sides on the part key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.sources.tables import fact_table, table


def wide_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture W: one typed 12-column survey row per line item (+ hoja_origen)."""
    li = fact_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    line, flag, qty = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity")
    may_prom = F.when((flag == "R") | ((flag == "A") & (line == 7)), F.lit(None).cast("double")) \
        .otherwise(F.col("l_extendedprice"))
    min_prom = (F.when((flag == "A") | ((flag == "R") & (line == 7)), F.lit(None).cast("double"))
                .when((flag == "R") & (qty == 1), F.lit(0.0))
                .otherwise(F.col("p_retailprice")))
    j = j.withColumns({"_may_prom": may_prom, "_min_prom": min_prom})
    return j.select(
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(" ab ")).otherwise(F.col("p_name")).alias("producto"),
        F.when(line == 3, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("unidad_may"),
        F.when(line == 2, F.lit(0.0)).otherwise(qty).alias("equiv_may"),
        F.when(line == 6, F.lit(None).cast("double"))
         .otherwise(F.col("_may_prom") * (1 - F.col("l_discount"))).alias("may_min"),
        F.col("_may_prom").alias("may_prom"),
        (F.col("_may_prom") * (1 + F.col("l_tax"))).alias("may_max"),
        F.lit(S.RETAIL_UNIT).alias("unidad_min"),
        F.lit(1.0).alias("equiv_min"),
        (F.col("_min_prom") * 0.95).alias("min_min"),
        F.col("_min_prom").alias("min_prom"),
        (F.col("_min_prom") * 1.05).alias("min_max"),
        F.col("l_linestatus").alias("hoja_origen"),
        F.col("l_partkey").alias("_partkey"),
        line.alias("_linenumber"),
    )


def text_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture X: W with every survey column as text, as a sheet would deliver it."""
    w = wide_survey(spark, sf_dir)
    as_text = {c: F.col(c).cast("string") for c in S.SURVEY_COLUMNS if c not in ("fecha", "producto")}
    as_text["may_prom"] = F.when(F.col("_linenumber") == 5, F.lit("S/D")) \
        .otherwise(F.col("may_prom").cast("string"))
    as_text["fecha"] = F.when(F.col("_partkey") % 101 == 0, F.lit("Fecha")) \
        .otherwise(F.date_format("fecha", "dd/MM/yyyy"))
    return w.withColumns(as_text).select(*S.SURVEY_COLUMNS, "hoja_origen")


def scale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture E: one scale sale per event."""
    ev = fact_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id",
        "ts",
        F.col("user_id").__mod__(19).cast("string").alias("mercado"),
        F.when(F.col("user_id") % 2 == 0, F.lit(S.WHOLESALE)).otherwise(F.lit(S.RETAIL)).alias("canal"),
        F.col("event_type").alias("producto"),
        ((F.col("event_id") % 76 + 5) / 10.0).alias("peso"),
        F.col("value").alias("precio"),
    )
