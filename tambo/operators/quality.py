"""Survey validation (P3-P7): required fields, analysis price, quality rules.

Everything is a narrow, row-local projection or filter: no shuffle, all inside
whole-stage codegen, and the counts of P6 are a single partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.functions.parsing import finite


def require_fields(df: DataFrame) -> DataFrame:
    """Drop rows without fecha or producto; trim producto."""
    return (df.filter(F.col("fecha").isNotNull() & F.col("producto").isNotNull())
              .withColumn("producto", F.trim(F.col("producto"))))


def add_analysis_price(df: DataFrame) -> DataFrame:
    """precio_mayorista / precio_minorista / precio_analisis / tipo_precio."""
    return df.withColumns({
        "precio_mayorista": F.col("may_prom"),
        "precio_minorista": F.col("min_prom"),
        "precio_analisis": F.coalesce(F.col("min_prom"), F.col("may_prom")),
        "tipo_precio": F.when(F.col("min_prom").isNotNull(), F.lit(S.RETAIL)).otherwise(F.lit(S.WHOLESALE)),
    })


def add_quality_flags(df: DataFrame) -> DataFrame:
    """error = concatenated messages, estado OK/ERROR (P5)."""
    bad_name = F.length(F.col("producto")) < 3
    bad_price = F.col("precio_analisis").isNull() | (F.col("precio_analisis") <= 0)
    error = F.concat(
        F.when(bad_name, F.lit(S.MSG_BAD_NAME)).otherwise(F.lit("")),
        F.when(bad_price, F.lit(S.MSG_NO_PRICE)).otherwise(F.lit("")),
    )
    return (df.withColumn("error", error)
              .withColumn("estado", F.when(F.col("error") != "", F.lit(S.STATUS_ERROR))
                          .otherwise(F.lit(S.STATUS_OK))))


def validate(df: DataFrame) -> DataFrame:
    """Typed wide survey -> validated survey (P3 + P4 + P5)."""
    return add_quality_flags(add_analysis_price(require_fields(df)))


def ok_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("estado") == S.STATUS_OK)


def error_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("estado") == S.STATUS_ERROR)


def quality_counts(validated: DataFrame) -> DataFrame:
    """One row: registros_leidos, registros_validos, registros_rechazados."""
    return validated.agg(
        F.count(F.lit(1)).alias("registros_leidos"),
        F.count_if(F.col("estado") == S.STATUS_OK).alias("registros_validos"),
        F.count_if(F.col("estado") == S.STATUS_ERROR).alias("registros_rechazados"),
    )


def null_skipping_mean(*cols) -> F.Column:
    """Row-wise mean of the non-null arguments; null when all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols), F.lit(0))
    return F.when(count > 0, total / count)


def etl_row_metrics(df: DataFrame) -> DataFrame:
    """precio_unitario, diferencia_precio, variacion_precio per survey row."""
    may, mn = F.col("precio_mayorista"), F.col("precio_minorista")
    range_may = F.col("may_max") - F.col("may_min")
    range_min = F.col("min_max") - F.col("min_min")
    return df.withColumns({
        "precio_unitario": finite(null_skipping_mean(may, mn)),
        "diferencia_precio": finite(mn - may),
        "variacion_precio": finite(null_skipping_mean(range_may, range_min)),
    })
