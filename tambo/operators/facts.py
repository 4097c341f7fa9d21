"""Channel unpivot: one validated survey row -> 0..2 price facts.

The two channels are packed into an array of two structs and inlined: a
narrow per-row expansion (Generate) that stays in the same stage as the scan,
with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.functions.columns import unit_or_default


def _channel_struct(channel: str, normalise: bool) -> F.Column:
    unit, equiv, pmin, pprom, pmax = S.CHANNEL_COLUMNS[channel]
    e = F.col(equiv)
    if normalise:
        e = F.when(e.isNull() | (e <= 0), F.lit(1.0)).otherwise(e)
        lo, mid, hi = F.col(pmin) / e, F.col(pprom) / e, F.col(pmax) / e
    else:
        lo, mid, hi = F.col(pmin), F.col(pprom), F.col(pmax)
    return F.struct(
        F.lit(channel).alias("tipo_venta"),
        unit_or_default(F.col(unit)).alias("unidad"),
        e.cast("double").alias("equivalencia"),
        lo.cast("double").alias("precio_min"),
        mid.cast("double").alias("precio_prom"),
        hi.cast("double").alias("precio_max"),
    )


def unpivot_channels(validated_ok: DataFrame, normalise: bool = True) -> DataFrame:
    """Price facts from OK survey rows.

    normalise=True  divides prices by the unit equivalence (null/<=0 -> 1.0) (P10)
    normalise=False keeps prices and the raw equivalence as surveyed (P9)
    A channel whose average price is null yields no fact; variacion_precio is
    max - min, null when either end is null (P12).
    """
    packed = validated_ok.filter(F.col("fecha").isNotNull() & (F.col("producto") != "")).select(
        F.col("fecha").cast("date").alias("fecha"),
        F.col("producto"),
        F.inline(F.array(_channel_struct(S.WHOLESALE, normalise), _channel_struct(S.RETAIL, normalise))),
    )
    return (packed.filter(F.col("precio_prom").isNotNull())
                  .withColumn("variacion_precio", F.col("precio_max") - F.col("precio_min")))


def to_semantic(facts: DataFrame) -> DataFrame:
    """Name facts as semantic rows (in-session source of the analytics, S7)."""
    return facts.withColumnsRenamed({
        "precio_min": "precio_minimo",
        "precio_prom": "precio_promedio",
        "precio_max": "precio_maximo",
    })
