"""KPIs, group averages, rankings and record projections.

All aggregates are hash aggregates with map-side partial aggregation, so a hot
product or date is pre-combined per task before the shuffle.  Windows and
global orderings run only over aggregates (per product, per date), never over
fact rows; top-k uses ``orderBy().limit()`` (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.functions.columns import money, stable_round
from tambo.plans.ordinal import ranked


# ----------------------------------------------------------------- KPIs
def kpis_global(sem: DataFrame) -> DataFrame:
    """Four KPIs over semantic rows (A1)."""
    return sem.agg(
        F.avg("precio_promedio").alias("precio_promedio_general"),
        F.max("precio_maximo").alias("precio_maximo_registrado"),
        F.min("precio_minimo").alias("precio_minimo_registrado"),
        F.avg("variacion_precio").alias("variacion_promedio"),
    )


def kpi_product_count(sem: DataFrame) -> DataFrame:
    """Distinct product count (A2)."""
    return sem.agg(F.count_distinct("producto").alias("total_productos_catalogados"))


def kpi_table(sem: DataFrame) -> DataFrame:
    """KPI table rows (A3, U1): one scan, four rows via stack, values numeric(18,2)."""
    return kpi_table_from(kpis_global(sem))


def kpi_table_from(k: DataFrame) -> DataFrame:
    """Four KPI rows from the one-row KPI frame (columns in ``kpis_global`` order)."""
    args = []
    for (name, goal), col in zip(S.KPI_ROWS, k.columns):
        args += [F.lit(name), stable_round(col, 2).cast("decimal(18,2)"), F.lit(goal)]
    rows = k.select(F.stack(F.lit(len(S.KPI_ROWS)), *args).alias("nombre_kpi", "valor", "meta"))
    order = F.array_position(F.array(*[F.lit(n) for n, _ in S.KPI_ROWS]), F.col("nombre_kpi"))
    return rows.select(order.cast("long").alias("kpi_key"), "nombre_kpi", "valor", "meta")


def kpis_filtered(records: DataFrame) -> DataFrame:
    """KPIs over dashboard records; empty selection -> zeros (A16).  Nulls are skipped."""
    return records.agg(
        F.coalesce(F.avg("precio_analisis"), F.lit(0.0)).alias("precio_promedio"),
        F.coalesce(F.max("precio_max"), F.lit(0.0)).alias("precio_maximo"),
        F.coalesce(F.min("precio_min"), F.lit(0.0)).alias("precio_minimo"),
        F.coalesce(F.avg("variacion_precio"), F.lit(0.0)).alias("variacion_promedio"),
    )


def fact_counts(validated: DataFrame) -> DataFrame:
    """Row counts per stage (A17) in one pass: read / valid / rejected survey rows and facts.

    A valid row with a date and a product yields one fact per channel with an average price.
    """
    ok = F.col("estado") == S.STATUS_OK
    yields = ok & F.col("fecha").isNotNull() & (F.col("producto") != "")
    facts = [F.count_if(yields & F.col(average).isNotNull()) for _, _, _, average, _ in S.CHANNEL_COLUMNS.values()]
    return validated.agg(
        F.count(F.lit(1)).alias("registros_leidos"),
        F.count_if(ok).alias("registros_validos"),
        F.count_if(F.col("estado") == S.STATUS_ERROR).alias("registros_rechazados"),
        sum(facts[1:], facts[0]).alias("hechos"))


# ------------------------------------------------------------ group averages
def avg_by(sem: DataFrame, keys: list[str], value: str = "precio_promedio",
           alias: str = "precio_promedio") -> DataFrame:
    """Null-key-dropping group mean (pandas groupby semantics)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return sem.filter(cond).groupBy(*keys).agg(F.avg(value).alias(alias))


def avg_by_product(sem: DataFrame) -> DataFrame:
    return avg_by(sem, ["producto"])


def avg_by_channel(sem: DataFrame) -> DataFrame:
    return avg_by(sem, ["tipo_venta"])


def avg_by_date(sem: DataFrame) -> DataFrame:
    return avg_by(sem, ["fecha"])


def variation_by_date(sem: DataFrame) -> DataFrame:
    return avg_by(sem, ["fecha"], "variacion_precio", "variacion_promedio")


def avg_by_product_date(sem: DataFrame) -> DataFrame:
    return avg_by(sem, ["producto", "fecha"])


def channel_gap_by_date(sem: DataFrame) -> DataFrame:
    """Channel pivot by date; dates with both channels only."""
    p = (sem.filter(F.col("fecha").isNotNull())
            .groupBy("fecha").pivot("tipo_venta", [S.WHOLESALE, S.RETAIL]).avg("precio_promedio")
            .withColumnsRenamed({S.WHOLESALE: "precio_mayorista", S.RETAIL: "precio_minorista"}))
    return (p.filter(F.col("precio_mayorista").isNotNull() & F.col("precio_minorista").isNotNull())
             .withColumn("diferencia", F.col("precio_minorista") - F.col("precio_mayorista")))


def channel_gap_by_date_sql(sem: DataFrame) -> DataFrame:
    """Same by conditional aggregates; every date kept, gap null when a channel is missing."""
    from tambo.functions.columns import days_since_origin
    return sem.groupBy("fecha").agg(
        (F.avg(F.when(F.col("tipo_venta") == S.RETAIL, F.col("precio_promedio")))
         - F.avg(F.when(F.col("tipo_venta") == S.WHOLESALE, F.col("precio_promedio")))).alias("diferencia")
    ).withColumn("x", days_since_origin("fecha"))


def group_average(records: DataFrame, key: str, value: str) -> DataFrame:
    """Generic mean of non-null values by key; blank/null key -> 'Sin datos' (A14)."""
    label = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(S.NO_DATA))
    return (records.filter(F.col(value).isNotNull())
                   .groupBy(label.alias("etiqueta"))
                   .agg(F.avg(value).alias("valor")))


def channel_columns_avg(records: DataFrame) -> DataFrame:
    """Means of the wholesale-only and retail-only record columns, 0 if empty."""
    return records.agg(
        F.coalesce(F.avg("precio_mayorista"), F.lit(0.0)).alias("promedio_mayorista"),
        F.coalesce(F.avg("precio_minorista"), F.lit(0.0)).alias("promedio_minorista"),
    )


# -------------------------------------------------------------------- rankings
def ranking_products(sem: DataFrame) -> DataFrame:
    """Places of the product averages, dearest first, ties by name."""
    return ranked(avg_by_product(sem), [F.desc("precio_promedio"), F.asc("producto")], "ranking")


def top_products(sem: DataFrame, k: int = 10) -> DataFrame:
    """Top-k products by average price (T1) as a distributed TakeOrderedAndProject."""
    top = avg_by_product(sem).orderBy(F.desc("precio_promedio"), F.asc("producto")).limit(k)
    w = Window.orderBy(F.desc("precio_promedio"), F.asc("producto"))
    return top.withColumn("ranking", F.row_number().over(w).cast("long"))


def ranking_detail(sem: DataFrame) -> DataFrame:
    """By (producto, tipo_venta, unidad): min, mean, max, mean range."""
    keys = ["producto", "tipo_venta", "unidad"]
    cond = F.col("producto").isNotNull() & F.col("tipo_venta").isNotNull() & F.col("unidad").isNotNull()
    return sem.filter(cond).groupBy(*keys).agg(
        F.min("precio_minimo").alias("precio_minimo"),
        F.avg("precio_promedio").alias("precio_promedio"),
        F.max("precio_maximo").alias("precio_maximo"),
        F.avg("variacion_precio").alias("variacion_precio"),
    )


def ranking_with_variation(facts: DataFrame, k: int = 10) -> DataFrame:
    """Top-k by mean price with mean range (0 if none), 2 dp."""
    agg = (facts.filter(F.col("producto").isNotNull()).groupBy("producto")
                .agg(F.avg("precio_prom").alias("precio"), F.avg("variacion_precio").alias("variacion")))
    top = agg.orderBy(F.desc("precio"), F.asc("producto")).limit(k)
    w = Window.orderBy(F.desc("precio"), F.asc("producto"))
    return top.select(
        F.row_number().over(w).cast("long").alias("ranking"),
        F.col("producto").alias("mercado"),
        F.lit("Mayorista / Minorista").alias("tipo"),
        stable_round("precio", 2).alias("precio"),
        F.coalesce(stable_round("variacion", 2), F.lit(0.0)).alias("variacion"),
    )


def ranking_channels_seen(records: DataFrame) -> DataFrame:
    """Per product: distinct channels seen, joined by ', ' (A13); channel count is bounded."""
    return (records.filter(F.col("producto").isNotNull())
                   .groupBy("producto")
                   .agg(F.array_join(F.array_sort(F.collect_set("tipo_precio")), ", ").alias("canales")))


def product_frequency(facts: DataFrame, k: int = 10) -> DataFrame:
    """Fact count per product, top k by count."""
    return (facts.filter(F.col("producto").isNotNull()).groupBy("producto")
                 .agg(F.count("precio_prom").alias("n_hechos"))
                 .orderBy(F.desc("n_hechos"), F.asc("producto")).limit(k))


def product_series(sem: DataFrame) -> DataFrame:
    """Per product: dates and daily mean prices in date order.

    Collected from the (product, date) aggregate, so each list is bounded by
    the number of calendar days, not by the number of facts.
    """
    daily = avg_by_product_date(sem)
    return (daily.groupBy("producto")
                 .agg(F.array_sort(F.collect_list(F.struct("fecha", stable_round("precio_promedio", 2).alias("y"))))
                      .alias("s"))
                 .select("producto", F.col("s.fecha").alias("fechas"), F.col("s.y").alias("precios")))


def last_and_previous(sem: DataFrame) -> DataFrame:
    """Last and previous daily mean per product and % change.

    Window over the (product, date) aggregate only; previous = last when the
    series has one point; change is 0 when previous is 0.
    """
    daily = avg_by_product_date(sem)
    w = Window.partitionBy("producto").orderBy(F.desc("fecha"))
    top2 = daily.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    g = top2.groupBy("producto").agg(
        F.max(F.when(F.col("rn") == 1, F.col("precio_promedio"))).alias("precio_actual"),
        F.max(F.when(F.col("rn") == 2, F.col("precio_promedio"))).alias("_prev"))
    prev = F.coalesce(F.col("_prev"), F.col("precio_actual"))
    return g.select(
        "producto", "precio_actual", prev.alias("precio_anterior"),
        F.when(prev != 0, (F.col("precio_actual") - prev) / prev * 100).otherwise(F.lit(0.0))
         .alias("variacion_pct"))


# ------------------------------------------------------------------ projections
def dashboard_records(facts: DataFrame) -> DataFrame:
    """Record projection of raw facts for the client dashboard."""
    is_may = F.col("tipo_venta") == S.WHOLESALE
    is_min = F.col("tipo_venta") == S.RETAIL
    return facts.select(
        F.date_format("fecha", "yyyy-MM-dd").alias("fecha"),
        F.coalesce(F.nullif(F.trim("producto"), F.lit("")), F.lit("Sin producto")).alias("producto"),
        F.coalesce(F.nullif(F.trim("tipo_venta"), F.lit("")), F.lit("No especificado")).alias("tipo_precio"),
        F.coalesce(F.nullif(F.trim("unidad"), F.lit("")), F.lit(S.NO_UNIT)).alias("unidad"),
        F.when(is_may, F.round("precio_prom", 2)).alias("precio_mayorista"),
        F.when(is_min, F.round("precio_prom", 2)).alias("precio_minorista"),
        F.round("precio_prom", 2).alias("precio_analisis"),
        F.round("precio_min", 2).alias("precio_min"),
        F.round("precio_max", 2).alias("precio_max"),
        F.round("variacion_precio", 2).alias("variacion_precio"),
    )


def format_money(df: DataFrame, cols: list[str]) -> DataFrame:
    """Money text 'S/ 0.00' for each column; '-' for null (P20)."""
    return df.select(*[money(c).alias(c) for c in cols])
