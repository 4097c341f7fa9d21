"""Scale sales.

A scale sale carries a market, a channel, a product, a weight and a price.
Sales of one product on one calendar day are merged into survey rows: the
k-th wholesale sale and the k-th retail sale of that (day, product) share a
row, stamped with the earlier of the two times (to the second).  That merge
is a full outer equi-join on (day, product, k); k is counted per minute, so a
product holding a third of all sales is still split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tambo import schemas as S
from tambo.plans.ordinal import numbered

PAIR_COLUMNS = [
    "fecha", "producto",
    "unidad_may", "equiv_may", "may_min", "may_prom", "may_max",
    "unidad_min", "equiv_min", "min_min", "min_prom", "min_max",
]


def catalogue(spark: SparkSession) -> DataFrame:
    """Fixed five-product catalogue (broadcast-sized by construction)."""
    schema = T.StructType([
        T.StructField("producto", T.StringType()), T.StructField("codigo", T.StringType()),
        T.StructField("categoria", T.StringType()), T.StructField("precio_minorista", T.DoubleType()),
        T.StructField("precio_mayorista", T.DoubleType()), T.StructField("unidad_mayorista", T.StringType()),
        T.StructField("equiv_mayorista", T.DoubleType())])
    return spark.createDataFrame(S.CATALOGUE, schema)


def scale_total(sales: DataFrame) -> DataFrame:
    """Accepted sales (weight > 0) with total = round(weight * price, 2) (B1)."""
    return sales.filter(F.col("peso") > 0).withColumn("total", F.round(F.col("peso") * F.col("precio"), 2))


def catalogue_price(sales: DataFrame, cat: DataFrame) -> DataFrame:
    """Catalogue price of the sale's product in its channel; unknown product -> 0.0."""
    j = sales.join(cat, "producto", "left")
    price = F.when(F.col("canal") == S.WHOLESALE, F.col("precio_mayorista")).otherwise(F.col("precio_minorista"))
    return j.select(*sales.columns, F.coalesce(price, F.lit(0.0)).alias("precio_catalogo"))


def scale_enrich(sales: DataFrame, cat: DataFrame) -> DataFrame:
    """Unit and equivalence per channel from the catalogue; unknown -> defaults."""
    j = sales.join(cat.select("producto", "unidad_mayorista", "equiv_mayorista"), "producto", "left")
    return j.select(
        *sales.columns,
        F.coalesce("unidad_mayorista", F.lit(S.UNKNOWN_PRODUCT["unidad_mayorista"])).alias("u_may"),
        F.coalesce("equiv_mayorista", F.lit(S.UNKNOWN_PRODUCT["equiv_mayorista"])).alias("eq_may"),
        F.lit(S.RETAIL_UNIT).alias("u_min"),
        F.lit(S.RETAIL_EQUIV).alias("eq_min"))


def scale_price_band(sales: DataFrame) -> DataFrame:
    """Price band +-5 % (2 dp) in the sale's channel; the other channel null (B2)."""
    p = F.col("precio")
    may, mn = F.col("canal") == S.WHOLESALE, F.col("canal") != S.WHOLESALE
    return sales.withColumns({
        "may_min": F.when(may, F.round(p * S.BAND_LOW, 2)),
        "may_prom": F.when(may, p),
        "may_max": F.when(may, F.round(p * S.BAND_HIGH, 2)),
        "min_min": F.when(mn, F.round(p * S.BAND_LOW, 2)),
        "min_prom": F.when(mn, p),
        "min_max": F.when(mn, F.round(p * S.BAND_HIGH, 2)),
    })


def sale_rank(sales: DataFrame) -> DataFrame:
    """k = 0-based position of the sale in its (day, product, channel), by (ts, event_id).

    Sales are numbered within a minute of the group; the sales of its earlier
    minutes come from a running sum over the counts (at most 1440 per group).
    """
    keys = ["dia", "producto", "canal"]
    cell = [*keys, "_minute"]
    s = sales.withColumns({"dia": F.to_date("ts"), "_minute": F.date_trunc("minute", "ts")})
    earlier = Window.partitionBy(*keys).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    starts = s.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")) \
              .select(*cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("ts", "event_id"))
    return (s.withColumn("_place", place).join(starts, cell)
             .withColumn("k", F.col("_before") + F.col("_place") - 1)
             .drop("_minute", "_place", "_before"))


def scale_pair_sales(sales: DataFrame, cat: DataFrame) -> DataFrame:
    """Survey rows from sales: k-th wholesale + k-th retail of a (day, product).

    ``fecha`` is the time of the earlier sale, truncated to the second; the
    row also keeps that sale's (ts, event_id) as ``creado_ts``/``creado_id``
    (file order of the sales history).
    """
    ranked = sale_rank(scale_price_band(scale_enrich(scale_total(sales), cat)))
    w = ranked.filter(F.col("canal") == S.WHOLESALE).select(
        "dia", "producto", "k", F.col("ts").alias("ts_w"), F.col("event_id").alias("id_w"),
        F.col("u_may").alias("unidad_may"), F.col("eq_may").alias("equiv_may"), "may_min", "may_prom", "may_max")
    r = ranked.filter(F.col("canal") != S.WHOLESALE).select(
        "dia", "producto", "k", F.col("ts").alias("ts_r"), F.col("event_id").alias("id_r"),
        F.col("u_min").alias("unidad_min"), F.col("eq_min").alias("equiv_min"), "min_min", "min_prom", "min_max")
    j = w.join(r, ["dia", "producto", "k"], "full_outer")
    w_first = F.col("ts_r").isNull() | (F.col("ts_w").isNotNull() & (
        (F.col("ts_w") < F.col("ts_r")) | ((F.col("ts_w") == F.col("ts_r")) & (F.col("id_w") < F.col("id_r")))))
    created_ts = F.when(w_first, F.col("ts_w")).otherwise(F.col("ts_r"))
    created_id = F.when(w_first, F.col("id_w")).otherwise(F.col("id_r"))
    return j.select(
        F.date_trunc("second", created_ts).alias("fecha"), "producto",
        "unidad_may", "equiv_may", "may_min", "may_prom", "may_max",
        "unidad_min", "equiv_min", "min_min", "min_prom", "min_max",
        created_ts.alias("creado_ts"), created_id.alias("creado_id"))


def latest_per_key(rows: DataFrame) -> DataFrame:
    """Last version per (fecha, producto) in file order (W6): an aggregate, not a window."""
    vals = [c for c in PAIR_COLUMNS if c not in ("fecha", "producto")]
    order = F.struct("creado_ts", "creado_id")
    g = rows.groupBy("fecha", "producto").agg(
        F.max_by(F.struct(*vals, "creado_ts", "creado_id"), order).alias("_v"))
    return g.select("fecha", "producto", "_v.*")


def scale_upsert(existing: DataFrame, incoming: DataFrame, after: int | None = None) -> DataFrame:
    """Upsert on (fecha, producto).

    Rows of both sides get every price column replaced and keep id and
    created_at; rows only in ``existing`` stay; new ones get the present time
    and ids after ``after``, or else after the present maximum.
    """
    keys = ["fecha", "producto"]
    vals = [c for c in PAIR_COLUMNS if c not in keys]
    new = latest_per_key(incoming).select(*keys, *vals)
    if after is None:
        after = existing.agg(F.max("id")).first()[0] or 0
    added = numbered(new.join(existing.select(*keys), keys, "left_anti"), "id", after) \
        .withColumn("created_at", F.current_timestamp())
    fresh = new.select(*keys, F.struct(*vals).alias("_new"))
    held = existing.select(*keys, "id", "created_at", F.struct(*vals).alias("_old")) \
        .join(fresh, keys, "left") \
        .select("id", *keys, F.coalesce("_new", "_old").alias("_v"), "created_at") \
        .select("id", *keys, "_v.*", "created_at")
    return held.unionByName(added)


def scale_recent(sales: DataFrame, n: int = 6) -> DataFrame:
    """Last n sales, newest first (T3): a distributed top-k."""
    return sales.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def pairs_as_survey(pairs: DataFrame) -> DataFrame:
    """Pair rows in the 12-column survey layout (B4): fecha as a date, sheet 'Balanza'."""
    return pairs.select(
        F.to_date("fecha").alias("fecha"), "producto",
        "unidad_may", "equiv_may", "may_min", "may_prom", "may_max",
        "unidad_min", "equiv_min", "min_min", "min_prom", "min_max",
        F.lit("Balanza").alias("hoja_origen"))


def write_sales_csv(pairs: DataFrame, path: str) -> None:
    """Sales history as ';' CSV with the Spanish header."""
    out = pairs.select(
        F.date_format("fecha", "dd/MM/yyyy HH:mm:ss").alias(S.SALES_CSV_COLUMNS[0]),
        *[F.col(c).alias(h) for c, h in zip(PAIR_COLUMNS[1:], S.SALES_CSV_COLUMNS[1:])])
    out.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def sales_csv_missing_columns(spark: SparkSession, path: str) -> list[str]:
    """Header check of a sales history (L12, re-aimed): the expected columns that any of its files lacks.

    The files are never rewritten or deleted.
    """
    lacking = sales_csv_headers(spark, path).select(F.explode("faltantes").alias("c")).distinct().collect()    # at most the header
    return [c for c in S.SALES_CSV_COLUMNS if c in {r["c"] for r in lacking}]


def sales_csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, faltantes, filas) of every file of a sales history: the expected columns its header lacks, its lines below that.

    A file's header is the first line of its first block, whichever task reads it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("archivo"), F.regexp_replace("value", "^\uFEFF", "").alias("linea"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("lugar"))
    files = lines.groupBy("archivo").agg(F.min_by("linea", "lugar").alias("cabecera"), F.count(F.lit(1)).alias("n"))
    fields = F.transform(F.split("cabecera", ";"), lambda f: F.trim(F.translate(f, '"', "")))
    expected = F.array(*[F.lit(c) for c in S.SALES_CSV_COLUMNS])
    return files.select("archivo", F.array_except(expected, fields).alias("faltantes"), (F.col("n") - 1).alias("filas"))


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sales history back from CSV (S9): both date formats, undated rows skipped.

    A file whose header lacks the product column is rejected (L12).
    """
    from tambo.functions.parsing import parse_number, parse_timestamp
    missing = sales_csv_missing_columns(spark, path)
    if S.SALES_CSV_COLUMNS[1] in missing:
        raise ValueError(f"sales history {path} lacks columns: {', '.join(missing)}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in S.SALES_CSV_COLUMNS])
    raw = spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)
    typed = raw.select(
        parse_timestamp(F.col(f"`{S.SALES_CSV_COLUMNS[0]}`"), ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy"]).alias("fecha"),
        *[(parse_number(F.col(f"`{h}`")) if c.startswith(("equiv", "may_", "min_")) else F.col(f"`{h}`")).alias(c)
          for c, h in zip(PAIR_COLUMNS[1:], S.SALES_CSV_COLUMNS[1:])])
    return typed.filter(F.col("fecha").isNotNull())
