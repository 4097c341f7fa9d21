"""Registered queries for every operator row (sources, quality, facts, metrics,
filters, warehouse, forecasts, scale sales).  Inputs: fixture W for the survey
path, X for the text ingest, E for scale sales (see FIXTURES.md)."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.functions import columns as C
from tambo.operators import facts as FX
from tambo.operators import filters as FL
from tambo.operators import forecast as FC
from tambo.operators import metrics as M
from tambo.operators import quality as Q
from tambo.operators import scale as B
from tambo.plans import catalog as CAT
from tambo.plans import scale_store as SS
from tambo.plans import warehouse as WH
from tambo.plans.ordinal import numbered
from tambo.registry import facts_normalised, facts_raw, register, semantic, validated
from tambo.session import scratch_path, stored_once
from tambo.sources import fixtures as FIX
from tambo.sources.survey_csv import read_survey_csv, type_survey

SURVEY_OUT = ["fecha", "producto", "unidad_may", "equiv_may", "may_min", "may_prom", "may_max",
              "unidad_min", "equiv_min", "min_min", "min_prom", "min_max", "hoja_origen"]


def _records(spark, sf_dir):
    return M.dashboard_records(facts_raw(spark, sf_dir))


# ------------------------------------------------------------------ ingest of the text survey X
@register("ingest_header_skip")
def q_ingest_header_skip(spark, sf_dir):
    t = type_survey(FIX.text_survey(spark, sf_dir))
    return t.groupBy("hoja_origen", "fecha").agg(F.count(F.lit(1)).alias("filas"))


@register("ingest_dates")
def q_ingest_dates(spark, sf_dir):
    from tambo.functions.parsing import parse_day_first_date
    x = FIX.text_survey(spark, sf_dir)
    return x.groupBy(F.col("fecha").alias("fecha_texto")).agg(F.count(F.lit(1)).alias("filas")) \
            .withColumn("fecha", parse_day_first_date("fecha_texto"))


@register("ingest_numeric")
def q_ingest_numeric(spark, sf_dir):
    t = type_survey(FIX.text_survey(spark, sf_dir))
    return t.select(*SURVEY_OUT)


@register("ingest_csv")
def q_ingest_csv(spark, sf_dir):
    x = FIX.text_survey(spark, sf_dir)
    sheets = []
    for sheet, sep in (("O", ";"), ("F", ",")):                         # line statuses are O or F
        path = scratch_path(spark, f"survey-{sheet}")
        rows = x.filter(F.col("hoja_origen") == sheet).select(*S.SURVEY_COLUMNS)
        (rows.write.option("sep", sep).option("header", "true")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
        # A sheet of notes, without a dated row, is passed over.
        x.filter("false").select(F.lit("").alias("value")).unionByName(
            spark.createDataFrame([("Notas;sin fecha",)], "value string")).coalesce(1).write.mode("append").text(path)
        sheets.append(read_survey_csv(spark, path, sep="auto", sheet_label=sheet))
    return type_survey(sheets[0].unionByName(sheets[1])).select(*SURVEY_OUT)


@register("ingest_pad_cut")
def q_ingest_pad_cut(spark, sf_dir):
    """Rows without a wholesale unit end after nine columns, those without data have two columns too many."""
    x = FIX.text_survey(spark, sf_dir)
    text = [F.coalesce(F.col(c), F.lit("")) for c in S.SURVEY_COLUMNS]
    line = F.when(F.col("unidad_may").isNull(), F.concat_ws(";", *text[:9])) \
            .when(F.col("may_prom") == "S/D", F.concat_ws(";", *text, F.lit("de"), F.lit("mas"))).otherwise(F.concat_ws(";", *text))
    path = scratch_path(spark, "survey-ragged")
    x.select(line.alias("value")).write.text(path)
    return type_survey(read_survey_csv(spark, path)).select(*SURVEY_OUT[:-1])


@register("ingest_required")
def q_ingest_required(spark, sf_dir):
    t = Q.require_fields(type_survey(FIX.text_survey(spark, sf_dir)))
    return t.select(*SURVEY_OUT)


@register("ingest_analysis_price")
def q_ingest_analysis_price(spark, sf_dir):
    v = Q.add_analysis_price(Q.require_fields(type_survey(FIX.text_survey(spark, sf_dir))))
    return v.select("fecha", "producto", "hoja_origen", "precio_mayorista", "precio_minorista",
                    "precio_analisis", "tipo_precio")


# ------------------------------------------------------------------ quality (W)
@register("quality_flags")
def q_quality_flags(spark, sf_dir):
    v = validated(spark, sf_dir)
    return v.groupBy("estado", "error").agg(F.count(F.lit(1)).alias("filas"))


@register("quality_split")
def q_quality_split(spark, sf_dir):
    return Q.quality_counts(validated(spark, sf_dir))


@register("quality_rejects")
def q_quality_rejects(spark, sf_dir):
    """The rejected rows with their messages."""
    return Q.error_rows(validated(spark, sf_dir)).select(
        "fecha", "producto", "hoja_origen", "precio_mayorista", "precio_minorista", "precio_analisis", "error")


@register("etl_row_metrics")
def q_etl_row_metrics(spark, sf_dir):
    m = Q.etl_row_metrics(Q.ok_rows(validated(spark, sf_dir)))
    return m.select("fecha", "producto", "hoja_origen", "precio_unitario", "diferencia_precio", "variacion_precio")


@register("facts_raw")
def q_facts_raw(spark, sf_dir):
    return facts_raw(spark, sf_dir)


@register("facts_normalised")
def q_facts_normalised(spark, sf_dir):
    return facts_normalised(spark, sf_dir)


@register("standardise_columns")
def q_standardise_columns(spark, sf_dir):
    s = semantic(spark, sf_dir)
    camel = s.select(F.col("fecha").alias("Fecha"), F.col("producto").alias("Producto"),
                     F.col("tipo_venta").alias("TipoVenta"), F.col("precio_minimo").alias("PrecioMinimo"),
                     F.col("precio_promedio").alias("PrecioPromedio"), F.col("precio_maximo").alias("PrecioMaximo"),
                     F.col("variacion_precio").alias("Variacion_Precio"))
    return C.standardise_columns(camel)


@register("calendar_columns")
def q_calendar_columns(spark, sf_dir):
    s = semantic(spark, sf_dir).select("fecha").distinct()
    return C.with_calendar(s)


# ------------------------------------------------------------------ metrics (semantic rows over W)
@register("kpis_global")
def q_kpis_global(spark, sf_dir):
    return M.kpis_global(semantic(spark, sf_dir))


@register("kpi_product_count")
def q_kpi_product_count(spark, sf_dir):
    return M.kpi_product_count(semantic(spark, sf_dir))


@register("kpi_table")
def q_kpi_table(spark, sf_dir):
    return M.kpi_table(semantic(spark, sf_dir))


@register("avg_by_product")
def q_avg_by_product(spark, sf_dir):
    return M.avg_by_product(semantic(spark, sf_dir))


@register("avg_by_channel")
def q_avg_by_channel(spark, sf_dir):
    return M.avg_by_channel(semantic(spark, sf_dir))


@register("avg_by_date")
def q_avg_by_date(spark, sf_dir):
    return M.avg_by_date(semantic(spark, sf_dir))


@register("variation_by_date")
def q_variation_by_date(spark, sf_dir):
    return M.variation_by_date(semantic(spark, sf_dir))


@register("channel_gap_by_date")
def q_channel_gap_by_date(spark, sf_dir):
    return M.channel_gap_by_date(semantic(spark, sf_dir))


@register("channel_gap_by_date_sql")
def q_channel_gap_by_date_sql(spark, sf_dir):
    return M.channel_gap_by_date_sql(semantic(spark, sf_dir))


@register("avg_by_product_date")
def q_avg_by_product_date(spark, sf_dir):
    return M.avg_by_product_date(semantic(spark, sf_dir))


@register("ranking_detail")
def q_ranking_detail(spark, sf_dir):
    return M.ranking_detail(semantic(spark, sf_dir))


@register("ranking_products")
def q_ranking_products(spark, sf_dir):
    return M.ranking_products(semantic(spark, sf_dir))


@register("ranking_with_variation")
def q_ranking_with_variation(spark, sf_dir):
    return M.ranking_with_variation(facts_raw(spark, sf_dir))


@register("ranking_channels_seen")
def q_ranking_channels_seen(spark, sf_dir):
    return M.ranking_channels_seen(_records(spark, sf_dir))


@register("group_average")
def q_group_average(spark, sf_dir):
    return M.group_average(_records(spark, sf_dir), "unidad", "precio_analisis")


@register("channel_columns_avg")
def q_channel_columns_avg(spark, sf_dir):
    return M.channel_columns_avg(_records(spark, sf_dir))


@register("kpis_filtered")
def q_kpis_filtered(spark, sf_dir):
    r = M.dashboard_records(FL.filter_dates(facts_raw(spark, sf_dir), "1996-01-01"))
    return M.kpis_filtered(FL.filter_units(r, "", "", None, [S.RETAIL], [S.RETAIL_UNIT]))


@register("fact_counts")
def q_fact_counts(spark, sf_dir):
    return M.fact_counts(validated(spark, sf_dir))


@register("product_frequency")
def q_product_frequency(spark, sf_dir):
    return M.product_frequency(facts_raw(spark, sf_dir))


@register("product_series")
def q_product_series(spark, sf_dir):
    return M.product_series(semantic(spark, sf_dir))


@register("last_and_previous")
def q_last_and_previous(spark, sf_dir):
    return M.last_and_previous(semantic(spark, sf_dir))


@register("dashboard_records")
def q_dashboard_records(spark, sf_dir):
    return _records(spark, sf_dir)


@register("format_money")
def q_format_money(spark, sf_dir):
    k = M.kpis_global(semantic(spark, sf_dir))
    return M.format_money(k, k.columns)


# ------------------------------------------------------------------ filters
@register("filter_dashboard")
def q_filter_dashboard(spark, sf_dir):
    s = semantic(spark, sf_dir)
    return FL.filter_dashboard(s, dt.date(1996, 1, 1), dt.date(1998, 12, 31), [], [S.RETAIL])


@register("filter_units")
def q_filter_units(spark, sf_dir):
    r = M.dashboard_records(FL.filter_dates(facts_raw(spark, sf_dir), "", "1997-06-30"))
    return FL.filter_units(r, "", "", None, [S.WHOLESALE, S.RETAIL], [S.RETAIL_UNIT, S.NO_UNIT])


@register("filter_domains")
def q_filter_domains(spark, sf_dir):
    return FL.filter_domains(_records(spark, sf_dir))


@register("product_search")
def q_product_search(spark, sf_dir):
    return FL.product_search(semantic(spark, sf_dir), "AN")


# ------------------------------------------------------------------ warehouse
def _batch(spark, sf_dir):
    """OK survey rows with the columns that a load reads, stored once, and their facts."""
    ok = Q.ok_rows(validated(spark, sf_dir)).select(*S.SURVEY_COLUMNS, "hoja_origen", "precio_mayorista", "precio_minorista")
    ok = stored_once(ok, "batch")
    return ok, FX.unpivot_channels(ok, normalise=True)


def _warehouse(spark, sf_dir):
    ok, f = _batch(spark, sf_dir)
    return WH.load(WH.empty_warehouse(spark), ok, f, replace=True), f


@register("semantic_view")
def q_semantic_view(spark, sf_dir):
    """Load the warehouse, write it as parquet, read it back and serve the view."""
    wh, _ = _warehouse(spark, sf_dir)
    root = scratch_path(spark, "warehouse")
    WH.save(wh, root, replace=True)
    return WH.semantic_sorted(WH.read(spark, root)).drop("id_precio")


@register("semantic_between")
def q_semantic_between(spark, sf_dir):
    """A range of dates from the stored view, whose facts lie in a directory for each year."""
    wh, _ = _warehouse(spark, sf_dir)
    root = scratch_path(spark, "by_year")
    WH.save(wh, root)
    return WH.semantic_between(WH.read(spark, root), "1995-06-15", "1996-03-31").drop("id_precio")


@register("source_choice")
def q_source_choice(spark, sf_dir):
    """The session's facts when it has any, else the stored view."""
    wh, facts = _warehouse(spark, sf_dir)
    root = scratch_path(spark, "source")
    WH.save(wh, root)
    sessions = {"con sesion": facts.filter(F.col("tipo_venta") == S.RETAIL), "sesion vacia": facts.filter(F.lit(False)), "sin sesion": None}
    rows = [WH.choose_source(spark, root, session).groupBy("tipo_venta").agg(
        F.count(F.lit(1)).alias("filas"), F.avg("precio_promedio").alias("precio_promedio")).withColumn("caso", F.lit(case))
        for case, session in sessions.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


@register("catalog_views")
def q_catalog_views(spark, sf_dir):
    """L1, T5: the catalog created twice over a warehouse that was loaded twice; all six views read by name."""
    ok, facts = _batch(spark, sf_dir)
    root = scratch_path(spark, "catalog")
    WH.load_into(spark, root, ok, facts.filter(F.col("tipo_venta") == S.RETAIL))
    CAT.create_catalog(spark, root)
    WH.load_into(spark, root, ok, facts)
    name = CAT.create_catalog(spark, root)
    view = lambda v: CAT.read_view(spark, name, v)                                  # noqa: E731
    rows = [
        view("vw_capa_semantica_bi").groupBy(F.col("anio").cast("string").alias("clave")).agg(
            F.count(F.lit(1)).cast("double").alias("valor"), F.avg(F.col("precio_maximo").cast("double")).alias("valor2")),
        view("vw_kpis_precios").select(F.lit("kpi").alias("clave"), F.col("precio_promedio_general").alias("valor"),
                                       F.col("variacion_promedio").alias("valor2")),
        view("vw_ranking_productos").select(F.col("producto").alias("clave"), F.col("precio_promedio").alias("valor"),
                                            F.col("ranking").cast("double").alias("valor2")),
        view("vw_grafico_barras_top10").select(F.col("producto").alias("clave"), F.col("precio_promedio").alias("valor"),
                                               F.col("ranking").cast("double").alias("valor2")),
        view("vw_grafico_circular").select(F.col("tipo_venta").alias("clave"), F.col("precio_promedio").alias("valor"),
                                           F.lit(None).cast("double").alias("valor2")),
        view("vw_grafico_lineas").select(F.col("fecha").cast("string").alias("clave"), F.col("precio_promedio").alias("valor"),
                                         F.lit(None).cast("double").alias("valor2")),
    ]
    out = [r.select(F.lit(v).alias("vista"), "clave", "valor", "valor2") for v, r in zip(CAT.VIEWS, rows)]
    return functools.reduce(lambda a, b: a.unionByName(b), out)


@register("kpi_incremental")
def q_kpi_incremental(spark, sf_dir):
    """A3, A10 kept by increments: facts appended in three loads, then KPIs and daily means read from the stored sums."""
    ok, facts = _batch(spark, sf_dir)
    root = scratch_path(spark, "increments")
    part = F.when(F.year("fecha") < 1996, 0).when(F.year("fecha") < 1998, 1).otherwise(2)
    for n in range(3):
        WH.load_into(spark, root, ok.filter(part == n), facts.filter(part == n), replace=n == 0)
    wh = WH.read(spark, root)
    daily = WH.daily_averages(wh).select(F.col("producto").alias("clave"), F.col("fecha").cast("string").alias("fecha"), "tipo_venta",
                                         F.col("precio_promedio").alias("valor"))
    kpis = wh["fact_kpis"].select(F.col("nombre_kpi").alias("clave"), F.lit("").alias("fecha"), F.lit("").alias("tipo_venta"),
                                  F.col("valor").cast("double").alias("valor"))
    return kpis.unionByName(daily)


@register("dim_producto")
def q_dim_producto(spark, sf_dir):
    return _warehouse(spark, sf_dir)[0]["dim_producto"]


@register("dim_tipo_venta")
def q_dim_tipo_venta(spark, sf_dir):
    return _warehouse(spark, sf_dir)[0]["dim_tipo_venta"]


@register("dim_tiempo")
def q_dim_tiempo(spark, sf_dir):
    wh = _warehouse(spark, sf_dir)[0]
    return (wh["dim_tiempo"].join(wh["dim_mes"], "id_mes").join(wh["dim_anio"], "id_anio")
              .select("fecha", "dia", "mes", "nombre_mes", "anio"))


@register("dim_unidad")
def q_dim_unidad(spark, sf_dir):
    wh = _warehouse(spark, sf_dir)[0]
    return wh["dim_unidad"].join(wh["dim_tipo_venta"], "id_tipo_venta") \
                           .select("unidad", "tipo_venta", "equivalencia")


@register("dim_upsert")
def q_dim_upsert(spark, sf_dir):
    """Second load of all facts into the dimensions built from the facts before 1998."""
    f = facts_normalised(spark, sf_dir)
    first = f.filter(F.col("fecha") < F.lit("1998-01-01").cast("date"))
    wh1 = WH.load_dimensions(WH.empty_warehouse(spark), first)
    wh2 = WH.load_dimensions(wh1, f)
    old = wh1["dim_producto"].select("producto", F.lit("existente").alias("origen"))
    return wh2["dim_producto"].join(old, "producto", "left") \
        .select("producto", "id_producto", F.coalesce("origen", F.lit("nuevo")).alias("origen"))


@register("dim_lookup")
def q_dim_lookup(spark, sf_dir):
    wh, f = _warehouse(spark, sf_dir)
    j = WH.dim_lookup(wh, f)
    return j.groupBy("tipo_venta", "unidad").agg(
        F.count(F.lit(1)).alias("hechos"), F.count_distinct("id_producto").alias("productos"),
        F.count_distinct("id_tiempo").alias("fechas"))


@register("fact_load")
def q_fact_load(spark, sf_dir):
    wh, _ = _warehouse(spark, sf_dir)
    return wh["fact_precios"].agg(
        F.count(F.lit(1)).alias("hechos"), F.count_distinct("id_precio").alias("ids_distintos"),
        F.sum("precio_prom").cast("double").alias("suma_precio_prom"),
        F.sum("precio_min").cast("double").alias("suma_precio_min"),
        F.sum("precio_max").cast("double").alias("suma_precio_max"))


@register("staging_rows")
def q_staging_rows(spark, sf_dir):
    ok = Q.ok_rows(validated(spark, sf_dir))
    return WH.staging_rows(ok).drop("fecha_captura")


@register("fk_check")
def q_fk_check(spark, sf_dir):
    """J10 on a warehouse damaged on purpose: members removed (orphans) and entered twice (duplicates)."""
    wh = _warehouse(spark, sf_dir)[0]
    t = dict(wh.tables)
    last = t["dim_producto"].agg(F.max("producto")).first()[0]
    again = t["dim_producto"].filter(F.col("producto") < "c").withColumn("id_producto", -F.col("id_producto"))
    t["dim_producto"] = t["dim_producto"].filter(F.col("producto") != last).unionByName(again)
    t["dim_tiempo"] = t["dim_tiempo"].filter(F.month("fecha") != 2)
    year = t["dim_anio"].filter(F.col("anio") == 1996)
    t["dim_mes"] = t["dim_mes"].join(year, "id_anio", "left_anti")
    t["dim_anio"] = t["dim_anio"].filter(F.col("anio") != 1997)
    t["dim_tipo_venta"] = t["dim_tipo_venta"].filter(F.col("tipo_venta") != S.WHOLESALE)
    kept = t["dim_unidad"].filter(F.col("unidad") != S.NO_UNIT)
    t["dim_unidad"] = kept.unionByName(kept.withColumn("id_unidad", -F.col("id_unidad")))
    return WH.fk_check(WH.Warehouse(t))


@register("schema_check")
def q_schema_check(spark, sf_dir):
    """The stored tables read back, one of them without a required column."""
    root = scratch_path(spark, "schema_check")
    WH.save(_warehouse(spark, sf_dir)[0], root)
    stored = WH.read(spark, root)
    stored.tables["dim_unidad"].drop("equivalencia").write.parquet(f"{root}/without_column")
    return WH.schema_check(WH.Warehouse({**stored.tables, "dim_unidad": spark.read.parquet(f"{root}/without_column")}))


# ------------------------------------------------------------------ forecasts (semantic rows over W)
@register("project_ordinal")
def q_project_ordinal(spark, sf_dir):
    return FC.project_ordinal(semantic(spark, sf_dir), S.HORIZON, clamp=True)


@register("project_ordinal_unclamped")
def q_project_ordinal_unclamped(spark, sf_dir):
    return FC.project_ordinal(semantic(spark, sf_dir), S.HORIZON, clamp=False)


@register("project_one_step")
def q_project_one_step(spark, sf_dir):
    return FC.project_ordinal(semantic(spark, sf_dir), 1, clamp=True)


@register("forecast_weeks")
def q_forecast_weeks(spark, sf_dir):
    return FC.forecast_weeks(semantic(spark, sf_dir))


@register("forecast_variation")
def q_forecast_variation(spark, sf_dir):
    return FC.forecast_variation(semantic(spark, sf_dir))


@register("forecast_gap")
def q_forecast_gap(spark, sf_dir):
    return FC.forecast_gap(semantic(spark, sf_dir))


@register("forecast_date_axis")
def q_forecast_date_axis(spark, sf_dir):
    return FC.forecast_date_axis(semantic(spark, sf_dir))


@register("forecast_product_date_axis")
def q_forecast_product_date_axis(spark, sf_dir):
    return FC.forecast_product_date_axis(semantic(spark, sf_dir))


@register("forecast_gap_date_axis")
def q_forecast_gap_date_axis(spark, sf_dir):
    return FC.forecast_gap_date_axis(semantic(spark, sf_dir))


@register("increments")
def q_increments(spark, sf_dir):
    return FC.increments(semantic(spark, sf_dir))


@register("increments_raw_rows")
def q_increments_raw_rows(spark, sf_dir):
    return FC.increments_raw_rows(semantic(spark, sf_dir))


@register("result_tables")
def q_result_tables(spark, sf_dir):
    """The second of two runs replaces both tables, which are read back together."""
    root, sem = scratch_path(spark, "results"), semantic(spark, sf_dir)
    for _ in range(2):
        WH.save_results(root, FC.forecast_table(sem), FC.increments(sem))
    tables = WH.read_results(spark, root)
    forecast, ranking = tables["predicciones_precios"], tables["ranking_incremento"]
    return ranking.select(F.lit("ranking").alias("tabla"), F.col("ranking").alias("fila"), "producto",
                          F.lit(None).cast("date").alias("fecha"), F.col("precio_actual").alias("valor1"),
                          F.col("precio_predicho").alias("valor2"), F.col("incremento_esperado").alias("valor3")).unionByName(
        forecast.select(F.lit("prediccion").alias("tabla"), F.col("semana").alias("fila"),
                        F.col("productomayorincremento").alias("producto"), F.col("fechaprediccion").alias("fecha"),
                        F.col("preciopromediofuturo").alias("valor1"), F.col("tendenciavariacion").alias("valor2"),
                        F.col("diferenciamayoristaminoristafutura").alias("valor3")))


@register("top_increment")
def q_top_increment(spark, sf_dir):
    return FC.top_increment(semantic(spark, sf_dir))


@register("top_increment_path")
def q_top_increment_path(spark, sf_dir):
    return FC.top_increment_path(semantic(spark, sf_dir))


@register("forecast_table")
def q_forecast_table(spark, sf_dir):
    return FC.forecast_table(semantic(spark, sf_dir))


@register("history_plus_forecast")
def q_history_plus_forecast(spark, sf_dir):
    return FC.history_plus_forecast(semantic(spark, sf_dir), anchor=True)


@register("history_plus_forecast_range")
def q_history_plus_forecast_range(spark, sf_dir):
    return FC.history_plus_forecast(semantic(spark, sf_dir), anchor=False, series="range")


@register("history_plus_forecast_gap")
def q_history_plus_forecast_gap(spark, sf_dir):
    return FC.history_plus_forecast(semantic(spark, sf_dir), anchor=True, series="gap")


@register("history_plus_forecast_top")
def q_history_plus_forecast_top(spark, sf_dir):
    return FC.history_plus_forecast(semantic(spark, sf_dir), anchor=True, series="top")


@register("executive_summary")
def q_executive_summary(spark, sf_dir):
    return FC.executive_summary(FX.to_semantic(facts_raw(spark, sf_dir)))


@register("product_alerts")
def q_product_alerts(spark, sf_dir):
    return FC.product_alerts(FX.to_semantic(facts_raw(spark, sf_dir)))


@register("client_summary")
def q_client_summary(spark, sf_dir):
    return FC.client_summary(_records(spark, sf_dir))


# ------------------------------------------------------------------ scale sales (E)
def _sales(spark, sf_dir):
    return FIX.scale_events(spark, sf_dir)


@register("scale_total")
def q_scale_total(spark, sf_dir):
    return B.scale_total(_sales(spark, sf_dir)).select("event_id", "peso", "precio", "total")


@register("scale_price_band")
def q_scale_price_band(spark, sf_dir):
    return B.scale_price_band(_sales(spark, sf_dir)).select(
        "event_id", "canal", "may_min", "may_prom", "may_max", "min_min", "min_prom", "min_max")


@register("catalogue_price")
def q_catalogue_price(spark, sf_dir):
    s = _sales(spark, sf_dir).withColumn(
        "producto", F.element_at(F.array(*[F.lit(r[0]) for r in S.CATALOGUE], F.lit("Camote")),
                                 (F.col("event_id") % 6 + 1).cast("int")))
    return B.catalogue_price(s, B.catalogue(spark)).select("event_id", "producto", "canal", "precio_catalogo")


@register("scale_enrich")
def q_scale_enrich(spark, sf_dir):
    s = _sales(spark, sf_dir).withColumn(
        "producto", F.element_at(F.array(*[F.lit(r[0]) for r in S.CATALOGUE], F.lit("Camote")),
                                 (F.col("event_id") % 6 + 1).cast("int")))
    return B.scale_enrich(s, B.catalogue(spark)).select("event_id", "producto", "u_may", "eq_may", "u_min", "eq_min")


@register("scale_pair_sales")
def q_scale_pair_sales(spark, sf_dir):
    return B.scale_pair_sales(_sales(spark, sf_dir), B.catalogue(spark)).select(*B.PAIR_COLUMNS)


@register("scale_upsert")
def q_scale_upsert(spark, sf_dir):
    """The table holds the days before the 16th at twice the price; the days from the 10th on arrive."""
    sales = _sales(spark, sf_dir)
    cat = B.catalogue(spark)
    early = sales.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).withColumn("precio", F.col("precio") * 2)
    arriving = sales.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    existing = numbered(B.latest_per_key(B.scale_pair_sales(early, cat)).orderBy("fecha", "producto"), "id", 0) \
        .withColumn("created_at", F.col("fecha"))
    held = existing.count()
    merged = B.scale_upsert(existing, B.scale_pair_sales(arriving, cat))
    new = F.col("id") > held
    return merged.select(*B.PAIR_COLUMNS, F.when(~new, F.col("id")).alias("id_previo"),
                         F.when(~new, F.col("created_at")).alias("alta_previa"),
                         F.count(F.lit(1)).over(Window.partitionBy("id")).alias("filas_con_id"))


@register("scale_upsert_stored")
def q_scale_upsert_stored(spark, sf_dir):
    """L10 on the stored table: the same two loads as ``scale_upsert``, one after the other."""
    sales, cat = _sales(spark, sf_dir), B.catalogue(spark)
    early = sales.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).withColumn("precio", F.col("precio") * 2)
    arriving = sales.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    root = scratch_path(spark, "upsert")
    SS.upsert_stored(spark, root, B.scale_pair_sales(early, cat))
    before = SS.read_stored(spark, root).select("fecha", "producto", F.struct("id", "created_at").alias("antes"))
    SS.upsert_stored(spark, root, B.scale_pair_sales(arriving, cat))
    after = SS.read_stored(spark, root).join(before, ["fecha", "producto"], "left")
    return after.select(*B.PAIR_COLUMNS, (F.col("antes") == F.struct("id", "created_at")).alias("conserva_alta"),
                        F.count(F.lit(1)).over(Window.partitionBy("id")).alias("filas_con_id"))


@register("scale_recent")
def q_scale_recent(spark, sf_dir):
    return B.scale_recent(_sales(spark, sf_dir)).select("event_id", "ts", "producto", "canal", "precio")


@register("scale_to_facts")
def q_scale_to_facts(spark, sf_dir):
    pairs = B.scale_pair_sales(_sales(spark, sf_dir), B.catalogue(spark))
    return FX.unpivot_channels(Q.ok_rows(Q.validate(B.pairs_as_survey(pairs))), normalise=True)


@register("scale_history")
def q_scale_history(spark, sf_dir):
    pairs = B.scale_pair_sales(_sales(spark, sf_dir), B.catalogue(spark))
    path = scratch_path(spark, "ventas_csv")
    B.write_sales_csv(pairs, path)
    return B.read_sales_csv(spark, path)


@register("scale_headers")
def q_scale_headers(spark, sf_dir):
    """The files of a sales history and of one without some columns, checked file by file."""
    pairs = B.scale_pair_sales(_sales(spark, sf_dir), B.catalogue(spark))
    whole, lacking = scratch_path(spark, "ventas_csv"), scratch_path(spark, "ventas_sin")
    B.write_sales_csv(pairs, whole)
    lines = spark.read.option("sep", ";").option("header", True).csv(whole)
    lines.drop(*S.SALES_CSV_COLUMNS[4:6]).write.option("sep", ";").option("header", True).csv(lacking)
    return functools.reduce(lambda a, b: a.unionByName(b), [
        B.sales_csv_headers(spark, path).groupBy(F.array_join("faltantes", ", ").alias("faltantes")).agg(F.sum("filas").alias("filas"))
         .withColumn("historial", F.lit(name)) for name, path in (("completo", whole), ("incompleto", lacking))])


@register("scale_stream")
def q_scale_stream(spark, sf_dir):
    """The sales arrive as two file batches, the second holding earlier sales of
    days already processed; the streamed table must equal the batch answer."""
    from tambo.streaming.scale_stream import current_sales_table, start_scale_stream
    root = scratch_path(spark, "scale_stream")
    inp, ckpt = f"{root}/input", f"{root}/_stream_checkpoint"
    sales = _sales(spark, sf_dir)
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        sales.filter(part).write.mode("append").parquet(inp)
        start_scale_stream(spark, inp, root, ckpt).awaitTermination()
    return current_sales_table(spark, root).select(*B.PAIR_COLUMNS)
