"""DuckDB oracle SQL per registered key (see ``tambo.oracle`` for the shared CTEs)."""

from __future__ import annotations

from tambo.oracle import F_CTE, V_CTE, X_CTE, day_first, facts_cte, final, sr, srs, with_

ORACLE: dict[str, str] = {}

MONTHS = "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre'," \
         "'Octubre','Noviembre','Diciembre']"
SURVEY_NUM = ["equiv_may", "may_min", "may_prom", "may_max", "equiv_min", "min_min", "min_prom", "min_max"]
SURVEY_OUT = ("fecha, producto, unidad_may, equiv_may, may_min, may_prom, may_max, unidad_min, equiv_min, "
              "min_min, min_prom, min_max, hoja_origen")
FACT_D = ["equivalencia", "precio_min", "precio_prom", "precio_max", "variacion_precio"]
SEM_D = ["equivalencia", "precio_minimo", "precio_promedio", "precio_maximo", "variacion_precio"]


def q(name: str, ctes: str, body: str, doubles: list[str]) -> None:
    ORACLE[name] = final(with_(ctes, body), doubles)


# Dashboard records over raw facts.
REC = F_CTE + """,
rec AS (
  SELECT strftime(fecha, '%Y-%m-%d') AS fecha,
         COALESCE(NULLIF(trim(producto), ''), 'Sin producto') AS producto,
         COALESCE(NULLIF(trim(tipo_venta), ''), 'No especificado') AS tipo_precio,
         COALESCE(NULLIF(trim(unidad), ''), 'Sin unidad') AS unidad,
         CASE WHEN tipo_venta = 'Mayorista' THEN """ + sr("precio_prom", 2) + """ END AS precio_mayorista,
         CASE WHEN tipo_venta = 'Minorista' THEN """ + sr("precio_prom", 2) + """ END AS precio_minorista,
         """ + sr("precio_prom", 2) + """ AS precio_analisis,
         """ + sr("precio_min", 2) + """ AS precio_min,
         """ + sr("precio_max", 2) + """ AS precio_max,
         """ + sr("variacion_precio", 2) + """ AS variacion_precio
  FROM fr
)"""
REC_D = ["precio_mayorista", "precio_minorista", "precio_analisis", "precio_min", "precio_max", "variacion_precio"]

# ------------------------------------------------------------------ metrics
q("top10_products", F_CTE, """
SELECT producto, precio_promedio,
       CAST(row_number() OVER (ORDER BY precio_promedio DESC, producto) AS BIGINT) AS ranking
FROM (SELECT producto, AVG(precio_promedio) AS precio_promedio FROM s
      WHERE producto IS NOT NULL GROUP BY producto) a
ORDER BY precio_promedio DESC, producto LIMIT 10""", ["precio_promedio"])

# ------------------------------------------------------------------ ingest (X)
q("ingest_header_skip", X_CTE, "SELECT hoja_origen, fecha, COUNT(*) AS filas FROM xt GROUP BY hoja_origen, fecha", [])
q("ingest_dates", X_CTE, f"""
SELECT fecha_texto, filas, {day_first('fecha_texto')} AS fecha
FROM (SELECT fecha AS fecha_texto, COUNT(*) AS filas FROM x GROUP BY fecha) g""", [])
q("ingest_numeric", X_CTE, f"SELECT {SURVEY_OUT} FROM xt", SURVEY_NUM)
q("ingest_csv", X_CTE, f"SELECT {SURVEY_OUT} FROM xt", SURVEY_NUM)
q("ingest_pad_cut", X_CTE, """
SELECT fecha, producto, unidad_may, equiv_may, may_min, may_prom, may_max, unidad_min, equiv_min,
       CASE WHEN unidad_may IS NOT NULL THEN min_min END AS min_min, CASE WHEN unidad_may IS NOT NULL THEN min_prom END AS min_prom,
       CASE WHEN unidad_may IS NOT NULL THEN min_max END AS min_max FROM xt""", SURVEY_NUM)
q("ingest_required", X_CTE, f"SELECT * REPLACE (trim(producto) AS producto) FROM "
                            f"(SELECT {SURVEY_OUT} FROM xt WHERE producto IS NOT NULL) t", SURVEY_NUM)
q("ingest_analysis_price", X_CTE, """
SELECT fecha, trim(producto) AS producto, hoja_origen, may_prom AS precio_mayorista,
       min_prom AS precio_minorista, COALESCE(min_prom, may_prom) AS precio_analisis,
       CASE WHEN min_prom IS NOT NULL THEN 'Minorista' ELSE 'Mayorista' END AS tipo_precio
FROM xt WHERE producto IS NOT NULL""", ["precio_mayorista", "precio_minorista", "precio_analisis"])

# ------------------------------------------------------------------ quality (W)
q("quality_flags", V_CTE, "SELECT estado, error, COUNT(*) AS filas FROM vq GROUP BY estado, error", [])
q("quality_split", V_CTE, """
SELECT COUNT(*) AS registros_leidos, COUNT(*) FILTER (WHERE estado = 'OK') AS registros_validos,
       COUNT(*) FILTER (WHERE estado = 'ERROR') AS registros_rechazados FROM vq""", [])
q("quality_rejects", V_CTE, """
SELECT fecha, producto, hoja_origen, precio_mayorista, precio_minorista, precio_analisis, error
FROM vq WHERE estado = 'ERROR'""", ["precio_mayorista", "precio_minorista", "precio_analisis"])
_NN = "(CAST({a} IS NOT NULL AS INTEGER) + CAST({b} IS NOT NULL AS INTEGER))"
_MEAN2 = ("CASE WHEN " + _NN + " > 0 THEN (COALESCE({a}, 0) + COALESCE({b}, 0)) / " + _NN + " END")
q("etl_row_metrics", V_CTE, f"""
SELECT fecha, producto, hoja_origen,
       {_MEAN2.format(a='may_prom', b='min_prom')} AS precio_unitario,
       min_prom - may_prom AS diferencia_precio,
       {_MEAN2.format(a='(may_max - may_min)', b='(min_max - min_min)')} AS variacion_precio
FROM vq WHERE estado = 'OK'""", ["precio_unitario", "diferencia_precio", "variacion_precio"])
q("facts_raw", F_CTE, "SELECT * FROM fr", FACT_D)
q("facts_normalised", F_CTE, "SELECT * FROM fn", FACT_D)
q("standardise_columns", F_CTE, """
SELECT fecha AS "Fecha", producto AS "Producto", tipo_venta, precio_minimo, precio_promedio, precio_maximo,
       variacion_precio FROM s""", ["precio_minimo", "precio_promedio", "precio_maximo", "variacion_precio"])
q("calendar_columns", F_CTE, f"""
SELECT fecha, day(fecha) AS dia, month(fecha) AS mes, {MONTHS}[month(fecha)] AS nombre_mes, year(fecha) AS anio
FROM (SELECT DISTINCT fecha FROM s) d""", [])

# ------------------------------------------------------------------ metrics (s over W)
KPI = """SELECT AVG(precio_promedio) AS precio_promedio_general, MAX(precio_maximo) AS precio_maximo_registrado,
       MIN(precio_minimo) AS precio_minimo_registrado, AVG(variacion_precio) AS variacion_promedio FROM s"""
KPI_D = ["precio_promedio_general", "precio_maximo_registrado", "precio_minimo_registrado", "variacion_promedio"]
q("kpis_global", F_CTE, KPI, KPI_D)
q("kpi_product_count", F_CTE, "SELECT COUNT(DISTINCT producto) AS total_productos_catalogados FROM s", [])
q("kpi_table", F_CTE + ",\nk AS (" + KPI + ")", f"""
SELECT CAST(1 AS BIGINT) AS kpi_key, 'Precio Promedio General' AS nombre_kpi,
       {srs('precio_promedio_general', 2)} AS valor, 'Mantener estabilidad de precios' AS meta FROM k
UNION ALL SELECT 2, 'Precio Maximo Registrado', {srs('precio_maximo_registrado', 2)},
       'Identificar precios elevados' FROM k
UNION ALL SELECT 3, 'Precio Minimo Registrado', {srs('precio_minimo_registrado', 2)},
       'Identificar precios bajos' FROM k
UNION ALL SELECT 4, 'Variacion Promedio', {srs('variacion_promedio', 2)},
       'Monitorear el rango maximo - minimo' FROM k""", ["valor"])
q("avg_by_product", F_CTE, "SELECT producto, AVG(precio_promedio) AS precio_promedio FROM s "
                           "WHERE producto IS NOT NULL GROUP BY producto", ["precio_promedio"])
q("avg_by_channel", F_CTE, "SELECT tipo_venta, AVG(precio_promedio) AS precio_promedio FROM s "
                           "WHERE tipo_venta IS NOT NULL GROUP BY tipo_venta", ["precio_promedio"])
q("avg_by_date", F_CTE, "SELECT fecha, AVG(precio_promedio) AS precio_promedio FROM s "
                        "WHERE fecha IS NOT NULL GROUP BY fecha", ["precio_promedio"])
q("variation_by_date", F_CTE, "SELECT fecha, AVG(variacion_precio) AS variacion_promedio FROM s "
                              "WHERE fecha IS NOT NULL GROUP BY fecha", ["variacion_promedio"])
q("channel_gap_by_date", F_CTE, """
SELECT fecha, precio_mayorista, precio_minorista, precio_minorista - precio_mayorista AS diferencia FROM (
  SELECT fecha, AVG(CASE WHEN tipo_venta = 'Mayorista' THEN precio_promedio END) AS precio_mayorista,
         AVG(CASE WHEN tipo_venta = 'Minorista' THEN precio_promedio END) AS precio_minorista
  FROM s WHERE fecha IS NOT NULL GROUP BY fecha) p
WHERE precio_mayorista IS NOT NULL AND precio_minorista IS NOT NULL""",
  ["precio_mayorista", "precio_minorista", "diferencia"])
q("channel_gap_by_date_sql", F_CTE, """
SELECT fecha, AVG(CASE WHEN tipo_venta = 'Minorista' THEN precio_promedio END)
            - AVG(CASE WHEN tipo_venta = 'Mayorista' THEN precio_promedio END) AS diferencia,
       CAST(fecha - DATE '2000-01-01' AS DOUBLE) AS x
FROM s GROUP BY fecha""", ["diferencia", "x"])
q("avg_by_product_date", F_CTE, "SELECT producto, fecha, AVG(precio_promedio) AS precio_promedio FROM s "
                                "WHERE producto IS NOT NULL AND fecha IS NOT NULL GROUP BY producto, fecha",
  ["precio_promedio"])
q("ranking_detail", F_CTE, """
SELECT producto, tipo_venta, unidad, MIN(precio_minimo) AS precio_minimo, AVG(precio_promedio) AS precio_promedio,
       MAX(precio_maximo) AS precio_maximo, AVG(variacion_precio) AS variacion_precio
FROM s WHERE producto IS NOT NULL AND tipo_venta IS NOT NULL AND unidad IS NOT NULL
GROUP BY producto, tipo_venta, unidad""", ["precio_minimo", "precio_promedio", "precio_maximo", "variacion_precio"])
q("ranking_products", F_CTE, """
SELECT producto, precio_promedio,
       CAST(row_number() OVER (ORDER BY precio_promedio DESC, producto) AS BIGINT) AS ranking
FROM (SELECT producto, AVG(precio_promedio) AS precio_promedio FROM s
      WHERE producto IS NOT NULL GROUP BY producto) a""", ["precio_promedio"])
q("ranking_with_variation", F_CTE, f"""
SELECT CAST(row_number() OVER (ORDER BY precio DESC, producto) AS BIGINT) AS ranking, producto AS mercado,
       'Mayorista / Minorista' AS tipo, {srs('precio', 2)} AS precio,
       COALESCE({srs('variacion', 2)}, CAST(0 AS DOUBLE)) AS variacion
FROM (SELECT producto, AVG(precio_prom) AS precio, AVG(variacion_precio) AS variacion FROM fr
      WHERE producto IS NOT NULL GROUP BY producto ORDER BY precio DESC, producto LIMIT 10) t""",
  ["precio", "variacion"])
q("ranking_channels_seen", REC, """
SELECT producto, array_to_string(list_sort(list_distinct(list(tipo_precio))), ', ') AS canales
FROM rec WHERE producto IS NOT NULL GROUP BY producto""", [])
q("group_average", REC, """
SELECT COALESCE(NULLIF(CAST(unidad AS VARCHAR), ''), 'Sin datos') AS etiqueta, AVG(precio_analisis) AS valor
FROM rec WHERE precio_analisis IS NOT NULL GROUP BY 1""", ["valor"])
q("channel_columns_avg", REC, """
SELECT COALESCE(AVG(precio_mayorista), CAST(0 AS DOUBLE)) AS promedio_mayorista,
       COALESCE(AVG(precio_minorista), CAST(0 AS DOUBLE)) AS promedio_minorista FROM rec""",
  ["promedio_mayorista", "promedio_minorista"])
q("kpis_filtered", REC, """
SELECT COALESCE(AVG(precio_analisis), CAST(0 AS DOUBLE)) AS precio_promedio,
       COALESCE(MAX(precio_max), CAST(0 AS DOUBLE)) AS precio_maximo,
       COALESCE(MIN(precio_min), CAST(0 AS DOUBLE)) AS precio_minimo,
       COALESCE(AVG(variacion_precio), CAST(0 AS DOUBLE)) AS variacion_promedio
FROM rec WHERE fecha >= '1996-01-01' AND tipo_precio IN ('Minorista') AND unidad IN ('Kilogramo')""",
  ["precio_promedio", "precio_maximo", "precio_minimo", "variacion_promedio"])
q("fact_counts", F_CTE, """
SELECT (SELECT COUNT(*) FROM vq) AS registros_leidos,
       (SELECT COUNT(*) FROM vq WHERE estado = 'OK') AS registros_validos,
       (SELECT COUNT(*) FROM vq WHERE estado = 'ERROR') AS registros_rechazados,
       (SELECT COUNT(*) FROM fn) AS hechos""", [])
q("product_frequency", F_CTE, """
SELECT producto, COUNT(precio_prom) AS n_hechos FROM fr WHERE producto IS NOT NULL GROUP BY producto
ORDER BY n_hechos DESC, producto LIMIT 10""", [])
DAILY = F_CTE + """,
daily AS (SELECT producto, fecha, AVG(precio_promedio) AS y FROM s
          WHERE producto IS NOT NULL AND fecha IS NOT NULL GROUP BY producto, fecha)"""
q("product_series", DAILY, f"""
SELECT producto, list(fecha ORDER BY fecha) AS fechas, list({srs('y', 2)} ORDER BY fecha) AS precios
FROM daily GROUP BY producto""", [])
q("last_and_previous", DAILY, """
SELECT producto, precio_actual, COALESCE(prev, precio_actual) AS precio_anterior,
       CASE WHEN COALESCE(prev, precio_actual) <> 0
            THEN (precio_actual - COALESCE(prev, precio_actual)) / COALESCE(prev, precio_actual) * 100
            ELSE CAST(0 AS DOUBLE) END AS variacion_pct
FROM (SELECT producto, MAX(CASE WHEN rn = 1 THEN y END) AS precio_actual, MAX(CASE WHEN rn = 2 THEN y END) AS prev
      FROM (SELECT *, row_number() OVER (PARTITION BY producto ORDER BY fecha DESC) AS rn FROM daily) r
      WHERE rn <= 2 GROUP BY producto) g""", ["precio_actual", "precio_anterior", "variacion_pct"])
q("dashboard_records", REC, "SELECT * FROM rec", REC_D)


def _money(c: str) -> str:
    return f"COALESCE('S/ ' || printf('%.2f', {sr(c, 2)}), '-') AS {c}"


q("format_money", F_CTE + ",\nk AS (" + KPI + ")",
  "SELECT " + ", ".join(_money(c) for c in KPI_D) + " FROM k", [])

# ------------------------------------------------------------------ filters
q("filter_dashboard", F_CTE, """
SELECT * FROM s WHERE fecha BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND tipo_venta IN ('Minorista')""",
  SEM_D)
q("filter_units", REC, """
SELECT * FROM rec WHERE fecha <= '1997-06-30' AND tipo_precio IN ('Mayorista', 'Minorista')
  AND unidad IN ('Kilogramo', 'Sin unidad')""", REC_D)
q("filter_domains", REC, """
SELECT 'fecha_min' AS dominio, MIN(fecha) AS valor FROM rec
UNION ALL SELECT 'fecha_max', MAX(fecha) FROM rec
UNION ALL SELECT DISTINCT 'producto', trim(producto) FROM rec WHERE producto IS NOT NULL
UNION ALL SELECT DISTINCT 'tipo', trim(tipo_precio) FROM rec WHERE tipo_precio IS NOT NULL
UNION ALL SELECT DISTINCT 'unidad', trim(unidad) FROM rec WHERE unidad IS NOT NULL""", [])
q("product_search", F_CTE, """
SELECT DISTINCT producto FROM s WHERE producto IS NOT NULL AND contains(lower(producto), 'an')""", [])

# ------------------------------------------------------------------ warehouse
DIMU = F_CTE + """,
du AS (SELECT unidad, tipo_venta, MIN(equivalencia) AS eq FROM fn GROUP BY unidad, tipo_venta)"""
SEMANTIC = f"""
SELECT f.producto, f.fecha, day(f.fecha) AS dia, month(f.fecha) AS mes, {MONTHS}[month(f.fecha)] AS nombre_mes,
       year(f.fecha) AS anio, f.unidad, {sr('du.eq', 4)} AS equivalencia, f.tipo_venta,
       {sr('f.precio_min', 2)} AS precio_minimo, {sr('f.precio_prom', 2)} AS precio_promedio,
       {sr('f.precio_max', 2)} AS precio_maximo,
       CAST(CAST({sr('f.precio_max', 2)} AS DECIMAL(18,2)) - CAST({sr('f.precio_min', 2)} AS DECIMAL(18,2))
            AS DOUBLE) AS variacion_precio
FROM fn f JOIN du ON f.unidad = du.unidad AND f.tipo_venta = du.tipo_venta"""
q("semantic_view", DIMU, SEMANTIC, SEM_D)
q("semantic_between", DIMU, SEMANTIC + " WHERE f.fecha BETWEEN DATE '1995-06-15' AND DATE '1996-03-31'", SEM_D)
q("source_choice", F_CTE, f"""
SELECT 'con sesion' AS caso, tipo_venta, COUNT(*) AS filas, AVG(precio_prom) AS precio_promedio FROM fn
WHERE tipo_venta = 'Minorista' GROUP BY tipo_venta
UNION ALL
SELECT caso, tipo_venta, COUNT(*), AVG({sr('precio_prom', 2)}) FROM fn, (VALUES ('sesion vacia'), ('sin sesion')) c(caso)
GROUP BY caso, tipo_venta""", ["precio_promedio"])
q("catalog_views", F_CTE, f"""
, st AS (SELECT producto, fecha, tipo_venta, {sr('precio_prom', 2)} AS p, {sr('precio_max', 2)} AS hi,
                CAST(CAST({sr('precio_max', 2)} AS DECIMAL(18,2)) - CAST({sr('precio_min', 2)} AS DECIMAL(18,2)) AS DOUBLE) AS v
         FROM fn),
  rk AS (SELECT producto, AVG(p) AS m, row_number() OVER (ORDER BY AVG(p) DESC, producto) AS n FROM st GROUP BY producto)
SELECT 'vw_capa_semantica_bi' AS vista, CAST(year(fecha) AS VARCHAR) AS clave, CAST(COUNT(*) AS DOUBLE) AS valor, AVG(hi) AS valor2
FROM st GROUP BY year(fecha)
UNION ALL SELECT 'vw_kpis_precios', 'kpi', AVG(p), AVG(v) FROM st
UNION ALL SELECT 'vw_ranking_productos', producto, m, CAST(n AS DOUBLE) FROM rk
UNION ALL SELECT 'vw_grafico_barras_top10', producto, m, CAST(n AS DOUBLE) FROM rk WHERE n <= 10
UNION ALL SELECT 'vw_grafico_circular', tipo_venta, AVG(p), NULL FROM st GROUP BY tipo_venta
UNION ALL SELECT 'vw_grafico_lineas', CAST(fecha AS VARCHAR), AVG(p), NULL FROM st GROUP BY fecha""".lstrip(), ["valor", "valor2"])
q("dim_producto", F_CTE, """
SELECT CAST(row_number() OVER (ORDER BY producto) AS BIGINT) AS id_producto, producto
FROM (SELECT DISTINCT producto FROM fn WHERE producto IS NOT NULL) d""", [])
q("dim_tipo_venta", F_CTE, """
SELECT CAST(row_number() OVER (ORDER BY tipo_venta) AS BIGINT) AS id_tipo_venta, tipo_venta
FROM (SELECT DISTINCT tipo_venta FROM fn) d""", [])
q("dim_tiempo", F_CTE, f"""
SELECT fecha, day(fecha) AS dia, month(fecha) AS mes, {MONTHS}[month(fecha)] AS nombre_mes, year(fecha) AS anio
FROM (SELECT DISTINCT fecha FROM fn WHERE fecha IS NOT NULL) d""", [])
q("dim_unidad", DIMU, f"SELECT unidad, tipo_venta, {sr('eq', 4)} AS equivalencia FROM du", ["equivalencia"])
q("dim_upsert", F_CTE, """
, first AS (SELECT DISTINCT producto FROM fn WHERE fecha < DATE '1998-01-01' AND producto IS NOT NULL),
  n1 AS (SELECT COUNT(*) AS c FROM first)
SELECT producto, CAST(row_number() OVER (ORDER BY producto) AS BIGINT) AS id_producto, 'existente' AS origen
FROM first
UNION ALL
SELECT producto, CAST((SELECT c FROM n1) + row_number() OVER (ORDER BY producto) AS BIGINT), 'nuevo'
FROM (SELECT DISTINCT producto FROM fn WHERE producto IS NOT NULL
      EXCEPT SELECT producto FROM first) nw""".lstrip(), [])
q("dim_lookup", F_CTE, """
SELECT tipo_venta, unidad, COUNT(*) AS hechos, COUNT(DISTINCT producto) AS productos,
       COUNT(DISTINCT fecha) AS fechas FROM fn GROUP BY tipo_venta, unidad""", [])


def _dec_sum(c: str) -> str:
    return f"CAST(SUM(CAST({sr(c, 2)} AS DECIMAL(18,2))) AS DOUBLE)"


q("kpi_incremental", F_CTE, f"""
, st AS (SELECT producto, fecha, tipo_venta, {sr('precio_prom', 2)} AS p, {sr('precio_max', 2)} AS hi, {sr('precio_min', 2)} AS lo FROM fn)
SELECT 'Precio Promedio General' AS clave, '' AS fecha, '' AS tipo_venta, {srs('AVG(p)', 2)} AS valor FROM st
UNION ALL SELECT 'Precio Maximo Registrado', '', '', MAX(hi) FROM st
UNION ALL SELECT 'Precio Minimo Registrado', '', '', MIN(lo) FROM st
UNION ALL SELECT 'Variacion Promedio', '', '', {srs('AVG(hi - lo)', 2)} FROM st
UNION ALL SELECT producto, CAST(CAST(fecha AS DATE) AS VARCHAR), tipo_venta, AVG(p) FROM st GROUP BY producto, fecha, tipo_venta""",
  ["valor"])
q("fact_load", F_CTE, f"""
SELECT COUNT(*) AS hechos, COUNT(*) AS ids_distintos, {_dec_sum('precio_prom')} AS suma_precio_prom,
       {_dec_sum('precio_min')} AS suma_precio_min, {_dec_sum('precio_max')} AS suma_precio_max FROM fn""",
  ["suma_precio_prom", "suma_precio_min", "suma_precio_max"])
q("staging_rows", V_CTE, f"""
SELECT fecha AS fecha_registro, producto AS producto_nombre,
       COALESCE(NULLIF(unidad_min, ''), NULLIF(unidad_may, ''), 'Sin unidad') AS unidad_medida,
       {sr('precio_mayorista', 2)} AS precio_mayorista_orig, {sr('precio_minorista', 2)} AS precio_minorista_orig,
       hoja_origen
FROM vq WHERE estado = 'OK'""", ["precio_mayorista_orig", "precio_minorista_orig"])
# The last product, February, the months of 1996, the year 1997, the wholesale channel and the default unit are
# removed from their dimensions; products before 'c' and all other units are entered twice.
FK = F_CTE + """,
days AS (SELECT DISTINCT fecha FROM fn WHERE month(fecha) <> 2),
months AS (SELECT DISTINCT year(fecha) AS y, month(fecha) AS m FROM fn WHERE year(fecha) <> 1996),
years AS (SELECT DISTINCT year(fecha) AS y FROM fn WHERE year(fecha) <> 1997),
goods AS (SELECT DISTINCT producto FROM fn),
units AS (SELECT DISTINCT unidad, tipo_venta FROM fn WHERE unidad <> 'Sin unidad'),
stored AS (SELECT producto FROM goods WHERE producto <> (SELECT MAX(producto) FROM goods)
           UNION ALL SELECT producto FROM goods WHERE producto < 'c'),
stored_units AS (SELECT * FROM units UNION ALL SELECT * FROM units)"""
q("fk_check", FK, """
SELECT 'fact_precios.id_producto' AS restriccion, COUNT(*) AS violaciones FROM fn
WHERE producto = (SELECT MAX(producto) FROM goods)
UNION ALL SELECT 'fact_precios.id_tiempo', COUNT(*) FROM fn WHERE fecha NOT IN (SELECT fecha FROM days)
UNION ALL SELECT 'fact_precios.id_unidad', COUNT(*) FROM fn WHERE unidad = 'Sin unidad'
UNION ALL SELECT 'fact_precios.id_tipo_venta', COUNT(*) FROM fn WHERE tipo_venta = 'Mayorista'
UNION ALL SELECT 'dim_tiempo.id_mes', COUNT(*) FROM days LEFT JOIN months
          ON y = year(fecha) AND m = month(fecha) WHERE y IS NULL
UNION ALL SELECT 'dim_mes.id_anio', COUNT(*) FROM months WHERE y NOT IN (SELECT y FROM years)
UNION ALL SELECT 'dim_unidad.id_tipo_venta', COUNT(*) FROM stored_units WHERE tipo_venta = 'Mayorista'
UNION ALL SELECT 'dim_producto(producto)', COUNT(*) FROM (SELECT 1 FROM stored GROUP BY producto HAVING COUNT(*) > 1) a
UNION ALL SELECT 'dim_anio(anio)', COUNT(*) FROM (SELECT 1 FROM years GROUP BY y HAVING COUNT(*) > 1) b
UNION ALL SELECT 'dim_mes(id_anio,mes)', COUNT(*) FROM (SELECT 1 FROM months GROUP BY y, m HAVING COUNT(*) > 1) c
UNION ALL SELECT 'dim_tiempo(fecha)', COUNT(*) FROM (SELECT 1 FROM days GROUP BY fecha HAVING COUNT(*) > 1) d
UNION ALL SELECT 'dim_tipo_venta(tipo_venta)', COUNT(*) FROM (SELECT tipo_venta FROM (SELECT DISTINCT tipo_venta
          FROM fn WHERE tipo_venta <> 'Mayorista') t GROUP BY 1 HAVING COUNT(*) > 1) e
UNION ALL SELECT 'dim_unidad(unidad,id_tipo_venta)', COUNT(*) FROM (SELECT 1 FROM stored_units
          GROUP BY unidad, tipo_venta HAVING COUNT(*) > 1) f""", [])
ORACLE["schema_check"] = """
SELECT * FROM (VALUES ('stg_precios_raw', 6, '', true), ('dim_producto', 2, '', true), ('dim_anio', 2, '', true),
  ('dim_mes', 4, '', true), ('dim_tiempo', 4, '', true), ('dim_tipo_venta', 2, '', true),
  ('dim_unidad', 4, 'equivalencia', false), ('fact_precios', 8, '', true), ('fact_kpis', 5, '', true))
  AS t(tabla, requeridas, faltantes, ok)"""


# ------------------------------------------------------------------ ordinal forecasts
def fit_sql(series: str, keys: str = "") -> str:
    """Ordinal fit of a (keys, fecha, y) series: n, slope, intercept, last_y, last_fecha."""
    part = f"PARTITION BY {keys} " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"""(SELECT {sel}COUNT(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
       arg_max(y, x) AS last_y, MAX(fecha) AS last_fecha
  FROM (SELECT *, CAST(row_number() OVER ({part}ORDER BY fecha) - 1 AS DOUBLE) AS x
        FROM {series} WHERE y IS NOT NULL) p {grp})"""


def proj(h: str, clamp: bool = True, p: str = "") -> str:
    line = f"{p}intercept + {p}slope * ({p}n - 1 + {h})"
    if clamp:
        line = f"GREATEST(CAST(0 AS DOUBLE), {line})"
    return f"(CASE WHEN {p}n IS NULL OR {p}n = 0 THEN CAST(0 AS DOUBLE) WHEN {p}n = 1 THEN {p}last_y ELSE {line} END)"


FC = F_CTE + """,
daily AS (SELECT producto, fecha, AVG(precio_promedio) AS y FROM s
          WHERE producto IS NOT NULL AND fecha IS NOT NULL GROUP BY producto, fecha),
gday AS (SELECT fecha, AVG(precio_promedio) AS y FROM s WHERE fecha IS NOT NULL GROUP BY fecha),
vday AS (SELECT fecha, AVG(variacion_precio) AS y FROM s WHERE fecha IS NOT NULL GROUP BY fecha),
gapday AS (SELECT fecha, y FROM (SELECT fecha, AVG(CASE WHEN tipo_venta = 'Minorista' THEN precio_promedio END)
             - AVG(CASE WHEN tipo_venta = 'Mayorista' THEN precio_promedio END) AS y
           FROM s WHERE fecha IS NOT NULL GROUP BY fecha) t WHERE y IS NOT NULL),
pf AS """ + fit_sql("daily", "producto") + """,
inc AS (SELECT producto, last_y AS precio_actual, """ + proj("8") + """ AS precio_predicho,
               """ + proj("8") + """ - last_y AS incremento_esperado FROM pf),
top1 AS (SELECT producto FROM inc ORDER BY incremento_esperado DESC, producto LIMIT 1),
gf AS """ + fit_sql("gday") + """,
vf AS """ + fit_sql("vday") + """,
xf AS """ + fit_sql("gapday") + """,
lastd AS (SELECT MAX(fecha) AS ultima_fecha FROM s),
wk AS (SELECT CAST(range AS BIGINT) AS semana FROM range(1, 9))"""

for name, h, clamp in (("project_ordinal", "8", True), ("project_ordinal_unclamped", "8", False),
                       ("project_one_step", "1", True)):
    q(name, FC, f"""
SELECT producto, n AS n_puntos, last_y AS valor_actual, {proj(h, clamp)} AS valor_proyectado FROM pf""",
      ["valor_actual", "valor_proyectado"])
q("increments", FC, """
SELECT *, CAST(row_number() OVER (ORDER BY incremento_esperado DESC, producto) AS BIGINT) AS ranking FROM inc""",
  ["precio_actual", "precio_predicho", "incremento_esperado"])
q("increments_raw_rows", F_CTE, """
, rr AS (SELECT producto, precio_promedio AS y,
               CAST(row_number() OVER (PARTITION BY producto ORDER BY fecha, tipo_venta, precio_promedio) - 1
                    AS DOUBLE) AS x
        FROM s WHERE producto IS NOT NULL AND fecha IS NOT NULL AND precio_promedio IS NOT NULL),
  rf AS (SELECT producto, COUNT(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
                arg_max(y, x) AS last_y FROM rr GROUP BY producto HAVING COUNT(*) >= 2),
  ri AS (SELECT producto, last_y AS precio_actual, intercept + slope * (n - 1 + 8) AS precio_predicho,
                intercept + slope * (n - 1 + 8) - last_y AS incremento_esperado FROM rf)
SELECT *, CAST(row_number() OVER (ORDER BY incremento_esperado DESC, producto) AS BIGINT) AS ranking FROM ri""".lstrip(),
  ["precio_actual", "precio_predicho", "incremento_esperado"])
q("top_increment", FC, """
SELECT COALESCE((SELECT producto FROM inc ORDER BY incremento_esperado DESC, producto LIMIT 1), 'Sin datos')
         AS producto_mayor_incremento,
       COALESCE((SELECT incremento_esperado FROM inc ORDER BY incremento_esperado DESC, producto LIMIT 1),
                CAST(0 AS DOUBLE)) AS incremento_esperado""", ["incremento_esperado"])
q("top_increment_path", FC, f"""
SELECT pf.producto, wk.semana, CAST(pf.last_fecha + CAST(7 * wk.semana AS INTEGER) AS DATE) AS fecha_prediccion,
       {proj('wk.semana', True, 'pf.')} AS precio_proyectado
FROM pf JOIN top1 ON pf.producto = top1.producto, wk""", ["precio_proyectado"])
WEEKLY = "CAST(lastd.ultima_fecha + CAST(7 * wk.semana AS INTEGER) AS DATE)"
q("forecast_weeks", FC, f"""
SELECT wk.semana, {WEEKLY} AS fecha_prediccion, {proj('wk.semana', True, 'gf.')} AS precio_promedio_futuro
FROM lastd, wk LEFT JOIN gf ON true WHERE lastd.ultima_fecha IS NOT NULL""", ["precio_promedio_futuro"])
q("forecast_variation", FC, f"""
SELECT wk.semana, {WEEKLY} AS fecha_prediccion, {proj('wk.semana', True, 'vf.')} AS tendencia_variacion
FROM lastd, wk LEFT JOIN vf ON true WHERE lastd.ultima_fecha IS NOT NULL""", ["tendencia_variacion"])
q("forecast_gap", FC, f"""
SELECT wk.semana, {WEEKLY} AS fecha_prediccion, {proj('wk.semana', True, 'xf.')} AS diferencia_futura
FROM lastd, wk LEFT JOIN xf ON true WHERE lastd.ultima_fecha IS NOT NULL""", ["diferencia_futura"])
q("forecast_table", FC, f"""
SELECT wk.semana, {WEEKLY} AS fechaprediccion, {proj('wk.semana', True, 'gf.')} AS preciopromediofuturo,
       {proj('wk.semana', True, 'vf.')} AS tendenciavariacion,
       {proj('wk.semana', True, 'xf.')} AS diferenciamayoristaminoristafutura,
       COALESCE((SELECT producto FROM top1), 'Sin datos') AS productomayorincremento
FROM lastd, wk LEFT JOIN gf ON true LEFT JOIN vf ON true LEFT JOIN xf ON true
WHERE lastd.ultima_fecha IS NOT NULL""", ["preciopromediofuturo", "tendenciavariacion",
                                          "diferenciamayoristaminoristafutura"])
q("history_plus_forecast", FC, f"""
SELECT fecha, y AS valor, 'Historico' AS tipo FROM gday
UNION ALL
SELECT {WEEKLY}, {proj('wk.semana', True, 'gf.')}, 'Proyectado' FROM lastd, wk LEFT JOIN gf ON true
WHERE lastd.ultima_fecha IS NOT NULL
UNION ALL
SELECT last_fecha, last_y, 'Proyectado' FROM gf""", ["valor"])

q("history_plus_forecast_range", FC, f"""
SELECT fecha, y AS valor, 'Historico' AS tipo FROM vday
UNION ALL
SELECT {WEEKLY}, {proj('wk.semana', True, 'vf.')}, 'Proyectado' FROM lastd, wk LEFT JOIN vf ON true
WHERE lastd.ultima_fecha IS NOT NULL""", ["valor"])
q("history_plus_forecast_gap", FC, f"""
SELECT fecha, y AS valor, 'Historico' AS tipo FROM gapday
UNION ALL
SELECT {WEEKLY}, {proj('wk.semana', True, 'xf.')}, 'Proyectado' FROM lastd, wk LEFT JOIN xf ON true
WHERE lastd.ultima_fecha IS NOT NULL
UNION ALL
SELECT last_fecha, last_y, 'Proyectado' FROM xf""", ["valor"])
q("history_plus_forecast_top", FC, f"""
SELECT fecha, y AS valor, 'Historico' AS tipo FROM daily JOIN top1 USING (producto)
UNION ALL
SELECT CAST(pf.last_fecha + CAST(7 * wk.semana AS INTEGER) AS DATE), {proj('wk.semana', True, 'pf.')}, 'Proyectado'
FROM pf JOIN top1 ON pf.producto = top1.producto, wk
UNION ALL
SELECT last_fecha, last_y, 'Proyectado' FROM pf JOIN top1 ON pf.producto = top1.producto""", ["valor"])

# ------------------------------------------------------------------ date-axis forecasts
# A least-squares line through daily means is mean(y) + slope * (t - mean(t)), t counted in days from any origin.
DAY = "CAST(date_diff('day', DATE '1970-01-01', fecha) AS DOUBLE)"
AHEAD = "CAST(DATE '1970-01-01' + CAST(hi + 7 * k AS INTEGER) AS DATE) AS fecha_prediccion"
q("forecast_date_axis", F_CTE, f"""
, daily AS (SELECT {DAY} AS t, AVG(precio_promedio) AS y, AVG(variacion_precio) AS v FROM s GROUP BY fecha),
  m AS (SELECT MAX(t) AS hi, AVG(t) AS mt, AVG(y) AS my, AVG(v) AS mv, regr_slope(y, t) AS by_day,
               (SUM(t * v) - AVG(t) * SUM(v) - AVG(v) * SUM(t) FILTER (v IS NOT NULL) + COUNT(v) * AVG(t) * AVG(v))
                 / NULLIF(COUNT(t) * VAR_POP(t), 0) AS bv_day FROM daily)
SELECT {AHEAD}, my + by_day * (hi + 7 * k - mt) AS precio_promedio_futuro,
       mv + bv_day * (hi + 7 * k - mt) AS tendencia_variacion
FROM m, range(1, 9) AS weeks(k)""".lstrip(), ["precio_promedio_futuro", "tendencia_variacion"])
q("forecast_product_date_axis", F_CTE, f"""
, daily AS (SELECT producto, fecha, {DAY} AS t, AVG(precio_promedio) AS y FROM s
            WHERE producto IS NOT NULL AND fecha IS NOT NULL GROUP BY producto, fecha),
  line AS (SELECT producto, arg_max(y, t) AS now, AVG(y) + regr_slope(y, t) * (MAX(t) + 56 - AVG(t)) AS later
           FROM daily GROUP BY producto HAVING COUNT(*) >= 2)
SELECT producto, now AS precio_actual, later AS precio_futuro, later - now AS incremento_esperado,
       CAST(row_number() OVER (ORDER BY later - now DESC, producto) AS BIGINT) AS ranking_incremento
FROM line""".lstrip(), ["precio_actual", "precio_futuro", "incremento_esperado"])
q("forecast_gap_date_axis", F_CTE, f"""
, channel AS (SELECT fecha, tipo_venta, AVG(precio_promedio) AS y FROM s GROUP BY fecha, tipo_venta),
  gap AS (SELECT {DAY.replace("fecha", "a.fecha")} AS t, a.y - b.y AS y FROM channel a JOIN channel b
          ON a.fecha = b.fecha AND a.tipo_venta = 'Minorista' AND b.tipo_venta = 'Mayorista'),
  m AS (SELECT MAX(t) AS hi, AVG(t) AS mt, AVG(y) AS my, regr_slope(y, t) AS by_day FROM gap WHERE y IS NOT NULL)
SELECT {AHEAD}, my + by_day * (hi + 7 * k - mt) AS diferencia_futura
FROM m, range(1, 9) AS weeks(k)""".lstrip(), ["diferencia_futura"])
q("result_tables", FC, f"""
SELECT 'ranking' AS tabla, CAST(row_number() OVER (ORDER BY incremento_esperado DESC, producto) AS BIGINT) AS fila, producto,
       CAST(NULL AS DATE) AS fecha, precio_actual AS valor1, precio_predicho AS valor2, incremento_esperado AS valor3 FROM inc
UNION ALL
SELECT 'prediccion', CAST(wk.semana AS BIGINT), COALESCE((SELECT producto FROM top1), 'Sin datos'), {WEEKLY},
       {proj('wk.semana', True, 'gf.')}, {proj('wk.semana', True, 'vf.')}, {proj('wk.semana', True, 'xf.')}
FROM lastd, wk LEFT JOIN gf ON true LEFT JOIN vf ON true LEFT JOIN xf ON true
WHERE lastd.ultima_fecha IS NOT NULL""", ["valor1", "valor2", "valor3"])

# ------------------------------------------------------------------ summaries over raw facts
FCR = FC.replace("FROM fn\n)", "FROM fr\n)", 1)
_PCT = ("CASE WHEN COALESCE(prev, last_y) <> 0 THEN (last_y - COALESCE(prev, last_y)) / COALESCE(prev, last_y) * 100 "
        "ELSE CAST(0 AS DOUBLE) END")
q("executive_summary", FCR, f"""
SELECT {srs("COALESCE((SELECT AVG(precio_predicho) FROM inc), CAST(0 AS DOUBLE))", 2)} AS precio_promedio_futuro,
       {srs(proj('8', True, 'vf.'), 2)} AS tendencia_variacion,
       COALESCE((SELECT producto FROM top1), 'Sin datos') AS producto_mayor_incremento,
       {srs(proj('8', True, 'xf.'), 2)} AS diferencia_futura_canales
FROM (SELECT 1) one LEFT JOIN vf ON true LEFT JOIN xf ON true""",
  ["precio_promedio_futuro", "tendencia_variacion", "diferencia_futura_canales"])
q("product_alerts", FCR, f"""
, top AS (SELECT producto FROM s WHERE producto IS NOT NULL GROUP BY producto
          ORDER BY COUNT(precio_promedio) DESC, producto LIMIT 10),
  tf AS (SELECT * FROM pf WHERE producto IN (SELECT producto FROM top)),
  pv AS (SELECT producto, y AS prev FROM (SELECT *, row_number() OVER (PARTITION BY producto ORDER BY fecha DESC)
         AS rn FROM daily WHERE y IS NOT NULL) r WHERE rn = 2),
  al AS (SELECT tf.*, pv.prev, {proj('8', True, 'tf.')} AS pred FROM tf LEFT JOIN pv ON tf.producto = pv.producto)
SELECT producto, {srs('last_y', 2)} AS precio_actual, {srs('pred', 2)} AS precio_predicho,
       {srs(_PCT, 2)} AS variacion_pct,
       CASE WHEN last_y <> 0 AND (pred - last_y) / last_y * 100 > 10 THEN 'Alza esperada >10%' ELSE 'Normal' END
         AS alerta,
       'Regresion lineal a 8 semanas' AS confianza
FROM al""".lstrip(), ["precio_actual", "precio_predicho", "variacion_pct"])

CLIENT = REC + """,
recd AS (SELECT * REPLACE (CAST(fecha AS DATE) AS fecha) FROM rec),
ctop AS (SELECT COALESCE(NULLIF(producto, ''), 'Sin datos') AS producto FROM recd WHERE precio_analisis IS NOT NULL
         GROUP BY 1 ORDER BY AVG(precio_analisis) DESC, 1 LIMIT 10),
cday AS (SELECT producto, fecha, """ + srs("AVG(precio_analisis)", 2) + """ AS y FROM recd
         WHERE precio_analisis IS NOT NULL AND producto IN (SELECT producto FROM ctop) GROUP BY producto, fecha),
cpf AS """ + fit_sql("cday", "producto") + """,
cfut AS (SELECT producto, """ + proj("1") + """ AS fut, """ + proj("1") + """ - last_y AS inc FROM cpf),
vser AS (SELECT fecha, AVG(variacion_precio) AS y FROM recd WHERE variacion_precio IS NOT NULL GROUP BY fecha),
mser AS (SELECT fecha, AVG(precio_mayorista) AS y FROM recd WHERE precio_mayorista IS NOT NULL GROUP BY fecha),
rser AS (SELECT fecha, AVG(precio_minorista) AS y FROM recd WHERE precio_minorista IS NOT NULL GROUP BY fecha),
cv AS """ + fit_sql("vser") + """,
cm AS """ + fit_sql("mser") + """,
cr AS """ + fit_sql("rser") + """,
one AS (SELECT """ + proj("1", True, "cv.") + """ AS tendencia, """ + proj("1", True, "cm.") + """ AS fm,
               """ + proj("1", True, "cr.") + """ AS fr_ FROM (SELECT 1) o LEFT JOIN cv ON true
        LEFT JOIN cm ON true LEFT JOIN cr ON true)"""
q("client_summary", CLIENT, """
SELECT COALESCE((SELECT AVG(fut) FROM cfut), CAST(0 AS DOUBLE)) AS precio_futuro, tendencia,
       COALESCE((SELECT producto FROM cfut ORDER BY inc DESC, producto LIMIT 1), 'Sin datos') AS producto_incremento,
       CASE WHEN fm <> 0 AND fr_ <> 0 THEN fr_ - fm ELSE CAST(0 AS DOUBLE) END AS diferencia_canales
FROM one""", ["precio_futuro", "tendencia", "diferencia_canales"])

# ------------------------------------------------------------------ scale sales (E)
E_CTE = """
e AS (SELECT event_id, ts, CAST(user_id % 19 AS VARCHAR) AS mercado,
             CASE WHEN user_id % 2 = 0 THEN 'Mayorista' ELSE 'Minorista' END AS canal,
             event_type AS producto, CAST(event_id % 76 + 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS peso,
             value AS precio FROM events),
cat AS (SELECT * FROM (VALUES ('Papa', 2.50, 1.60, 'Saco', 50.0), ('Tomate', 4.50, 2.80, 'Cajón', 20.0),
          ('Cebolla', 3.00, 1.80, 'Saco', 45.0), ('Zanahoria', 3.80, 2.20, 'Saco', 50.0),
          ('Choclo', 5.00, 3.20, 'Ciento', 40.0))
        AS t(producto, precio_minorista, precio_mayorista, unidad_mayorista, equiv_mayorista))"""
BAND = {lo: sr(f"precio * CAST({f} AS DOUBLE)", 2) for lo, f in (("lo", "0.95"), ("hi", "1.05"))}
PAIRS = E_CTE + """,
sb AS (SELECT e.*, CAST(ts AS DATE) AS dia, COALESCE(c.unidad_mayorista, 'Saco') AS u_may,
              COALESCE(CAST(c.equiv_mayorista AS DOUBLE), CAST(50 AS DOUBLE)) AS eq_may
       FROM e LEFT JOIN cat c ON e.producto = c.producto WHERE peso > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY dia, producto, canal ORDER BY ts, event_id) - 1 AS k FROM sb),
wq AS (SELECT dia, producto, k, ts AS ts_w, event_id AS id_w, u_may AS unidad_may, eq_may AS equiv_may,
              """ + BAND["lo"] + """ AS may_min, precio AS may_prom, """ + BAND["hi"] + """ AS may_max
       FROM rk WHERE canal = 'Mayorista'),
rq AS (SELECT dia, producto, k, ts AS ts_r, event_id AS id_r, 'Kilogramo' AS unidad_min,
              CAST(1 AS DOUBLE) AS equiv_min, """ + BAND["lo"] + """ AS min_min, precio AS min_prom,
              """ + BAND["hi"] + """ AS min_max
       FROM rk WHERE canal <> 'Mayorista'),
pj AS (SELECT COALESCE(wq.producto, rq.producto) AS producto, wq.*, rq.* EXCLUDE (dia, producto, k),
              (rq.ts_r IS NULL OR (wq.ts_w IS NOT NULL AND (wq.ts_w < rq.ts_r OR (wq.ts_w = rq.ts_r AND wq.id_w < rq.id_r))))
                AS w_first
       FROM wq FULL OUTER JOIN rq ON wq.dia = rq.dia AND wq.producto = rq.producto AND wq.k = rq.k),
pairs AS (SELECT date_trunc('second', CASE WHEN w_first THEN ts_w ELSE ts_r END) AS fecha, producto,
                 unidad_may, equiv_may, may_min, may_prom, may_max, unidad_min, equiv_min, min_min, min_prom, min_max,
                 CASE WHEN w_first THEN ts_w ELSE ts_r END AS creado_ts,
                 CASE WHEN w_first THEN id_w ELSE id_r END AS creado_id
          FROM (SELECT * EXCLUDE (producto), producto AS producto FROM pj) z)"""
PAIR_OUT = ("fecha, producto, unidad_may, equiv_may, may_min, may_prom, may_max, unidad_min, equiv_min, "
            "min_min, min_prom, min_max")
PAIR_D = ["equiv_may", "may_min", "may_prom", "may_max", "equiv_min", "min_min", "min_prom", "min_max"]
q("scale_total", E_CTE, f"SELECT event_id, peso, precio, {sr('peso * precio', 2)} AS total FROM e WHERE peso > 0",
  ["peso", "precio", "total"])
q("scale_price_band", E_CTE, f"""
SELECT event_id, canal,
       CASE WHEN canal = 'Mayorista' THEN {BAND['lo']} END AS may_min,
       CASE WHEN canal = 'Mayorista' THEN precio END AS may_prom,
       CASE WHEN canal = 'Mayorista' THEN {BAND['hi']} END AS may_max,
       CASE WHEN canal <> 'Mayorista' THEN {BAND['lo']} END AS min_min,
       CASE WHEN canal <> 'Mayorista' THEN precio END AS min_prom,
       CASE WHEN canal <> 'Mayorista' THEN {BAND['hi']} END AS min_max
FROM e""", ["may_min", "may_prom", "may_max", "min_min", "min_prom", "min_max"])
CATP = E_CTE + """,
ep AS (SELECT e.* REPLACE (['Papa', 'Tomate', 'Cebolla', 'Zanahoria', 'Choclo', 'Camote'][event_id % 6 + 1]
                           AS producto) FROM e)"""
q("catalogue_price", CATP, """
SELECT ep.event_id, ep.producto, ep.canal,
       COALESCE(CAST(CASE WHEN ep.canal = 'Mayorista' THEN c.precio_mayorista ELSE c.precio_minorista END AS DOUBLE),
                CAST(0 AS DOUBLE)) AS precio_catalogo
FROM ep LEFT JOIN cat c ON ep.producto = c.producto""", ["precio_catalogo"])
q("scale_enrich", CATP, """
SELECT ep.event_id, ep.producto, COALESCE(c.unidad_mayorista, 'Saco') AS u_may,
       COALESCE(CAST(c.equiv_mayorista AS DOUBLE), CAST(50 AS DOUBLE)) AS eq_may, 'Kilogramo' AS u_min,
       CAST(1 AS DOUBLE) AS eq_min
FROM ep LEFT JOIN cat c ON ep.producto = c.producto""", ["eq_may", "eq_min"])
q("scale_pair_sales", PAIRS, f"SELECT {PAIR_OUT} FROM pairs", PAIR_D)
LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fecha, producto
             ORDER BY creado_ts DESC, creado_id DESC) AS rn FROM {src}) t WHERE rn = 1)"""
# Days before the 10th stay at twice the price, days from the 10th on have the arriving prices; the rows of
# the days before the 16th had ids and creation times, those after get new ones.  Bands follow the doubled price.
TWICE = {"lo": sr("precio * 2 * CAST(0.95 AS DOUBLE)", 2), "hi": sr("precio * 2 * CAST(1.05 AS DOUBLE)", 2)}
DOUBLED = PAIRS.replace("e AS (", "e AS (SELECT * REPLACE (CASE WHEN ts < TIMESTAMP '2024-01-10' THEN precio * 2 "
                        "ELSE precio END AS precio) FROM (", 1).replace("FROM events)", "FROM events) ev)", 1)
q("scale_upsert", DOUBLED + f""",
lp AS {LATEST.format(src='pairs')},
held AS (SELECT fecha, producto, row_number() OVER (ORDER BY fecha, producto) AS id_previo FROM lp
         WHERE fecha < TIMESTAMP '2024-01-16')""", f"""
SELECT {PAIR_OUT}, CAST(id_previo AS BIGINT) AS id_previo,
       CASE WHEN id_previo IS NOT NULL THEN fecha END AS alta_previa, CAST(1 AS BIGINT) AS filas_con_id
FROM lp LEFT JOIN held USING (fecha, producto)""", PAIR_D)
q("scale_upsert_stored", DOUBLED + f""",
lp AS {LATEST.format(src='pairs')}""", f"""
SELECT {PAIR_OUT}, CASE WHEN fecha < TIMESTAMP '2024-01-16' THEN true END AS conserva_alta, CAST(1 AS BIGINT) AS filas_con_id
FROM lp""", PAIR_D)
q("scale_recent", E_CTE, "SELECT event_id, ts, producto, canal, precio FROM e ORDER BY ts DESC, event_id DESC LIMIT 6",
  ["precio"])
q("scale_to_facts", PAIRS + """,
sv AS (SELECT CAST(fecha AS DATE) AS fecha, trim(producto) AS producto, unidad_may, equiv_may, may_min, may_prom,
              may_max, unidad_min, equiv_min, min_min, min_prom, min_max, 'Balanza' AS hoja_origen,
              COALESCE(min_prom, may_prom) AS precio_analisis
       FROM pairs WHERE fecha IS NOT NULL AND producto IS NOT NULL),
sok AS (SELECT * FROM sv WHERE length(producto) >= 3 AND precio_analisis IS NOT NULL AND precio_analisis > 0
        AND producto <> ''),
""" + facts_cte("sf", True, "sok"), "SELECT * FROM sf", FACT_D)
q("scale_headers", PAIRS, """
SELECT 'completo' AS historial, '' AS faltantes, COUNT(*) AS filas FROM pairs
UNION ALL SELECT 'incompleto', 'Mayorista - Precio Min., Mayorista - Precio Prom.', COUNT(*) FROM pairs""", [])
q("scale_history", PAIRS, f"SELECT {PAIR_OUT} FROM pairs", PAIR_D)

# The streamed table equals the latest version per key of the batch answer.
q("scale_stream", PAIRS, f"SELECT {PAIR_OUT} FROM {LATEST.format(src='pairs')} t", PAIR_D)
