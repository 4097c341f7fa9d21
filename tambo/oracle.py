"""DuckDB SQL that recomputes each registered query from the driver tables.

The fixtures and every stage are written again as CTEs, independently of the
Spark code.  Rounding follows Spark's HALF_UP on the shortest decimal text of
a double (``sr``), which DuckDB reproduces by going through VARCHAR and
DECIMAL; outputs are rounded to 4 dp on both sides.
"""

from __future__ import annotations


def sr(expr: str, d: int = 4) -> str:
    """Spark-style round(double, d) in DuckDB (HALF_UP on the shortest decimal text)."""
    return f"CAST(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def srs(expr: str, d: int = 2) -> str:
    """``stable_round`` of the library: 6 dp, then ``d`` dp, HALF_UP."""
    return f"CAST(ROUND(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), 6), {d}) AS DOUBLE)"


def out4(expr: str) -> str:
    """Output rounding shared with ``tambo.registry.finish``: 6 dp, then 4 dp.

    The first step absorbs last-bit differences of sums computed in another
    order, so values that sit on a 4-dp tie round the same way in both engines.
    """
    return f"CAST(ROUND(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), 6), 4) AS DOUBLE)"


def final(body: str, doubles: list[str]) -> str:
    """Wrap a query so its double columns are rounded to 4 dp like the Spark side."""
    if not doubles:
        return body
    repl = ", ".join(f"{out4(c)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({body}) AS q"


D = "CAST({} AS DOUBLE)".format

# Fixture W (typed wide survey) as CTEs.
W_CTE = """
w0 AS (
  SELECT l.l_partkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
         l.l_returnflag, l.l_linestatus, l.l_shipdate, p.p_name, p.p_type, p.p_retailprice,
         CASE WHEN l.l_returnflag = 'R' OR (l.l_returnflag = 'A' AND l.l_linenumber = 7)
              THEN NULL ELSE l.l_extendedprice END AS may_prom0,
         CASE WHEN l.l_returnflag = 'A' OR (l.l_returnflag = 'R' AND l.l_linenumber = 7) THEN NULL
              WHEN l.l_returnflag = 'R' AND l.l_quantity = 1 THEN CAST(0 AS DOUBLE)
              ELSE p.p_retailprice END AS min_prom0
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
w AS (
  SELECT CAST(l_shipdate AS DATE) AS fecha,
         CASE WHEN l_partkey % 97 = 0 THEN ' ab ' ELSE p_name END AS producto,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE p_type END AS unidad_may,
         CASE WHEN l_linenumber = 2 THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS equiv_may,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE may_prom0 * (1 - l_discount) END AS may_min,
         may_prom0 AS may_prom,
         may_prom0 * (1 + l_tax) AS may_max,
         'Kilogramo' AS unidad_min,
         CAST(1 AS DOUBLE) AS equiv_min,
         min_prom0 * CAST(0.95 AS DOUBLE) AS min_min,
         min_prom0 AS min_prom,
         min_prom0 * CAST(1.05 AS DOUBLE) AS min_max,
         l_linestatus AS hoja_origen,
         l_partkey AS _partkey,
         l_linenumber AS _linenumber
  FROM w0
)"""

# Fixture X (text survey), parsed back the way the ingest does.
NUM_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def num(c: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({c}), '{NUM_RE}') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


def day_first(c: str) -> str:
    fmts = ["%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"]
    parts = ", ".join(f"try_strptime(trim({c}), '{f}')" for f in fmts)
    return f"CAST(COALESCE({parts}) AS DATE)"


X_CTE = W_CTE + """,
x AS (
  SELECT CASE WHEN _partkey % 101 = 0 THEN 'Fecha' ELSE strftime(fecha, '%d/%m/%Y') END AS fecha,
         producto, unidad_may, CAST(equiv_may AS VARCHAR) AS equiv_may,
         CAST(may_min AS VARCHAR) AS may_min,
         CASE WHEN _linenumber = 5 THEN 'S/D' ELSE CAST(may_prom AS VARCHAR) END AS may_prom,
         CAST(may_max AS VARCHAR) AS may_max, unidad_min, CAST(equiv_min AS VARCHAR) AS equiv_min,
         CAST(min_min AS VARCHAR) AS min_min, CAST(min_prom AS VARCHAR) AS min_prom,
         CAST(min_max AS VARCHAR) AS min_max, hoja_origen
  FROM w
),
xt AS (
  SELECT * FROM (
    SELECT """ + day_first("fecha") + """ AS fecha, fecha AS fecha_texto, producto, unidad_may,
           """ + num("equiv_may") + """ AS equiv_may, """ + num("may_min") + """ AS may_min,
           """ + num("may_prom") + """ AS may_prom, """ + num("may_max") + """ AS may_max,
           unidad_min, """ + num("equiv_min") + """ AS equiv_min, """ + num("min_min") + """ AS min_min,
           """ + num("min_prom") + """ AS min_prom, """ + num("min_max") + """ AS min_max, hoja_origen
    FROM x) t
  WHERE fecha IS NOT NULL
)"""

# Validation (P3-P5) of W.
V_CTE = W_CTE + """,
v0 AS (
  SELECT * REPLACE (trim(producto) AS producto) FROM w
  WHERE fecha IS NOT NULL AND producto IS NOT NULL
),
v1 AS (
  SELECT *, may_prom AS precio_mayorista, min_prom AS precio_minorista,
         COALESCE(min_prom, may_prom) AS precio_analisis,
         CASE WHEN min_prom IS NOT NULL THEN 'Minorista' ELSE 'Mayorista' END AS tipo_precio
  FROM v0
),
v2 AS (
  SELECT *, (CASE WHEN length(producto) < 3 THEN 'Nombre producto invalido | ' ELSE '' END)
         || (CASE WHEN precio_analisis IS NULL OR precio_analisis <= 0 THEN 'Sin precio valido | ' ELSE '' END)
         AS error
  FROM v1
),
vq AS (SELECT *, CASE WHEN error <> '' THEN 'ERROR' ELSE 'OK' END AS estado FROM v2),
ok AS (SELECT * FROM vq WHERE estado = 'OK' AND producto <> '')"""


def _facts_branch(ch: str, u: str, e: str, lo: str, mid: str, hi: str, normalise: bool,
                  src: str = "ok") -> str:
    if normalise:
        eq = f"CASE WHEN {e} IS NULL OR {e} <= 0 THEN CAST(1 AS DOUBLE) ELSE {e} END"
        return (f"SELECT fecha, producto, '{ch}' AS tipo_venta, "
                f"COALESCE(NULLIF(trim({u}), ''), 'Sin unidad') AS unidad, "
                f"{eq} AS equivalencia, {lo} / ({eq}) AS precio_min, {mid} / ({eq}) AS precio_prom, "
                f"{hi} / ({eq}) AS precio_max FROM {src} WHERE {mid} IS NOT NULL")
    return (f"SELECT fecha, producto, '{ch}' AS tipo_venta, "
            f"COALESCE(NULLIF(trim({u}), ''), 'Sin unidad') AS unidad, "
            f"CAST({e} AS DOUBLE) AS equivalencia, {lo} AS precio_min, {mid} AS precio_prom, "
            f"{hi} AS precio_max FROM {src} WHERE {mid} IS NOT NULL")


def facts_cte(name: str, normalise: bool, src: str = "ok") -> str:
    a = _facts_branch("Mayorista", "unidad_may", "equiv_may", "may_min", "may_prom", "may_max", normalise, src)
    b = _facts_branch("Minorista", "unidad_min", "equiv_min", "min_min", "min_prom", "min_max", normalise, src)
    return (f"{name} AS (SELECT *, precio_max - precio_min AS variacion_precio FROM "
            f"({a} UNION ALL {b}) u)")


# Normalised facts (fn), raw facts (fr), semantic rows over fn (s).
F_CTE = V_CTE + ",\n" + facts_cte("fn", True) + ",\n" + facts_cte("fr", False) + """,
s AS (
  SELECT fecha, producto, tipo_venta, unidad, equivalencia, precio_min AS precio_minimo,
         precio_prom AS precio_promedio, precio_max AS precio_maximo, variacion_precio
  FROM fn
)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
