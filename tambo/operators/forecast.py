"""Least-squares projections.

Two regression axes exist:

* ordinal: x = 0..n-1 over the non-null points of a series in date order; the
  projection h steps ahead is ``intercept + slope * (n - 1 + h)``; one point
  projects to itself, an empty series to 0.0; ``clamp`` floors at 0.
* date: x = days since 2000-01-01; lines come from moments in one aggregate, the
  spread of x being that of all dates, with or without a value.

Series are daily means, i.e. aggregates whose size is bounded by the calendar
(per key: one row per date).  Windows run only over those aggregates.  The
raw-row variant (F11) numbers rows inside (product, date, channel) cells and
adds the rows of earlier cells, because one product may hold a third of all facts.
Single-row results are combined by union + one aggregate, never by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.functions.columns import days_since_origin, stable_round
from tambo.plans.ordinal import ranked
from tambo.session import checkpoint_dir


# ---------------------------------------------------------------- series and fits
_SUMS = {"precio_promedio": ("_sy", "_ny"), "variacion_precio": ("_sv", "_nv")}


def daily_base(sem: DataFrame) -> DataFrame:
    """Sums and counts of price and range per (producto, fecha, tipo_venta).

    Every daily series of the forecasts (global, per product, per channel,
    ranges) is a re-aggregation of this one partial aggregate, so a job that
    needs several series reads the facts once: the identical shuffle below
    each branch is reused by the planner.  Its size is bounded by products x
    days x 2 channels.
    """
    return sem.filter(F.col("fecha").isNotNull()).groupBy("producto", "fecha", "tipo_venta").agg(
        F.sum("precio_promedio").alias("_sy"), F.count("precio_promedio").alias("_ny"),
        F.sum("variacion_precio").alias("_sv"), F.count("variacion_precio").alias("_nv"))


def _mean(s: str, n: str, cond: Column | None = None) -> Column:
    if cond is not None:
        s_, n_ = F.sum(F.when(cond, F.col(s))), F.sum(F.when(cond, F.col(n)))
    else:
        s_, n_ = F.sum(s), F.sum(n)
    return F.when(n_ > 0, s_ / n_)


def daily_series(sem: DataFrame, keys: list[str], value: str = "precio_promedio") -> DataFrame:
    """Mean of ``value`` per (keys, fecha); null keys dropped; y may be null."""
    if value not in _SUMS:
        cond = F.col("fecha").isNotNull()
        for k in keys:
            cond = cond & F.col(k).isNotNull()
        return sem.filter(cond).groupBy(*keys, "fecha").agg(F.avg(value).alias("y"))
    base = daily_base(sem)
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    return base.groupBy(*keys, "fecha").agg(_mean(*_SUMS[value]).alias("y"))


def gap_series(sem: DataFrame) -> DataFrame:
    """Retail minus wholesale daily means on dates with both channels (A8 as a series)."""
    g = daily_base(sem).groupBy("fecha").agg(
        _mean("_sy", "_ny", F.col("tipo_venta") == S.RETAIL).alias("_r"),
        _mean("_sy", "_ny", F.col("tipo_venta") == S.WHOLESALE).alias("_w"))
    return g.select("fecha", (F.col("_r") - F.col("_w")).alias("y")).filter(F.col("y").isNotNull())


def ordinal_fit(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n, slope, intercept on x = 0..n-1 over non-null y in date order; last point.

    The window runs over the daily series (one row per date per key).
    """
    w = Window.partitionBy(*keys).orderBy("fecha") if keys else Window.orderBy("fecha")
    pts = series.filter(F.col("y").isNotNull()).withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    return pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.max_by("y", "x").alias("last_y"),
        F.max("fecha").alias("last_fecha"),
    )


def projected(h: Column | int, clamp: bool = True) -> Column:
    """Projection h steps past the last point of a fit row (n >= 1)."""
    h = F.lit(h) if isinstance(h, int) else h
    line = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + h)
    if clamp:
        line = F.greatest(F.lit(0.0), line)
    return F.when(F.col("n") == 1, F.col("last_y")).otherwise(line)


def weeks(n: int = S.HORIZON) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n))).alias("semana")


def collapse(parts: list[DataFrame]) -> DataFrame:
    """Combine 0/1-row frames with disjoint columns into exactly one row (no join)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def _prefixed(fit: DataFrame, prefix: str, cols=("n", "slope", "intercept", "last_y")) -> DataFrame:
    return fit.select(*[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def _proj_prefixed(prefix: str, h: Column | int, clamp: bool = True, empty: float | None = 0.0) -> Column:
    """``projected`` on prefixed columns; a missing fit (empty series) gives ``empty``."""
    h = F.lit(h) if isinstance(h, int) else h
    n, slope, icpt, last = (F.col(f"{prefix}_{c}") for c in ("n", "slope", "intercept", "last_y"))
    line = icpt + slope * (n - 1 + h)
    if clamp:
        line = F.greatest(F.lit(0.0), line)
    val = F.when(n == 1, last).otherwise(line)
    return F.when(n.isNull() | (n == 0), F.lit(empty)).otherwise(val)


# --------------------------------------------------------------- per product
def project_ordinal(sem: DataFrame, horizon: int = S.HORIZON, clamp: bool = True,
                    value: str = "precio_promedio") -> DataFrame:
    """Per product: ordinal projection of the daily mean ``horizon`` steps ahead."""
    fit = ordinal_fit(daily_series(sem, ["producto"], value), ["producto"])
    return fit.select(
        "producto",
        F.col("n").cast("long").alias("n_puntos"),
        F.col("last_y").alias("valor_actual"),
        projected(horizon, clamp).alias("valor_proyectado"),
    )


def expected_increments(sem: DataFrame, horizon: int = S.HORIZON, clamp: bool = True) -> DataFrame:
    """Per product: current, predicted, increment (F10 without the rank)."""
    fit = ordinal_fit(daily_series(sem, ["producto"]), ["producto"])
    return fit.select(
        "producto",
        F.col("last_y").alias("precio_actual"),
        projected(horizon, clamp).alias("precio_predicho"),
    ).withColumn("incremento_esperado", F.col("precio_predicho") - F.col("precio_actual"))


def _by_increment(rows: DataFrame, rank_col: str) -> DataFrame:
    """Ranked by the expected increment, the largest first, ties by name."""
    return ranked(rows, [F.desc("incremento_esperado"), F.asc("producto")], rank_col)


def increments(sem: DataFrame, horizon: int = S.HORIZON, clamp: bool = True) -> DataFrame:
    """Per product: current, predicted, increment, rank by increment."""
    return _by_increment(expected_increments(sem, horizon, clamp), "ranking")


def forecastable(sem: DataFrame) -> DataFrame:
    """Rows fit for forecasting (P19): date, product and price present."""
    return sem.dropna(subset=["fecha", "producto", "precio_promedio"])


def increments_raw_rows(sem: DataFrame, horizon: int = S.HORIZON, min_points: int = 2) -> DataFrame:
    """Per product over raw rows with a price (positions count those only), in (fecha, tipo_venta, price) order, unclamped, n >= 2.

    Rows of equal price in a (product, date, channel) cell are counted before the
    shuffle.  A position is the rows of earlier cells (a running sum over the
    cells, bounded by the calendar) plus the place inside the cell, so the centred
    sum of x * y needs one row per cell, and that of x * x is n (n^2 - 1) / 12.
    """
    cell = ["producto", "fecha", "tipo_venta"]
    y, c = F.col("precio_promedio"), F.col("_c")
    prices = forecastable(sem).groupBy(*cell, "precio_promedio").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    cheaper = Window.partitionBy(*cell).orderBy("precio_promedio").rowsBetween(Window.unboundedPreceding, -1)
    cells = prices.withColumn("_at", F.coalesce(F.sum("_c").over(cheaper), F.lit(0.0))).groupBy(*cell).agg(
        F.sum("_c").alias("_m"), F.sum(y * c).alias("_sy"),
        F.sum(y * c * (F.col("_at") + (c - 1) / 2)).alias("_spy"),
        F.max("precio_promedio").alias("_last"))
    whole = Window.partitionBy("producto")
    earlier = whole.orderBy("fecha", "tipo_venta").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumns({
        "_start": F.coalesce(F.sum("_m").over(earlier), F.lit(0.0)),
        "n": F.sum("_m").over(whole),
        "_ay": F.sum("_sy").over(whole) / F.sum("_m").over(whole)})
    m, ay, ax = F.col("_m"), F.col("_ay"), (F.col("n") - 1) / 2
    cov = (F.col("_start") - ax) * (F.col("_sy") - m * ay) + F.col("_spy") - ay * m * (m - 1) / 2
    fit = placed.groupBy("producto").agg(
        F.max("n").alias("n"), F.max("_ay").alias("_ay"), F.sum(cov).alias("_cov"),
        F.max_by("_last", F.struct("fecha", "tipo_venta")).alias("last_y")).filter(F.col("n") >= min_points)
    n = F.col("n")
    fit = fit.withColumn("slope", F.col("_cov") * 12 / (n * (n * n - 1))) \
             .withColumn("intercept", F.col("_ay") - F.col("slope") * (n - 1) / 2)
    out = fit.select(
        "producto",
        F.col("last_y").alias("precio_actual"),
        projected(horizon, clamp=False).alias("precio_predicho"),
    ).withColumn("incremento_esperado", F.col("precio_predicho") - F.col("precio_actual"))
    return _by_increment(out, "ranking")


def top_increment(sem: DataFrame) -> DataFrame:
    """The product with the largest expected increment; 'Sin datos' when none."""
    inc = expected_increments(sem).select(
        F.col("producto").alias("producto_mayor_incremento"),
        F.col("incremento_esperado"),
        F.struct(-F.col("incremento_esperado"), F.col("producto")).alias("_k"))
    one = inc.agg(F.min_by("producto_mayor_incremento", "_k").alias("producto_mayor_incremento"),
                  F.min_by("incremento_esperado", "_k").alias("incremento_esperado"))
    return one.select(F.coalesce("producto_mayor_incremento", F.lit(S.NO_DATA)).alias("producto_mayor_incremento"),
                      F.coalesce("incremento_esperado", F.lit(0.0)).alias("incremento_esperado"))


def top_increment_path(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """8-step path of the product with the largest increment, labelled last + 7*i."""
    fit = ordinal_fit(daily_series(sem, ["producto"]), ["producto"])
    fit = fit.withColumn("_inc", projected(horizon, True) - F.col("last_y"))
    top = fit.orderBy(F.desc("_inc"), F.asc("producto")).limit(1)
    return top.select("producto", "n", "slope", "intercept", "last_y", "last_fecha", weeks(horizon)).select(
        "producto", F.col("semana").cast("long").alias("semana"),
        F.date_add("last_fecha", F.col("semana") * S.STEP_DAYS).alias("fecha_prediccion"),
        projected(F.col("semana"), True).alias("precio_proyectado"))


# ------------------------------------------------------------ global ordinal series
def _global_parts(sem: DataFrame) -> list[DataFrame]:
    price = _prefixed(ordinal_fit(daily_series(sem, []), []), "p")
    var = _prefixed(ordinal_fit(daily_series(sem, [], "variacion_precio"), []), "v")
    gap = _prefixed(ordinal_fit(gap_series(sem), []), "g")
    last = sem.agg(F.max("fecha").alias("ultima_fecha"))
    return [last, price, var, gap]


def _weekly(one_row: DataFrame, horizon: int, cols: dict[str, Column]) -> DataFrame:
    base = one_row.filter(F.col("ultima_fecha").isNotNull()).select("*", weeks(horizon))
    return base.select(
        F.col("semana").cast("long").alias("semana"),
        F.date_add("ultima_fecha", F.col("semana") * S.STEP_DAYS).alias("fecha_prediccion"),
        *[c.alias(n) for n, c in cols.items()])


def forecast_weeks(sem: DataFrame, horizon: int = S.HORIZON, clamp: bool = True) -> DataFrame:
    """Global daily mean price projected 1..8 steps, labelled last date + 7*i, from rows fit for forecasting."""
    one = collapse(_global_parts(forecastable(sem))[:2])
    return _weekly(one, horizon, {"precio_promedio_futuro": _proj_prefixed("p", F.col("semana"), clamp)})


def forecast_variation(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """Global daily mean range projected 1..8 steps (F8)."""
    parts = _global_parts(forecastable(sem))
    one = collapse([parts[0], parts[2]])
    return _weekly(one, horizon, {"tendencia_variacion": _proj_prefixed("v", F.col("semana"))})


def forecast_gap(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """Retail - wholesale daily gap projected 1..8 steps; 0.0 without common dates."""
    parts = _global_parts(forecastable(sem))
    one = collapse([parts[0], parts[3]])
    return _weekly(one, horizon, {"diferencia_futura": _proj_prefixed("g", F.col("semana"))})


def _top_part(sem: DataFrame) -> DataFrame:
    return top_increment(sem).select("producto_mayor_incremento")


def forecast_table(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """The 8-row forecast table: date, price, range, gap and top product (F16), from the rows fit for forecasting."""
    sem = forecastable(sem)
    one = collapse(_global_parts(sem) + [_top_part(sem)])
    return _weekly(one, horizon, {
        "preciopromediofuturo": _proj_prefixed("p", F.col("semana")),
        "tendenciavariacion": _proj_prefixed("v", F.col("semana")),
        "diferenciamayoristaminoristafutura": _proj_prefixed("g", F.col("semana")),
        "productomayorincremento": F.col("producto_mayor_incremento"),
    }).withColumnRenamed("fecha_prediccion", "fechaprediccion")


def history_plus_forecast(sem: DataFrame, anchor: bool = True, horizon: int = S.HORIZON,
                          series: str = "price") -> DataFrame:
    """Daily history tagged 'Historico' plus the projection tagged 'Proyectado' (U3).

    ``series``: the mean price, the mean range, the channel gap, or the price of
    the product with the largest increment ('top').  With ``anchor`` the last real
    point is repeated as the first projected row.
    """
    if series == "top":
        path = top_increment_path(sem, horizon)
        # One product: a proven bound for the broadcast.
        hist = daily_series(sem, ["producto"]).join(F.broadcast(path.select("producto").distinct()), "producto",
                                                    "left_semi").select("fecha", "y")
        proj = path.select("fecha_prediccion", F.col("precio_proyectado").alias("_p"))
    elif series == "range":
        hist = daily_series(sem, [], "variacion_precio")
        proj = forecast_variation(sem, horizon).select("fecha_prediccion", F.col("tendencia_variacion").alias("_p"))
    elif series == "gap":
        hist = gap_series(sem)
        proj = forecast_gap(sem, horizon).select("fecha_prediccion", F.col("diferencia_futura").alias("_p"))
    elif series == "price":
        hist = daily_series(sem, [])
        proj = forecast_weeks(sem, horizon).select("fecha_prediccion", F.col("precio_promedio_futuro").alias("_p"))
    else:
        raise ValueError(f"unknown series {series!r}")
    projected_rows = proj.select(F.col("fecha_prediccion").alias("fecha"), F.col("_p").alias("valor"))
    if anchor:
        last = ordinal_fit(hist, []).filter(F.col("n") > 0)
        projected_rows = projected_rows.unionByName(
            last.select(F.col("last_fecha").alias("fecha"), F.col("last_y").alias("valor")))
    return hist.select("fecha", F.col("y").alias("valor"), F.lit(S.HISTORY).alias("tipo")) \
               .unionByName(projected_rows.withColumn("tipo", F.lit(S.PROJECTED)))


# ---------------------------------------------------------------- date axis
def _line(y: str) -> Column:
    """Aggregate: the least-squares line of ``y`` over x as (mean of x, mean of y, slope).

    A day without ``y`` has no part in the covariance but counts for the spread of x.
    """
    return F.struct(F.avg("x").alias("x"), F.avg(y).alias("y"),
                    (F.regr_sxy(y, "x") / F.nullif(F.regr_sxx("x", "x"), F.lit(0.0))).alias("slope"))


def _on(line: str, x: Column) -> Column:
    """The value of a line at ``x``."""
    return F.col(f"{line}.y") + F.col(f"{line}.slope") * (x - F.col(f"{line}.x"))


def _weeks_ahead(series: DataFrame, values: dict[str, str], horizon: int) -> DataFrame:
    """(fecha_prediccion, one column for each value's line) for the weeks after the last day of a series; no row without one."""
    lines = series.withColumn("x", days_since_origin("fecha")).agg(
        F.max("fecha").alias("ultima_fecha"), *[_line(y).alias(f"_{name}") for name, y in values.items()])
    ahead = lines.filter(F.col("ultima_fecha").isNotNull()).select("*", weeks(horizon)) \
                 .withColumn("fecha_prediccion", F.date_add("ultima_fecha", F.col("semana") * S.STEP_DAYS))
    return ahead.select("fecha_prediccion", *[_on(f"_{name}", days_since_origin("fecha_prediccion")).alias(name) for name in values])


def forecast_date_axis(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """Global 8-week forecast of price and range on the date axis."""
    days = daily_base(sem).groupBy("fecha").agg(_mean("_sy", "_ny").alias("precio"), _mean("_sv", "_nv").alias("rango"))
    return _weeks_ahead(days, {"precio_promedio_futuro": "precio", "tendencia_variacion": "rango"}, horizon)


def forecast_product_date_axis(sem: DataFrame, ahead_days: int = S.PRODUCT_AHEAD_DAYS) -> DataFrame:
    """Per product on the date axis: current, value at +56 days, increment, rank; n >= 2."""
    days = daily_series(sem, ["producto"]).withColumn("x", days_since_origin("fecha"))
    fit = days.groupBy("producto").agg(F.count(F.lit(1)).alias("_n"), F.max("x").alias("_last"),
                                       F.max_by("y", "x").alias("precio_actual"), _line("y").alias("_line"))
    out = fit.filter(F.col("_n") >= 2).select("producto", "precio_actual", _on("_line", F.col("_last") + ahead_days).alias("precio_futuro"))
    out = out.withColumn("incremento_esperado", F.col("precio_futuro") - F.col("precio_actual"))
    return _by_increment(out, "ranking_incremento")


def forecast_gap_date_axis(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """Channel-gap 8-week forecast on the date axis over dates with both channels."""
    return _weeks_ahead(gap_series(sem), {"diferencia_futura": "y"}, horizon)


# ------------------------------------------------------------------ summaries
def executive_summary(sem: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """One row, 2 dp: mean of product futures, projected range, top product, projected gap."""
    prod = expected_increments(sem, horizon).agg(F.avg("precio_predicho").alias("_fut"))
    parts = _global_parts(sem)
    one = collapse([prod, parts[2], parts[3], _top_part(sem)])
    return one.select(
        stable_round(F.coalesce("_fut", F.lit(0.0)), 2).alias("precio_promedio_futuro"),
        stable_round(_proj_prefixed("v", horizon), 2).alias("tendencia_variacion"),
        F.coalesce("producto_mayor_incremento", F.lit(S.NO_DATA)).alias("producto_mayor_incremento"),
        stable_round(_proj_prefixed("g", horizon), 2).alias("diferencia_futura_canales"))


def product_alerts(sem: DataFrame, k: int = 10, horizon: int = S.HORIZON) -> DataFrame:
    """Top-k products by fact count: current, predicted, change, alert if rise > 10 %."""
    top = (sem.filter(F.col("producto").isNotNull()).groupBy("producto")
              .agg(F.count("precio_promedio").alias("n_hechos"))
              .orderBy(F.desc("n_hechos"), F.asc("producto")).limit(k))
    # k rows at most: a proven bound, so the semi join broadcasts it.
    daily = daily_series(sem, ["producto"]).join(F.broadcast(top.select("producto")), "producto", "left_semi")
    fit = ordinal_fit(daily, ["producto"])
    w = Window.partitionBy("producto").orderBy(F.desc("fecha"))
    prev = (daily.filter(F.col("y").isNotNull()).withColumn("rn", F.row_number().over(w))
                 .filter(F.col("rn") == 2).select("producto", F.col("y").alias("_prev")))
    f = fit.join(prev, "producto", "left").withColumn("_pred", projected(horizon, True))
    actual, pred = F.col("last_y"), F.col("_pred")
    anterior = F.coalesce(F.col("_prev"), actual)
    rise = F.when(actual != 0, (pred - actual) / actual * 100)
    return f.select(
        "producto",
        stable_round(actual, 2).alias("precio_actual"),
        stable_round(pred, 2).alias("precio_predicho"),
        stable_round(F.when(anterior != 0, (actual - anterior) / anterior * 100).otherwise(F.lit(0.0)), 2)
         .alias("variacion_pct"),
        F.when(rise > S.ALERT_PCT, F.lit(S.ALERT_RISE)).otherwise(F.lit(S.ALERT_NORMAL)).alias("alerta"),
        F.lit(S.ALERT_CONFIDENCE).alias("confianza"))


def client_summary(records: DataFrame, k: int = 10) -> DataFrame:
    """Client dashboard summary over records.

    One-step projections; the top-k products by mean analysis price; each
    product series is its daily mean rounded to 2 dp; the channel gap is the
    difference of the two channel projections, 0 when either is 0.

    The records are read once, for the sums and counts of each (product, date);
    those are checkpointed, because each series would otherwise read them again.
    """
    checkpoint_dir(records.sparkSession)
    values = ["precio_analisis", "variacion_precio", "precio_mayorista", "precio_minorista"]
    base = records.groupBy("producto", "fecha").agg(
        *[F.sum(v).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"n_{v}") for v in values]) \
        .withColumn("fecha", F.to_date("fecha")).checkpoint()
    priced = base.filter(F.col("n_precio_analisis") > 0)
    top = (priced.groupBy(F.coalesce(F.nullif("producto", F.lit("")), F.lit(S.NO_DATA)).alias("producto"))
                 .agg(_mean("s_precio_analisis", "n_precio_analisis").alias("_avg"))
                 .orderBy(F.desc("_avg"), F.asc("producto")).limit(k).select("producto"))
    daily = priced.join(F.broadcast(top), "producto", "left_semi").select(
        "producto", "fecha", stable_round(F.col("s_precio_analisis") / F.col("n_precio_analisis"), 2).alias("y"))
    fit = ordinal_fit(daily, ["producto"]).withColumn("_fut", projected(1, True)) \
        .withColumn("_inc", F.col("_fut") - F.col("last_y"))
    prods = fit.agg(F.avg("_fut").alias("_avg_fut"),
                    F.min_by("producto", F.struct(-F.col("_inc"), F.col("producto"))).alias("_best"))

    def one_step(col: str, prefix: str) -> DataFrame:
        s = base.groupBy("fecha").agg(_mean(f"s_{col}", f"n_{col}").alias("y"))
        return _prefixed(ordinal_fit(s, []), prefix)

    one = collapse([prods, one_step("variacion_precio", "v"), one_step("precio_mayorista", "m"),
                    one_step("precio_minorista", "r")])
    fm, fr = _proj_prefixed("m", 1), _proj_prefixed("r", 1)
    return one.select(
        F.coalesce("_avg_fut", F.lit(0.0)).alias("precio_futuro"),
        _proj_prefixed("v", 1).alias("tendencia"),
        F.coalesce("_best", F.lit(S.NO_DATA)).alias("producto_incremento"),
        F.when((fm != 0) & (fr != 0), fr - fm).otherwise(F.lit(0.0)).alias("diferencia_canales"))
