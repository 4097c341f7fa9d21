"""Unpivot, normalisation, ordinal and date-axis projections against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tambo.operators import facts as FX
from tambo.operators import forecast as FC
from tambo.operators import quality as Q

D0 = dt.date(2024, 1, 1)


def _survey(spark, rows):
    return spark.createDataFrame(rows, "fecha date, producto string, unidad_may string, equiv_may double, "
                                       "may_min double, may_prom double, may_max double, unidad_min string, "
                                       "equiv_min double, min_min double, min_prom double, min_max double")


def test_unpivot_counts_and_normalisation(spark):
    rows = [(D0, "Papa", "Saco", 50.0, 90.0, 100.0, 110.0, "Kilogramo", 1.0, 2.0, 2.5, 3.0),
            (D0, "Papa", None, 0.0, None, 40.0, 44.0, " ", None, None, None, None),
            (D0, "Papa", "Saco", -3.0, 9.0, 10.0, None, None, None, None, None, None)]
    ok = Q.ok_rows(Q.validate(_survey(spark, rows)))
    n = FX.unpivot_channels(ok, normalise=True).orderBy("precio_prom").collect()
    assert len(n) == 4                                    # one fact per non-null channel price
    assert n[0].precio_prom == pytest.approx(2.0) and n[0].equivalencia == 50.0   # 100 / 50
    assert n[1].tipo_venta == "Minorista" and n[1].precio_prom == 2.5
    undivided = [r for r in n if r.precio_prom in (40.0, 10.0)]
    assert {r.equivalencia for r in undivided} == {1.0}   # 0 and negative -> 1.0
    assert {r.unidad for r in undivided} == {"Sin unidad", "Saco"}
    assert [r.variacion_precio for r in n if r.precio_prom == 40.0] == [None]
    raw = FX.unpivot_channels(ok, normalise=False).collect()
    assert sorted(r.precio_prom for r in raw) == [2.5, 10.0, 40.0, 100.0]
    assert sorted((r.equivalencia is None, r.equivalencia) for r in raw)[0] == (False, -3.0)


def _sem(spark, pts):
    """pts: list of (producto, day offset, tipo_venta, precio, variacion)."""
    return spark.createDataFrame(
        [(p, D0 + dt.timedelta(days=d), t, y, v) for p, d, t, y, v in pts],
        "producto string, fecha date, tipo_venta string, precio_promedio double, variacion_precio double")


def _np_proj(ys, h, clamp=True):
    if not ys:
        return 0.0
    if len(ys) == 1:
        return ys[0]
    m, b = np.polyfit(np.arange(len(ys), dtype=float), ys, 1)
    v = b + m * (len(ys) - 1 + h)
    return max(0.0, v) if clamp else v


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ordinal_projection_matches_polyfit(spark, seed):
    rng = np.random.default_rng(seed)
    pts, series = [], {}
    for p in ["a", "b", "c", "d"]:
        n = int(rng.integers(1, 12))
        days = sorted(rng.choice(60, size=n, replace=False).tolist())
        ys = []
        for d in days:
            vals = rng.uniform(-5, 20, size=int(rng.integers(1, 3))).round(2).tolist()
            pts += [(p, d, "Mayorista", v, 1.0) for v in vals]
            ys.append(float(np.mean(vals)))
        series[p] = ys
    sem = _sem(spark, pts)
    for clamp in (True, False):
        got = {r.producto: r.valor_proyectado for r in FC.project_ordinal(sem, 8, clamp).collect()}
        for p, ys in series.items():
            assert got[p] == pytest.approx(_np_proj(ys, 8, clamp), rel=1e-9, abs=1e-9)


def test_small_series_and_clamp(spark):
    sem = _sem(spark, [("one", 0, "Mayorista", 7.0, None), ("fall", 0, "Mayorista", 10.0, None),
                       ("fall", 1, "Mayorista", 5.0, None), ("two", 0, "Minorista", 1.0, None),
                       ("two", 5, "Minorista", 2.0, None)])
    got = {r.producto: r for r in FC.increments(sem).collect()}
    assert got["one"].precio_predicho == 7.0 and got["one"].incremento_esperado == 0.0
    assert got["fall"].precio_predicho == 0.0                      # clamped
    assert got["two"].precio_predicho == pytest.approx(10.0)      # ordinal, gaps ignored
    top = FC.top_increment(sem).first()
    assert top.producto_mayor_incremento == "two"
    empty = FC.top_increment(sem.filter(F.lit(False))).first()
    assert (empty.producto_mayor_incremento, empty.incremento_esperado) == ("Sin datos", 0.0)


def test_raw_rows_index_matches_window(spark):
    rng = np.random.default_rng(7)
    pts = [(p, int(rng.integers(0, 30)), str(rng.choice(["Mayorista", "Minorista"])),
            float(rng.integers(1, 50)), None) for p in ["x", "y"] for _ in range(200)]
    got = {r.producto: r.precio_predicho for r in FC.increments_raw_rows(_sem(spark, pts)).collect()}
    for p in ["x", "y"]:
        rows = sorted((d, t, y) for q, d, t, y, _ in pts if q == p)
        assert got[p] == pytest.approx(_np_proj([y for _, _, y in rows], 8, clamp=False), rel=1e-9)


def test_date_axis_range_slope_keeps_all_dates_in_denominator(spark):
    pts = [("a", 0, "Mayorista", 10.0, 1.0), ("a", 7, "Mayorista", 12.0, None),
           ("a", 14, "Mayorista", 13.0, 3.0), ("a", 21, "Mayorista", 15.0, None)]
    out = FC.forecast_date_axis(_sem(spark, pts)).orderBy("fecha_prediccion").collect()
    x = np.array([(D0 - dt.date(2000, 1, 1)).days + d for d in (0, 7, 14, 21)], dtype=float)
    y = np.array([10.0, 12.0, 13.0, 15.0])
    ax, sxx = x.mean(), ((x - x.mean()) ** 2).sum()
    vy = np.array([1.0, np.nan, 3.0, np.nan])
    avy = np.nanmean(vy)
    pv = np.nansum((x - ax) * (vy - avy)) / sxx                     # all dates in the denominator
    py = ((x - ax) * (y - y.mean())).sum() / sxx
    assert len(out) == 8 and out[0].fecha_prediccion == D0 + dt.timedelta(days=28)
    xf = x[-1] + 7
    assert out[0].precio_promedio_futuro == pytest.approx(y.mean() + py * (xf - ax))
    assert out[0].tendencia_variacion == pytest.approx(avy + pv * (xf - ax))


def test_gap_forecast_without_common_dates_is_zero(spark):
    sem = _sem(spark, [("a", 0, "Mayorista", 10.0, 1.0), ("a", 1, "Minorista", 12.0, 1.0)])
    rows = FC.forecast_gap(sem).collect()
    assert len(rows) == 8 and {r.diferencia_futura for r in rows} == {0.0}
    table = FC.forecast_table(sem).orderBy("semana").collect()
    assert table[0].fechaprediccion == D0 + dt.timedelta(days=8)
    assert table[0].productomayorincremento == "a"


def test_raw_row_positions_count_priced_rows_only(spark):
    import datetime as dt

    from tambo.operators import forecast as FC
    rows = [("Papa", dt.date(2024, 1, d), "Minorista", y) for d, y in ((1, 1.0), (2, 2.0), (3, None), (4, 3.0))]
    sem = spark.createDataFrame(rows, "producto string, fecha date, tipo_venta string, precio_promedio double")
    assert abs(FC.increments_raw_rows(sem).first().precio_predicho - 11.0) < 1e-9
