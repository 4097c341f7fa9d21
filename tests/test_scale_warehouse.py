"""Scale-sale pairing vs a sequential simulator, stream replay, warehouse reloads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tambo.operators import facts as FX
from tambo.operators import quality as Q
from tambo.operators import scale as B
from tambo.plans import warehouse as WH
from tambo.sources import fixtures as FIX
from tambo.streaming.scale_stream import ScaleSalesSink, current_sales_table

from conftest import SF_SMALL


def _simulate(sales):
    """Row-by-row merge as the application does it, sales in time order."""
    rows = []
    for s in sorted(sales, key=lambda s: (s["ts"], s["event_id"])):
        ch = "may" if s["canal"] == "Mayorista" else "min"
        for r in rows:
            if r["dia"] == s["ts"].date() and r["producto"] == s["producto"] and r[ch] is None:
                r[ch] = s["precio"]
                break
        else:
            rows.append({"dia": s["ts"].date(), "producto": s["producto"],
                         "fecha": s["ts"].replace(microsecond=0), "may": None, "min": None})
            rows[-1][ch] = s["precio"]
    return sorted((r["fecha"], r["producto"], r["may"], r["min"]) for r in rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_pairing_matches_sequential_merge(spark, seed):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1, 8)
    sales = [{"event_id": i, "ts": t0 + dt.timedelta(minutes=rnd.randint(0, 3 * 24 * 60)),
              "mercado": "1", "canal": rnd.choice(["Mayorista", "Minorista"]),
              "producto": rnd.choice(["Papa", "Tomate"]), "peso": 1.0, "precio": float(rnd.randint(1, 9))}
             for i in range(300)]
    df = spark.createDataFrame(sales, "event_id long, ts timestamp, mercado string, canal string, "
                                      "producto string, peso double, precio double")
    got = sorted((r.fecha, r.producto, r.may_prom, r.min_prom)
                 for r in B.scale_pair_sales(df, B.catalogue(spark)).collect())
    assert got == _simulate(sales)


def test_price_band_and_enrichment(spark):
    df = spark.createDataFrame([(1, "Mayorista", "Papa", 2.0), (2, "Minorista", "Yuca", 3.0)],
                               "event_id long, canal string, producto string, precio double")
    b = {r.event_id: r for r in B.scale_price_band(df).collect()}
    assert (b[1].may_min, b[1].may_prom, b[1].may_max, b[1].min_prom) == (1.9, 2.0, 2.1, None)
    e = {r.event_id: r for r in B.scale_enrich(df, B.catalogue(spark)).collect()}
    assert (e[1].u_may, e[1].eq_may) == ("Saco", 50.0) and (e[2].u_may, e[2].eq_may) == ("Saco", 50.0)
    p = {r.event_id: r.precio_catalogo for r in B.catalogue_price(df, B.catalogue(spark)).collect()}
    assert p == {1: 1.6, 2: 0.0}


def test_stream_batches_in_any_order_and_replay(spark, tmp_path):
    sales = FIX.scale_events(spark, SF_SMALL)
    expected = sorted(tuple(r) for r in B.latest_per_key(B.scale_pair_sales(sales, B.catalogue(spark)))
                      .select(*B.PAIR_COLUMNS).collect())
    sink = ScaleSalesSink(spark, str(tmp_path / "t"))
    late_first = [sales.filter(F.col("event_id") % 2 == 1), sales.filter(F.col("event_id") % 2 == 0)]
    for i, batch in enumerate(late_first):
        sink(batch, i)
    sink(late_first[0], 0)                                      # replayed batch is a no-op
    got = sorted(tuple(r) for r in current_sales_table(spark, str(tmp_path / "t"))
                 .select(*B.PAIR_COLUMNS).collect())
    assert got == expected
    assert sink.raw().count() == sales.count()


def test_reload_in_replace_mode_is_stable(spark):
    v = Q.validate(FIX.wide_survey(spark, SF_SMALL))
    ok = Q.ok_rows(v)
    f = FX.unpivot_channels(ok)
    wh1 = WH.load(WH.empty_warehouse(spark), ok, f, replace=True)
    dims1 = {n: sorted(map(tuple, wh1[n].collect())) for n in WH.DIM_SCHEMAS}
    wh2 = WH.load(wh1, ok, f, replace=True, load_id=2)
    for n in WH.DIM_SCHEMAS:
        assert sorted(map(tuple, wh2[n].collect())) == dims1[n]       # dims unchanged on reload
    assert wh2["fact_precios"].count() == f.count()                   # replace, not append
    cols = ["producto", "fecha", "tipo_venta", "precio_promedio"]
    sv = WH.semantic_as_double(WH.semantic_view(wh2)).select(*cols)
    fr = FX.to_semantic(f).select("producto", "fecha", "tipo_venta",
                                  F.col("precio_promedio").cast("decimal(18,2)").cast("double")
                                  .alias("precio_promedio"))
    assert sv.exceptAll(fr).count() == 0 and fr.exceptAll(sv).count() == 0
    assert {r.violaciones for r in WH.fk_check(wh2).collect()} == {0}
    wh3 = WH.load(wh1, ok, f, replace=False, load_id=3)
    assert wh3["fact_precios"].count() == 2 * f.count()
    assert wh3["fact_precios"].select("id_precio").distinct().count() == 2 * f.count()


def test_versioned_save_replace_append_and_failed_load(spark, tmp_path):
    v = Q.validate(FIX.wide_survey(spark, SF_SMALL))
    ok = Q.ok_rows(v)
    f = FX.unpivot_channels(ok)
    n = f.count()
    root = str(tmp_path / "wh")
    assert WH.read(spark, root)["fact_precios"].count() == 0
    wh = WH.load(WH.empty_warehouse(spark), ok, f, replace=True)
    assert WH.save(wh, root) == 1
    assert WH.read(spark, root)["fact_precios"].count() == n
    WH.save(WH.load(WH.read(spark, root), ok, f, replace=False, load_id=2), root, replace=False)
    appended = WH.read(spark, root)["fact_precios"]
    assert appended.count() == 2 * n                                      # append lists both loads
    assert appended.select("id_precio").distinct().count() == 2 * n
    WH.save(WH.load(WH.read(spark, root), ok, f, replace=True, load_id=3), root, replace=True)
    assert WH.read(spark, root)["fact_precios"].count() == n            # replace lists the new load only
    broken = WH.load(WH.read(spark, root), ok, f, replace=True, load_id=4)
    bad = {**broken.tables, "fact_kpis": broken["fact_kpis"].withColumn("x", F.lit(1) / F.lit(0))}
    with pytest.raises(Exception):
        WH.save(WH.Warehouse(bad), root, replace=True)
    after = WH.read(spark, root)                                         # failed load: previous state
    assert after["fact_precios"].count() == n
    assert {r.restriccion for r in WH.fk_check(after).filter("violaciones > 0").collect()} == set()


def test_stream_batch_that_failed_between_its_writes_is_made_good(spark, tmp_path, monkeypatch):
    sales = FIX.scale_events(spark, SF_SMALL)
    sink = ScaleSalesSink(spark, str(tmp_path / "t"))

    def fail(*_):
        raise RuntimeError("lost after the raw append")

    with monkeypatch.context() as m:
        m.setattr(B, "scale_pair_sales", fail)
        with pytest.raises(RuntimeError):
            sink(sales, 0)
    assert sink.raw().count() == sales.count()
    sink(sales, 0)
    expected = B.latest_per_key(B.scale_pair_sales(sales, B.catalogue(spark))).select(*B.PAIR_COLUMNS)
    got = current_sales_table(spark, str(tmp_path / "t")).select(*B.PAIR_COLUMNS)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_ids_are_unique_over_many_partitions(spark):
    first = WH.numbered(spark.range(300).repartition(300).toDF("x"), "n", 0)
    second = WH.numbered(spark.range(300).repartition(300).toDF("x"), "n", 300)
    assert sorted(r.n for r in first.union(second).collect()) == list(range(1, 601))


def test_default_loads_manifest_errors_and_appended_kpis(spark, tmp_path, monkeypatch):
    f = FX.unpivot_channels(Q.ok_rows(Q.validate(FIX.wide_survey(spark, SF_SMALL))))
    ok = Q.ok_rows(Q.validate(FIX.wide_survey(spark, SF_SMALL)))
    root, half = str(tmp_path / "wh"), F.col("fecha") < "1995-06-01"
    WH.save(WH.load(WH.empty_warehouse(spark), ok, f.filter(half)), root)
    two = WH.load(WH.read(spark, root), ok, f.filter(~half), replace=False)
    assert WH.save(two, root, replace=False) == 2
    whole = WH.load(WH.empty_warehouse(spark), ok, f)
    kpis = lambda w: sorted((r.nombre_kpi, float(r.valor)) for r in w["fact_kpis"].collect())        # noqa: E731
    for (name, a), (_, b) in zip(kpis(WH.read(spark, root)), kpis(whole)):
        assert abs(a - b) <= 0.02, name
    with monkeypatch.context() as m:
        def lost(*_):
            raise OSError("lost")
        m.setattr(WH.manifest, "newest", lost)
        with pytest.raises(OSError, match="lost"):
            WH.save(two, root, replace=False)
    assert WH.choose_source(spark, root, f.filter(half)).count() == f.filter(half).count()
    assert WH.choose_source(spark, root, f.filter("false")).count() == f.count()
