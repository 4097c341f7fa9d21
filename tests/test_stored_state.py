"""Committed states: interleaved writers, failures between writes, the stored upsert, catalog objects, and inputs that used to break."""

import os

import pytest
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.operators import facts as FX
from tambo.operators import forecast as FC
from tambo.operators import quality as Q
from tambo.operators import scale as B
from tambo.plans import catalog as CAT
from tambo.plans import manifest
from tambo.plans import scale_store as SS
from tambo.plans import warehouse as WH
from tambo.plans.ordinal import numbered, ranked
from tambo.registry_more import _batch
from tambo.sources import fixtures as FIX
from tambo.sources.survey_csv import read_survey_csv
from tambo.streaming.scale_stream import ScaleSalesSink, current_sales_table

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def batch(spark):
    ok = Q.ok_rows(Q.validate(FIX.wide_survey(spark, SF_SMALL))).cache()
    return ok, FX.unpivot_channels(ok).cache()


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


# ------------------------------------------------------------------ L8
def test_two_loads_from_one_state_keep_the_first(spark, tmp_path, batch, monkeypatch):
    ok, facts = batch
    root = str(tmp_path / "wh")
    one = WH.load(WH.read(spark, root), ok, facts)
    two = WH.load(WH.read(spark, root), ok, facts.limit(10))
    assert WH.save(one, root) == 1
    stored = files_below(root)
    with pytest.raises(manifest.Conflict):
        WH.save(two, root)
    assert files_below(root) == stored
    # The second read the newest state just before the first committed: it writes, and fails at the commit.
    with monkeypatch.context() as m:
        m.setattr(manifest, "newest", lambda *_: 0)
        with pytest.raises(manifest.Conflict):
            WH.save(two, root)
    assert {k: v for k, v in files_below(root).items() if k in stored} == stored
    assert WH.read(spark, root)["fact_precios"].count() == facts.count()
    assert {r.violaciones for r in WH.fk_check(WH.read(spark, root)).collect()} == {0}


def test_load_into_repeats_after_a_conflict(spark, tmp_path, batch, monkeypatch):
    ok, facts = batch
    root, begun = str(tmp_path / "wh"), []
    whole = WH.load

    def meanwhile(wh, *args, **kwargs):
        loaded = whole(wh, *args, **kwargs)
        if not begun:
            begun.append(1)
            WH.save(whole(WH.read(spark, root), ok, facts.limit(20)), root)     # another loader is faster
        return loaded

    monkeypatch.setattr(WH, "load", meanwhile)
    assert WH.load_into(spark, root, ok, facts, replace=False) == 2
    got = WH.read(spark, root)["fact_precios"]
    assert got.count() == facts.count() + 20 == got.select("id_precio").distinct().count()
    with pytest.raises(ValueError):
        WH.load_into(spark, root, ok, facts, attempts=0)


def test_commits_are_compare_and_set(spark, tmp_path):
    root = str(tmp_path / "m")
    assert manifest.newest(spark, root) == 0 and manifest.state_of(spark, root, 0) == {}
    assert manifest.commit(spark, root, 0, {"t": ["a", "b"], "empty": []}) == 1
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, root, 0, {"t": ["c"]})
    assert manifest.newest(spark, root) == 1 and manifest.state_of(spark, root, 1) == {"t": ["a", "b"], "empty": []}
    assert manifest.commit(spark, root, 1, {"t": ["c"]}) == 2


# ------------------------------------------------------------------ S6, P14, J2
def test_a_range_of_dates_reads_its_years_only(spark, tmp_path, batch):
    ok, facts = batch
    root = str(tmp_path / "wh")
    WH.load_into(spark, root, ok, facts)
    WH.load_into(spark, root, ok, facts.limit(0), replace=False)                    # a load without facts adds no directory
    names = manifest.state_of(spark, root, 2)["fact_precios"]
    years = {r.y for r in facts.select(F.year("fecha").alias("y")).distinct().collect()}
    assert len(years) > 2 and {n.split("/anio=")[1] for n in names} == {str(y) for y in years}
    want = facts.filter("fecha between date'1995-06-15' and date'1995-10-01'").count()
    for n in names:
        if not n.endswith("anio=1995"):
            for f in files_below(os.path.join(root, "fact_precios", n)):
                if f.endswith(".parquet"):
                    open(f, "wb").write(b"not to be read")
    view = WH.semantic_between(WH.read(spark, root), "1995-06-15", "1995-10-01")
    assert view.count() == want > 0
    assert WH.semantic_view(WH.read(spark, root)).filter("anio = 1995").count() == facts.filter("year(fecha) = 1995").count()
    # A condition on the date alone chooses the years when the query runs.
    plan = WH.semantic_view(WH.read(spark, root)).filter("fecha = date'1995-06-20'")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(Exception):
        WH.semantic_between(WH.read(spark, root), "1995-06-15").count()
    assert WH.semantic_between(WH.Warehouse(WH.empty_warehouse(spark).tables), until="1995-10-01").count() == 0


def test_frequent_members_are_looked_up_apart(spark, batch):
    _, facts = batch
    hot = facts.withColumn("producto", F.when(F.col("precio_prom") % 1 < 0.4, F.lit("Papa")).otherwise(F.col("producto")))
    copies = hot.filter(F.col("producto") == "Papa").limit(1).join(spark.range(2000)).drop("id")     # a group of equal rows
    hot = hot.unionByName(copies).unionByName(hot.limit(3).withColumn("producto", F.lit(None).cast("string"))).repartition(8).cache()
    wh = WH.load_dimensions(WH.empty_warehouse(spark), hot.filter("producto != 'Papa' or producto is null").unionByName(copies))
    n = hot.filter(F.col("producto").isNotNull()).count()
    assert hot.filter("producto = 'Papa'").count() > n / 3
    key = ["producto", "fecha", "tipo_venta", "unidad", "precio_prom", "id_producto", "id_tiempo", "id_tipo_venta", "id_unidad"]
    counted = lambda df: {tuple(r) for r in df.groupBy(*key).count().collect()}      # noqa: E731
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ids = WH.member_keys(WH.batch_members(hot)).join(WH.stored_keys(wh.tables), WH.MEMBER_KEY).filter("tabla = 'dim_producto'")
        members = ids.select(F.col("texto").alias("producto"), F.col("id").alias("id_producto"), "n")
        apart = WH._lookup_apart(hot, members, ["producto"], "id_producto", n)
        tasks = [r["count"] for r in apart.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == n and len(tasks) == 8 and max(tasks) < n / 4
        assert "SortMergeJoin" in apart._jdf.queryExecution().executedPlan().toString()
        split = counted(WH.dim_lookup(wh, hot, broadcast_bytes=0))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert split == counted(WH.dim_lookup(wh, hot))
    assert WH.dim_lookup(wh, hot.limit(0), broadcast_bytes=0).count() == 0


def test_ranks_over_many_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 40).cast("double").alias("v"), F.col("id").cast("string").alias("p")).repartition(60)
    got = ranked(rows, [F.desc("v"), F.asc("p")], "n").collect()
    assert [(r.v, r.p) for r in sorted(got, key=lambda r: r.n)] == sorted(((r.v, r.p) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted(r.n for r in got) == list(range(1, 501))
    assert ranked(rows.limit(0), [F.desc("v")], "n").columns == ["v", "p", "n"] and ranked(rows.limit(0), [F.desc("v")], "n").count() == 0


# ------------------------------------------------------------------ L9
def test_result_tables_are_swapped_together(spark, tmp_path, batch):
    root = str(tmp_path / "wh")
    frame = lambda n: spark.range(n)                                                # noqa: E731
    assert WH.read_results(spark, root) == {}
    WH.save_results(root, frame(3), frame(4))
    with pytest.raises(Exception):
        WH.save_results(root, frame(5), frame(6).select(F.raise_error(F.lit("lost")).alias("id")))
    counts = lambda: [WH.read_results(spark, root)[n].count() for n in WH.RESULTS]
    assert counts() == [3, 4]
    WH.load_into(spark, root, *batch)
    assert counts() == [3, 4]                                                       # a load leaves them as they are
    WH.save_results(root, frame(7), frame(8))
    assert counts() == [7, 8] and WH.read(spark, root)["fact_precios"].count() == batch[1].count()


# ------------------------------------------------------------------ L10
def test_stored_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    root, cat = str(tmp_path / "s"), B.catalogue(spark)
    pairs = B.scale_pair_sales(FIX.scale_events(spark, SF_SMALL), cat).cache()
    assert SS.read_stored(spark, root).count() == 0
    assert SS.upsert_stored(spark, root, pairs.limit(0)) == 0
    SS.upsert_stored(spark, root, pairs, buckets=8)
    first = {(r.fecha, r.producto): r for r in SS.read_stored(spark, root).collect()}
    assert len(first) == B.latest_per_key(pairs).count() and len({r.id for r in first.values()}) == len(first)
    before, stored = manifest.state_of(spark, root, 1), files_below(os.path.join(root, SS.TABLE))
    one = pairs.orderBy("fecha", "producto").limit(1)
    changed = one.withColumn("may_prom", F.lit(99.0)).unionByName(
        one.withColumn("producto", F.lit("Nuevo")).withColumn("creado_id", F.lit(-1).cast(one.schema["creado_id"].dataType)))
    assert SS.upsert_stored(spark, root, changed, buckets=3) == 2
    after = manifest.state_of(spark, root, 2)
    moved = {k for k in after if k.startswith(SS.TABLE + "/") and after[k] != before.get(k)}
    assert 1 <= len(moved) <= 2 and after[SS.BUCKETS] == ["8"]
    kept = files_below(os.path.join(root, SS.TABLE))
    assert {f: t for f, t in kept.items() if f in stored} == stored
    second = {(r.fecha, r.producto): r for r in SS.read_stored(spark, root).collect()}
    key = (one.first().fecha, one.first().producto)
    assert second[key].may_prom == 99.0 and second[key].id == first[key].id and second[key].created_at == first[key].created_at
    assert {k: r for k, r in second.items() if k != key and k in first} == {k: r for k, r in first.items() if k != key}
    new, = set(second) - set(first)
    assert new == (key[0], "Nuevo") and second[new].id == max(r.id for r in first.values()) + 1


def test_interleaved_upserts_conflict(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    pairs = B.scale_pair_sales(FIX.scale_events(spark, SF_SMALL), B.catalogue(spark))
    SS.upsert_stored(spark, root, pairs)
    rows = SS.read_stored(spark, root).count()
    with monkeypatch.context() as m:
        m.setattr(manifest, "newest", lambda *_: 0)
        with pytest.raises(manifest.Conflict):
            SS.upsert_stored(spark, root, pairs.limit(3))
    assert SS.read_stored(spark, root).count() == rows


# ------------------------------------------------------------------ L1, T5
def test_catalog_follows_the_committed_state(spark, tmp_path, batch):
    ok, facts = batch
    root = str(tmp_path / "wh")
    name = CAT.create_catalog(spark, root)
    assert CAT.create_catalog(spark, root) == name
    assert {r.tableName for r in spark.sql(f"SHOW TABLES IN {name}").collect() if not r.isTemporary} == set(CAT.COLUMNS)
    assert [CAT.read_view(spark, name, v).count() for v in CAT.VIEWS] == [0, 1, 0, 0, 0, 0]
    n = facts.count()
    for replace, rows in ((True, n), (False, 2 * n), (True, n)):
        WH.load_into(spark, root, ok, facts, replace)
        CAT.create_catalog(spark, root)
        assert spark.table(f"{name}.fact_precios").count() == rows
        assert CAT.read_view(spark, name, "vw_capa_semantica_bi").count() == rows
    days = [r.fecha for r in CAT.read_view(spark, name, "vw_grafico_lineas").collect()]
    assert days == sorted(days) and len(days) == facts.select("fecha").distinct().count()
    assert [r.ranking for r in CAT.read_view(spark, name, "vw_grafico_barras_top10").collect()] == list(range(1, 11))
    assert WH.schema_check(CAT.stored(spark, name)).filter("not ok").count() == 0


# ------------------------------------------------------------------ B5, S3, P19
def test_replayed_sales_without_an_id_are_stored_once(spark, tmp_path):
    sink = ScaleSalesSink(spark, str(tmp_path / "t"))
    sales = FIX.scale_events(spark, SF_SMALL).limit(5)
    odd = sales.withColumn("event_id", F.lit(None).cast("long"))
    for _ in range(2):
        sink(sales.unionByName(odd), 0)
    assert sink.raw().count() == 10 and sink.raw().filter("event_id is null").count() == 5
    assert current_sales_table(spark, str(tmp_path / "t")).count() > 0


def test_sheets_without_dates_are_skipped_or_refused(spark, tmp_path):
    (tmp_path / "good one.csv").write_text("Titulo\n01/02/2024;Papa;kg;1;2;3;4\n")
    (tmp_path / "notes.csv").write_text("solo notas\nsin fecha;x\n")
    (tmp_path / "empty.csv").write_text("")
    got = read_survey_csv(spark, str(tmp_path), sep="auto").filter("fecha = '01/02/2024'").collect()
    assert [(r.producto, r.hoja_origen) for r in got] == [("Papa", "good one")]
    with pytest.raises(ValueError, match="empty.csv.*notes.csv"):
        read_survey_csv(spark, str(tmp_path), sep="auto", undated="raise")
    with pytest.raises(ValueError, match="unknown undated"):
        read_survey_csv(spark, str(tmp_path), sep="auto", undated="drop")
    none = read_survey_csv(spark, [str(tmp_path / "notes.csv"), str(tmp_path / "empty.csv")], sep="auto")
    assert none.count() == 0 and none.columns == [*S.SURVEY_COLUMNS, "hoja_origen"]


def test_forecasts_leave_out_rows_without_product_or_price(spark):
    rows = [(f"2024-01-0{d}", "Papa", "Minorista", float(d), 0.5) for d in range(1, 6)]
    odd = [("2024-01-05", None, "Minorista", 200.0, 9.0), ("2024-01-09", "Papa", "Minorista", None, 9.0)]
    frame = lambda r: spark.createDataFrame(r, "f string, producto string, tipo_venta string, precio_promedio double, "        # noqa: E731
                                               "variacion_precio double").withColumn("fecha", F.to_date("f"))
    for forecast in (FC.forecast_table, FC.forecast_weeks, FC.forecast_variation, FC.forecast_gap):
        assert forecast(frame(rows + odd)).collect() == forecast(frame(rows)).collect()
    assert [r.preciopromediofuturo for r in FC.forecast_table(frame(rows + odd)).limit(3).collect()] == [6.0, 7.0, 8.0]


def test_appends_read_no_old_facts_and_keep_kpis(spark):
    f = FX.unpivot_channels(Q.ok_rows(Q.validate(FIX.wide_survey(spark, SF_SMALL))))
    ok = Q.ok_rows(Q.validate(FIX.wide_survey(spark, SF_SMALL)))
    early = F.col("fecha") < "1997-01-01"
    first = WH.load(WH.empty_warehouse(spark), ok, f.filter(early))
    unread = first["fact_precios"].withColumn("id_precio", F.raise_error(F.lit("old facts were read")).cast("long"))
    second = WH.load(WH.Warehouse({**first.tables, "fact_precios": unread}), ok, f.filter(~early), replace=False)
    added = second.batch["fact_precios"]
    whole = first["fact_precios"].unionByName(added)
    ids = whole.agg(F.count("*"), F.min("id_precio"), F.max("id_precio"), F.count_distinct("id_precio")).first()
    assert tuple(ids) == (f.count(), 1, f.count(), f.count())
    shown = lambda k: sorted((r.nombre_kpi, r.valor) for r in k.collect())                           # noqa: E731
    assert shown(second["fact_kpis"]) == shown(WH.kpi_rows_of_table(whole))
    daily = {(r.producto, r.fecha, r.tipo_venta): r.precio_promedio for r in WH.daily_averages(second).collect()}
    again = WH.semantic_as_double(WH.semantic_view(WH.Warehouse({**second.tables, "fact_precios": whole})))
    want = again.groupBy("producto", "fecha", "tipo_venta").agg(F.avg("precio_promedio").alias("p")).collect()
    assert len(want) == len(daily) and all(abs(daily[r.producto, r.fecha, r.tipo_venta] - r.p) < 1e-9 for r in want)


# ------------------------------------------------------------------ plans at size
def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_by_name_broadcast_the_dimensions(spark, tmp_path, batch):
    """Without sizes of the tables all facts went through one shuffle a dimension, by the channel's two values too."""
    root = str(tmp_path / "wh")
    WH.load_into(spark, root, *batch)
    CAT.create_catalog(spark, root)
    WH.load_into(spark, root, *batch)
    name = CAT.create_catalog(spark, root)
    plan = executed(spark.table(f"{name}_vw_capa_semantica_bi"))
    keys = ("id_producto", "id_unidad", "id_tipo_venta", "id_tiempo")
    assert not any(f"hashpartitioning({key}" in plan for key in keys)
    assert spark.table(f"{name}_vw_capa_semantica_bi").count() == batch[1].count()


def test_a_load_takes_its_daily_sums_once(spark, batch):
    sums = WH.load(WH.empty_warehouse(spark), *batch)[WH.SUMS]
    plan = executed(sums)
    assert "Aggregate" not in plan and "BroadcastHashJoin" not in plan
    assert sums.agg(F.sum("n_prom")).first()[0] == batch[1].count()


def test_empty_warehouse_has_no_tasks(spark):
    for table in WH.empty_warehouse(spark).tables.values():
        assert table.rdd.getNumPartitions() == 0 or "LocalTableScan <empty>" in executed(table)
        assert table.count() == 0


def test_loads_read_a_batch_stored_once(spark):
    ok, facts = _batch(spark, SF_SMALL)
    for df in (ok, facts):
        assert "Join" not in executed(df) and "FileScan parquet" in executed(df)
    want = Q.ok_rows(Q.validate(FIX.wide_survey(spark, SF_SMALL)))
    assert sorted(map(str, ok.collect())) == sorted(map(str, want.select(*ok.columns).collect()))


def test_numbered_rows_are_read_by_column(spark):
    rows = spark.range(1000).selectExpr("id as x", "cast(id as string) as y").repartition(7)
    found = numbered(rows, "n", 5)
    assert "FileScan parquet [x" in executed(found.select("x", "n")) and "y#" not in executed(found.select("x", "n"))
    assert sorted(r.n for r in found.collect()) == list(range(6, 1006)) and found.collect() == found.collect()
