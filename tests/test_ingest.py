"""CSV scan, title rows, column padding/cutting, separators, sheets."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tambo.operators import quality as Q
from tambo.sources.survey_csv import SEPARATORS, dated_under, read_survey_csv, sniff_separators, type_survey


def _write(path, text, bom=False):
    path.write_bytes((("\ufeff" if bom else "") + text).encode("utf-8"))
    return str(path)


ROWS = ("05/03/2024;Papa;Saco;50;70;80;90;Kilogramo;1;2;2.5;3\n"
        "06/03/2024;Tomate;Cajón;20;50;56;60;Kilogramo;1;4;4.5;5\n")


def test_bom_and_title_rows(spark, tmp_path):
    p = _write(tmp_path / "s.csv", "Reporte de precios;;;\nFecha;Producto;Unidad\n" + ROWS, bom=True)
    t = type_survey(read_survey_csv(spark, p, sheet_label="CSV"))
    rows = t.orderBy("fecha").collect()
    assert [r.producto for r in rows] == ["Papa", "Tomate"]
    assert rows[0].fecha == dt.date(2024, 3, 5)
    assert rows[0].may_prom == 80.0 and rows[1].min_max == 5.0
    assert {r.hoja_origen for r in rows} == {"CSV"}


def test_bom_on_first_data_row(spark, tmp_path):
    p = _write(tmp_path / "s.csv", ROWS, bom=True)
    assert type_survey(read_survey_csv(spark, p)).count() == 2


def test_short_rows_padded_and_long_rows_cut(spark, tmp_path):
    p = _write(tmp_path / "s.csv", "05/03/2024;Papa;Saco;50;70;80;90\n"
                                   "06/03/2024;Papa;Saco;50;70;80;90;Kilogramo;1;2;2.5;3;x;y\n")
    t = type_survey(read_survey_csv(spark, p)).orderBy("fecha").collect()
    assert t[0].unidad_min is None and t[0].min_prom is None and t[0].may_max == 90.0
    assert t[1].min_max == 3.0 and len(t[1]) == 13


def test_comma_file_needs_auto_separator(spark, tmp_path):
    p = _write(tmp_path / "s.csv", ROWS.replace(";", ","))
    assert type_survey(read_survey_csv(spark, p)).count() == 0          # ';' as in the reference
    assert list(sniff_separators(spark, [p]).values()) == [","]
    assert type_survey(read_survey_csv(spark, p, sep="auto")).count() == 2


def test_separator_is_found_per_file_below_long_notes(spark, tmp_path):
    notes = "nota; con; punto; y; coma\n" * 300
    a = _write(tmp_path / "Enero.csv", notes + ROWS.replace(";", ","))
    b = _write(tmp_path / "Febrero.csv", ROWS)
    t = type_survey(read_survey_csv(spark, [f"file://{a}", b], sep="auto"))
    assert {r.hoja_origen: r["count"] for r in t.groupBy("hoja_origen").count().collect()} == {"Enero": 2, "Febrero": 2}
    assert {r.hoja_origen for r in read_survey_csv(spark, f"file://{tmp_path}").collect()} == {"Enero", "Febrero"}
    with pytest.raises(ValueError, match="no dated row"):
        sniff_separators(spark, [_write(tmp_path / "x.csv", notes)], undated="raise")


def test_two_files_are_two_sheets(spark, tmp_path):
    a = _write(tmp_path / "Enero.csv", ROWS)
    b = _write(tmp_path / "Febrero.csv", ROWS)
    t = type_survey(read_survey_csv(spark, [a, b]))
    got = {r.hoja_origen: r["count"] for r in t.groupBy("hoja_origen").count().collect()}
    assert got == {"Enero": 2, "Febrero": 2}


def test_bad_dates_and_numbers(spark, tmp_path):
    p = _write(tmp_path / "s.csv", "31/02/2024;Papa;Saco;50;70;80;90\n"
                                   "2024-03-07;Papa;Saco;1.5d;NaN;S/D;1e2\n"
                                   "7/3/2024 10:11:12; Papa ;Saco;abc;70;80;90\n")
    t = type_survey(read_survey_csv(spark, p)).orderBy("equiv_may").collect()
    assert len(t) == 2                                       # 31 Feb is not a date
    iso = [r for r in t if r.producto == "Papa"][0]
    assert iso.equiv_may is None and iso.may_min is None and iso.may_prom is None and iso.may_max == 100.0
    v = Q.require_fields(type_survey(read_survey_csv(spark, p)))
    assert sorted(r.producto for r in v.collect()) == ["Papa", "Papa"]


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "ab", 1.0, 2.0), (dt.date(2024, 1, 1), "Papa", 5.0, 0.0),
         (dt.date(2024, 1, 1), "Papa", None, None), (dt.date(2024, 1, 1), "Papa", 3.0, None),
         (None, "Papa", 3.0, 3.0), (dt.date(2024, 1, 1), None, 3.0, 3.0)],
        "fecha date, producto string, may_prom double, min_prom double")
    v = Q.validate(df).orderBy(F.col("may_prom").asc_nulls_first()).collect()
    assert len(v) == 4
    by = {(r.may_prom, r.min_prom): r for r in v}
    assert by[(1.0, 2.0)].error == "Nombre producto invalido | " and by[(1.0, 2.0)].estado == "ERROR"
    assert by[(5.0, 0.0)].estado == "ERROR"                  # retail 0 beats a valid wholesale price
    assert by[(None, None)].error == "Sin precio valido | "
    assert by[(3.0, None)].estado == "OK" and by[(3.0, None)].tipo_precio == "Mayorista"
    counts = Q.quality_counts(Q.validate(df)).first()
    assert (counts.registros_leidos, counts.registros_validos, counts.registros_rechazados) == (4, 1, 3)


def test_filters_empty_selection_semantics(spark):
    from tambo.operators import filters as FL
    df = spark.createDataFrame(
        [("2024-01-01", "Papa", "Mayorista", "Saco"), ("2024-02-01", "Papa", "Minorista", "Kilogramo"),
         ("2024-03-01", "Tomate", "Minorista", "Kilogramo")],
        "fecha string, producto string, tipo_precio string, unidad string")
    assert FL.filter_units(df, "", "", None, None, None).count() == 3
    assert FL.filter_units(df, "", "", [], None, None).count() == 0            # client: empty = none
    assert FL.filter_units(df, "", "", [], None, None, empty_means="all").count() == 3
    assert FL.filter_units(df, "2024-02-01", "", None, ["Minorista"], ["Kilogramo"]).count() == 2
    sem = df.withColumn("fecha", F.to_date("fecha")).withColumnRenamed("tipo_precio", "tipo_venta")
    assert FL.filter_dashboard(sem, "2024-01-01", "2024-02-28", [], []).count() == 2   # empty = all
    assert [r.producto for r in FL.product_search(sem, "TOM").collect()] == ["Tomate"]


def test_sales_csv_header_check(spark, tmp_path):
    import pytest
    from tambo import schemas as S
    from tambo.operators import scale as B
    good = _write(tmp_path / "v.csv", ";".join(S.SALES_CSV_COLUMNS) + "\n"
                  "05/03/2024 10:00:00;Papa;Saco;50;1.52;1.6;1.68;;;;;\n"
                  "sin fecha;Papa;Saco;50;1.52;1.6;1.68;;;;;\n")
    assert B.sales_csv_missing_columns(spark, good) == []
    rows = B.read_sales_csv(spark, good).collect()
    assert len(rows) == 1 and rows[0].may_prom == 1.6 and rows[0].min_prom is None
    bad = _write(tmp_path / "old.csv", "Fecha;Producto;Precio\n05/03/2024;Papa;1.6\n")
    assert "Productos" in B.sales_csv_missing_columns(spark, bad)
    # Every file of a folder is checked by its own first line.
    both = B.sales_csv_headers(spark, str(tmp_path)).collect()
    assert {(os.path.basename(r.archivo), len(r.faltantes) > 0, r.filas) for r in both} == {("v.csv", False, 2), ("old.csv", True, 1)}
    assert "Productos" in B.sales_csv_missing_columns(spark, str(tmp_path))
    with pytest.raises(ValueError):
        B.read_sales_csv(spark, bad)


def test_separators_are_told_by_the_first_field(spark):
    lines = ["05/03/2024;Papa", "05/03/2024", '"05/03/2024" ,x', "05/03/2024\tx;y", ";05/03/2024", "x;05/03/2024", " 5/3/2024 ;", "2024-03-05,1;2", ""]
    rows = spark.createDataFrame([(v,) for v in lines], "value string").select(*[dated_under(sep).alias(f"c{i}") for i, sep in enumerate(SEPARATORS)])
    assert [tuple(r) for r in rows.collect()] == [
        (True, False, False), (False, False, False), (False, True, False), (False, False, True), (False, False, False),
        (False, False, False), (True, False, False), (False, True, False), (False, False, False)]
    assert "split(" not in rows._jdf.queryExecution().executedPlan().toString()
