"""Dashboard filters and their domains.

Filters are plain conjunctive predicates on columns, so Catalyst pushes them
through the projections down to the parquet scan where the column exists.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in(col: str, values: Sequence | None, empty_means: str) -> Column:
    if values is None:
        return F.lit(True)
    if len(values) == 0:
        return F.lit(empty_means == "all")
    return F.col(col).isin(list(values))


def filter_dashboard(sem: DataFrame, start: dt.date | str, end: dt.date | str,
                     productos: Sequence[str] | None, canales: Sequence[str] | None) -> DataFrame:
    """Date BETWEEN, product IN, channel IN; an empty selection means all."""
    cond = F.col("fecha").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    cond = cond & _in("producto", productos, "all") & _in("tipo_venta", canales, "all")
    return sem.filter(cond)


def filter_units(records: DataFrame, start: str, end: str, productos: Sequence[str] | None,
                 tipos: Sequence[str] | None, unidades: Sequence[str] | None,
                 empty_means: str = "none") -> DataFrame:
    """Client filter over records: blank date bound = open, IN lists, unit IN.

    ``None`` leaves a dimension unfiltered; an empty list selects nothing
    (``empty_means="none"``, the client behaviour) or everything ("all").
    Dates are ISO text in records, compared as text like the client does.
    """
    cond = F.lit(True)
    if start:
        cond = cond & (F.col("fecha") >= F.lit(start))
    if end:
        cond = cond & (F.col("fecha") <= F.lit(end))
    cond = (cond & _in("producto", productos, empty_means) & _in("tipo_precio", tipos, empty_means)
            & _in("unidad", unidades, empty_means))
    return records.filter(cond)


def filter_domains(df: DataFrame) -> DataFrame:
    """Filter domains as (dominio, valor) rows: date bounds, distinct products, channels and units.

    One pass: the rows are aggregated to their (product, channel, unit)
    combinations with date bounds, and those rows give every domain.  The
    bounds of an empty input are null.
    """
    chan = "tipo_precio" if "tipo_precio" in df.columns else "tipo_venta"
    date = F.col("fecha").cast("string")
    combos = df.groupBy(F.trim("producto").alias("producto"), F.trim(chan).alias("tipo"),
                        F.trim("unidad").alias("unidad")).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    seed = df.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in combos.columns])
    low, high = F.lit("fecha_min"), F.lit("fecha_max")
    pairs = combos.unionByName(seed).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("dominio"), F.col(c).alias("valor"))
        for n, c in (("fecha_min", "lo"), ("fecha_max", "hi"), ("producto", "producto"), ("tipo", "tipo"),
                     ("unidad", "unidad"))])))
    is_bound = F.col("dominio").isin("fecha_min", "fecha_max")
    grouped = pairs.groupBy("dominio", F.when(~is_bound, F.col("valor")).alias("_member")) \
                   .agg(F.min("valor").alias("_lo"), F.max("valor").alias("_hi"))
    out = grouped.select("dominio", F.when(F.col("dominio") == low, F.col("_lo"))
                         .when(F.col("dominio") == high, F.col("_hi")).otherwise(F.col("_member")).alias("valor"))
    return out.filter(is_bound | F.col("valor").isNotNull())


def filter_dates(facts: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Facts within ISO date bounds, blank = open: the client's date filter on the DATE column, before it is formatted
    as text, so that it reaches the scan (P15).  Undated rows fail any bound."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col("fecha") >= F.lit(start).cast("date"))
    if end:
        cond = cond & (F.col("fecha") <= F.lit(end).cast("date"))
    return facts.filter(cond)


def product_search(df: DataFrame, query: str) -> DataFrame:
    """Distinct products whose name contains ``query``, case-insensitive."""
    return (df.select("producto").filter(F.col("producto").isNotNull()).distinct()
              .filter(F.lower(F.col("producto")).contains(query.lower())))
