"""Column helpers: renames, unit default, calendar columns, money text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tambo import schemas as S


def unit_or_default(col: Column | str) -> Column:
    """Trimmed unit, blank or null -> 'Sin unidad' (P11)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(S.NO_UNIT))


def standardise_columns(df: DataFrame) -> DataFrame:
    """Fold names (lower case, no '_') and map the known ones to snake_case."""
    mapping = {}
    for name in df.columns:
        folded = name.lower().replace("_", "")
        if folded in S.STANDARD_NAMES and S.STANDARD_NAMES[folded] != name:
            mapping[name] = S.STANDARD_NAMES[folded]
    return df.withColumnsRenamed(mapping) if mapping else df


def month_name(month: Column) -> Column:
    """Spanish month name of a 1-based month number."""
    return F.element_at(F.array(*[F.lit(m) for m in S.MONTH_NAMES]), month)


def with_calendar(df: DataFrame, date_col: str = "fecha") -> DataFrame:
    """Add dia, mes, nombre_mes, anio (P13) and variacion_precio if absent."""
    d = F.col(date_col)
    out = df.withColumns({
        "dia": F.dayofmonth(d),
        "mes": F.month(d),
        "nombre_mes": month_name(F.month(d)),
        "anio": F.year(d),
    })
    if "variacion_precio" not in df.columns and {"precio_maximo", "precio_minimo"} <= set(df.columns):
        out = out.withColumn("variacion_precio", F.col("precio_maximo") - F.col("precio_minimo"))
    return out


def money(col: Column | str) -> Column:
    """'S/ 12.35' text; '-' for null (P20)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.format_string(S.MONEY_PREFIX + "%.2f", c), F.lit("-"))


def days_since_origin(date_col: Column | str) -> Column:
    """x of the date-axis regressions: days since 2000-01-01."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.datediff(c, F.lit(S.DATE_AXIS_ORIGIN).cast("date")).cast("double")


def stable_round(col: Column | str, d: int = 2) -> Column:
    """Round an aggregate (mean, regression) to ``d`` dp, HALF_UP.

    Rounding to 6 dp first absorbs the last-bit noise of sums taken in a
    different order, so a value that is mathematically on a tie always rounds
    the same way regardless of partitioning.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.round(c, 6), d)
