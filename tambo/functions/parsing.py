"""Tolerant text parsing as JVM-side column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-first formats accepted for survey dates, tried in order, each with the
# text shape that selects it (one parse attempt per value, no failing parses).
DATE_FORMATS = ["d/M/yyyy H:mm:ss", "d/M/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
DATE_SHAPES = [
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
]

# Plain decimal / scientific number; rejects Java suffixes such as "1.5d",
# "NaN" and "Infinity" that a bare cast would accept.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_day_first_date(col: Column | str, trimmed: bool = False) -> Column:
    """Text -> DATE; day-first, unparsable -> null."""
    c = F.col(col) if isinstance(col, str) else col
    c = c if trimmed else F.trim(c)
    out = None
    for shape, fmt in zip(DATE_SHAPES, DATE_FORMATS):
        parsed = F.try_to_timestamp(c, F.lit(fmt))
        out = F.when(c.rlike(shape), parsed) if out is None else out.when(c.rlike(shape), parsed)
    return out.cast("date")


def parse_timestamp(col: Column | str, formats: list[str]) -> Column:
    """Text -> TIMESTAMP trying ``formats`` in order; bad text -> null."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in formats])


def parse_number(col: Column | str, trimmed: bool = False, check_finite: bool = True) -> Column:
    """Text -> DOUBLE; bad text, NaN and infinities -> null."""
    c = F.col(col) if isinstance(col, str) else col
    c = c if trimmed else F.trim(c)
    v = F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))
    return finite(v) if check_finite else v


def finite(col: Column) -> Column:
    """Null for NaN and +/- infinity (P8); NaN fails the comparison too."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)
