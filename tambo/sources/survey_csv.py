"""Survey CSV scan.

Files have no header, use ``;`` by default and carry 12 positional columns.
The scan is a plain distributed CSV read with an explicit all-text schema:
short rows are padded with nulls and longer rows are cut to 12 columns by the
PERMISSIVE parser.  Title rows need no positional logic: a row is kept when its
first column parses as a day-first date, which is order-free and therefore
safe under any split of the file.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tambo import schemas as S
from tambo.functions.parsing import finite, parse_day_first_date, parse_number

SEPARATORS = [";", ",", "\t"]


def _plain(uri: str) -> str:
    """A file's path as text, however its URI was written."""
    return re.sub(r"^file:/+", "/", unquote(uri))


def dated_under(sep: str) -> Column:
    """Whether a line (``value``) begins with a day-first date and has a second field under ``sep``.

    Cuts the first field out of lines that hold the separator; no line is split into all its fields.
    """
    first = F.trim(F.translate(F.substring_index("value", sep, 1), '"', ""))
    return F.contains("value", F.lit(sep)) & parse_day_first_date(first).isNotNull()


def sniff_separators(spark: SparkSession, paths: Sequence[str], undated: str = "skip") -> dict[str, str]:
    """Separator of each file (S2): the one under which most of its lines, over the whole file, begin with a
    day-first date and have a second field; ties go to the first candidate.

    A file without such a line, an empty one too, is no survey sheet: it is passed over, or with
    ``undated="raise"`` refused.
    """
    if undated not in ("skip", "raise"):
        raise ValueError(f"unknown undated: {undated}")
    lines = spark.read.text(list(paths))
    files = lines.inputFiles()
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\uFEFF", "").alias("value"))
    dated = [dated_under(sep) for sep in SEPARATORS]
    counts = lines.groupBy("file").agg(*[F.count_if(d).alias(f"c{i}") for i, d in enumerate(dated)]).collect()   # one row per file
    found = {}
    for r in counts:
        best = max(range(len(SEPARATORS)), key=lambda i: (r[f"c{i}"], -i))
        if r[f"c{best}"]:
            found[unquote(r["file"])] = SEPARATORS[best]
    without = sorted({_plain(f) for f in files} - {_plain(f) for f in found})
    if without and undated == "raise":
        raise ValueError(f"no dated row under any separator: {', '.join(without)}")
    return found


def read_survey_csv(spark: SparkSession, paths: str | Sequence[str], sep: str = ";",
                    sheet_label: str | None = None, undated: str = "skip") -> DataFrame:
    """Raw 12 text columns + ``hoja_origen``.

    A sheet is labelled by its file's stem unless ``sheet_label`` names it.  With
    ``sep="auto"`` each file is read with its own separator and those without a dated row are
    passed over or refused (``undated``, see ``sniff_separators``).  A leading byte-order mark is
    removed from the first column.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if sep == "auto":
        by_sep: dict[str, list[str]] = {}
        for file, own in sniff_separators(spark, paths, undated).items():
            by_sep.setdefault(own, []).append(file)
        parts = [read_survey_csv(spark, files, own, sheet_label) for own, files in sorted(by_sep.items())]
        if not parts:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*S.SURVEY_COLUMNS, "hoja_origen"]))
        return functools.reduce(DataFrame.unionByName, parts)
    raw = (spark.read.schema(S.RAW_SURVEY_SCHEMA)
           .option("sep", sep).option("header", "false").option("mode", "PERMISSIVE")
           .option("encoding", "UTF-8")
           .csv(paths))
    # The name comes as it stands in the file's URI.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return raw.select(
        F.regexp_replace(F.col("fecha"), "^\uFEFF", "").alias("fecha"),
        *S.SURVEY_COLUMNS[1:],
        (stem if sheet_label is None else F.lit(sheet_label)).alias("hoja_origen"),
    )


def type_survey(raw: DataFrame) -> DataFrame:
    """Text survey -> typed survey: day-first date, numbers, rows without a date dropped.

    Three stacked projections (trim, parse, finite) so that the optimizer does
    not inline one parse into several places: each value is trimmed, matched
    and cast once, and the stage stays small enough for whole-stage codegen.
    """
    nums = S.NUMERIC_SURVEY_COLUMNS
    trimmed = raw.withColumns({c: F.trim(F.col(c)) for c in ["fecha", *nums]})
    parsed = trimmed.withColumns({
        "fecha": parse_day_first_date(F.col("fecha"), trimmed=True),
        **{c: parse_number(F.col(c), trimmed=True, check_finite=False) for c in nums},
    })
    return parsed.filter(F.col("fecha").isNotNull()).withColumns({c: finite(F.col(c)) for c in nums})
