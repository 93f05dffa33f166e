"""Lines and sizes of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\v\f\r"


def scanner_lines(text: Column) -> Column:
    """The lines of a text without their ends; nothing follows a final line end; an empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda s: F.when(s.endswith("\r"), F.left(s, F.length(s) - 1)).otherwise(s))


def explode_lines(files: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """file, line (from 1), text."""
    lines = F.posexplode(scanner_lines(F.col(text))).alias("p", "text")
    return files.select(F.col(file).alias("file"), lines).select("file", (F.col("p") + 1).alias("line"), "text")


def physical_lines(text: Column) -> Column:
    """Line ends, and one more if the last line has none; an empty text has 0."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))


def max_line_length(text: Column) -> Column:
    """struct(length, line): code points of the longest line (one carriage return at its end not counted), the first of
    that length."""
    lines = F.split(text, "\n", -1)
    measured = F.transform(lines, lambda s, i: F.struct((F.length(s) - F.when(s.endswith("\r"), 1).otherwise(0)).alias("length"), (-i).alias("back")))
    best = F.array_max(measured)
    return F.struct(best["length"].alias("length"), F.when(best["length"] > 0, 1 - best["back"]).otherwise(0).alias("line"))


def package_of(path: Column) -> Column:
    """The directory of a path, ``.`` at the top."""
    found = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    return F.when(found == "", ".").otherwise(found)
