"""Escape hatches: lines that match a named pattern, their rate, and forbidden names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.regex import to_java
from plumbline.functions.text import BLANKS, explode_lines, scanner_lines

# The pattern dictionary by language, in the order in which hits of a line are reported.
PATTERNS = {
    "go": {"nolint": r"//\s*nolint\b", "discarded-result": r"^\s*_\s*=\s*\w+(\.\w+)*\([^)]*\)\s*$", "nosec": r"//\s*#nosec\b"},
    "python": {"type-ignore": r"#\s*type:\s*ignore\b", "noqa": r"#\s*noqa\b", "bare-except": r"^\s*except\s*:\s*$", "pylint-disable": r"#\s*pylint:\s*disable\b"},
    "ts": {"ts-ignore": r"//\s*@ts-ignore\b", "ts-expect-error": r"//\s*@ts-expect-error\b", "ts-nocheck": r"//\s*@ts-nocheck\b", "eslint-disable": r"//\s*eslint-disable"},
    "swift": {"force-try": r"\btry!", "force-cast": r"\bas!", "force-unwrap": r"[\w)\]]!([^=!]|$)", "discarded-error": r"\btry\?\s", "swiftlint-disable": r"//\s*swiftlint:disable\b"},
}
# Language names, the files of each, and the test files that are left out.
ALIASES = {"py": "python", "golang": "go", "typescript": "ts", "js": "ts", "javascript": "ts"}
EXTENSIONS = {"go": [".go"], "python": [".py"], "ts": [".ts", ".tsx", ".js", ".jsx"], "swift": [".swift"]}
TEST_SUFFIXES = {"go": ["_test.go"], "python": ["_test.py"], "ts": [f".{t}{e}" for t in ("test", "spec") for e in (".ts", ".tsx", ".js", ".jsx")], "swift": ["Tests.swift", "Test.swift"]}


def patterns_of(lang: str) -> dict[str, str]:
    return PATTERNS[ALIASES.get(lang, lang)]


def checked_names(lang: str, names: list[str]) -> list[str]:
    """The names, if the language has a pattern of each."""
    unknown = sorted({*names} - {*patterns_of(lang)})
    if unknown:
        raise ValueError(f"no pattern of {lang} is named {', '.join(unknown)}")
    return names


def scanned(files: DataFrame, lang: str) -> DataFrame:
    """Files (file, content) of a language that are not tests."""
    lang = ALIASES.get(lang, lang)
    ends = lambda suffixes: F.expr(" or ".join(f"endswith(file, '{s}')" for s in suffixes))
    return files.filter(ends(EXTENSIONS[lang]) & ~ends(TEST_SUFFIXES[lang]))


def hatches(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """file, line, pattern, text (trimmed): one row per line and pattern that matches it; no shuffle."""
    lines = explode_lines(files)
    hits = [F.when(F.col("text").rlike(to_java(p)), F.lit(name)) for name, p in patterns.items()]
    named = lines.select("file", "line", F.explode(F.array_compact(F.array(*hits))).alias("pattern"), F.btrim("text", F.lit(BLANKS)).alias("text"))
    return named


def lines_by_file(files: DataFrame) -> DataFrame:
    return files.select("file", F.size(scanner_lines(F.col("content"))).cast("long").alias("lines"))


def escape_report(hits: DataFrame, lines: DataFrame, fail_above: float, forbidden: list[str] = ()) -> DataFrame:
    """One row: hits, total_lines, rate per 1000 lines, forbidden names found, passed (rate at most fail_above)."""
    rows = hits.select(F.lit(1).alias("hit"), "pattern", F.lit(0).cast("long").alias("lines")).unionByName(lines.select(F.lit(0).alias("hit"), F.lit(None).cast("string").alias("pattern"), "lines"))
    both = rows.agg(
        F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.array_sort(F.collect_set(F.when(F.col("pattern").isin(*forbidden), F.col("pattern")))).alias("forbidden_found"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines")
    )
    rate = F.when(F.col("total_lines") == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("total_lines") * 1000)
    return both.withColumn("rate", rate).withColumn("passed", (F.col("rate") <= fail_above) & (F.size("forbidden_found") == 0))


def rate_report(files: DataFrame, patterns: dict[str, str], fail_above: float, forbidden: list[str] = ()) -> DataFrame:
    """``escape_report`` of files in one pass: a row of counts per file, added up before any shuffle."""
    lines = files.select(scanner_lines(F.col("content")).alias("lines"))
    count = lambda p: F.size(F.filter("lines", lambda x: x.rlike(to_java(p)))).cast("long")
    counts = lines.select(F.size("lines").cast("long").alias("lines"), *(count(p).alias(f"n{k}") for k, p in enumerate(patterns.values())))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = counts.agg(total("lines").alias("total_lines"), *(total(f"n{k}").alias(f"n{k}") for k in range(len(patterns))))
    hits = F.lit(0).cast("long")
    for k in range(len(patterns)):
        hits = hits + F.col(f"n{k}")
    names = [F.when(F.col(f"n{k}") > 0, F.lit(n)) for k, n in enumerate(patterns) if n in forbidden]
    found = F.array_sort(F.array_compact(F.array(*names))) if names else F.array().cast("array<string>")
    out = sums.select(hits.alias("hits"), "total_lines", found.alias("forbidden_found"))
    rate = F.when(F.col("total_lines") == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("total_lines") * 1000)
    return out.withColumn("rate", rate).withColumn("passed", (F.col("rate") <= fail_above) & (F.size("forbidden_found") == 0))


def by_pattern(hits: DataFrame) -> DataFrame:
    return hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("hits"))
