"""Coverage reports as tables: four formats, each read as text by Spark and taken apart by its functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COVERAGE_JSON = "files map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>"
ISTANBUL = "map<string,struct<statementMap:map<string,struct<start:struct<line:int>>>,s:map<string,int>>>"


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "report")


def cover_profile(reports: DataFrame) -> DataFrame:
    """Lines ``file:12.3,18.4 3 1`` after a header -> file, start_line, end_line, num_stmt, count."""
    lines = reports.select(F.explode(F.split("report", "\r?\n")).alias("l"))
    row = r"\A(.+):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+ ([0-9]+) ([0-9]+)\z"
    part = lambda k, name: F.regexp_extract("l", row, k).cast("int" if k > 1 else "string").alias(name)
    return lines.filter(F.col("l").rlike(row)).select(*(part(k + 1, n) for k, n in enumerate(["file", "start_line", "end_line", "num_stmt", "count"])))


def coverage_json(reports: DataFrame) -> DataFrame:
    """file, line, hit; a line that is executed and missing counts as hit."""
    files = reports.select(F.explode(F.from_json("report", COVERAGE_JSON)["files"]).alias("file", "v"))
    some = lambda c, hit: F.transform(F.coalesce(c, F.array().cast("array<int>")), lambda x: F.struct(x.alias("line"), F.lit(hit).alias("hit")))
    return files.select("file", F.explode(F.concat(some(F.col("v.executed_lines"), True), some(F.col("v.missing_lines"), False))).alias("x")).groupBy("file", "x.line").agg(F.bool_or("x.hit").alias("hit"))


def istanbul(reports: DataFrame) -> DataFrame:
    """file, stmt_id, line, hits: a row per statement, by its first line."""
    files = reports.select(F.explode(F.from_json("report", ISTANBUL)).alias("file", "v"))
    return files.select("file", F.col("v.s").alias("s"), F.explode("v.statementMap").alias("stmt_id", "x")).select("file", "stmt_id", F.col("x.start.line").alias("line"), F.coalesce(F.element_at("s", F.col("stmt_id")), F.lit(0)).alias("hits"))


def lcov(reports: DataFrame) -> DataFrame:
    """SF, DA and end_of_record lines -> file, line, hit (in any section of the file). A report is split into its
    sections first, so no order over lines is needed."""
    sections = reports.select(F.explode(F.split("report", "end_of_record")).alias("s")).select(F.regexp_extract("s", r"(?m)^SF:(.*?)\r?$", 1).alias("file"), F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^DA:([0-9]+,[0-9]+)"), 1)).alias("d"))
    return sections.filter("file <> ''").groupBy("file", F.split("d", ",")[0].cast("int").alias("line")).agg(F.bool_or(F.split("d", ",")[1].cast("long") > 0).alias("hit"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """One path a line, trimmed, with slashes, without ``./``; an empty file gives an empty table."""
    lines = spark.read.text(path).select(F.btrim(F.replace("value", F.lit("\\"), F.lit("/")), F.lit(" \t\n\x0b\x0c\r\x85\xa0")).alias("path")).filter("path <> ''")
    return lines.select(F.regexp_replace("path", r"\A(?:\./)+", "").alias("path")).distinct()
