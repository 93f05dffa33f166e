"""Risk scores from complexity and coverage, size limits, coverage joins, diffs of two reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage() -> Column:
    """Of lines_total, lines_covered, unmeasured: 0 where the file is missing from the report, 1 where nothing can be covered."""
    return F.when(F.col("unmeasured"), F.lit(0.0)).when(F.col("lines_total") <= 0, F.lit(1.0)).otherwise(F.col("lines_covered") / F.col("lines_total"))


def with_score(functions: DataFrame) -> DataFrame:
    c, u = F.col("complexity").cast("double"), F.lit(1.0) - F.col("coverage")
    return functions.withColumn("coverage", coverage()).withColumn("crap", c * c * u * u * u + c)


def crap_gate(scored: DataFrame, fail_above: float) -> DataFrame:
    """functions, above, max_crap, unmeasured, passed (no score over fail_above)."""
    return scored.agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(F.col("crap") > fail_above).alias("above"), F.max("crap").alias("max_crap"), F.count_if("unmeasured").alias("unmeasured"), F.coalesce(F.bool_and(F.col("crap") <= fail_above), F.lit(True)).alias("passed")
    )


@dataclass(frozen=True)
class SizeLimits:
    """0 turns a limit off."""

    lines: int = 80
    params: int = 6
    nesting: int = 5
    file_lines: int = 600
    line_length: int = 320


def _over(rows: DataFrame, checks: list[tuple[str, Column, int]], start_line: dict[str, Column], name: Column) -> DataFrame:
    found = [F.when(value > limit, F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"), F.lit(limit).cast("long").alias("threshold"), start_line.get(kind, F.lit(0)).cast("long").alias("start_line"))) for kind, value, limit in checks if limit > 0]
    if not found:
        return rows.limit(0).select("file", F.lit("").alias("name"), F.lit(0).cast("long").alias("start_line"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("threshold"))
    return rows.select("file", name.alias("name"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("file", "name", "f.start_line", "f.kind", "f.value", "f.threshold")


def size_findings(functions: DataFrame, file_sizes: DataFrame, limits: SizeLimits = SizeLimits()) -> DataFrame:
    """file, name, start_line, kind, value, threshold: functions and files over a limit."""
    own = {k: F.col("start_line") for k in ("lines", "params", "nesting")}
    of_functions = _over(functions, [("lines", F.col("end_line") - F.col("start_line") + 1, limits.lines), ("params", F.col("param_count"), limits.params), ("nesting", F.col("max_nesting_depth"), limits.nesting)], own, F.col("name"))
    of_files = _over(file_sizes, [("file_lines", F.col("lines"), limits.file_lines), ("file_line_length", F.col("max_line_length"), limits.line_length)], {"file_line_length": F.col("max_line_length_line")}, F.lit(""))
    return of_functions.unionByName(of_files)


def merged_ranges(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """Maximal runs of consecutive lines (repeats count once): by..., start, end."""
    w = Window.partitionBy(*by).orderBy(line)
    runs = lines.select(*by, line).distinct().withColumn("_run", F.col(line) - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_run")


def _level(length: Column) -> Column:
    """The least k with 4^k >= length."""
    return F.when(length <= 1, F.lit(0)).otherwise(F.ceil(F.length(F.bin(length - 1)) / 2)).cast("int")


#: rows of a task of these joins
ROWS_A_TASK = 1 << 18


def tasks_for(rows: int) -> int:
    """How many tasks take so many rows, so that a task's memory stays the same for larger tables."""
    return 1 + rows // ROWS_A_TASK


def _inside(functions: DataFrame, rows: DataFrame, tasks: int | None, *sums: Column) -> DataFrame:
    """Aggregates of rows(file, s, e, ...) that lie wholly in a function (start_line to end_line of the file), and whether the
    file has no rows at all (unmeasured). The functions' columns are kept; equal functions are one.

    A function is indexed by the bin of its start, of the least power of four that isn't smaller than it, so that it reaches
    into one more bin at most; a row by the bin of its begin and the one before, for each size that its file's functions
    have. So a row meets the functions around it, a few times as many as it lies in, and not all of its file; a generated
    file of very many functions is dealt over its bins, and a function's rows meet in one place. With ``tasks`` the bins are
    dealt over so many, else over as many as Spark chooses.
    """
    level = _level((F.col("end_line") - F.col("start_line") + 1).cast("long"))
    own = functions.distinct()
    names = [f"_{k}" for k in range(len(own.columns))]
    seen = rows.select(F.col("file").alias("seen")).distinct()
    indexed = own.select(*(F.col(c).alias(n) for c, n in zip(own.columns, names, strict=True)), F.col("file").alias("of"), F.col("start_line").alias("begin"), F.col("end_line").alias("end"), level.alias("size"))
    indexed = indexed.join(seen, F.col("of") == F.col("seen"), "left").withColumn("unmeasured", F.col("seen").isNull()).drop("seen")
    indexed = indexed.withColumn("bin", F.expr("shiftright(cast(begin as bigint), 2 * size)"))
    sizes = functions.select("file", level.alias("level")).filter("level is not null").distinct()
    at = F.expr("shiftright(cast(s as bigint), 2 * level)")
    placed = rows.join(sizes, "file").select("*", F.explode(F.when(F.col("level") == 0, F.array(at)).otherwise(F.array(at, at - 1))).alias("at"))
    if tasks:
        indexed, placed = indexed.repartition(tasks, "of", "size", "bin"), placed.repartition(tasks, "file", "level", "at")
    met = indexed.join(placed, (F.col("of") == F.col("file")) & (F.col("size") == F.col("level")) & (F.col("bin") == F.col("at")) & (F.col("s") >= F.col("begin")) & (F.col("e") <= F.col("end")), "left")
    counted = met.groupBy("of", "size", "bin", *names, "unmeasured").agg(*sums)
    made = [c for c in counted.columns if c not in ("of", "size", "bin", "unmeasured", *names)]
    return counted.select(*(F.col(n).alias(c) for n, c in zip(names, own.columns, strict=True)), *made, "unmeasured")


def join_blocks(functions: DataFrame, blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Coverage by blocks that lie wholly in a function of the same file: sums of statements, uncovered ranges by start.

    The files' report decides what is unmeasured; blocks that repeat are summed, not merged.
    """
    b = blocks.select("file", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("num_stmt").alias("n"), F.col("count").alias("hits"))
    none = F.sort_array(F.collect_list(F.when(F.col("hits") == 0, F.struct(F.col("s").alias("start"), F.col("e").alias("end")))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _inside(functions, b, tasks, total(F.col("n")).alias("lines_total"), total(F.when(F.col("hits") > 0, F.col("n"))).alias("lines_covered"), none.alias("uncovered_lines"))


def _points(functions: DataFrame, rows: DataFrame, tasks: int | None) -> DataFrame:
    """lines_total, lines_covered, unmeasured by rows(file, line, hit) that lie in a function."""
    own = rows.select("file", F.col("line").alias("s"), F.col("line").alias("e"), "hit")
    return _inside(functions, own, tasks, F.count("s").alias("lines_total"), F.count_if("hit").alias("lines_covered"))


def join_lines(functions: DataFrame, lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Coverage by lines (file, line, hit): each line counts once, hit if any row says so."""
    return _points(functions, lines.groupBy("file", "line").agg(F.bool_or("hit").alias("hit")), tasks)


def join_statements(functions: DataFrame, statements: DataFrame, tasks: int | None = None) -> DataFrame:
    """Coverage by statements (file, line, hits) that begin in a function: each counts, also several on a line."""
    return _points(functions, statements.select("file", "line", (F.col("hits") > 0).alias("hit")), tasks)


def matched_paths(files: DataFrame, reported: DataFrame) -> DataFrame:
    """file, report_path: for each of files(file) the reported(path) that is equal, else one that ends with it after a slash
    (the smallest of several). Ends are exploded and joined, so no pair of paths is compared."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("file"), (k > 1).alias("part")))
    found = reported.select("path", F.explode(ends).alias("e")).select("e.file", F.struct("e.part", "path").alias("rank"))
    return files.select("file").distinct().join(found, "file").groupBy("file").agg(F.min("rank").alias("rank")).select("file", F.col("rank.path").alias("report_path"))


def file_sizes(measured: DataFrame, functions: DataFrame) -> DataFrame:
    """measured(file, lines, max_line_length, max_line_length_line); where functions(file, file_lines) knows a file's lines,
    these count."""
    own = functions.groupBy("file").agg(F.max("file_lines").alias("_lines"))
    return measured.join(own, "file", "left").withColumn("lines", F.coalesce("_lines", "lines")).drop("_lines")


def with_line_lengths(functions: DataFrame, sizes: DataFrame) -> DataFrame:
    """The functions with their file's longest line."""
    own = sizes.select("file", F.col("max_line_length").alias("file_max_line_length"), F.col("max_line_length_line").alias("file_max_line_length_line"))
    return functions.join(own, "file", "left")


def crap_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, name, old_crap, new_crap, delta, change: rows whose score differs; of repeated keys the last (by ord) counts."""
    last = lambda d, c: d.groupBy("file", "name").agg(F.max_by("crap", "ord").alias(c), F.lit(True).alias(f"_{c}"))
    both = last(old, "old_crap").join(last(new, "new_crap"), ["file", "name"], "full")
    change = F.when(F.col("_old_crap").isNull(), "new").when(F.col("_new_crap").isNull(), "removed").otherwise("changed")
    delta = F.coalesce("new_crap", F.lit(0.0)) - F.coalesce("old_crap", F.lit(0.0))
    return both.filter(~F.col("old_crap").eqNullSafe(F.col("new_crap"))).select("file", "name", "old_crap", "new_crap", delta.alias("delta"), change.alias("change"))
