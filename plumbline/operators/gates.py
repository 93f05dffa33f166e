"""What all gates share: changed-file scopes, evidence that inputs were analysed, top-n rows with a rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import cleaned
from plumbline.functions.regex import excluded


def in_scope(rows: DataFrame, changed: DataFrame | None, *paths: str) -> DataFrame:
    """Rows of which any path column is a changed path, both cleaned: equal paths, never ends of paths. None: no scope, all
    rows; an empty table: no rows. A column of paths may be an array: any of them counts."""
    if changed is None:
        return rows
    text = dict(rows.dtypes)
    clean = lambda c, kind: cleaned(c) if kind == "string" else c
    names = changed.select(clean(F.col("path"), dict(changed.dtypes)["path"]).alias("path")).distinct()
    packed = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("own")  # so that no name of the rows counts
    if len(paths) == 1 and not text[paths[0]].startswith("array"):
        return rows.select(packed, clean(F.col(paths[0]), text[paths[0]]).alias("path")).join(names, "path", "left_semi").select("own.*")
    own = F.array_compact(F.flatten(F.array(*(F.transform(p, lambda x: clean(x, "string")) if text[p].startswith("array") else F.array(clean(F.col(p), text[p])) for p in paths))))
    hits = rows.select(packed, own.alias("paths"), F.monotonically_increasing_id().alias("row")).select("own", "row", F.explode("paths").alias("path"))
    return hits.join(names, "path", "left_semi").dropDuplicates(["row"]).select("own.*")


def policy_scope(changed: DataFrame | None, policy: str) -> DataFrame | None:
    """The scope of a gate whose policy is a file itself: if that file changed, everything is judged (None)."""
    if changed is None or not changed.filter(cleaned(F.col("path")) == cleaned(F.lit(policy))).isEmpty():
        return None
    return changed


def without_excluded(rows: DataFrame, path: str, globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose path no glob excludes, and a row with the number of the others."""
    out = excluded(F.col(path), globs)
    return rows.filter(~out), rows.agg(F.count_if(out).alias("excluded"))


def evidence(eligible: DataFrame, analyzed: DataFrame, changed: DataFrame | None = None, excluded: Column | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """One row: required, analyzed, n_missing, n_unresolved, passed, reason.

    A full run without eligible files fails; a scoped one passes as not applicable. unresolved(file, specifier): local
    imports of the scope that lead nowhere; any fails.
    """
    rows = eligible if excluded is None else eligible.filter(~excluded)
    rows = in_scope(rows, changed, "path").select("path").distinct()
    seen = analyzed.select("path").distinct().withColumn("_seen", F.lit(True))
    out = rows.join(seen, "path", "left").agg(F.count(F.lit(1)).alias("required"), F.count("_seen").alias("analyzed"), F.count_if(F.col("_seen").isNull()).alias("n_missing"))
    lost = F.lit(0).cast("long")
    if unresolved is not None:
        count = in_scope(unresolved, changed, "file").agg(F.count(F.lit(1)).alias("n_unresolved"), F.lit(0).alias("_one"))
        out, lost = out.withColumn("_one", F.lit(0)).join(count, "_one"), F.col("n_unresolved")
    nothing = (F.col("required") == 0) & F.lit(changed is None)
    short = F.lit("insufficient analysis: ")
    reason = F.when(lost > 0, F.concat(short, lost.cast("string"), F.lit(" relative local import(s) could not be resolved"))).when(nothing, F.concat(short, F.lit("no eligible files")))
    reason = reason.when(F.col("n_missing") > 0, F.concat(short, F.col("n_missing").cast("string"), F.lit(" eligible file(s) were not analyzed"))).when(F.col("required") == 0, "not applicable").otherwise("")
    return out.select("required", "analyzed", "n_missing", lost.alias("n_unresolved"), (~nothing & (F.col("n_missing") == 0) & (lost == 0)).alias("passed"), reason.alias("reason"))


def with_evidence(verdict: DataFrame, analysis: DataFrame) -> DataFrame:
    """A verdict of one row with the evidence for it: passed only if both pass."""
    right = analysis.select(F.lit(0).alias("one"), F.col("passed").alias("analysed"), F.struct(*(F.col(c).alias(f"evidence_{c}") for c in ("required", "analyzed", "n_missing", "n_unresolved", "reason"))).alias("evidence"))
    both = verdict.select(F.struct(*verdict.columns).alias("own"), F.lit(0).alias("one")).join(right, "one")
    passed = (F.col("own.passed") & F.col("analysed")).alias("passed")
    return both.select(*(passed if c == "passed" else F.col(f"own.{c}") for c in verdict.columns), "evidence.*")


def evidence_lines(analysis: DataFrame, lost: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """ord, text: the evidence as lines of text. lost(path): eligible files that were not analysed."""
    idle = F.col("passed") & (F.col("required") == 0)
    head = F.when(idle, "analysis evidence: no eligible changed files; gate not applicable").otherwise(F.format_string("analysis evidence: %d/%d eligible file(s) analyzed", "analyzed", "required"))
    lines = F.array(F.struct(F.lit(0).alias("ord"), head.alias("text")), F.when(~F.col("passed"), F.struct(F.lit(1).alias("ord"), F.concat(F.lit("FAIL: "), "reason").alias("text"))))
    out = analysis.select(F.explode(F.array_compact(lines)).alias("l")).select("l.ord", "l.text")
    for k, (rows, text) in enumerate(((lost, F.concat(F.lit("  missing: "), "path") if lost is not None else None), (unresolved, F.concat(F.lit("  unresolved import: "), "file", F.lit(" "), "specifier") if unresolved is not None else None)), 2):
        if rows is not None:
            out = out.unionByName(rows.select(F.lit(k).alias("ord"), text.alias("text")))
    return out


def missing(eligible: DataFrame, analyzed: DataFrame) -> DataFrame:
    return eligible.select("path").distinct().join(analyzed.select("path"), "path", "left_anti")


def top_n(rows: DataFrame, n: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first n rows (0: all) and a row with the number of the others."""
    rest = rows.agg(F.count(F.lit(1)).alias("n")).select((F.greatest(F.col("n") - n, F.lit(0)) if n > 0 else F.lit(0)).cast("long").alias("remaining"))
    ordered = rows.orderBy(*order)
    return (ordered.limit(n) if n > 0 else ordered), rest


def count_gate(rows: DataFrame, fail_above: int = 0) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("findings")).withColumn("passed", F.col("findings") <= fail_above)
