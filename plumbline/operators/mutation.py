"""Mutants: three report formats by JSON functions, scores and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import gates

# Statuses, and their names in two tools' reports (others are left out).
STATUSES = ["killed", "crashed", "timeout", "survived", "no_coverage", "unviable", "ignored"]
STRYKER = {"Killed": "killed", "Crash": "crashed", "Timeout": "timeout", "Survived": "survived", "NoCoverage": "no_coverage", "Unviable": "unviable"}
GREMLINS = {"KILLED": "killed", "TIMED OUT": "timeout", "LIVED": "survived", "NOT COVERED": "no_coverage"}

GENERIC_SCHEMA = "mutants array<struct<file:string,line:int,mutator:string,status:string>>"
STRYKER_SCHEMA = "files map<string,struct<mutants:array<struct<mutatorName:string,status:string,location:struct<start:struct<line:int>>>>>>"
GREMLINS_SCHEMA = "files array<struct<file_name:string,mutations:array<struct<line:int,type:string,status:string>>>>"


def _named(status: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(status == k, v).otherwise(out)
    return F.coalesce(out, F.lit("ignored"))


def parse_mutants(reports: DataFrame, text: str = "report") -> DataFrame:
    """file, line, mutator, status of all reports (a JSON text per row), whatever their formats.

    Key ``mutants``: generic (statuses in any case, an unknown one raises); ``files`` as an object or as an array: two
    tools' formats. Anything else raises.
    """
    kind = F.schema_of_variant(F.try_parse_json(text))
    has = lambda path: F.get_json_object(text, path).isNotNull()
    form = F.when(has("$.mutants"), "generic").when(F.get_json_object(text, "$.files").startswith("{"), "stryker").when(F.get_json_object(text, "$.files").startswith("["), "gremlins")
    rows = reports.select(F.col(text).alias("_t"), F.coalesce(form, F.raise_error(F.concat(F.lit("unknown mutation report: "), F.coalesce(kind, F.lit("not JSON"))))).alias("_f"))
    g = rows.filter("_f = 'generic'").select(F.explode(F.from_json("_t", GENERIC_SCHEMA)["mutants"]).alias("m")).select("m.*")
    lower = F.lower("status")
    g = g.withColumn("status", F.when(lower.isin(*STATUSES), lower).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null"))))))
    s = rows.filter("_f = 'stryker'").select(F.explode(F.from_json("_t", STRYKER_SCHEMA)["files"]).alias("file", "v")).select("file", F.explode("v.mutants").alias("m"))
    s = s.select("file", F.col("m.location.start.line").alias("line"), F.col("m.mutatorName").alias("mutator"), _named(F.col("m.status"), STRYKER).alias("status"))
    r = rows.filter("_f = 'gremlins'").select(F.explode(F.from_json("_t", GREMLINS_SCHEMA)["files"]).alias("v")).select(F.col("v.file_name").alias("file"), F.explode("v.mutations").alias("m"))
    r = r.select("file", "m.line", F.col("m.type").alias("mutator"), _named(F.col("m.status"), GREMLINS).alias("status"))
    return g.unionByName(s).unionByName(r)


def mutation_report(mutants: DataFrame, fail_below: float = 60.0, covered_only: bool = False, min_mutants: int = 0, minimum_graded: int = 0) -> DataFrame:
    """One row: tallies, graded, score (100 if nothing is graded), passed, insufficient, insufficient_evidence.

    Fewer than min_mutants graded: the score is too noisy, passes. Fewer than minimum_graded: fails, and that wins.
    """
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    out = mutants.agg(is_("killed", "crashed", "timeout").alias("detected"), is_("crashed").alias("crashed"), is_("survived").alias("survived"), is_("no_coverage").alias("no_coverage"), is_("unviable").alias("unviable"))
    graded = F.col("detected") + F.col("survived") + (F.lit(0) if covered_only else F.col("no_coverage"))
    out = out.withColumn("graded", graded.cast("long"))
    out = out.withColumn("score", F.when(F.col("graded") > 0, F.col("detected") / F.when(F.col("graded") > 0, F.col("graded")) * 100).otherwise(F.lit(100.0)))
    few = F.lit(min_mutants > 0) & (F.col("graded") < min_mutants)
    none = F.lit(minimum_graded > 0) & (F.col("graded") < minimum_graded)
    return out.withColumn("insufficient", few).withColumn("insufficient_evidence", none).withColumn("passed", ((F.col("score") >= fail_below) | few) & ~none)


def survivors(mutants: DataFrame, covered_only: bool = False) -> DataFrame:
    return mutants.filter(F.col("status").isin("survived", *([] if covered_only else ["no_coverage"])))


def scoped_mutation_report(mutants: DataFrame, fail_below: float, changed: DataFrame | None, eligible: DataFrame, *, minimum_graded: int = 0, **how) -> DataFrame:
    """The report over changed files; without an eligible changed file there is no floor. eligible(path)."""
    nothing = minimum_graded > 0 and changed is not None and gates.in_scope(eligible, changed, "path").isEmpty()
    return mutation_report(gates.in_scope(mutants, changed, "file"), fail_below, minimum_graded=0 if nothing else minimum_graded, **how)
