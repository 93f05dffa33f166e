"""Findings about tests: one row per test with counts and marks, exploded into the checks that it fails."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import discard, written

if TYPE_CHECKING:
    import pyarrow as pa

# The checks in the order in which a test's findings are reported, and what they say.
KINDS = ["skipped", "focused", "expected-failure", "no-assertions", "low-assertions", "interaction-only", "temp-no-cleanup"]
OPT_IN = ["interaction-only"]
DETAILS = {
    "skipped": "unconditionally skipped — it never runs",
    "focused": "focused (.only/fit/fdescribe) — every non-focused test in the run is silently disabled",
    "expected-failure": "marked expected-failure — a known-broken test is being tolerated",
    "no-assertions": "makes no assertions — it can't fail on wrong behavior",
    "interaction-only": "every assertion only verifies a mock/spy call — nothing checks a returned value or resulting state",
    "temp-no-cleanup": "creates a temp directory/file with no cleanup in the test or its file",
}


def disabled(ignore: list[str] = (), include: list[str] = ()) -> set[str]:
    """Checks that are off: those to opt in that aren't included; ignored ones win."""
    for k in (*ignore, *include):
        if k not in KINDS:
            raise ValueError(f"unknown check {k!r}")
    return {*ignore, *(k for k in OPT_IN if k not in include)}


def test_findings(tests: DataFrame, min_assertions: int = 1, off: set[str] | None = None) -> DataFrame:
    """file, line, test, kind, detail, check_ord. Suites and skipped tests are not judged by their assertions."""
    least = max(1, min_assertions)
    off = disabled() if off is None else off
    a, i = F.col("assertions"), F.col("interactions")
    judged = ~(F.col("suite") | F.col("skipped"))
    low = F.concat(a.cast("string"), F.lit(f" assertion(s), below the minimum of {least}"))
    when = {
        "skipped": F.col("skipped"), "focused": F.col("focused"), "expected-failure": F.col("expected_failure"), "no-assertions": judged & (a == 0), "low-assertions": judged & (a > 0) & (a < least),
        "interaction-only": judged & (a >= least) & (i == a), "temp-no-cleanup": judged & F.col("uncleaned_temp"),
    }
    rows = [F.when(when[k], F.struct(F.lit(n).alias("check_ord"), F.lit(k).alias("kind"), (low if k == "low-assertions" else F.lit(DETAILS[k])).alias("detail"))) for n, k in enumerate(KINDS) if k not in off]
    found = tests.select("file", "line", F.col("name").alias("test"), F.explode(F.array_compact(F.array(*rows))).alias("f"))
    return found.select("file", "line", "test", "f.kind", "f.detail", "f.check_ord")


def test_counts(tests: DataFrame) -> DataFrame:
    return tests.filter(~F.col("suite")).agg(F.count(F.lit(1)).alias("tests"), F.coalesce(F.sum("assertions"), F.lit(0)).cast("long").alias("assertions"))


#: Calls up to which one task follows them; a choice of the plan, the result is the same.
ONE_TASK = 500_000


#: Rounds after which calls of marked helpers are dropped; the result is the same.
ROUNDS = 4


def asserting_helpers(functions: DataFrame, calls: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """name of the helpers that assert, themselves or through another one, from functions(name, assertions, helper) and
    calls(caller, callee). helper: whether a function may be one at all (no test; where a test is handed on, one that takes
    it). A name that stands for several functions is a helper if any of them is.

    Marks spread backward over calls. At most ``one_task`` distinct calls of helpers, counted first, are followed by one task.
    More are followed in rounds, each of which joins the names marked in the round before only; a round is written, so a
    lost executor costs one round, and there are as many as helpers call each other in a row. Every ``ROUNDS`` rounds the calls of
    helpers that are marked go, so a round is compared with the few since then and not with all before.
    """
    may = functions.filter("helper").select("name").distinct()
    known = written(calls.select("caller", "callee").distinct().join(may.withColumnRenamed("name", "caller"), "caller", "left_semi"), "helper-calls")
    new = written(functions.filter("helper and assertions > 0").select("name").distinct(), "helpers")
    kind = new.schema["name"].dataType.simpleString()
    if known.count() <= one_task:
        rows = known.unionByName(new.select("name", F.lit(None).cast(kind).alias("callee")).withColumnRenamed("name", "caller"))
        out = written(rows.coalesce(1).mapInArrow(_followed, f"name {kind}"), "helpers")
        discard(known, new)
        return out
    parts, recent = [new], [new]
    while not new.isEmpty():
        if len(recent) >= ROUNDS or len(parts) == 1:
            old, known = known, written(_without(known, "caller", recent), "helper-calls")
            discard(old)
            recent = []
        found = known.join(new.withColumnRenamed("name", "callee"), "callee", "left_semi").select(F.col("caller").alias("name")).distinct()
        new = written(_without(found, "name", recent), "helpers")
        parts.append(new)
        recent.append(new)
    discard(known, *parts[1:][-1:])  # the last one is empty
    out = parts[0]
    for p in parts[1:-1]:
        out = out.unionByName(p)
    return out


def _without(rows: DataFrame, column: str, names: list[DataFrame]) -> DataFrame:
    for n in names:
        rows = rows.join(n.withColumnRenamed("name", column), column, "left_anti")
    return rows


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls (caller, callee) and marked names (callee is null) -> all names that a marked one is reached from."""
    import pyarrow as pa

    callers: dict[object, list] = {}
    work = []
    for batch in batches:
        kind = batch.column(0).type
        for caller, callee in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            work.append(caller) if callee is None else callers.setdefault(callee, []).append(caller)
    seen = set(work)
    while work:
        new = set(callers.get(work.pop(), ())) - seen
        seen |= new
        work += new
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), kind)], names=["name"])


def with_helper_calls(tests: DataFrame, calls: DataFrame, helpers: DataFrame) -> DataFrame:
    """Tests whose calls of asserting helpers count as assertions, each call one."""
    made = calls.join(helpers.withColumnRenamed("name", "callee"), "callee", "left_semi").groupBy(F.col("caller").alias("by")).agg(F.count(F.lit(1)).alias("made"))
    both = tests.join(made, F.col("name") == F.col("by"), "left")
    return both.select(*((F.col("assertions") + F.coalesce("made", F.lit(0))).alias(c) if c == "assertions" else F.col(c) for c in tests.columns))
