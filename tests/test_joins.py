"""Joins by indexes and tables against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.regex import exclude_glob, folders_above, glob_pattern, literal_folder
from plumbline.operators import arch, crap, dupe, gates, imports, testmetric
from plumbline.sources.config import PathMapping


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_coverage_by_bins(spark):
    r = random.Random(1)
    functions = [(r.choice("ab"), k, s := r.randint(1, 300), s + r.choice([0, 1, 3, 15, 16, 17, 200])) for k in range(60)] + [("a", 90, 1, 5000), ("none", 91, 1, 9), ("a", 92, None, None)]
    blocks = [(r.choice("abc"), s := r.randint(1, 320), s + r.randint(0, 12), r.randint(1, 5), r.randint(0, 1)) for _ in range(200)]
    f = spark.createDataFrame(functions, "file string, name int, start_line int, end_line int")
    b = spark.createDataFrame(blocks, "file string, start_line int, end_line int, num_stmt int, count int")
    seen = {x[0] for x in blocks}
    want = []
    for file, name, s, e in functions:
        own = [x for x in blocks if s is not None and x[0] == file and x[1] >= s and x[2] <= e]
        want.append((name, sum(x[3] for x in own), sum(x[3] for x in own if x[4]), sorted((x[1], x[2]) for x in own if not x[4]), file not in seen))
    got = crap.join_blocks(f, b)
    assert got.columns == ["file", "name", "start_line", "end_line", "lines_total", "lines_covered", "uncovered_lines", "unmeasured"]
    assert sorted(((x.name, x.lines_total, x.lines_covered, [tuple(u) for u in x.uncovered_lines], x.unmeasured) for x in got.collect())) == sorted(want)


def test_rows_of_a_function_meet_in_one_place(spark):
    """No shuffle follows the join with the bins, and the bins are dealt over as many tasks as were asked for."""
    r = random.Random(3)
    functions = [(k % 3, k, s := r.randint(-20, 300), s + r.choice([0, 1, 3, 4, 15, 16, 63, 64])) for k in range(80)] + [(0, 90, None, None), (7, 91, 1, 9), (1, 92, 5, 4)]
    lines = sorted({(r.randint(0, 4), r.randint(-20, 320), r.random() < 0.5) for _ in range(300)})
    f = spark.createDataFrame(functions + functions[:5], "file int, name int, start_line int, end_line int")
    got = crap.join_statements(f, spark.createDataFrame([(a, b, int(c)) for a, b, c in lines], "file int, line int, hits int"), 9)
    assert got.rdd.getNumPartitions() == 9
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in plan[: plan.index("Join")]
    own = lambda x: [h for a, b, h in lines if x[2] is not None and a == x[0] and x[2] <= b <= x[3]]
    seen = {a for a, _, _ in lines}
    assert rows(got) == sorted(((*x, len(own(x)), sum(own(x)), x[0] not in seen) for x in functions), key=str)


GLOBS = ["a/*", "a/b/**", "**/x?", "x", "./a/", "a/**/c", "**", "a/b/c", "*", "a.b/c+", "", " a/b ", "***/c", "a/****/c"]
PATHS = ["a", "a/b", "a/b/c", "x", "q/x1", "a.b/c+", "a/q/r/c", "axb/cc", "x/y", "a\\b"]


def test_globs_as_columns(spark):
    import re

    g = spark.createDataFrame([(x,) for x in GLOBS], "g string").select("g", glob_pattern(F.col("g")).alias("p"), literal_folder(F.col("g")).alias("f")).collect()
    above = {x.path: set(x.f) for x in spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", folders_above(F.col("path")).alias("f")).collect()}
    for x in g:
        assert (x.p or "") == exclude_glob(x.g)
        for p in PATHS:
            if x.p and re.search(x.p.replace("\\z", "\\Z"), p.replace("\\", "/")):
                assert x.f in above[p], (x.g, p)


def test_rules_as_a_table(spark):
    pairs = [(f, t) for f in PATHS for t in PATHS]
    edges = spark.createDataFrame([(f, t, f"{f}.go", f"{t}.go") for f, t in pairs], "from_pkg string, to_pkg string, file string, import string")
    rules = [arch.Rule(f"r{k}", s, (GLOBS[k % 5], "a/b")) for k, s in enumerate(GLOBS) if s.strip()]
    free = [arch.Allowed("r0", "a/b", "**"), arch.Allowed("r3", "x", "q/*"), arch.Allowed("r6", "a", "a/b")]
    table = spark.createDataFrame([(r.name, r.source, list(r.deny)) for r in rules], "rule string, source string, deny array<string>")
    exceptions = spark.createDataFrame([(e.rule, e.source, e.target) for e in free], "rule string, source string, target string")
    assert rows(arch.rule_violations(edges, table)) == rows(arch.violations(edges, rules))
    assert rows(arch.rule_violations(edges, table, exceptions)) == rows(arch.violations(edges, rules, free))
    assert arch.rule_violations(edges, table.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_helpers(spark, one_task):
    functions = spark.createDataFrame([("a", 1, True), ("b", 0, True), ("c", 0, True), ("d", 0, True), ("t", 0, False), ("e", 0, True), ("f", 0, True), ("u", 2, False)], "name string, assertions int, helper boolean")
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "b"), ("d", "d"), ("t", "c"), ("t", "c"), ("t", "d"), ("e", "t"), ("f", "u"), ("b", "c")], "caller string, callee string")
    helpers = testmetric.asserting_helpers(functions, calls, one_task)
    assert rows(helpers) == [("a",), ("b",), ("c",)]  # not by way of tests
    assert rows(testmetric.with_helper_calls(functions.filter("not helper"), calls, helpers), "name", "assertions") == [("t", 2), ("u", 2)]
    assert testmetric.asserting_helpers(functions.limit(0), calls, one_task).count() == 0


def test_cycles_through_packages(spark):
    go = lambda *to: "package p\nimport (\n" + "".join(f'\t"m/{t}"\n' for t in to) + ")\n"
    files = spark.createDataFrame([("p/a.go", go("q")), ("p/b.go", go()), ("q/c.go", go("p")), ("q/d.go", go("q")), ("r/e.go", go("r")), ("s/f.go", go("s", "fmt")), ("s/g.go", go("s"))], "file string, content string")
    assert rows(imports.go_cycles(files, "m")) == [("p/a.go", "p/a.go"), ("q/c.go", "p/a.go"), ("q/d.go", "p/a.go"), ("s/f.go", "s/f.go"), ("s/g.go", "s/f.go")]


def test_mappings_as_a_table(spark):
    r = random.Random(2)
    mappings = [PathMapping("@a/*", ("x/*", "y/*.js")), PathMapping("@*/b", ("z/*/q",)), PathMapping("@a/c", ("exact",)), PathMapping("@*", ("any/*",)), PathMapping("*", ("all/*/e",))]
    specs = ["@a/c", "@a/", "@a", "@x/b", "@/b", "@b", "b", "@a/c/b", *("".join(r.choice("@a/bc") for _ in range(6)) for _ in range(60))]
    df = spark.createDataFrame([(s,) for s in specs], "specifier string").distinct()
    for some in (mappings, mappings[:4], mappings[2:3], []):
        want = df.select("specifier", imports.mapped(F.col("specifier"), "top", some).alias("bases")).filter("bases is not null")
        assert rows(imports.mapped_specifiers(df, "top", imports.mapping_table(spark, some))) == rows(want)


def test_runs_along_diagonals(spark):
    words = [f"w{k}" for k in range(40)]
    texts = {"a": words[:20] + ["x"] + words[20:30], "b": ["y"] + words[:20], "c": words[5:30], "d": ["z"] * 9, "e": ["q"]}
    files = spark.createDataFrame([(f, "\n".join(w)) for f, w in texts.items()], "file string, content string")
    got = rows(dupe.repeat_runs(dupe.text_windows(files, 5), 5), "file_a", "start_line_a", "end_line_a", "file_b", "start_line_b", "end_line_b", "tokens")
    # the place of windows 16 to 19 is c alone; in d each window follows the first one
    assert got == [("a", 1, 20, "b", 2, 21, 20), ("a", 22, 31, "c", 16, 25, 10), ("a", 6, 20, "c", 1, 15, 15), *(("d", 1, 5, "d", 1 + k, 5 + k, 5) for k in range(1, 5))]
    assert dupe.repeat_runs(dupe.text_windows(files.limit(0), 5), 5).count() == 0


def test_scopes_with_any_names(spark):
    rows_ = spark.createDataFrame([("a", 1, "b", 0), ("c", 2, "d", 0)], "path string, row int, own string, one int")
    changed = spark.createDataFrame([("d",), ("a",)], "path string")
    assert rows(gates.in_scope(rows_, changed, "own")) == [("c", 2, "d", 0)]
    assert rows(gates.in_scope(rows_, changed, "path", "own")) == [("a", 1, "b", 0), ("c", 2, "d", 0)]


def test_edges_meet_only_folders_that_rules_name(spark):
    """No row for each edge under the top folder, which would be one key for all; rules at the top still meet all edges."""
    edges = spark.createDataFrame([(f"C{k % 3}/c{k}/a", "N/x", f"{k}", "i") for k in range(200)], "from_pkg string, to_pkg string, file string, import string")
    rules = spark.createDataFrame([(f"r{k}", f"C{k % 3}/c{k}/*", ["N/**"]) for k in range(200)], "rule string, source string, deny array<string>")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = arch.rule_violations(edges, rules)
        assert found.count() == 200
        most = found._jdf.queryExecution().executedPlan()
        found.collect()
        sizes = []
        stack = [most]
        while stack:
            node = stack.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                stack.append(node.executedPlan())
                continue
            if name.endswith("QueryStageExec"):
                stack.append(node.plan())
                continue
            if name == "ShuffleExchangeExec":
                sizes.append(node.metrics().apply("shuffleRecordsWritten").value())
            stack += [node.children().apply(k) for k in range(node.children().size())]
        assert max(sizes) == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    top = spark.createDataFrame([("all", "**", ["N/*"]), ("one", "C1/**", ["N/*"])], "rule string, source string, deny array<string>")
    got = arch.rule_violations(edges, top).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in got} == {"all": 200, "one": sum(k % 3 == 1 for k in range(200))}


def test_rounds_of_helpers_read_few_tables(spark, monkeypatch):
    """A long row of helpers: no round reads the names of all rounds before."""
    n, leaves, plain = 24, [], testmetric.written

    def counted(df, name):
        leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return plain(df, name)

    monkeypatch.setattr(testmetric, "written", counted)
    functions = spark.createDataFrame([(k, int(k in (n, 40)), k != 7) for k in range(50)], "name long, assertions int, helper boolean")
    calls = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n, 20), (20, 18), (45, 40), (40, 45), (46, 47)], "caller long, callee long")
    assert sorted(r.name for r in testmetric.asserting_helpers(functions, calls, 0).collect()) == [*range(8, n + 1), 40, 45]
    assert max(leaves) <= testmetric.ROUNDS + 3


def test_only_windows_that_may_repeat_are_shuffled(spark, monkeypatch):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = words(30)
    texts = [(k, " ".join(words(200) + shared[: k % 25] + words(50))) for k in range(40)]
    texts += [(50, "a " * 30), (51, "\n".join(shared)), (51, "\n".join(shared)), (None, " ".join(shared)), (52, None), (53, "a b"), (54, "")]
    files = spark.createDataFrame(texts, "file long, content string").repartition(3)
    likely = dupe.likely_windows(files, 9)
    columns = ("file", "pos", "start_line", "end_line")
    got, want = (sorted(map(str, dupe.repeated_windows(x).select(*columns).collect())) for x in (likely, dupe.text_windows(files, 9)))
    assert got == want and len(want) > 200
    assert likely.count() < 0.1 * dupe.text_windows(files, 9).count()
    runs = sorted(map(str, dupe.repeat_runs(likely, 9).collect()))
    monkeypatch.setattr(dupe, "FREQUENT", 2)
    assert runs == sorted(map(str, dupe.repeat_runs(dupe.text_windows(files, 9), 9).collect()))
