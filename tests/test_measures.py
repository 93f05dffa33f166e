"""Golden rows of the measures, on small tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import python_facts
from plumbline.functions.regex import allowed, exclude_glob, excluded, to_java
from plumbline.functions.text import max_line_length, package_of, physical_lines, scanner_lines
from plumbline.operators import arch, crap, deadcode, dupe, escape, gates, graph, mutation, testmetric
from plumbline.sources import coverage
from plumbline.sources.trees import source_tree
from plumbline.sources.walks import WALKS


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def one(df):
    return df.collect()[0].asDict()


def test_score(spark):
    f = spark.createDataFrame([(1, 10, 10, False), (10, 10, 0, False), (4, 10, 5, False), (3, 0, 0, False), (3, 5, 5, True)], "complexity int, lines_total int, lines_covered int, unmeasured boolean")
    assert [r.crap for r in crap.with_score(f).orderBy("complexity", "unmeasured", "lines_total").collect()] == [1.0, 3.0, 12.0, 6.0, 110.0]
    gate = one(crap.crap_gate(crap.with_score(f), 30))
    assert (gate["functions"], gate["above"], gate["unmeasured"], gate["passed"]) == (5, 1, 1, False)
    assert one(crap.crap_gate(crap.with_score(f), 110))["passed"]
    assert one(crap.crap_gate(crap.with_score(f.limit(0)), 30))["passed"]


def test_merged_ranges(spark):
    lines = spark.createDataFrame([("a", x) for x in (7, 3, 1, 2, 3, 9, 8)] + [("b", 5)], "file string, line int")
    assert rows(crap.merged_ranges(lines, ["file"])) == [("a", 1, 3), ("a", 7, 9), ("b", 5, 5)]


def test_size_findings(spark):
    f = spark.createDataFrame([("a", "f", 10, 100, 7, 5), ("a", "g", 1, 80, 6, 6)], "file string, name string, start_line int, end_line int, param_count int, max_nesting_depth int")
    sizes = spark.createDataFrame([("a", 600, 321, 4), ("b", 601, 320, 1)], "file string, lines int, max_line_length int, max_line_length_line int")
    assert rows(crap.size_findings(f, sizes), "file", "name", "start_line", "kind", "value") == [
        ("a", "", 4, "file_line_length", 321), ("a", "f", 10, "lines", 91), ("a", "f", 10, "params", 7), ("a", "g", 1, "nesting", 6), ("b", "", 0, "file_lines", 601),
    ]
    assert crap.size_findings(f, sizes, crap.SizeLimits(0, 0, 0, 0, 0)).count() == 0


def test_coverage_joins(spark):
    f = spark.createDataFrame([("a", "f", 1, 9), ("a", "g", 10, 20), ("b", "h", 1, 5)], "file string, name string, start_line int, end_line int")
    profile = spark.createDataFrame([("mode: set\na:1.2,3.4 2 1\na:4.1,9.9 1 0\na:9.1,12.2 5 1\nbad line\n",)], "report string")
    joined = crap.join_blocks(f, coverage.cover_profile(profile))
    assert rows(joined, "name", "lines_total", "lines_covered", "unmeasured") == [("f", 3, 2, False), ("g", 0, 0, False), ("h", 0, 0, True)]
    assert one(joined.filter("name = 'f'"))["uncovered_lines"] == [(4, 9)]
    report = spark.createDataFrame([(json.dumps({"files": {"a": {"executed_lines": [1, 2, 30], "missing_lines": [2, 11, 12]}}}),)], "report string")
    joined = crap.join_lines(f, coverage.coverage_json(report))
    assert rows(joined, "name", "lines_total", "lines_covered", "unmeasured") == [("f", 2, 2, False), ("g", 2, 0, False), ("h", 0, 0, True)]
    ts = spark.createDataFrame([(json.dumps({"/x/a.ts": {"statementMap": {"0": {"start": {"line": 3}}, "1": {"start": {"line": 3}}}, "s": {"0": 2, "1": 0}}}),)], "report string")
    assert rows(coverage.istanbul(ts)) == [("/x/a.ts", "0", 3, 2), ("/x/a.ts", "1", 3, 0)]
    lcov = spark.createDataFrame([("SF:a\nDA:1,0\nDA:2,3\nend_of_record\nSF:a\nDA:1,1\nend_of_record\n",)], "report string")
    assert rows(coverage.lcov(lcov)) == [("a", 1, True), ("a", 2, True)]


def test_crap_diff(spark):
    old = spark.createDataFrame([("a", "f", 1.0, 0), ("a", "f", 5.0, 1), ("a", "g", 2.0, 2), ("a", "same", 3.0, 3)], "file string, name string, crap double, ord int")
    new = spark.createDataFrame([("a", "f", 7.0, 0), ("a", "h", 4.0, 1), ("a", "same", 3.0, 2)], "file string, name string, crap double, ord int")
    assert rows(crap.crap_diff(old, new), "name", "delta", "change") == [("f", 2.0, "changed"), ("g", -2.0, "removed"), ("h", 4.0, "new")]


def test_lines(spark):
    t = spark.createDataFrame([(0, ""), (1, "a"), (2, "a\n"), (3, "a\r\nbbb\n\n"), (4, "\n")], "k int, t string").orderBy("k")
    assert [r[0] for r in t.select(F.size(scanner_lines(F.col("t")))).collect()] == [0, 1, 1, 3, 1]
    assert [r[0] for r in t.select(physical_lines(F.col("t"))).collect()] == [0, 1, 1, 3, 1]
    assert [tuple(r[0]) for r in t.select(max_line_length(F.col("t"))).collect()] == [(0, 0), (1, 1), (1, 1), (3, 2), (0, 0)]
    p = spark.createDataFrame([("a/b/c.py",), ("c.py",)], "p string")
    assert [r[0] for r in p.select(package_of(F.col("p"))).collect()] == ["a/b", "."]


def test_hatches(spark):
    files = spark.createDataFrame([
        ("a.go", "x := 1 // nolint\n_ = f.Close()\ny() // #nosec G1\n"), ("a.py", "import x # type: ignore\nx = 1  # noqa\n# noqaé\nexcept:\n# pylint: disable=x\n"), ("a.swift", "try! f()\nlet a = b as! C\nx!\nif a != b {}\ntry? f()\n// swiftlint:disable x\n"),
        ("a.test.ts", "// @ts-ignore"), ("a.ts", "// @ts-ignore\r\n// eslint-disable-next-line\n"),
    ], "file string, content string")
    of = lambda lang: rows(escape.hatches(escape.scanned(files, lang), escape.patterns_of(lang)), "line", "pattern")
    assert of("golang") == [(1, "nolint"), (2, "discarded-result"), (3, "nosec")]
    assert of("py") == [(1, "type-ignore"), (2, "noqa"), (3, "noqa"), (4, "bare-except"), (5, "pylint-disable")]
    assert of("swift") == [(1, "force-try"), (1, "force-unwrap"), (2, "force-cast"), (2, "force-unwrap"), (3, "force-unwrap"), (5, "discarded-error"), (6, "swiftlint-disable")]
    assert of("js") == [(1, "ts-ignore"), (2, "eslint-disable")]
    hits = escape.hatches(escape.scanned(files, "go"), escape.patterns_of("go"))
    report = one(escape.escape_report(hits, escape.lines_by_file(escape.scanned(files, "go")), 1000, ["nosec"]))
    assert (report["hits"], report["total_lines"], report["rate"], report["forbidden_found"], report["passed"]) == (3, 3, 1000.0, ["nosec"], False)
    empty = one(escape.escape_report(hits.limit(0), escape.lines_by_file(files).limit(0), 1))
    assert (empty["rate"], empty["passed"]) == (0.0, True)


def test_translated_classes():
    assert to_java(r"#\s*noqa\b") != r"#\s*noqa\b"
    assert to_java(r"[\w)\]]!([^=!]|$)") == r"[0-9A-Za-z_)\]]!([^=!]|\z)"


@pytest.mark.parametrize(("glob", "path", "hit"), [
    ("a.py", "x/a.py", True), ("gen", "x/gen/a.py", True), ("x/*", "x/a.py", True), ("x/*", "x/y/a.py", True), ("x/*.py", "x/y/a.py", False), ("**/y", "x/y/a.py", True), ("x/**", "x/y/a.py", True), ("x/**/a.py", "x/a.py", True), ("?.py", "ab.py", False),
    ("./x/", "x/a", True), ("a.b", "axb", False), ("a+b", "x/a+b", True), ("", "x", False),
])
def test_exclude_globs(glob, path, hit):
    p = exclude_glob(glob)
    assert bool(p and re.search(p.replace(r"\z", r"\Z"), path)) == hit


def test_allow_list(spark):
    f = spark.createDataFrame([("gen/a.go", "X"), ("src/a.pb.go", "Y"), ("src/b.go", "T.Registered"), ("src/c.go", "Registered2"), ("a/b/x.ts", "z")], "file string, name string")
    keep = lambda *entries: [r.name for r in f.filter(~allowed(F.col("file"), F.col("name"), list(entries))).collect()]
    assert keep("# c", "gen/", "*.pb.go") == ["T.Registered", "Registered2", "z"]
    assert keep("Registered") == ["X", "Y", "Registered2", "z"]
    assert keep("**/x.t[a-z]", "src/*.go") == ["X"]
    assert [r.name for r in f.filter(excluded(F.col("file"), ["src"])).collect()] == ["Y", "T.Registered", "Registered2"]


def test_architecture(spark):
    e = spark.createDataFrame([("domain/a.go", 0, "infra/b.go"), ("domain/a.go", 1, "infra/c.go"), ("domain/z.go", 0, "infra/b.go"), ("cmd/b/m.go", 0, "cmd/a/m.go"), ("infra/b.go", 0, "infra/c.go")], "src string, ord int, dst string")
    edges = arch.arch_edges(e)
    rules = [arch.Rule("domain-pure", "domain", ("infra",)), arch.Rule("no-cmd", "cmd/*", ("cmd/**",))]
    assert rows(arch.violations(edges, rules), "rule", "file", "import") == [("domain-pure", "domain/a.go", "infra/b.go"), ("domain-pure", "domain/a.go", "infra/c.go"), ("domain-pure", "domain/z.go", "infra/b.go"), ("no-cmd", "cmd/b/m.go", "cmd/a/m.go")]
    assert rows(arch.violations(edges, rules, [arch.Allowed("no-cmd", "cmd/b", "cmd/a")]), "rule").count(("no-cmd",)) == 0
    assert arch.violations(edges, []).count() == 0
    with pytest.raises(ValueError, match="needs"):
        arch.violations(edges, [arch.Rule("x", "", ("y",))])
    pairs = arch.package_pairs(edges)
    assert rows(pairs, "from_pkg", "to_pkg", "file", "import") == [("cmd/b", "cmd/a", "cmd/b/m.go", "cmd/a/m.go"), ("domain", "infra", "domain/a.go", "infra/b.go")]
    assert ("infra", 1, 0, 0.0) in rows(arch.coupling(pairs)) and ("domain", 0, 1, 1.0) in rows(arch.coupling(pairs))
    chain = spark.createDataFrame([("c1/a", 0, "stable/a"), ("c2/a", 0, "stable/a"), ("stable/a", 0, "unstable/a"), ("unstable/a", 0, "leaf/a"), ("unstable/a", 1, "leaf2/a")], "src string, ord int, dst string")
    found = arch.stability_violations(arch.package_pairs(arch.arch_edges(chain)))
    assert rows(found, "from_pkg", "to_pkg") == [("stable", "unstable")]
    assert arch.new_since(found, found).count() == 0
    v = arch.violations(edges, rules)
    assert rows(arch.arch_diff(v.filter("rule = 'no-cmd'"), v.filter("rule <> 'no-cmd'")), "change").count(("new",)) == 3


def test_tests(spark):
    t = spark.createDataFrame([
        ("a", 1, "none", False, 0, 0, False, False, False, False), ("a", 2, "low", False, 1, 0, False, False, False, True), ("a", 3, "mock", False, 2, 2, False, False, False, False), ("a", 4, "skip", False, 0, 0, True, False, True, True), ("a", 5, "suite", True, 0, 0, False, True, False, False),
    ], "file string, line int, name string, suite boolean, assertions int, interactions int, skipped boolean, focused boolean, expected_failure boolean, uncleaned_temp boolean")
    assert rows(testmetric.test_findings(t, 2), "line", "kind") == [(1, "no-assertions"), (2, "low-assertions"), (2, "temp-no-cleanup"), (4, "expected-failure"), (4, "skipped"), (5, "focused")]
    assert (3, "interaction-only") in rows(testmetric.test_findings(t, 2, testmetric.disabled(include=["interaction-only"])), "line", "kind")
    assert one(testmetric.test_counts(t)) == {"tests": 4, "assertions": 3}
    with pytest.raises(ValueError, match="unknown"):
        testmetric.disabled(["nope"])


def test_mutation(spark):
    stryker = {"files": {"a.ts": {"mutants": [{"mutatorName": "X", "status": s, "location": {"start": {"line": 1}}} for s in ("Killed", "Timeout", "Survived", "NoCoverage", "Ignored")]}}}
    gremlins = {"files": [{"file_name": "a.go", "mutations": [{"line": 3, "type": "Y", "status": s} for s in ("KILLED", "LIVED", "NOT COVERED", "SKIPPED")]}]}
    generic = {"mutants": [{"file": "a", "line": 1, "mutator": "Z", "status": "KILLED"}]}
    of = lambda *r: mutation.parse_mutants(spark.createDataFrame([(json.dumps(x),) for x in r], "report string"))
    assert one(mutation.mutation_report(of(stryker)))["score"] == 50.0
    assert round(one(mutation.mutation_report(of(stryker), covered_only=True))["score"], 1) == 66.7
    assert one(mutation.mutation_report(of(stryker, gremlins, generic)))["graded"] == 8
    nothing = one(mutation.mutation_report(of(stryker).limit(0), 60))
    assert (nothing["score"], nothing["passed"]) == (100.0, True)
    floor = one(mutation.mutation_report(of(stryker), 60, min_mutants=9, minimum_graded=9))
    assert (floor["insufficient"], floor["insufficient_evidence"], floor["passed"]) == (True, True, False)
    assert one(mutation.mutation_report(of(stryker), 60, min_mutants=9))["passed"]
    assert mutation.survivors(of(stryker)).count() == 2
    for bad in ({"mutants": [{"file": "a", "line": 1, "mutator": "Z", "status": "odd"}]}, {"x": 1}):
        with pytest.raises(Exception, match="unknown"):
            of(bad).collect()


def test_dead_code(spark):
    reports = [
        json.dumps([{"Funcs": [{"Name": "F", "Position": {"File": "a.go", "Line": 3}, "Generated": False}, {"Name": "G", "Position": {"File": "a.go", "Line": 9}, "Generated": True}]}]), "null",
        json.dumps({"issues": [{"file": "a.ts", "files": [{"name": "a.ts"}], "exports": [{"name": "x", "line": 4}], "types": [], "enumMembers": [{"name": "E.a", "line": 5}]}]}),
        "a.py:3: unused function 'f' (60% confidence)\na.py:9: unreachable code after 'return' (100% confidence)\n", json.dumps([{"kind": "function.method", "name": "m", "hints": ["unused"], "location": "/x/a:b.swift:7:3"}, {"kind": "class", "name": "c", "hints": ["assignOnly"], "location": "/x/a.swift:1:1"}]),
    ]
    found = deadcode.parse_dead(spark.createDataFrame([(r,) for r in reports], "report string"))
    assert rows(found) == [("/x/a:b.swift", 7, "m", "function"), ("a.go", 3, "F", "function"), ("a.py", 3, "f", "function"), ("a.py", 9, "unreachable code after 'return'", "code"), ("a.ts", 0, "a.ts", "file"), ("a.ts", 4, "x", "export"), ("a.ts", 5, "E.a", "member")]
    assert deadcode.not_allowed(found, ["a.py", "*.go"]).count() == 6
    for bad in ("", "what"):
        with pytest.raises(Exception, match="unknown"):
            deadcode.parse_dead(spark.createDataFrame([(bad,)], "report string")).collect()


def test_gates(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    some = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    out = one(gates.evidence(files, some("a")))
    assert (out["required"], out["analyzed"], out["n_missing"], out["passed"]) == (2, 1, 1, False)
    assert one(gates.evidence(files.limit(0), some("a")))["passed"] is False
    assert one(gates.evidence(files, some("a"), changed=some("docs")))["reason"] == "not applicable"
    assert one(gates.evidence(files, some("a"), changed=some("a")))["passed"]
    assert one(gates.evidence(files, some("a"), excluded=F.col("path") == "b"))["passed"]
    assert rows(gates.missing(files, some("a"))) == [("b",)]
    pairs = spark.createDataFrame([("a", "x"), ("y", "b"), ("c", "d")], "f string, t string")
    assert gates.in_scope(pairs, None, "f").count() == 3
    assert gates.in_scope(pairs, some(), "f").count() == 0
    assert rows(gates.in_scope(pairs, some("a", "b"), "f", "t")) == [("a", "x"), ("y", "b")]
    top, rest = gates.top_n(pairs, 2, F.col("f"))
    assert (rows(top, "f"), one(rest)["remaining"]) == ([("a",), ("c",)], 1)


def test_graphs(spark):
    e = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a"), ("a", 1, "c"), ("s", 0, "a"), ("x", 0, "x"), ("p", 0, "q"), ("q", 0, "r"), ("r", 1, "p"), ("r", 0, "q")], "src string, ord int, dst string")
    assert rows(graph.cycles(e), F.array_join("files", ","), F.array_join("chain", ">")) == [("a,b", "a>b>a"), ("p,q,r", "p>q>r>p"), ("x", "x>x")]
    plain = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (9, 9)], "a long, b long")
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 9)]
    assert rows(graph.strong_components(plain)) == want
    assert rows(graph.strong_components(plain, most=0)) == want
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(90, 91), (None, 1)], "a long, b long")
    assert rows(graph.connected_components(chain).groupBy("component").count()) == [(1, 40), (90, 2)]
    assert graph.connected_components(chain.limit(0)).count() == 0


def test_clones(spark):
    def tokens(**files):
        return spark.createDataFrame([(f, k, t, line) for f, ts in files.items() for k, (t, line) in enumerate(ts)], "file string, pos int, text string, line int")

    run = [(f"t{k}", 3 + k) for k in range(8)]
    t = tokens(a=[("x", 1), ("y", 2), *run], b=[*[(w, n + 10) for w, n in run], ("z", 30)])
    assert rows(dupe.clone_pairs(t, 5)) == [("a", 3, 10, "b", 13, 20, 8)]
    report = one(dupe.dupe_report(t, dupe.clone_pairs(t, 5), 5))
    assert (report["total_lines"], report["duplicated_lines"], report["passed"]) == (28, 16, False)
    same = tokens(a=[*run, *[(w, n + 20) for w, n in run]])
    assert rows(dupe.clone_pairs(same, 5), "tokens") == [(8,)]
    assert dupe.windows(t, 5).count() == 6 + 5
    assert dupe.repeated_windows(dupe.windows(t, 5)).count() == 8
    assert dupe.clone_pairs(t.limit(0), 5).count() == 0


def test_python_facts(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "_p.py").write_text("class C:\n    def m(self, a, *b):\n        if a and b:\n            for x in b:\n                pass\n        elif a:\n            return 1\n\n\ndef g():\n    return 1\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.py").write_text("x")
    (tmp_path / "bad.py").write_text("def (")
    files = source_tree(spark, str(tmp_path), WALKS["py-size"])
    assert rows(files, "file") == [("bad.py",), ("pkg/__init__.py",), ("pkg/_p.py",)]
    assert rows(python_facts.python_functions(files)) == [("pkg/_p.py", "C.m", 2, 7, 5, 2, 2), ("pkg/_p.py", "g", 10, 11, 1, 0, 0)]
    assert rows(python_facts.python_tokens(files).filter("line = 10"), "text", "line") == sorted([("def", 10), ("g", 10), ("(", 10), (")", 10), (":", 10)])


def test_stream_of_files(spark, tmp_path):
    from plumbline.streaming.hatches import hit_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"file": "a.py", "content": "x # noqa\\ny # noqa", "arrived": "2024-01-01T00:03:00"}\n')
    stream = spark.readStream.schema("file string, content string, arrived timestamp").json(str(tmp_path / "in"))
    q = hit_counts(stream, escape.patterns_of("python")).writeStream.format("memory").queryName("hits").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("hits"), "pattern", "hits") == [("noqa", 2)]
