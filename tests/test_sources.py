"""Readers, walks, imports and facts on small written-down cases."""

import ast
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import python_facts
from plumbline.functions.paths import cleaned, relative_to
from plumbline.operators import escape, gates, graph, imports
from plumbline.sources import config
from plumbline.sources.trees import in_walk_order, listed, source_tree
from plumbline.sources.walks import WALKS, eligible


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def test_paths(spark):
    given = ["a/b", "./a//b/", "a/../b", "../a", "a/../../b", "/x/./y", "", ".", "a\\b"]
    df = spark.createDataFrame([(g,) for g in given], "p string")
    assert [r[0] for r in df.select(cleaned(F.col("p"))).collect()] == [os.path.normpath(g.replace("\\", "/") or ".") for g in given]
    assert df.select(relative_to(F.lit("/home/x/a/b.py"), "/home/x"), relative_to(F.lit("./c.py"), "/home/x")).first() == ("a/b.py", "c.py")


def test_lists_and_rules():
    assert config.exclude_list("a/**  # why\n\n# all\n b \n") == ["a/**", "b"]
    assert config.ignore_list("# x\nlib/\n a#b \n") == ["lib/", "a#b"]
    with pytest.raises(ValueError):
        config.ignore_list("x[a")
    rules, exceptions = config.layer_rules('{"rules": [{"name": "r", "from": "a/**", "deny": ["b"]}], "exceptions": [{"rule": "r", "from": "a", "to": "b", "reason": "y"}]}')
    assert (rules[0].name, rules[0].source, rules[0].deny, exceptions[0].target) == ("r", "a/**", ("b",), "b")
    for bad in ('{"rules": []}', "{}", '{"rules": [{"name": "r"}]}'):
        with pytest.raises(ValueError):
            config.layer_rules(bad)


def test_path_mappings():
    text = '{ // c\n "compilerOptions": { "baseUrl": "./src", /* x */ "paths": { "@a/*": ["a/*", "b/*",], "@a/x": ["y//z"], "@*": ["c/*"], }, }, }'
    base, found = config.path_mappings(text)
    assert base == "src" and [m.pattern for m in found] == ["@a/x", "@a/*", "@*"] and found[0].targets == ("y//z",)
    assert config.path_mappings("{}") == (".", [])
    for bad in ("{ /* }", '{"compilerOptions": {"paths": {"a**": ["b"]}}}', '{"compilerOptions": {"paths": {"a": []}}}'):
        with pytest.raises(ValueError):
            config.path_mappings(bad)


def test_folders(tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / "m" / "n").mkdir(parents=True)
    (tmp_path / "repo" / "m" / "go.mod").write_text("// x\nmodule example.com/m \n")
    assert config.find_module(str(tmp_path / "repo" / "m" / "n")) == (str(tmp_path / "repo" / "m"), "example.com/m")
    assert config.repository_root(str(tmp_path / "repo" / "m" / "n")) == str(tmp_path / "repo")
    (tmp_path / "out.txt").write_text("secret")
    os.symlink(tmp_path / "out.txt", tmp_path / "repo" / "link.txt")
    (tmp_path / "repo" / "in.txt").write_text("fine")
    assert config.read_inside(str(tmp_path / "repo"), "in.txt") == "fine"
    for bad in ("../out.txt", "link.txt", "/etc/hostname"):
        with pytest.raises(PermissionError):
            config.read_inside(str(tmp_path / "repo"), bad)


def test_walk_of_a_tree(spark, tmp_path):
    for name in ("a.ts", "a.test.ts", "b.d.ts", ".h.ts", "node_modules/x.ts", ".hid/x.ts", "lib/c.jsx", "lib/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    os.symlink("/etc/hostname", tmp_path / "out.ts")
    assert rows(source_tree(spark, str(tmp_path), WALKS["ts"]), "file") == [("a.ts",), ("lib/c.jsx",)]
    df = spark.createDataFrame([("x/Tests/A.swift",), ("x/ATest.swift",), ("x/b.swift",)], "path string")
    assert [r[0] for r in df.select(eligible(F.col("path"), "swift", None)).collect()] == [False, True, True]
    assert not df.select(eligible(F.col("path"), "cobol")).first()[0]


def test_python_imports(spark):
    files = {
        "a/__init__.py": "", "a/b.py": "from . import (c,  # one\n  d as e,\n)\nfrom .. import top\nimport a.c as x, a.d\nfrom .none import q\nfrom .c import z\n", "a/c.py": "from . import b  # note\nfrom ..a.d import (p\nimport top\n",
        "a/d.py": "import os, a.b\n  from .c import *\n", "top.py": "from a.b import c\nfrom a import b\n", "b.py": None,
    }
    df = spark.createDataFrame(list(files.items()), "file string, content string")
    edges = rows(imports.python_edges(df), "src", "dst")
    assert edges == [
        ("a/b.py", "a/__init__.py"), ("a/b.py", "a/c.py"), ("a/b.py", "a/d.py"), ("a/b.py", "top.py"), ("a/c.py", "a/__init__.py"), ("a/d.py", "a/b.py"), ("a/d.py", "a/c.py"), ("top.py", "a/__init__.py"), ("top.py", "a/b.py"),
    ]
    assert [r.dst for r in imports.python_edges(df).filter("src = 'a/b.py'").orderBy("ord").collect()] == ["a/c.py", "a/d.py", "a/__init__.py", "top.py"]
    assert rows(imports.python_unresolved(df)) == [("a/b.py", ".c"), ("a/b.py", ".none")]
    assert imports.python_edges(df.limit(0)).count() == 0


def test_script_imports(spark):
    files = {"src/a.ts": "import x from './b';\n// import './none'\nexport * from \"../lib\";\nconst s = '// ', r = require('./c.js'); import('react'); import '@u/d'; import './a'; import './b.js'", "src/b.ts": "", "src/c.js": "`//`; import './gone'", "lib/index.tsx": None, "src/util/d.jsx": ""}
    df = spark.createDataFrame(list(files.items()), "file string, content string")
    mappings = [config.PathMapping("@u/*", ("none/*", "util/*")), config.PathMapping("@*", ("x/*",))]
    assert [tuple(r) for r in imports.script_edges(df, "src", mappings).orderBy("src", "ord").select("src", "dst").collect()] == [("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/index.tsx"), ("src/a.ts", "src/c.js"), ("src/a.ts", "src/util/d.jsx")]
    assert rows(imports.script_unresolved(df, "src", mappings)) == [("src/a.ts", "./b.js"), ("src/c.js", "./gone")]


def test_complexity_of_written_down_functions():
    cases = {
        "pass": 1, "if a:\n  pass\nelif b:\n  pass\nelse:\n  pass": 3, "for x in y:\n  pass\nelse:\n  pass": 3, "while a and b or c:\n  pass": 4, "try:\n  pass\nexcept A:\n  pass\nexcept B:\n  pass\nelse:\n  pass\nfinally:\n  pass": 4,
        "x = [y for y in z if y if not y]": 4, "assert a": 2, "x = 1 if a else 2": 2, "match x:\n  case 1:\n    pass\n  case 2:\n    pass\n  case _:\n    pass": 3, "match x:\n  case 1:\n    pass\n  case 2:\n    pass": 3,
        "def g():\n  if a:\n    pass\nreturn g": 1, "class K:\n  def m(self):\n    if a:\n      pass": 1,
    }
    for body, want in cases.items():
        text = "def f():\n" + "\n".join("  " + line for line in body.split("\n"))
        assert python_facts.complexity(ast.parse(text).body[0].body) == want, body
    code = "def f():\n  def g():\n    pass\nclass A:\n  def m(self): pass\n  class B:\n    def n(self): pass\nif x:\n  def h(): pass\n"
    assert [f[0] for f in python_facts.functions_of(code)] == ["f", "A.m", "h"]


def test_test_facts(spark):
    code = "import x\nclass TestA(Base):\n  @pytest.mark.xfail\n  def test_a(self):\n    with pytest.raises(E):\n      f()\n    self.assertEqual(1, 2)\n    if y:\n      self.skipTest('z')\nclass Other:\n  def test_no(self): pass\n@skip\ndef test_b():\n  t = tempfile.mkdtemp()\n  try:\n    assert m.called\n  finally:\n    pass\nasync def test_c():\n  _check_it()\n  pytest.skip('now')\n"
    files = spark.createDataFrame([("a", code), ("b", "def ("), ("c", None), ("d", "x = 1")], "file string, content string")
    facts = python_facts.python_tests(files).orderBy("line")
    assert [tuple(r) for r in facts.select("line", "name", "suite", "assertions", "interactions", "skipped", "focused", "expected_failure", "uncleaned_temp").collect()] == [
        (4, "TestA.test_a", False, 2, 0, False, False, True, False), (13, "test_b", False, 1, 1, True, False, False, False), (19, "test_c", False, 1, 0, True, False, False, False),
    ]


def test_what_is_called(spark):
    body = ["m().assert_called()", "x[0].assert_any_call(1)", "pytest.raises(E)", "other.raises(E)", "foo(1).expect_it()", "f(pytest.skip)", "self.skipTest('a')", "tempfile.mkdtemp()", "assert a.b.call_count == c.d", "(lambda: check_all(1))()"]
    code = "def test_a():\n  " + "\n  ".join(body) + "\n"
    r = python_facts.python_tests(spark.createDataFrame([("a", code)], "file string, content string")).first()
    assert (r.assertions, r.interactions, r.skipped, r.uncleaned_temp) == (6, 3, True, True)


def test_parameters(spark):
    code = "class A:\n" + "".join(f"  {d}def m{k}({a}): pass\n" for k, (d, a) in enumerate([("", "self, a"), ("", "*args"), ("", "this, /, a, *, b=lambda q, r: q, **k"), ("@staticmethod\n  ", "a"), ("@abc.staticmethod()\n  ", "a"), ("@classmethod\n  ", "c, a"), ("", "")])) + "def f(self, *, b): pass\n"
    got = python_facts.python_functions(spark.createDataFrame([("a", code)], "file string, content string")).orderBy("start_line")
    assert [r.param_count for r in got.collect()] == [1, 0, 3, 1, 1, 1, 0, 2]



def test_scopes_and_names(spark):
    found = spark.createDataFrame([(["a", "b"], 1), (["c"], 2), ([], 3)], "files array<string>, n int")
    changed = spark.createDataFrame([("./b",), ("d",)], "path string")
    assert rows(gates.in_scope(found, changed, "files"), "n") == [(1,)]
    assert gates.policy_scope(changed, "d") is None and gates.policy_scope(changed, "e") is changed and gates.policy_scope(None, "e") is None
    assert escape.checked_names("py", ["noqa"]) == ["noqa"]
    with pytest.raises(ValueError):
        escape.checked_names("go", ["noqa"])
    verdict = spark.createDataFrame([(True,)], "passed boolean")
    assert config.exit_code(verdict) == 0 and config.exit_code(verdict.select((~F.col("passed")).alias("passed"))) == 1
    one = gates.evidence(changed, changed, unresolved=spark.createDataFrame([("b", "./x")], "file string, specifier string"))
    assert one.first()["reason"].startswith("insufficient analysis: 1 relative") and not gates.with_evidence(verdict, one).first()["passed"]


def test_components_in_one_task_and_in_rounds(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 7] + [(100, 3), (200, 201), (5, 5), (None, 1)], "a long, b long")
    assert rows(graph.connected_components(edges), "node", "component") == rows(graph.connected_components(edges, one_task=0), "node", "component")
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_tarjan_of_a_long_stack():
    import time

    n = 60_000
    began = time.time()
    found = graph.tarjan([(k, k + 1) for k in range(n)] + [(k + 1, k) for k in range(0, n, 2)])
    assert found[1] == 0 and time.time() - began < 10


def plain_clones(files, n):
    """Greedy clones over tokens: (text, line) lists by file."""
    order = sorted(files)
    covered = {f: [False] * len(files[f]) for f in order}
    text = {f: [t for t, _ in files[f]] for f in order}
    out = []
    for i, f in enumerate(order):
        for p in range(len(text[f]) - n + 1):
            if covered[f][p]:
                continue
            best = (0, "", 0)
            for g in order[i:]:
                for q in range(p + 1 if g == f else 0, len(text[g]) - n + 1):
                    if covered[g][q] or text[f][p : p + n] != text[g][q : q + n]:
                        continue
                    size = n
                    while p + size < len(text[f]) and q + size < len(text[g]) and text[f][p + size] == text[g][q + size]:
                        size += 1
                    size = min(size, q - p) if f == g else size
                    if size >= n and size > best[0]:
                        best = (size, g, q)
            size, g, q = best
            if size:
                for k in range(size):
                    covered[f][p + k] = covered[g][q + k] = True
                out.append((f, files[f][p][1], files[f][p + size - 1][1], g, files[g][q][1], files[g][q + size - 1][1], size))
    return out


def test_clones_against_tokens(spark):
    import random

    from plumbline.operators import dupe

    r = random.Random(9)
    files = {}
    parts = [[r.choice("abcdefghij") for _ in range(r.randint(4, 14))] for _ in range(5)]
    for k in range(14):
        tokens = [t for _ in range(r.randint(1, 5)) for t in (r.choice(parts) if r.random() < 0.7 else [r.choice("abc") for _ in range(6)])]
        files[f"f{k:02d}"] = [(t, 1 + i // 3) for i, t in enumerate(tokens)]
    rows_ = [(f, t, line, p) for f, ts in files.items() for p, (t, line) in enumerate(ts)]
    df = spark.createDataFrame(rows_, "file string, text string, line int, pos int")
    assert rows(dupe.clone_pairs(df, 5)) == sorted(plain_clones(files, 5), key=str)
    texts = spark.createDataFrame([(f, "\n".join(" ".join(t for t, line in ts if line == n) for n in range(1, ts[-1][1] + 1))) for f, ts in files.items()], "file string, content string")
    assert rows(dupe.window_clones(dupe.text_windows(texts, 5), 5)) == sorted(plain_clones(files, 5), key=str)
    assert rows(dupe.token_lines(texts)) == sorted((f, ts[-1][1]) for f, ts in files.items())


def test_chains_of_random_graphs(spark):
    """Components by reachability; the chain starts at the first file and follows edges in their order, depth first."""
    import random

    r = random.Random(4)
    n = 40
    pairs = sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(55))})
    df = spark.createDataFrame([(a, k, b) for k, (a, b) in enumerate(pairs)], "src string, ord int, dst string")
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)

    def reach(x):
        seen, work = set(), list(out.get(x, []))
        while work:
            y = work.pop()
            if y not in seen:
                seen.add(y)
                work += out.get(y, [])
        return seen

    far = {x: reach(x) for x in {y for p in pairs for y in p}}
    want = {tuple(sorted({y for y in far[x] if x in far[y]} | {x})) for x in far if x in far[x]}
    found = graph.cycles(df).collect()
    assert {tuple(c.files) for c in found} == want and len(found) == len(want) > 1
    for c in found:
        assert c.chain[0] == c.chain[-1] == c.files[0] and all((a, b) in pairs for a, b in zip(c.chain, c.chain[1:], strict=False)) and len(set(c.chain[1:])) == len(c.chain) - 1


def test_tables_of_finished_steps_are_deleted(spark):
    from plumbline.sources.shared import discard, scratch, shared_dir, written

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    t = written(spark.range(3), "kept")
    assert t.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    discard(t, None)
    with scratch(spark):
        assert written(spark.range(4), "inside").count() == 4
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_trees_are_listed_in_the_order_of_a_walk(spark, tmp_path):
    import os

    r = random.Random(3)
    for k in range(60):
        folder = tmp_path.joinpath(*(r.choice(["a", "a-b", "B", "_c", "é", ".git", "skip"]) for _ in range(r.randint(0, 4))))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / r.choice(["x.py", "a.b", f"f{k}.py", "_y"])).write_text(str(k))
    want = []

    def walk(folder, at):
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if os.path.isdir(path):
                if name != "skip" and not name.startswith("."):
                    walk(path, at + name + "/")
            else:
                want.append(at + name)

    walk(str(tmp_path), "")
    got = in_walk_order(listed(spark, str(tmp_path), {"skip"}).repartition(5)).orderBy("walk_ord").collect()
    assert [(x.file, x.walk_ord) for x in got] == [(f, k) for k, f in enumerate(want)]
    (tmp_path / "none").mkdir()
    assert in_walk_order(listed(spark, str(tmp_path / "none"))).count() == 0


def test_go_edges_make_pairs_without_shuffling_them(spark):
    text = 'package p\n\nimport (\n\t"m/p"\n\t"m/p/sub"\n\t"m/p"\n\t"m/none"\n)\n'
    files = spark.createDataFrame([("p/a.go", "package p\n"), ("p/z.go", text), ("p/sub/b.go", text), ("p/b.go", None), ("p/z.go", text), ("q/c.go", text)], "file string, content string")
    edges = imports.go_edges(files, "m")
    targets = ["p/a.go", "p/b.go", "p/sub/b.go", "p/z.go"]
    expected = [(s, k, t) for s in ("p/z.go", "p/sub/b.go", "q/c.go") for k, t in enumerate(x for x in targets if x != s)]
    assert rows(edges) == sorted(expected, key=str)
    plan = edges.select("src", "dst")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Window" not in above and "Sort" not in above


def test_all_importers_meet_one_list_of_a_package_before_the_next(spark):
    files = spark.createDataFrame([(f"p/f{k:03d}.go", 'package p\n\nimport "m/p"\n') for k in range(320)], "file string, content string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(x) for x in imports.go_edges(files, "m").select("src", "dst").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted((f"p/f{a:03d}.go", f"p/f{b:03d}.go") for a in range(320) for b in range(320) if a != b)
    assert len({dst for _, dst in got[:300]}) < 160  # all of a package's files for each importer: 300


def test_a_component_of_clones_takes_few_bytes_a_window():
    """Islands come in batches and are let go; results are those of all windows at once, also of windows that differ in half of
    their bits only."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from plumbline.operators import dupe

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())]))
    r = np.random.default_rng(3)

    def batches(files, length, ids, split):
        for k in range(files):
            keys = r.integers(0, ids, length)
            pos = np.arange(length, dtype=np.int32) + 7 * k
            k1, k2 = (keys // 3, keys) if split else (keys, keys)
            flat = pa.StructArray.from_arrays([pa.array(pos), pa.array(pos // 5), pa.array(pos // 5 + 1), pa.array(k1), pa.array(k2)], fields=list(kind.value_type))
            seen.append((np.full(length, (k * 5) % files), pos, pos // 5, pos // 5 + 1, k1, k2))
            yield pa.RecordBatch.from_arrays([pa.array([f"f{(k * 5) % files:03d}"]), pa.ListArray.from_arrays(pa.array([0, length], pa.int32()), flat)], names=["file", "ws"])

    for files, length, ids, split in ((1, 1, 1, False), (6, 9, 4, False), (8, 30, 6, True), (7, 25, 2, True)):
        seen = []
        got = pa.Table.from_batches(list(dupe.component_clones(batches(files, length, ids, split), 5)), schema=pa.schema([(c, pa.string() if c.startswith("file") else pa.int32()) for c in dupe.COLUMNS]))
        want = dupe.greedy_clones(*(np.concatenate(c) for c in zip(*seen)), 5)
        assert [tuple(x.values()) for x in got.to_pylist()] == [(f"f{a:03d}", *x, f"f{b:03d}", c, d, e) for a, *x, b, c, d, e in want]
    seen = []
    ready = list(batches(100, 3000, 3000, False))
    del seen[:]
    tracemalloc.start()
    assert sum(len(b) for b in dupe.component_clones(iter(ready), 40)) > 0
    assert tracemalloc.get_traced_memory()[1] < 90 * 300_000
    tracemalloc.stop()


def test_clones_of_islands_and_of_many_copies(spark):
    """Repeated passages that lie apart in a file are solved apart; copies of one passage in reasonable time."""
    import time

    import numpy as np

    from plumbline.operators import dupe

    passage = {c: [f"{c}{k}" for k in range(8)] for c in "xyz"}
    own = iter(range(10_000))
    apart = lambda *names: [(t, 1) for c in names for t in [*passage[c], *(f"own{next(own)}" for _ in range(9))]]
    files = {"a": apart("x", "y"), "b": apart("y", "z"), "c": apart("z", "x"), "d": apart("x", "x", "z")}
    texts = spark.createDataFrame([(f, " ".join(t for t, _ in ts)) for f, ts in files.items()], "file string, content string")
    found = dupe.window_clones(dupe.text_windows(texts, 5), 5)
    assert rows(found) == sorted(plain_clones(files, 5), key=str)
    islands = dupe._islands(dupe.repeated_windows(dupe.text_windows(texts, 5)), 5)
    assert rows(islands.groupBy("file").count()) == [("a", 2), ("b", 2), ("c", 2), ("d", 3)]
    copies, length = 3000, 60
    file, pos = np.repeat(np.arange(copies), length), np.tile(np.arange(length), copies)
    began = time.time()
    pairs = list(dupe.greedy_clones(file, pos, pos, pos, pos, pos, 40))
    assert [(f[0], f[3]) for f in pairs] == [(k, k + 1) for k in range(0, copies, 2)] and time.time() - began < 8
