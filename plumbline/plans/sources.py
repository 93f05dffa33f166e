"""Queries over source files that are written from the documents' ids: paths, imports and tests whose facts arithmetic
gives, so that the SQL doesn't repeat the parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.paths import cleaned, relative_to
from plumbline.functions.python_facts import python_functions, python_tests
from plumbline.operators import crap, gates, imports
from plumbline.plans.queries import items_by_order, query, table
from plumbline.sources.config import PathMapping
from plumbline.sources.walks import WALKS, eligible, walked

FOLDERS = ["src", "vendor", "node_modules/a", "lib/testdata/b", "pkg/__pycache__", ".hidden/x", "Pods", "venv/lib", "tests", "Tests", "site-packages", "Carthage"]
NAMES = ["a.go", "a_test.go", "b.py", "test_b.py", "b_test.py", "c.ts", "c.d.ts", "c.test.ts", "c.spec.jsx", "d.swift", "dTests.swift", "dTest.swift", "e.js", "e.TSX", "f.tsx", ".g.ts", "test_h.txt"]
_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
PATHS_SQL = f"WITH f AS (SELECT doc_id, {_LIST(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || '/n' || doc_id || '/' || {_LIST(NAMES)}[doc_id % {len(NAMES)} + 1] AS path FROM documents)\n"


def paths_of(spark, sf_dir):
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("doc_id") % len(items) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(FOLDERS), F.lit("/n"), F.col("doc_id").cast("string"), F.lit("/"), pick(NAMES)).alias("path"))


def _skips(*names: str) -> str:
    return "NOT regexp_matches(path, '(^|/)(" + "|".join([*names, r"\.[^/]*"]) + ")/')"


_GO, _SWIFT = "path LIKE '%.go'", "path LIKE '%.swift'"
_SWIFT_TEST = "(path LIKE '%Tests.swift' OR path LIKE '%Test.swift')"
_SCRIPT, _SCRIPT_TEST = r"regexp_matches(path, '\.(ts|tsx|js|jsx)$')", r"regexp_matches(path, '\.(test|spec)\.(ts|tsx|js|jsx)$')"
_PY, _PY_TEST = "path LIKE '%.py'", r"(path LIKE '%/test\_%' ESCAPE '\' OR path LIKE '%\_test.py' ESCAPE '\')"
_DOT = "path NOT LIKE '%/.%'"
_GO_TEST = r"path LIKE '%\_test.go' ESCAPE '\'"
WALKS_SQL = {
    "go": f"{_skips('vendor', 'testdata')} AND {_GO} AND NOT {_GO_TEST}", "swift": f"{_skips('Pods', 'Tests')} AND {_SWIFT} AND NOT {_SWIFT_TEST}",
    "ts": f"{_skips('node_modules')} AND {_SCRIPT} AND path NOT LIKE '%.d.ts' AND NOT {_SCRIPT_TEST} AND {_DOT}", "py-size": f"{_skips('node_modules', '__pycache__', 'venv', 'site-packages', 'vendor')} AND {_PY}",
    "py-tok": f"{_skips('__pycache__')} AND {_PY} AND NOT {_PY_TEST}", "escape-go": f"{_skips('vendor', 'node_modules', 'testdata')} AND {_GO} AND NOT {_GO_TEST}",
    "escape-python": f"{_skips('vendor', 'node_modules', 'testdata')} AND {_PY} AND path NOT LIKE '%\\_test.py' ESCAPE '\\'", "escape-ts": f"{_skips('vendor', 'node_modules', 'testdata')} AND {_SCRIPT} AND NOT {_SCRIPT_TEST}",
    "escape-swift": f"{_skips('vendor', 'node_modules', 'testdata')} AND {_SWIFT} AND NOT {_SWIFT_TEST}", "import-py": f"{_skips('__pycache__', 'venv', 'testdata')} AND {_PY}",
    "import-ts": f"{_skips('node_modules', 'testdata')} AND {_SCRIPT} AND path NOT LIKE '%.d.ts'", "import-go": f"{_skips('vendor', 'testdata')} AND {_GO}", "tests-go": f"{_skips('vendor', 'node_modules', 'testdata')} AND {_GO_TEST}",
    "tests-py": f"{_skips('node_modules', '__pycache__', 'venv', 'site-packages', 'vendor')} AND {_PY} AND {_PY_TEST}", "tests-ts": f"{_skips('node_modules')} AND {_SCRIPT_TEST} AND {_DOT}",
    "tests-swift": f"{_skips('Pods', 'Carthage', 'DerivedData', 'vendor', 'node_modules', 'testdata', 'checkouts')} AND {_SWIFT}",
}
WALKS_SQL |= {"go-tok": WALKS_SQL["go"], "swift-tok": WALKS_SQL["swift"], "ts-tok": WALKS_SQL["ts"]}


def _each(rows, kinds: dict):
    """kind, path: a row for each kind whose predicate holds."""
    return rows.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))).alias("kind"), "path")


@query(PATHS_SQL + " UNION ALL ".join(f"SELECT '{k}' AS kind, path FROM f WHERE {w}" for k, w in WALKS_SQL.items()))
def walk_files(spark, sf_dir):
    return _each(paths_of(spark, sf_dir), {k: walked(F.col("path"), w) for k, w in WALKS.items()})


_ELIGIBLE_SKIPS = ("node_modules", "vendor", "testdata", "Pods", "venv", "__pycache__")
_MIXED = r"regexp_matches(lower(path), '\.(ts|tsx|js|jsx)$') AND path NOT LIKE '%.d.ts'"
ELIGIBLE_SQL = {
    "go": f"{_GO} AND NOT {_GO_TEST}", "go tests": _GO_TEST, "python": f"{_PY} AND NOT {_PY_TEST}", "python tests": f"{_PY} AND {_PY_TEST}", "ts": f"{_MIXED} AND path NOT LIKE '%.test.%' AND path NOT LIKE '%.spec.%'",
    "ts tests": f"{_MIXED} AND (path LIKE '%.test.%' OR path LIKE '%.spec.%')", "swift": f"{_SWIFT} AND NOT {_SWIFT_TEST} AND NOT regexp_matches(path, '(^|/)Tests/')", "swift tests": _SWIFT_TEST,
}


@query(PATHS_SQL + " UNION ALL ".join(f"SELECT '{k}' AS kind, path FROM f WHERE {_skips(*_ELIGIBLE_SKIPS)} AND {w}" for k, w in ELIGIBLE_SQL.items()))
def eligible_files(spark, sf_dir):
    kinds = {k: eligible(F.col("path"), k.split()[0], k.endswith(" tests")) for k in ELIGIBLE_SQL}
    return _each(paths_of(spark, sf_dir), kinds)


@query("SELECT doc_id, 'a/' || doc_id % 7 || '/b' AS clean, doc_id % 7 || '/b' AS rel FROM documents")
def cleaned_paths(spark, sf_dir):
    raw = F.concat(F.lit("./a//x/../"), (F.col("doc_id") % 7).cast("string"), F.lit("\\b/./"))
    return table(spark, sf_dir, "documents").select("doc_id", cleaned(raw).alias("clean"), relative_to(raw, "a/").alias("rel"))


# imports: document d is module d of folder d % 17


def _script(spark, sf_dir, suffix: str, *lines):
    d = F.col("doc_id")
    folder = lambda k: F.concat(F.lit("pkg"), (k % 17).cast("string"))
    text = lambda parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    content = F.concat_ws("\n", *(text(line(d, folder)) for line in lines))
    return table(spark, sf_dir, "documents").select(F.concat(folder(d), F.lit("/m"), d.cast("string"), F.lit(suffix)).alias("file"), content.alias("content"))


_FILES_SQL = "WITH m AS (SELECT DISTINCT doc_id AS d, 'pkg' || doc_id % 17 AS pkg FROM documents)"
_T = lambda e: f"(SELECT pkg || '/m' || d FROM m t WHERE t.d = {e})"


def ts_files(spark, sf_dir):
    n = lambda k: k.cast("string")
    return _script(
        spark, sf_dir, ".ts", lambda d, f: ['import x from "./m', n(d + 17), '"; // from "./m0"'], lambda d, f: ["/* require('./none') */ export * from '../", f(d * 3), "/m", n(d * 3), "'"], lambda d, f: ['const y = require("lib/z"), s = "//";'],
        lambda d, f: ["import('@all/", f(d + 5), "/m", n(d + 5), "')"], lambda d, f: ["import \"./m", n(d + 17), '"'], lambda d, f: ['import self from "./m', n(d), '.ts"'],
    )


MAPPINGS = [PathMapping("@all/*", ("none/*", "./*")), PathMapping("@*", ("nowhere/*",))]
_TS_SQL = f"""{_FILES_SQL}, t AS (
  SELECT pkg || '/m' || d AS src, 0 AS ord, CASE WHEN (d + 17) % 17 = d % 17 THEN {_T('m.d + 17')} END AS dst, './m' || (d + 17) AS spec FROM m
  UNION ALL SELECT pkg || '/m' || d, 1, {_T('m.d * 3')}, '../pkg' || (d * 3) % 17 || '/m' || (d * 3) FROM m
  UNION ALL SELECT pkg || '/m' || d, 3, {_T('m.d + 5')}, '@all/pkg' || (d + 5) % 17 || '/m' || (d + 5) FROM m
  UNION ALL SELECT pkg || '/m' || d, 4, {_T('m.d + 17')}, './m' || (d + 17) FROM m)
"""


@query(_TS_SQL + "SELECT src || '.ts' AS src, dst || '.ts' AS dst FROM t WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL")
def import_edges_ts(spark, sf_dir):
    return imports.script_edges(ts_files(spark, sf_dir), ".", MAPPINGS).select("src", "dst")


@query(_TS_SQL + "SELECT src || '.ts' AS file, spec AS specifier FROM t WHERE dst IS NULL")
def import_unresolved_ts(spark, sf_dir):
    return imports.script_unresolved(ts_files(spark, sf_dir), ".", MAPPINGS)


_ALIAS_SQL = f"""{_FILES_SQL}, t AS (
  SELECT pkg || '/m' || d AS src, d, CASE WHEN d % 3 = 0 THEN d ELSE d + 1 END AS q FROM m),
r AS (SELECT src, (SELECT pkg || '/m' || m.d FROM m WHERE m.d = CASE WHEN q % 2 = 0 THEN q + 2 ELSE q END) AS dst FROM t)
"""


@query(_ALIAS_SQL + "SELECT src || '.ts' AS src, dst || '.ts' AS dst FROM r WHERE dst IS NOT NULL AND dst <> src")
def import_edges_alias_table(spark, sf_dir):
    """A mapping for each document, as a table: those of even ones lead to the document two further, and win over a general one."""
    d = F.col("doc_id")
    name = lambda k: F.concat(F.lit("pkg"), (k % 17).cast("string"), F.lit("/m"), k.cast("string"))
    docs = table(spark, sf_dir, "documents")
    q = F.when(d % 3 == 0, d).otherwise(d + 1)
    files = docs.select(F.concat(name(d), F.lit(".ts")).alias("file"), F.concat(F.lit('import a from "~d'), q.cast("string"), F.lit('/x/'), name(q), F.lit('";\nimport b from "@none/b";\n')).alias("content"))
    twice = docs.select(d).unionByName(docs.select((d + 1).alias("doc_id"))).distinct()
    exact = twice.select(F.col("doc_id").cast("int").alias("rank"), F.concat(F.lit("~d"), d.cast("string"), F.lit("/x/")).alias("before"), F.lit("").alias("after"), F.lit(True).alias("star"), F.array(F.concat(F.lit("none/"), d.cast("string"), F.lit("/*")), F.when(d % 2 == 0, name(d + 2)).otherwise("*")).alias("targets"))
    general = docs.sparkSession.createDataFrame([(2**31 - 1, "~d", "", True, ["wrong/*"])], "rank int, before string, after string, star boolean, targets array<string>")
    return imports.script_edges(files, ".", exact.unionByName(general)).select("src", "dst")


def py_files(spark, sf_dir):
    n = lambda k: k.cast("string")
    return _script(
        spark, sf_dir, ".py", lambda d, f: ["from .m", n(d + 17), " import a, b as c"], lambda d, f: ["import os, ", f(d * 3), ".m", n(d * 3)], lambda d, f: ["from ..", f(d + 5), " import (m", n(d + 5), ",  # first (\n    q)"], lambda d, f: ["from .gone", n(d), " import x"],
        lambda d, f: ["from m", n(d + 34), " import z"], lambda d, f: ["from .m", n(d + 17), " import again"],
    )


_PY_SQL = f"""{_FILES_SQL}, t AS (
  SELECT pkg || '/m' || d AS src, {_T('m.d + 17')} AS dst FROM m UNION SELECT pkg || '/m' || d, {_T('m.d * 3')} FROM m UNION SELECT pkg || '/m' || d, {_T('m.d + 5')} FROM m UNION SELECT pkg || '/m' || d, {_T('m.d + 34')} FROM m)
"""


@query(_PY_SQL + "SELECT src || '.py' AS src, dst || '.py' AS dst FROM t WHERE dst IS NOT NULL AND dst <> src")
def import_edges_py(spark, sf_dir):
    return imports.python_edges(py_files(spark, sf_dir)).select("src", "dst")


@query(
    _FILES_SQL + f""" SELECT pkg || '/m' || d || '.py' AS file, '.gone' || d AS specifier FROM m UNION ALL SELECT pkg || '/m' || d || '.py', '.m' || (d + 17) FROM m
    UNION ALL SELECT pkg || '/m' || d || '.py', '.m' || (d + 17) FROM m WHERE {_T('m.d + 17')} IS NULL UNION ALL SELECT pkg || '/m' || d || '.py', '..pkg' || (d + 5) % 17 FROM m WHERE {_T('m.d + 5')} IS NULL"""
)
def import_unresolved_py(spark, sf_dir):
    return imports.python_unresolved(py_files(spark, sf_dir))


@query("""
WITH m AS (SELECT DISTINCT doc_id AS d, doc_id % 101 AS pkg FROM documents)
SELECT DISTINCT 'p' || a.pkg || '/f' || a.d || '.go' AS src, 'p' || b.pkg || '/f' || b.d || '.go' AS dst FROM m a JOIN m b ON b.pkg = a.d * 7 % 101 OR b.pkg = (a.d + 1) % 101 WHERE a.d <> b.d""")
def import_edges_go(spark, sf_dir):
    d = F.col("doc_id")
    n = lambda k: (k % 101).cast("string")
    content = F.concat(F.lit('package p\n\n// import "mod/sub/p0"\nimport "mod/sub/p'), n(d * 7), F.lit('"\nimport (\n\t"fmt"\n\tx "mod/sub/p'), n(d + 1), F.lit('"\n)\n\nvar s = `\nimport "mod/sub/p3"\n`\n'))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), n(d), F.lit("/f"), d.cast("string"), F.lit(".go")).alias("file"), content.alias("content"))
    return imports.go_edges(files, "mod", "sub").select("src", "dst")


@query("""
WITH RECURSIVE m AS (SELECT doc_id AS d, 'p' || doc_id % 23 AS pkg, CASE WHEN n_chars % 2 = 1 AND doc_id % 23 // 6 = n_chars % 23 // 6 THEN 'p' || n_chars % 23 END AS target FROM documents),
g AS (SELECT a.d AS a, b.d AS b FROM m a JOIN m b ON b.pkg = a.target AND b.d <> a.d AND b.target IS NOT NULL),
w AS (SELECT a AS s, b AS t FROM g UNION SELECT w.s, g.b FROM w JOIN g ON g.a = w.t), n AS (SELECT d, pkg || '/f' || d || '.go' AS file FROM m)
SELECT x.file, min(y.file) AS component FROM w JOIN w r ON r.s = w.t AND r.t = w.s JOIN n x ON x.d = w.s JOIN n y ON y.d = w.t GROUP BY x.file""")
def go_hub_cycles(spark, sf_dir):
    """Packages by number, whose files grow with the documents; half of them import another package of their six."""
    d, n = F.col("doc_id"), F.col("n_chars")
    near = (n % 2 == 1) & (F.floor(d % 23 / 6) == F.floor(n % 23 / 6))
    content = F.concat(F.lit("package p\n\nimport (\n\t\"fmt\"\n"), F.when(near, F.concat(F.lit('\t"mod/p'), (n % 23).cast("string"), F.lit('"\n'))).otherwise(""), F.lit(")\n"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (d % 23).cast("string"), F.lit("/f"), d.cast("string"), F.lit(".go")).alias("file"), content.alias("content"))
    return imports.go_cycles(files, "mod")


@query(_TS_SQL + """, e AS (SELECT count(*) AS required, count(DISTINCT l.doc_id) AS analyzed FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
u AS (SELECT count(*) AS n_unresolved FROM t WHERE dst IS NULL)
SELECT required, analyzed, required - analyzed AS n_missing, n_unresolved, n_unresolved = 0 AND required = analyzed AND required > 0 AS passed,
  CASE WHEN n_unresolved > 0 THEN 'insufficient analysis: ' || n_unresolved || ' relative local import(s) could not be resolved' ELSE '' END AS reason FROM e, u""")
def evidence_unresolved(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))
    return gates.evidence(docs, seen, unresolved=imports.script_unresolved(ts_files(spark, sf_dir), ".", MAPPINGS))


# Python facts: document d has d % 4 assertions, d % 3 mocks, and so on


def py_tests(spark, sf_dir):
    d = F.col("doc_id")
    body = F.concat(
        F.lit("import unittest\n\ndef test_"), d.cast("string"), F.lit("(x, y=1):\n    pass\n"), F.repeat(F.lit("    assert x\n"), (d % 4).cast("int")), F.repeat(F.lit("    m.assert_called_once()\n"), (d % 3).cast("int")),
        F.when(d % 5 == 0, "    pytest.skip('no')\n").otherwise(""), F.when(d % 6 == 0, "    t = mkdtemp()\n").otherwise(""), F.when(d % 12 == 0, "    shutil.rmtree(t)\n").otherwise(""), F.repeat(F.lit("    if x and y:\n        for k in x:\n            pass\n        else:\n            y = [z for z in x if z]\n"), (d % 3).cast("int")),
        F.lit("    def inner():\n        if x:\n            assert y\n\nclass Case(unittest.TestCase):\n    @unittest.skip('later')\n    def test_m(self, a):\n        self.assertEqual(1, a)\n"),
        F.lit("    def any(*args):\n        pass\n    def other(this, a, /, b=lambda q: q, *, c):\n        pass\n    @abc.staticmethod\n    def loose(a, **k):\n        pass\n    def bare():\n        pass\n"),
    )
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("file"), body.alias("content"))


@query("""
SELECT doc_id::VARCHAR AS file, 'test_' || doc_id AS name, (doc_id % 4 + doc_id % 3 + 1)::INTEGER AS assertions, (doc_id % 3)::INTEGER AS interactions, doc_id % 5 = 0 AS skipped, doc_id % 6 = 0 AND doc_id % 12 <> 0 AS uncleaned_temp FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'Case.test_m', 1, 0, true, false FROM documents""")
def python_test_facts(spark, sf_dir):
    return python_tests(py_tests(spark, sf_dir)).select("file", "name", "assertions", "interactions", "skipped", "uncleaned_temp")


@query("""
SELECT doc_id::VARCHAR AS file, 'test_' || doc_id AS name, (1 + doc_id % 4 + 6 * (doc_id % 3))::INTEGER AS complexity, 2 AS param_count, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS max_nesting_depth FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'Case.' || m.name, 1, m.params, 0 FROM documents, (VALUES ('test_m', 1), ('any', 0), ('other', 3), ('loose', 2), ('bare', 0)) m(name, params)""")
def python_function_facts(spark, sf_dir):
    return python_functions(py_tests(spark, sf_dir)).select("file", "name", "complexity", "param_count", "max_nesting_depth")


# coverage: statements by their first line, paths by their ends, sizes of files


@query("""
WITH f AS (SELECT l_orderkey AS file, l_suppkey AS name, min(l_linenumber) AS s, max(l_linenumber) AS e FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey AS file, (l_linenumber + 1) // 2 AS line, l_returnflag <> 'R' AS hit FROM lineitem WHERE l_linestatus = 'O')
SELECT f.file, f.name, count(line) AS lines_total, count(*) FILTER (hit) AS lines_covered, NOT EXISTS (SELECT 1 FROM l x WHERE x.file = f.file) AS unmeasured FROM f LEFT JOIN l ON l.file = f.file AND line BETWEEN s AND e GROUP BY f.file, f.name""")
def cov_statement_join(spark, sf_dir):
    items, tasks = items_by_order(spark, sf_dir)
    functions = items.groupBy(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name")).agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line"))
    statements = items.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("file"), F.floor((F.col("l_linenumber") + 1) / 2).alias("line"), (F.col("l_returnflag") != "R").cast("int").alias("hits"))
    return crap.join_statements(functions, statements, tasks).select("file", "name", "lines_total", "lines_covered", "unmeasured")


@query("""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/f' || doc_id || '.swift' WHEN doc_id % 3 = 1 THEN '/home/x/a/f' || doc_id || '.swift' ELSE '/home/xa/f' || doc_id || '.swift' END AS path FROM documents),
q AS (SELECT path FROM p UNION ALL SELECT '/also' || path FROM p WHERE doc_id % 2 = 0), f AS (SELECT 'a/f' || doc_id || '.swift' AS file FROM documents)
SELECT file, coalesce(min(path) FILTER (path = file), min(path)) AS report_path FROM f JOIN q ON path = file OR ends_with(path, '/' || file) GROUP BY file""")
def cov_paths(spark, sf_dir):
    d = F.col("doc_id")
    name = F.concat(F.lit("a/f"), d.cast("string"), F.lit(".swift"))
    docs = table(spark, sf_dir, "documents")
    path = F.when(d % 3 == 0, name).when(d % 3 == 1, F.concat(F.lit("/home/x/"), name)).otherwise(F.concat(F.lit("/home/x"), name))
    paths = docs.select("doc_id", path.alias("path"))
    paths = paths.select("path").unionByName(paths.filter("doc_id % 2 = 0").select(F.concat(F.lit("/also"), "path").alias("path")))
    return crap.matched_paths(docs.select(name.alias("file")), paths)


@query("""
WITH m AS (SELECT doc_id, n_chars AS lines, length(lang) AS longest FROM documents), f AS (SELECT o_custkey AS file, max(o_orderkey) AS n FROM orders GROUP BY 1)
SELECT doc_id AS file, coalesce(n, lines) AS lines, longest AS max_line_length FROM m LEFT JOIN f ON file = doc_id""")
def file_size_facts(spark, sf_dir):
    measured = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("n_chars").alias("lines"), F.length("lang").alias("max_line_length"))
    functions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("file_lines"))
    return crap.file_sizes(measured, functions)
