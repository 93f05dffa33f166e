"""Queries through what a gate is told from outside: lists of changed files, exclude and allow lists, rules, path mappings, an
earlier report; and what it says at the end."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plumbline.functions.regex import excluded
from plumbline.operators import arch, deadcode, escape, gates, graph, imports
from plumbline.plans import queries as q
from plumbline.plans import sources as s
from plumbline.plans.queries import query, table
from plumbline.sources import config, coverage
from plumbline.sources.shared import new_path


@query("SELECT DISTINCT 'pkg' || doc_id % 17 || '/m' || doc_id AS path FROM documents")
def changed_files_list(spark, sf_dir):
    """A list with blanks, blank lines, repeats, backslashes and leading ``./``, written as text."""
    d = F.col("doc_id")
    name = lambda slash: F.concat(F.lit("pkg"), (d % 17).cast("string"), F.lit(slash), F.lit("m"), d.cast("string"))
    lines = F.array(F.concat(F.lit("  ./"), name("/"), F.lit("\t")), F.lit(" "), F.when(d % 3 == 0, name("\\")).otherwise(F.concat(F.lit("././"), name("/"))))
    path = new_path(spark, "changed-files")
    table(spark, sf_dir, "documents").select(F.explode(lines).alias("value")).write.text(path)
    return coverage.changed_files(spark, path)


@query("SELECT 'file ' || doc_id AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def scope_of_unclean_paths(spark, sf_dir):
    """Both sides name the same files in different ways; ends of paths are not enough."""
    d = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("./a//x/../"), d, F.lit("\\b/./")).alias("path"), F.concat(F.lit("file "), d).alias("name"))
    changed = table(spark, sf_dir, "labels").select(F.explode(F.array(F.concat(F.lit("a/./"), d, F.lit("//b")), F.concat(F.lit("c/a/"), d, F.lit("/b/c")))).alias("path"))
    return gates.in_scope(rows, changed, "path").select("name")


EXCLUDES = "# what others wrote\n" + "\n".join(f"  {g}  # a glob" for g in q.GLOBS) + "\n\n#example.org\n"


@query(q.ORACLES["glob_filter"])
def exclude_file_filter(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return paths.filter(~excluded(F.col("path"), config.exclude_list(EXCLUDES)))


ALLOWED = "# known\n" + "\n".join(q.IGNORED) + "\n   \n# PROM*\n"


@query(q.ORACLES["dead_ignored"])
def ignore_file_filter(spark, sf_dir):
    return deadcode.not_allowed(q.dead_of(spark, sf_dir), config.ignore_list(ALLOWED))


RULES = json.dumps({"rules": [{"name": r.name, "from": r.source, "deny": list(r.deny)} for r in q.RULES], "exceptions": [{"rule": e.rule, "from": e.source, "to": e.target} for e in q.EXCEPTIONS]})


@query(q.ORACLES["arch_exceptions"])
def rules_file_violations(spark, sf_dir):
    return arch.violations(q.edges_of(spark, sf_dir), *config.layer_rules(RULES))


TSCONFIG = """{ // comments and trailing commas
  "compilerOptions": { "baseUrl": "./x/..", /* a "star" each */ "paths": { "@*": ["nowhere/*",], "@all/*": ["none/*", "./*"], }, },
}"""


@query(s._TS_SQL + "SELECT src || '.ts' AS src, dst || '.ts' AS dst FROM t WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL")
def mapping_file_edges(spark, sf_dir):
    base, mappings = config.path_mappings(TSCONFIG)
    return imports.script_edges(s.ts_files(spark, sf_dir), base, mappings).select("src", "dst")


@query(q.ORACLES["crap_gate"])
def report_read_back(spark, sf_dir):
    """A verdict written as indented JSON, and read with its schema by a later run."""
    report = q.crap_gate(spark, sf_dir)
    path = new_path(spark, "report")
    config.report_json(report).write.text(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema)
    return config.read_report(spark, path, schema).filter("functions is not null")


_ENDS = {"go": ([".go"], ["_test.go"]), "py": ([".py"], ["_test.py"]), "ts": ([".ts", ".tsx", ".js", ".jsx"], [f".{t}{e}" for t in ("test", "spec") for e in (".ts", ".tsx", ".js", ".jsx")]), "swift": ([".swift"], ["Tests.swift", "Test.swift"])}
_ANY = lambda ends: "(" + " OR ".join(f"ends_with(path, '{e}')" for e in ends) + ")"


@query(s.PATHS_SQL + " UNION ALL ".join(f"SELECT '{k}' AS lang, path AS file FROM f WHERE {_ANY(a)} AND NOT {_ANY(b)}" for k, (a, b) in _ENDS.items()))
def scanned_by_language(spark, sf_dir):
    files = s.paths_of(spark, sf_dir).select(F.col("path").alias("file"))
    out = None
    for name in _ENDS:
        one = escape.scanned(files, name).select(F.lit(name).alias("lang"), "file")
        out = one if out is None else out.unionByName(one)
    return out


@query(q.EDGES_SQL + "SELECT count(*) AS findings, count(*) <= 0 AS passed FROM w")
def stability_gate(spark, sf_dir):
    return gates.count_gate(arch.stability_violations(arch.package_pairs(q.edges_of(spark, sf_dir))))


@query(q.EDGES_SQL + "SELECT file AS name FROM e UNION SELECT import FROM e")
def graph_nodes(spark, sf_dir):
    edges = q.edges_of(spark, sf_dir).select(F.col("file").alias("src"), F.col("import").alias("dst"))
    return graph.numbered(edges)[1].select("name")


@query("SELECT 'crap' AS gate, (count(*) FILTER (NOT passed))::INTEGER AS code FROM (" + q.ORACLES["crap_gate"] + ") UNION ALL SELECT 'stability', (count(*) FILTER (NOT passed))::INTEGER FROM (" + q.EDGES_SQL + "SELECT count(*) <= 0 AS passed FROM w) UNION ALL SELECT 'escape', (count(*) FILTER (NOT passed))::INTEGER FROM (" + q.ORACLES["escape_rate"] + ") UNION ALL SELECT 'unknown rule', 2")
def exit_codes(spark, sf_dir):
    """What a gate ends with: 0, 1, or 2 if it couldn't judge."""
    gate = {"crap": lambda: q.crap_gate(spark, sf_dir), "stability": lambda: stability_gate(spark, sf_dir), "escape": lambda: q.escape_rate(spark, sf_dir), "unknown rule": lambda: arch.violations(q.edges_of(spark, sf_dir), [arch.Rule("", "a", ("b",))])}
    return spark.createDataFrame([(k, config.exit_status(v)) for k, v in gate.items()], "gate string, code int")
