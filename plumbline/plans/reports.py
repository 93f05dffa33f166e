"""Queries over reports: tools' formats written from the tables and read back, scopes with their denominators, verdicts with
evidence, orders, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import arch, crap, deadcode, escape, gates, mutation, testmetric
from plumbline.operators.orders import in_order
from plumbline.plans import queries as q
from plumbline.plans.queries import query, table
from plumbline.sources import config, coverage, splitjson
from plumbline.sources.shared import new_path

# mutants: users are files, events mutants


def _mutants(spark, sf_dir, names: dict[str, str]):
    status = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").cast("int").alias("line"), F.col("event_type").alias("mutator"), F.element_at(status, F.col("event_type")).alias("status"))


def _mutants_sql(names: dict[str, str]) -> str:
    return "SELECT 'u' || user_id AS file, event_id::INTEGER AS line, event_type AS mutator, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END AS status FROM events"


GENERIC = {"purchase": "Killed", "signup": "TIMEOUT", "click": "survived", "view": "No_Coverage", "error": "unviable"}
STRYKER = {"purchase": "Killed", "signup": "Timeout", "click": "Survived", "view": "NoCoverage", "error": "Pending"}
GREMLINS = {"purchase": "KILLED", "signup": "TIMED OUT", "click": "LIVED", "view": "NOT COVERED", "error": "RUNNABLE"}
_READ = {"purchase": "killed", "signup": "timeout", "click": "survived", "view": "no_coverage", "error": "ignored"}


@query(_mutants_sql({k: v.lower() for k, v in GENERIC.items()}))
def ingest_mutants(spark, sf_dir):
    rows = _mutants(spark, sf_dir, GENERIC)
    reports = rows.groupBy("file").agg(F.to_json(F.struct(F.collect_list(F.struct("file", "line", "mutator", "status")).alias("mutants"))).alias("report"))
    return mutation.parse_mutants(reports)


@query(_mutants_sql(_READ))
def ingest_stryker(spark, sf_dir):
    one = F.struct(F.col("mutator").alias("mutatorName"), "status", F.struct(F.struct("line").alias("start")).alias("location"))
    by = _mutants(spark, sf_dir, STRYKER).groupBy("file").agg(F.struct(F.collect_list(one).alias("mutants")).alias("v"))
    return mutation.parse_mutants(by.select(F.to_json(F.struct(F.create_map("file", "v").alias("files"))).alias("report")))


@query(_mutants_sql(_READ))
def ingest_gremlins(spark, sf_dir):
    one = F.struct("line", F.col("mutator").alias("type"), "status")
    by = _mutants(spark, sf_dir, GREMLINS).groupBy(F.col("file").alias("file_name")).agg(F.collect_list(one).alias("mutations"))
    return mutation.parse_mutants(by.select(F.to_json(F.struct(F.array(F.struct("file_name", "mutations")).alias("files"))).alias("report")))


# dead symbols: parts


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("int").alias("line"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5).alias("k"))


@query("SELECT p_brand AS file, p_partkey::INTEGER AS line, p_name AS name, 'function' AS kind FROM part WHERE p_partkey % 5 <> 0")
def ingest_deadcode(spark, sf_dir):
    one = F.struct(F.col("name").alias("Name"), F.struct(F.col("file").alias("File"), F.col("line").alias("Line")).alias("Position"), (F.col("k") == 0).alias("Generated"))
    by = _parts(spark, sf_dir).groupBy("file").agg(F.collect_list(one).alias("Funcs"))
    return deadcode.parse_dead(by.select(F.to_json(F.array(F.struct("Funcs"))).alias("report")))


_KNIP = ["files", "exports", "types", "enumMembers", "namespaceMembers"]


@query("SELECT p_brand AS file, p_partkey::INTEGER AS line, p_name AS name, ['file', 'export', 'type', 'member', 'member'][p_partkey % 5 + 1] AS kind FROM part")
def ingest_knip(spark, sf_dir):
    lists = [F.collect_list(F.when(F.col("k") == n, F.struct("name", "line"))).alias(c) for n, c in enumerate(_KNIP)]
    by = _parts(spark, sf_dir).groupBy("file").agg(*lists)
    return deadcode.parse_dead(by.select(F.to_json(F.struct(F.array(F.struct("file", *_KNIP)).alias("issues"))).alias("report")))


@query("SELECT p_brand AS file, p_partkey::INTEGER AS line, CASE WHEN p_partkey % 5 = 0 THEN 'unreachable code after ''return''' ELSE p_name END AS name, ['code', 'function', 'type', 'import', 'variable'][p_partkey % 5 + 1] AS kind FROM part")
def ingest_vulture(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ["", "function", "class", "import", "attribute"])), (F.col("k") + 1).cast("int"))
    message = F.when(F.col("k") == 0, "unreachable code after 'return'").otherwise(F.concat(F.lit("unused "), word, F.lit(" '"), "name", F.lit("'")))
    line = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), message, F.lit(" (60% confidence)"))
    return deadcode.parse_dead(_parts(spark, sf_dir).groupBy("file").agg(F.array_join(F.collect_list(line), "\n").alias("report")))


@query("SELECT p_brand AS file, p_partkey::INTEGER AS line, p_name AS name, ['function', 'type', 'variable', 'import', 'member'][p_partkey % 5 + 1] AS kind FROM part WHERE p_partkey % 3 <> 0")
def ingest_periphery(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["function.method", "struct", "var.instance", "module", "enumelement"])), (F.col("k") + 1).cast("int"))
    one = F.struct(kind.alias("kind"), "name", F.array(F.when(F.col("line") % 3 == 0, "assignOnlyProperty").otherwise("unused")).alias("hints"), F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":5")).alias("location"))
    return deadcode.parse_dead(_parts(spark, sf_dir).groupBy("file").agg(F.to_json(F.collect_list(one)).alias("report")))


# coverage reports: orders are files, lineitems lines


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o/"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("int").alias("n"), (F.col("l_returnflag") != "R").alias("hit"))


@query("SELECT 'o/' || l_orderkey AS file, l_linenumber::INTEGER AS start_line, (l_linenumber + 2)::INTEGER AS end_line, l_quantity::INTEGER AS num_stmt, (l_returnflag <> 'R')::INTEGER AS count FROM lineitem")
def ingest_cover_profile(spark, sf_dir):
    line = F.format_string("%s:%d.2,%d.16 %d %d", "file", "line", F.col("line") + 2, "n", F.col("hit").cast("int"))
    return coverage.cover_profile(_items(spark, sf_dir).groupBy("file").agg(F.concat(F.lit("mode: count\n"), F.array_join(F.collect_list(line), "\n")).alias("report")))


_LINES_SQL = "SELECT 'o/' || l_orderkey AS file, l_linenumber::INTEGER AS line, bool_or(l_returnflag <> 'R') AS hit FROM lineitem GROUP BY 1, 2"


@query(_LINES_SQL)
def ingest_coverage_json(spark, sf_dir):
    lists = [F.collect_list(F.when(c, F.col("line"))).alias(n) for n, c in (("executed_lines", F.col("hit")), ("missing_lines", ~F.col("hit")))]
    by = _items(spark, sf_dir).groupBy("file").agg(F.struct(*lists).alias("v"))
    return coverage.coverage_json(by.select(F.to_json(F.struct(F.create_map("file", "v").alias("files"))).alias("report")))


@query("SELECT 'o/' || l_orderkey AS file, l_linenumber::INTEGER AS line, (l_returnflag <> 'R')::INTEGER AS hits, count(*) AS n FROM lineitem GROUP BY ALL")
def ingest_istanbul(spark, sf_dir):
    rows = _items(spark, sf_dir).groupBy("file").agg(F.collect_list(F.struct("line", F.col("hit").cast("int").alias("h"))).alias("rows"))
    name = lambda i: i.cast("string")
    entry = lambda f: F.map_from_entries(F.transform("rows", lambda r, i: F.struct(name(i), f(r))))
    of = F.struct(entry(lambda r: F.struct(F.struct(r["line"].alias("line")).alias("start"))).alias("statementMap"), entry(lambda r: r["h"]).alias("s"))
    found = coverage.istanbul(rows.select(F.to_json(F.create_map("file", of)).alias("report")))
    return found.groupBy("file", "line", "hits").agg(F.count(F.lit(1)).alias("n"))


def _in_files(reports, name: str) -> str:
    """Reports written as JSON texts into the shared folder, many in a file; gives the folder."""
    path = new_path(reports.sparkSession, name)
    reports.select("report").write.text(path)
    return path


@query(_LINES_SQL)
def split_coverage_json(spark, sf_dir):
    """The same lines from files that are read by ranges of 64 KB."""
    lists = [F.collect_list(F.when(c, F.col("line"))).alias(n) for n, c in (("executed_lines", F.col("hit")), ("missing_lines", ~F.col("hit")))]
    by = _items(spark, sf_dir).groupBy("file").agg(F.struct(*lists).alias("v")).groupBy((F.xxhash64("file") % 20).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("file", "v"))).alias("files"))
    path = _in_files(by.select(F.to_json(F.struct(F.create_map(F.lit("version"), F.lit('a "{[ \\ name')).alias("meta"), "files", F.create_map(F.lit("covered"), F.lit(1)).alias("totals"))).alias("report")), "coverage-reports")
    return coverage.coverage_json(splitjson.as_reports(splitjson.json_members(spark, path, "files", 1 << 16), "files"))


@query("SELECT user_id::VARCHAR AS file, event_id::INTEGER AS line, event_type AS mutator, CASE WHEN event_type IN ('click', 'error') THEN 'survived' ELSE 'killed' END AS status FROM events")
def split_stryker(spark, sf_dir):
    """Mutants from files that are read by ranges of 64 KB."""
    one = F.struct(F.col("event_type").alias("mutatorName"), F.when(F.col("event_type").isin("click", "error"), "Survived").otherwise("Killed").alias("status"), F.struct(F.struct(F.col("event_id").cast("int").alias("line")).alias("start")).alias("location"))
    by = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.struct(F.collect_list(one).alias("mutants")).alias("v"))
    reports = by.groupBy((F.xxhash64("file") % 10).alias("k")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("file", "v"))).alias("files"))).alias("report"))
    return mutation.parse_mutants(splitjson.as_reports(splitjson.json_members(spark, _in_files(reports, "mutation-reports"), "files", 1 << 16), "files"))


@query(_LINES_SQL)
def ingest_lcov(spark, sf_dir):
    line = F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), F.col("hit").cast("int").cast("string"))
    by = _items(spark, sf_dir).groupBy("file", F.col("n") % 2).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))  # a file may have two sections
    sections = by.select((F.xxhash64("file") % 50).alias("k"), F.concat(F.lit("SF:"), "file", F.lit("\n"), "lines", F.lit("\nend_of_record\n")).alias("s"))
    return coverage.lcov(sections.groupBy("k").agg(F.array_join(F.collect_list("s"), "").alias("report")))


# scopes: customers, documents and packages that another table names


def big_customers(spark, sf_dir):
    """Customers with a negative balance, as changed files."""
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("path"))


@query(q.CRAP_SQL + "SELECT count(*) AS functions, count(*) FILTER (crap > 30) AS above, round(max(crap), 6) AS max_crap, count(*) FILTER (unmeasured) AS unmeasured, coalesce(bool_and(crap <= 30), true) AS passed FROM s WHERE file IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def crap_gate_ratchet(spark, sf_dir):
    scored = crap.with_score(q.functions_of(spark, sf_dir))
    return crap.crap_gate(gates.in_scope(scored, big_customers(spark, sf_dir), "file"), 30).withColumn("max_crap", F.round("max_crap", 6))


@query(q.WORDS_SQL + """, l2 AS (SELECT file, max(x) - min(x) + 1 AS n FROM (SELECT file, unnest(ls) AS x FROM t) GROUP BY file), c AS (SELECT doc_id AS file FROM labels WHERE toxic = 1 OR quality = 0),
d AS (SELECT file, count(DISTINCT l) AS n FROM (SELECT file, unnest(range(start_line, end_line + 1)) AS l FROM r) GROUP BY file)
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM l2 WHERE file IN (SELECT file FROM c)) AS total_lines, (SELECT coalesce(sum(n), 0)::BIGINT FROM d WHERE file IN (SELECT file FROM c)) AS duplicated_lines""")
def dup_lines_ratchet(spark, sf_dir):
    """Repeated windows are looked for in all files; lines and denominator are those of the changed ones."""
    from plumbline.operators import dupe

    changed = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0").select(F.col("doc_id").alias("path"))
    files = q.files_of(spark, sf_dir)
    total = gates.in_scope(dupe.token_lines(files), changed, "file").select("lines", F.lit(0).cast("long").alias("dup"))
    found = gates.in_scope(dupe.duplicated_lines(q._repeated(spark, sf_dir)), changed, "file").select(F.lit(0).cast("long").alias("lines"), F.col("lines").alias("dup"))
    return total.unionByName(found).agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("total_lines"), F.coalesce(F.sum("dup"), F.lit(0)).cast("long").alias("duplicated_lines"))


@query(q.TESTS_SQL + ", c AS (SELECT (doc_id % 10)::VARCHAR AS file FROM documents WHERE lang = 'de' AND source = 'src0') SELECT count(*) AS findings, count(*) <= 0 AS passed FROM t WHERE (skipped OR focused) AND file IN (SELECT file FROM c)")
def test_gate_ratchet(spark, sf_dir):
    changed = table(spark, sf_dir, "documents").filter("lang = 'de' and source = 'src0'").select((F.col("doc_id") % 10).cast("string").alias("path"))
    tests = gates.in_scope(q.tests_of(spark, sf_dir), changed, "file")
    off = testmetric.disabled(ignore=[k for k in testmetric.KINDS if k not in ("skipped", "focused")])
    found = testmetric.test_findings(tests, 1, off).select("file", "line", "test").distinct()
    return gates.count_gate(found)


@query(q.DEAD_SQL + "SELECT count(*) AS findings, count(*) <= 0 AS passed FROM d WHERE file IN (SELECT p_brand || '/' || p_type FROM part WHERE p_size > 40)")
def dead_gate_ratchet(spark, sf_dir):
    changed = table(spark, sf_dir, "part").filter("p_size > 40").select(F.concat_ws("/", "p_brand", "p_type").alias("path"))
    return gates.count_gate(gates.in_scope(q.dead_of(spark, sf_dir), changed, "file"))


@query(q.VIOLATIONS_SQL + "SELECT 'scoped' AS scope, count(*) AS findings, count(*) <= 0 AS passed FROM v WHERE 'ASIA/NATION_8/a' IN (file, import) OR 'EUROPE/NATION_6/b' IN (file, import) UNION ALL SELECT 'policy changed', count(*), count(*) <= 0 FROM v")
def arch_gate_policy(spark, sf_dir):
    """A changed rules file brings the verdict over everything back."""
    found = arch.violations(q.edges_of(spark, sf_dir), q.RULES)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    own = paths("ASIA/NATION_8/a", "./EUROPE//NATION_6/b")
    out = None
    for name, changed in (("scoped", own), ("policy changed", own.unionByName(paths("./rules.json")))):
        one = gates.count_gate(gates.in_scope(found, gates.policy_scope(changed, "rules.json"), "file", "import")).select(F.lit(name).alias("scope"), "findings", "passed")
        out = one if out is None else out.unionByName(one)
    return out


@query(q._mutation_sql(where="file IN (SELECT c_custkey FROM customer WHERE c_acctbal < -100000)", floor=0))
def mutation_scoped_floor(spark, sf_dir):
    """No changed file is eligible, so the floor of graded mutants doesn't apply."""
    changed = table(spark, sf_dir, "customer").filter("c_acctbal < -100000").select(F.col("c_custkey").alias("path"))
    eligible = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"))
    return mutation.scoped_mutation_report(q.mutants_of(spark, sf_dir), 60.0, changed, eligible, minimum_graded=10).withColumn("score", F.round("score", 9))


# verdicts with evidence, reports as JSON


@query(q.CRAP_SQL + """, e AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), c AS (SELECT count(*) AS r, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS a FROM customer)
SELECT count(*) AS functions, r AS evidence_required, a AS evidence_analyzed, r - a AS evidence_n_missing, coalesce(bool_and(crap <= 30), true) AND r = a AND r > 0 AS passed FROM s, c GROUP BY r, a""")
def crap_verdict(spark, sf_dir):
    eligible = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    analyzed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"))
    verdict = crap.crap_gate(crap.with_score(q.functions_of(spark, sf_dir)), 30)
    return gates.with_evidence(verdict, gates.evidence(eligible, analyzed)).select("functions", "evidence_required", "evidence_analyzed", "evidence_n_missing", "passed")


@query("""
WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels), m AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l))
SELECT 0 AS ord, 'analysis evidence: ' || ((SELECT count(*) FROM d) - (SELECT count(*) FROM m)) || '/' || (SELECT count(*) FROM d) || ' eligible file(s) analyzed' AS text
UNION ALL SELECT 1, 'FAIL: insufficient analysis: ' || count(*) || ' eligible file(s) were not analyzed' FROM m HAVING count(*) > 0 UNION ALL SELECT 2, '  missing: ' || doc_id FROM m""")
def evidence_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return gates.evidence_lines(gates.evidence(docs, seen), gates.missing(docs, seen))


@query(q.ORACLES["crap_gate"])
def report_json(spark, sf_dir):
    """The report as indented JSON, and read back with its schema."""
    report = q.crap_gate(spark, sf_dir)
    text = config.report_json(report)
    return text.select(F.from_json("value", report.schema).alias("r")).select("r.*")


@query("SELECT count(*) FILTER (url LIKE '%example%') AS excluded FROM pages")
def excluded_count(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("x/"), F.regexp_replace("url", "/", "_")).alias("path"))
    return gates.without_excluded(rows, "path", ["x/*example*"])[1]


# orders: the first hundred rows of each report


def _top(sql: str, columns: str, order: str) -> str:
    return f"SELECT {columns} FROM ({sql}) ORDER BY {order} LIMIT 100"


@query(_top(q.ORACLES["size_findings"], "*", "file, start_line, kind, name"))
def top_size_findings(spark, sf_dir):
    return in_order(q.size_findings(spark, sf_dir), "size").limit(100)


@query(_top(q.ORACLES["escape_hits"], "*", "file, line, pattern"))
def top_hatches(spark, sf_dir):
    return in_order(escape.hatches(q.files_of(spark, sf_dir), q.HATCHES), "hatches").limit(100)


@query(_top(q.ORACLES["arch_violations"], "*", "rule, file, import"))
def top_violations(spark, sf_dir):
    return in_order(q.arch_violations(spark, sf_dir), "violations").limit(100)


@query(_top(q.ORACLES["test_findings"], "*", "file, line, test, list_position(['skipped', 'focused', 'expected-failure', 'no-assertions', 'low-assertions', 'interaction-only', 'temp-no-cleanup'], kind)"))
def top_test_findings(spark, sf_dir):
    found = testmetric.test_findings(q.tests_of(spark, sf_dir), 2, testmetric.disabled(include=["interaction-only"]))
    return in_order(found, "findings").limit(100).select("file", "line", "test", "kind")


@query(_top(q.ORACLES["crap_diff"], "*", "delta DESC, file, name"))
def top_crap_diff(spark, sf_dir):
    return in_order(q.crap_diff(spark, sf_dir), "crapdiff").limit(100)


@query(_top(q.ORACLES["arch_diff"], "*", "CASE change WHEN 'new' THEN 0 ELSE 1 END, rule, file, import"))
def top_arch_diff(spark, sf_dir):
    return in_order(q.arch_diff(spark, sf_dir), "archdiff").limit(100)


@query(q.SCC_SQL + "SELECT count(*) AS size, min(lpad(node::VARCHAR, 12, '0')) AS first FROM m GROUP BY scc ORDER BY size DESC, first LIMIT 100")
def top_cycles(spark, sf_dir):
    from plumbline.operators import graph

    name = F.lpad(F.col("node").cast("string"), 12, "0")
    found = graph.strong_components(q.customer_graph(spark, sf_dir)).groupBy("scc").agg(F.array_sort(F.collect_list(name)).alias("files"))
    return in_order(found, "cycles").limit(100).select(F.size("files").cast("long").alias("size"), F.element_at("files", 1).alias("first"))


@query(_top(q.ORACLES["mutation_survivors"], "*", "file, line, status"))
def top_survivors(spark, sf_dir):
    return in_order(q.mutation_survivors(spark, sf_dir), "survivors").limit(100)
