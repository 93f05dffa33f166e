"""The measures over the driver's tables, by name, each with its equivalent in SQL.

Documents stand in for source files (source: package, line: source line, word: token), orders for functions and their
lineitems for statements, events for mutants, conversations for tests, parts for symbols, trade between nations for
imports between packages. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.regex import excluded
from plumbline.functions.text import max_line_length, physical_lines
from plumbline.operators import arch, crap, deadcode, dupe, escape, gates, graph, mutation, orders, testmetric

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# hatches

HATCHES = {"license": r"SPDX|[Ll]icen[sc]e", "email": r"[\w.+-]+@[\w-]+\.\w+", "the": r"\bthe\b", "de": r"\bde\b"}
FORBIDDEN = ["email", "license"]
RATE_LIMIT = 400.0


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))


def changed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for a list of changed files: those that another table marks."""
    return table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0").select(F.col("doc_id").alias("path"))


LINES_SQL = """
WITH parts AS (
  SELECT doc_id AS file, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents
), scanned AS (
  SELECT file, CASE WHEN ps[len(ps)] = '' THEN ps[1:len(ps) - 1] ELSE ps END AS ps FROM parts
), lines AS (
  SELECT file, k AS line, CASE WHEN ps[k] LIKE '%' || chr(13) THEN left(ps[k], length(ps[k]) - 1) ELSE ps[k] END AS text
  FROM (SELECT file, ps, unnest(range(1, len(ps) + 1)) AS k FROM scanned)
), hits AS (
""" + " UNION ALL ".join(f"SELECT file, line, '{n}' AS pattern, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM lines WHERE regexp_matches(text, '{p}')" for n, p in HATCHES.items()) + ")\n"  # fmt: skip


def _rate_sql(where: str = "true") -> str:
    return f"""{LINES_SQL}, h AS (SELECT count(*) AS hits, coalesce(list_sort(list(DISTINCT pattern) FILTER (pattern IN ('email', 'license'))), []) AS found FROM hits WHERE {where}),
    l AS (SELECT coalesce(sum(len(ps)), 0)::BIGINT AS total_lines FROM scanned WHERE {where})
    SELECT hits, total_lines, CASE WHEN total_lines = 0 THEN 0.0 ELSE hits / total_lines::DOUBLE * 1000 END AS rate, array_to_string(found, ',') AS forbidden_found,
      (CASE WHEN total_lines = 0 THEN 0.0 ELSE hits / total_lines::DOUBLE * 1000 END) <= {RATE_LIMIT} AND len(found) = 0 AS passed FROM h, l"""


def _rate(files: DataFrame) -> DataFrame:
    return escape.rate_report(files, HATCHES, RATE_LIMIT, FORBIDDEN).select("hits", "total_lines", "rate", F.array_join("forbidden_found", ",").alias("forbidden_found"), "passed")


@query(LINES_SQL + "SELECT file, line::INTEGER AS line, pattern, text FROM hits")
def escape_hits(spark, sf_dir):
    return escape.hatches(files_of(spark, sf_dir), HATCHES)


@query(_rate_sql())
def escape_rate(spark, sf_dir):
    return _rate(files_of(spark, sf_dir))


@query(LINES_SQL + "SELECT pattern, count(*) AS hits FROM hits GROUP BY pattern")
def escape_by_pattern(spark, sf_dir):
    return escape.by_pattern(escape.hatches(files_of(spark, sf_dir), HATCHES))


@query(LINES_SQL + "SELECT file, count(*) AS hits FROM hits WHERE pattern IN ('email', 'license') GROUP BY file")
def escape_forbidden(spark, sf_dir):
    return escape.hatches(files_of(spark, sf_dir), {k: HATCHES[k] for k in FORBIDDEN}).groupBy("file").agg(F.count(F.lit(1)).alias("hits"))


@query(_rate_sql("file IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)"))
def escape_rate_ratchet(spark, sf_dir):
    files, changed = files_of(spark, sf_dir), changed_docs(spark, sf_dir)
    return _rate(gates.in_scope(files, changed, "file"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END::INTEGER AS lines FROM documents")
def physical_line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", physical_lines(F.col("text")).alias("lines"))


@query("""
WITH l AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
m AS (SELECT doc_id, k, length(CASE WHEN ps[k] LIKE '%' || chr(13) THEN left(ps[k], length(ps[k]) - 1) ELSE ps[k] END) AS n FROM l),
best AS (SELECT doc_id, max(n) AS length FROM m GROUP BY doc_id)
SELECT best.doc_id, length::INTEGER AS length, (CASE WHEN length = 0 THEN 0 ELSE min(k) END)::INTEGER AS line FROM best JOIN m ON m.doc_id = best.doc_id AND m.n = best.length GROUP BY best.doc_id, length""")
def longest_lines(spark, sf_dir):
    best = max_line_length(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", best["length"].alias("length"), best["line"].alias("line"))


# risk scores: an order is a function, its lineitems are statements, covered unless returned


def functions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.max("l_linenumber") + F.count(F.lit(1))).alias("c"), F.count(F.lit(1)).alias("lines_total"), F.count_if(F.col("l_returnflag") != "R").alias("lines_covered")
    )
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("name"), F.coalesce("c", F.lit(1)).alias("complexity"), F.coalesce("lines_total", F.lit(0)).alias("lines_total"), F.coalesce("lines_covered", F.lit(0)).alias("lines_covered"),
        F.col("l_orderkey").isNull().alias("unmeasured"), F.year("o_orderdate").alias("year"), "o_orderdate",
    )


CRAP_SQL = """
WITH l AS (SELECT l_orderkey, max(l_linenumber) + count(*) AS c, count(*) AS lines_total, count(*) FILTER (l_returnflag <> 'R') AS lines_covered FROM lineitem GROUP BY l_orderkey),
f AS (SELECT o_custkey AS file, o_orderkey AS name, coalesce(c, 1)::BIGINT AS complexity, coalesce(lines_total, 0)::BIGINT AS lines_total, coalesce(lines_covered, 0)::BIGINT AS lines_covered, l_orderkey IS NULL AS unmeasured, year(o_orderdate) AS year, o_orderdate FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
v AS (SELECT *, CASE WHEN unmeasured THEN 0.0::DOUBLE WHEN lines_total <= 0 THEN 1.0::DOUBLE ELSE lines_covered / lines_total::DOUBLE END AS coverage FROM f),
s AS (SELECT *, complexity::DOUBLE * complexity::DOUBLE * (1 - coverage) * (1 - coverage) * (1 - coverage) + complexity::DOUBLE AS crap FROM v)
"""


@query(CRAP_SQL + "SELECT file, name, complexity, lines_total, lines_covered, unmeasured, round(coverage, 9) AS coverage, round(crap, 6) AS crap FROM s")
def crap_score(spark, sf_dir):
    return crap.with_score(functions_of(spark, sf_dir)).select("file", "name", "complexity", "lines_total", "lines_covered", "unmeasured", F.round("coverage", 9).alias("coverage"), F.round("crap", 6).alias("crap"))


@query(CRAP_SQL + "SELECT name, round(crap, 6) AS crap FROM s ORDER BY s.crap DESC, file, name LIMIT 20")
def crap_top20(spark, sf_dir):
    top, _ = gates.top_n(crap.with_score(functions_of(spark, sf_dir)), 20, F.col("crap").desc(), F.col("file"), F.col("name"))
    return top.select("name", F.round("crap", 6).alias("crap"))


@query(CRAP_SQL + "SELECT count(*) AS functions, count(*) FILTER (crap > 30) AS above, round(max(crap), 6) AS max_crap, count(*) FILTER (unmeasured) AS unmeasured, coalesce(bool_and(crap <= 30), true) AS passed FROM s")
def crap_gate(spark, sf_dir):
    return crap.crap_gate(crap.with_score(functions_of(spark, sf_dir)), 30).withColumn("max_crap", F.round("max_crap", 6))


@query(CRAP_SQL + "SELECT file, name FROM s WHERE unmeasured")
def crap_unmeasured(spark, sf_dir):
    return functions_of(spark, sf_dir).filter("unmeasured").select("file", "name")


@query(CRAP_SQL + """, o AS (SELECT file::VARCHAR AS file, 'r' AS name, max_by(crap, name) AS old_crap FROM s WHERE year <= 1995 GROUP BY 1), n AS (SELECT file::VARCHAR AS file, 'r' AS name, max_by(crap, name) AS new_crap FROM s WHERE year > 1995 GROUP BY 1)
SELECT file, name, round(old_crap, 6) AS old_crap, round(new_crap, 6) AS new_crap, round(coalesce(new_crap, 0.0) - coalesce(old_crap, 0.0), 6) AS delta,
  CASE WHEN old_crap IS NULL THEN 'new' WHEN new_crap IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n USING (file, name) WHERE old_crap IS DISTINCT FROM new_crap""")
def crap_diff(spark, sf_dir):
    scored = crap.with_score(functions_of(spark, sf_dir)).select(F.col("file").cast("string").alias("file"), F.lit("r").alias("name"), "crap", F.col("name").alias("ord"), "year")
    out = crap.crap_diff(scored.filter("year <= 1995"), scored.filter("year > 1995"))
    return out.select("file", "name", *(F.round(c, 6).alias(c) for c in ("old_crap", "new_crap", "delta")), "change")


SIZE = crap.SizeLimits(lines=20, params=6, nesting=0, file_lines=40, line_length=900)


@query("""
WITH f AS (SELECT p_brand AS file, p_partkey::VARCHAR AS name, p_partkey AS start_line, p_partkey + p_size - 1 AS end_line, length(p_name) - length(replace(p_name, ' ', '')) + length(p_type) % 9 AS params FROM part),
l AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
m AS (SELECT doc_id, k, length(CASE WHEN ps[k] LIKE '%' || chr(13) THEN left(ps[k], length(ps[k]) - 1) ELSE ps[k] END) AS n FROM l),
d AS (SELECT doc_id::VARCHAR AS file, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 0 ELSE 1 END) AS lines, (SELECT max(n) FROM m WHERE m.doc_id = documents.doc_id) AS longest FROM documents)
SELECT file, name, start_line, 'lines' AS kind, end_line - start_line + 1 AS value, 20::BIGINT AS threshold FROM f WHERE end_line - start_line + 1 > 20
UNION ALL SELECT file, name, start_line, 'params', params, 6 FROM f WHERE params > 6
UNION ALL SELECT file, '', 0, 'file_lines', lines, 40 FROM d WHERE lines > 40
UNION ALL SELECT file, '', (SELECT min(k) FROM m WHERE m.doc_id::VARCHAR = d.file AND n = longest), 'file_line_length', longest, 900 FROM d WHERE longest > 900""")
def size_findings(spark, sf_dir):
    spaces = F.length("p_name") - F.length(F.replace("p_name", F.lit(" "), F.lit("")))
    functions = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("start_line"), (F.col("p_partkey") + F.col("p_size") - 1).alias("end_line"), (spaces + F.length("p_type") % 9).alias("param_count"), F.lit(0).alias("max_nesting_depth"))
    longest = max_line_length(F.col("text"))
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), physical_lines(F.col("text")).alias("lines"), longest["length"].alias("max_line_length"), longest["line"].alias("max_line_length_line"))
    return crap.size_findings(functions, sizes, SIZE)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM l)
SELECT l_orderkey, min(l_linenumber) AS "start", max(l_linenumber) AS "end" FROM r GROUP BY l_orderkey, run""")
def uncovered_ranges(spark, sf_dir):
    return crap.merged_ranges(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber")


def items_by_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The lineitems dealt by their order over tasks of like size however many there are, and how many tasks."""
    items = table(spark, sf_dir, "lineitem")
    tasks = crap.tasks_for(items.count())
    return items.repartition(tasks, "l_orderkey"), tasks


@query("""
WITH f AS (SELECT o_custkey AS file, o_orderkey AS name, datediff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS s FROM orders),
b AS (SELECT o_custkey AS file, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::INTEGER AS s, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::INTEGER + 7 AS e, l_quantity::INTEGER AS stmts, (l_returnflag <> 'R')::INTEGER AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT f.file, f.name, coalesce(sum(stmts), 0)::BIGINT AS lines_total, coalesce(sum(stmts) FILTER (c > 0), 0)::BIGINT AS lines_covered, count(*) FILTER (c = 0) AS uncovered,
  NOT EXISTS (SELECT 1 FROM b x WHERE x.file = f.file) AS unmeasured
FROM f LEFT JOIN b ON b.file = f.file AND b.s >= f.s AND b.e <= f.s + 60 GROUP BY f.file, f.name""")
def cov_interval_join(spark, sf_dir):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    orders = table(spark, sf_dir, "orders")
    functions = orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("name"), day("o_orderdate").alias("start_line"), (day("o_orderdate") + 60).alias("end_line"))
    items = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    blocks = items.select(F.col("o_custkey").alias("file"), day("l_shipdate").alias("start_line"), (day("l_shipdate") + 7).alias("end_line"), F.col("l_quantity").cast("int").alias("num_stmt"), (F.col("l_returnflag") != "R").cast("int").alias("count"))
    return crap.join_blocks(functions, blocks).select("file", "name", "lines_total", "lines_covered", F.size("uncovered_lines").cast("long").alias("uncovered"), "unmeasured")


@query("""
WITH f AS (SELECT l_orderkey AS file, l_suppkey AS name, min(l_linenumber) AS s, max(l_linenumber) AS e FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey AS file, l_linenumber AS line, bool_or(l_returnflag <> 'R') AS hit FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT f.file, f.name, count(line) AS lines_total, count(*) FILTER (hit) AS lines_covered, NOT EXISTS (SELECT 1 FROM l x WHERE x.file = f.file) AS unmeasured
FROM f LEFT JOIN l ON l.file = f.file AND line BETWEEN s AND e GROUP BY f.file, f.name""")
def cov_line_join(spark, sf_dir):
    items, tasks = items_by_order(spark, sf_dir)
    functions = items.groupBy(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name")).agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line"))
    lines = items.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") != "R").alias("hit"))
    return crap.join_lines(functions, lines, tasks).select("file", "name", "lines_total", "lines_covered", "unmeasured")


# mutants

STATUS = {"purchase": "killed", "signup": "timeout", "click": "survived", "view": "no_coverage", "error": "ignored"}
MUTANTS_SQL = "WITH m AS (SELECT user_id AS file, event_id AS line, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END AS status FROM events)\n"


def mutants_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.element_at(status, F.col("event_type")).alias("status"))


def _mutation_sql(covered_only: bool = False, where: str = "true", few: int = 0, floor: int = 0) -> str:
    return f"""{MUTANTS_SQL}, t AS (SELECT count(*) FILTER (status IN ('killed', 'crashed', 'timeout')) AS detected, count(*) FILTER (status = 'crashed') AS crashed, count(*) FILTER (status = 'survived') AS survived, count(*) FILTER (status = 'no_coverage') AS no_coverage, count(*) FILTER (status = 'unviable') AS unviable FROM m WHERE {where}),
    g AS (SELECT *, detected + survived + {'0' if covered_only else 'no_coverage'} AS graded FROM t), s AS (SELECT *, CASE WHEN graded > 0 THEN detected / graded::DOUBLE * 100 ELSE 100.0 END AS score FROM g)
    SELECT detected, crashed, survived, no_coverage, unviable, graded, round(score, 9) AS score, {few} > 0 AND graded < {few} AS insufficient, {floor} > 0 AND graded < {floor} AS insufficient_evidence,
      (score >= 60 OR ({few} > 0 AND graded < {few})) AND NOT ({floor} > 0 AND graded < {floor}) AS passed FROM s"""


def _mutation(rows: DataFrame, **how) -> DataFrame:
    return mutation.mutation_report(rows, 60.0, **how).withColumn("score", F.round("score", 9))


@query(_mutation_sql())
def mutation_score(spark, sf_dir):
    return _mutation(mutants_of(spark, sf_dir))


@query(_mutation_sql(covered_only=True))
def mutation_score_covered_only(spark, sf_dir):
    return _mutation(mutants_of(spark, sf_dir), covered_only=True)


@query(_mutation_sql(few=10**9))
def mutation_score_min_mutants(spark, sf_dir):
    return _mutation(mutants_of(spark, sf_dir), min_mutants=10**9)


@query(_mutation_sql(few=10**9, floor=10**9))
def mutation_score_minimum_graded(spark, sf_dir):
    return _mutation(mutants_of(spark, sf_dir), min_mutants=10**9, minimum_graded=10**9)


@query(_mutation_sql(where="file IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def mutation_score_ratchet(spark, sf_dir):
    changed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("path"))
    return _mutation(gates.in_scope(mutants_of(spark, sf_dir), changed, "file"))


@query(MUTANTS_SQL + "SELECT file, line, status FROM m WHERE status IN ('survived', 'no_coverage')")
def mutation_survivors(spark, sf_dir):
    return mutation.survivors(mutants_of(spark, sf_dir))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# tests


def tests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.length("text") < 200
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("assertions"), F.count_if((F.col("role") == "assistant") & short).alias("interactions"), F.bool_or(F.col("role") == "system").alias("skipped"), F.bool_or(F.col("turn") > 6).alias("focused"),
        (F.count(F.lit(1)) == 1).alias("expected_failure"), F.bool_or(F.col("text").contains("@")).alias("uncleaned_temp"),
    ).select((F.col("conv_id") % 10).cast("string").alias("file"), F.col("conv_id").alias("line"), F.col("conv_id").cast("string").alias("name"), (F.col("conv_id") % 11 == 0).alias("suite"), "assertions", "interactions", "skipped", "focused", "expected_failure", "uncleaned_temp")


TESTS_SQL = """
WITH t AS (SELECT (conv_id % 10)::VARCHAR AS file, conv_id AS line, conv_id::VARCHAR AS test, conv_id % 11 = 0 AS suite, count(*) FILTER (role = 'assistant') AS assertions, count(*) FILTER (role = 'assistant' AND length(text) < 200) AS interactions,
  bool_or(role = 'system') AS skipped, bool_or(turn > 6) AS focused, count(*) = 1 AS expected_failure, bool_or(contains(text, '@')) AS uncleaned FROM conversations GROUP BY conv_id),
j AS (SELECT * FROM t WHERE NOT suite AND NOT skipped)
"""


@query(TESTS_SQL + """
SELECT file, line, test, 'skipped' AS kind FROM t WHERE skipped UNION ALL SELECT file, line, test, 'focused' FROM t WHERE focused UNION ALL SELECT file, line, test, 'expected-failure' FROM t WHERE expected_failure
UNION ALL SELECT file, line, test, CASE WHEN assertions = 0 THEN 'no-assertions' WHEN assertions < 2 THEN 'low-assertions' ELSE 'interaction-only' END FROM j WHERE assertions < 2 OR interactions = assertions
UNION ALL SELECT file, line, test, 'temp-no-cleanup' FROM j WHERE uncleaned""")
def test_findings(spark, sf_dir):
    return testmetric.test_findings(tests_of(spark, sf_dir), 2, testmetric.disabled(include=["interaction-only"])).select("file", "line", "test", "kind")


@query(TESTS_SQL + "SELECT count(*) AS tests, coalesce(sum(assertions), 0)::BIGINT AS assertions, round(coalesce(sum(assertions), 0) / count(*)::DOUBLE, 9) AS density FROM t WHERE NOT suite")
def test_density(spark, sf_dir):
    counts = testmetric.test_counts(tests_of(spark, sf_dir))
    return counts.withColumn("density", F.round(F.col("assertions") / F.col("tests"), 9))


# dead symbols: parts of whose shipped quantity over a third comes back

IGNORED = ["Brand#1/", "Brand#2?/S*", "PROM[A-O]", "lib/*", "100"]


def dead_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("n"), back.alias("back")).filter("3 * back <= n").select("p_partkey")
    parts = table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti")
    return parts.select(F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_partkey").alias("line"), F.col("p_partkey").cast("string").alias("name"), F.lit("export").alias("kind"))


DEAD_SQL = "WITH u AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING 3 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) <= sum(l_quantity)), d AS (SELECT p_brand || '/' || p_type AS file, p_partkey AS line, p_partkey::VARCHAR AS name, 'export' AS kind FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM u))\n"


@query(DEAD_SQL + "SELECT * FROM d")
def dead_symbols(spark, sf_dir):
    return dead_of(spark, sf_dir)


@query(DEAD_SQL + r"SELECT * FROM d WHERE NOT (starts_with(file, 'Brand#1/') OR regexp_full_match(file, 'Brand#2[^/]/S[^/]*') OR regexp_full_match(regexp_extract(file, '[^/]*$'), 'PROM[A-O]') OR regexp_full_match(file, 'lib/[^/]*') OR name = '100' OR ends_with(name, '.100'))")
def dead_ignored(spark, sf_dir):
    return deadcode.not_allowed(dead_of(spark, sf_dir), IGNORED)


# packages: a nation that sells more to another than that one sells to it imports from it


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = lambda k, out: nation.select(F.col("n_nationkey").alias(k), F.concat_ws("/", "r_name", "n_name").alias(out))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    sold = items.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    # both directions of a pair of nations, summed together
    lo, hi = F.least("s_nationkey", "c_nationkey"), F.greatest("s_nationkey", "c_nationkey")
    up = F.col("s_nationkey") < F.col("c_nationkey")
    by = sold.filter("s_nationkey <> c_nationkey").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.sum(F.when(up, F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("net"), F.min("l_orderkey").alias("ord"))
    first = F.col("net") >= 0
    pairs = by.select(F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("s_nationkey"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("c_nationkey"), "ord")
    named = pairs.join(path("s_nationkey", "s"), "s_nationkey").join(path("c_nationkey", "c"), "c_nationkey")
    return named.select(F.concat("s", F.lit("/a")).alias("src"), "ord", F.concat("c", F.lit("/b")).alias("dst"))


EDGES_SQL = """
WITH n AS (SELECT n_nationkey, r_name || '/' || n_name AS pkg FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_quantity) AS q, min(l_orderkey) AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
y AS (SELECT coalesce(x.a, r.b) AS a, coalesce(x.b, r.a) AS b, coalesce(x.q, 0) AS q, coalesce(r.q, 0) AS other, least(x.ord, r.ord) AS ord FROM x FULL OUTER JOIN x r ON r.a = x.b AND r.b = x.a),
e AS (SELECT s.pkg || '/a' AS file, s.pkg AS from_pkg, c.pkg || '/b' AS import, c.pkg AS to_pkg, ord FROM y JOIN n s ON s.n_nationkey = a JOIN n c ON c.n_nationkey = b WHERE q > other OR (q = other AND a < b)),
p AS (SELECT from_pkg, to_pkg, min(file) AS file, min_by(import, (file, ord)) AS import FROM e GROUP BY from_pkg, to_pkg),
k AS (SELECT package, sum(a)::BIGINT AS afferent, sum(b)::BIGINT AS efferent, sum(b) / (sum(a) + sum(b))::DOUBLE AS instability FROM (SELECT from_pkg AS package, 0 AS a, 1 AS b FROM p UNION ALL SELECT to_pkg, 1, 0 FROM p) GROUP BY package),
w AS (SELECT p.*, f.instability AS from_instability, t.instability AS to_instability FROM p JOIN k f ON f.package = from_pkg JOIN k t ON t.package = to_pkg WHERE f.instability < t.instability)
"""
RULES = [arch.Rule("asia-europe", "ASIA/*", ("EUROPE/**",)), arch.Rule("no-home", "**/*A", ("AMERICA/?????*", "NATION_13"))]
EXCEPTIONS = [arch.Allowed("asia-europe", "ASIA/NATION_17", "EUROPE/NATION_8"), arch.Allowed("no-home", "ASIA/*", "**")]
_R1 = "regexp_full_match(from_pkg, 'ASIA/[^/]*(?:/.*)?') AND regexp_full_match(to_pkg, 'EUROPE/.*(?:/.*)?')"
_R2 = "regexp_full_match(from_pkg, '(?:.*/)?[^/]*A(?:/.*)?') AND (regexp_full_match(to_pkg, 'AMERICA/[^/]{5}[^/]*(?:/.*)?') OR regexp_full_match(to_pkg, '(?:.*/)?NATION_13(?:/.*)?'))"
_V = ", v AS (SELECT 'asia-europe' AS rule, from_pkg, to_pkg, file, import FROM e WHERE {} UNION ALL SELECT 'no-home', from_pkg, to_pkg, file, import FROM e WHERE {})\n"
VIOLATIONS_SQL = EDGES_SQL + _V.format(_R1, _R2)
EXEMPT_SQL = EDGES_SQL + _V.format(f"{_R1} AND NOT (regexp_full_match(from_pkg, 'ASIA/NATION_17(?:/.*)?') AND regexp_full_match(to_pkg, 'EUROPE/NATION_8(?:/.*)?'))", f"{_R2} AND NOT regexp_full_match(from_pkg, 'ASIA/[^/]*(?:/.*)?')")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.arch_edges(trade_edges(spark, sf_dir))


@query(EDGES_SQL + "SELECT file, from_pkg, import, to_pkg, ord FROM e")
def arch_edges(spark, sf_dir):
    return edges_of(spark, sf_dir)


@query(VIOLATIONS_SQL + "SELECT * FROM v")
def arch_violations(spark, sf_dir):
    return arch.violations(edges_of(spark, sf_dir), RULES)


@query(EXEMPT_SQL + "SELECT * FROM v")
def arch_exceptions(spark, sf_dir):
    return arch.violations(edges_of(spark, sf_dir), RULES, EXCEPTIONS)


@query(VIOLATIONS_SQL.replace(", v AS", ", o AS").rstrip() + EXEMPT_SQL[len(EDGES_SQL) :] + """SELECT rule, from_pkg, to_pkg, file, import, 'fixed' AS change FROM o WHERE from_pkg NOT LIKE 'AFRICA%' AND (rule, file, import) NOT IN (SELECT (rule, file, import) FROM v)
UNION ALL SELECT rule, from_pkg, to_pkg, file, import, 'new' FROM v WHERE (rule, file, import) NOT IN (SELECT (rule, file, import) FROM o WHERE from_pkg NOT LIKE 'AFRICA%')""")
def arch_diff(spark, sf_dir):
    """Before: without exceptions and without one region; after: with exceptions."""
    edges = edges_of(spark, sf_dir)
    before = arch.violations(edges, RULES).filter("from_pkg not like 'AFRICA%'")
    return arch.arch_diff(before, arch.violations(edges, RULES, EXCEPTIONS))


@query(VIOLATIONS_SQL + "SELECT rule, from_pkg, to_pkg, file, import FROM v WHERE file LIKE '%6/_' OR import LIKE '%6/_'")
def arch_violations_ratchet(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    changed = edges.select(F.explode(F.array("file", "import")).alias("path")).filter("path like '%6/_'")
    return gates.in_scope(arch.violations(edges, RULES), changed, "file", "import")


@query(EDGES_SQL + "SELECT from_pkg, to_pkg, file, import FROM p")
def package_pairs(spark, sf_dir):
    return arch.package_pairs(edges_of(spark, sf_dir))


@query(EDGES_SQL + "SELECT package, afferent, efferent, round(instability, 9) AS instability FROM k")
def coupling(spark, sf_dir):
    return arch.coupling(arch.package_pairs(edges_of(spark, sf_dir))).withColumn("instability", F.round("instability", 9))


@query(EDGES_SQL + "SELECT from_pkg, to_pkg, file, import, round(from_instability, 9) AS from_instability, round(to_instability, 9) AS to_instability FROM w")
def stability_violations(spark, sf_dir):
    found = arch.stability_violations(arch.package_pairs(edges_of(spark, sf_dir)))
    return found.withColumn("from_instability", F.round("from_instability", 9)).withColumn("to_instability", F.round("to_instability", 9))


@query(EDGES_SQL + "SELECT from_pkg, to_pkg, file, import FROM w WHERE from_pkg NOT LIKE 'A%'")
def stability_baseline(spark, sf_dir):
    found = arch.stability_violations(arch.package_pairs(edges_of(spark, sf_dir)))
    return arch.new_since(found, found.filter("from_pkg like 'A%'")).select("from_pkg", "to_pkg", "file", "import")


# cycles: the first and the last order of a customer point to others of its dozen, the dozen to the next one


def customer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("a")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    dozen = F.floor(F.col("a") / 12) * 12
    targets = F.array(*((dozen + F.pmod(F.floor(F.col(c) / 4) * 7, F.lit(12))).cast("long") for c in ("lo", "hi")), (F.col("a") + 12).cast("long"))
    return ends.select("a", F.explode(targets).alias("b"))


SCC_SQL = """
WITH RECURSIVE o AS (SELECT o_custkey AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey),
g AS (SELECT a, a // 12 * 12 + lo // 4 * 7 % 12 AS b FROM o UNION SELECT a, a // 12 * 12 + hi // 4 * 7 % 12 FROM o),
walk AS (SELECT a AS start, b AS node FROM g UNION SELECT start, g.b FROM walk JOIN g ON g.a = walk.node),
m AS (SELECT f.start AS node, min(f.node) AS scc FROM walk f JOIN walk r ON r.start = f.node AND r.node = f.start GROUP BY f.start)
"""


@query(SCC_SQL + "SELECT node, scc FROM m")
def scc_members(spark, sf_dir):
    return graph.strong_components(customer_graph(spark, sf_dir))


@query(SCC_SQL + "SELECT count(DISTINCT scc) AS findings, count(DISTINCT scc) <= 0 AS passed FROM m")
def cycle_count(spark, sf_dir):
    return gates.count_gate(graph.strong_components(customer_graph(spark, sf_dir)).select("scc").distinct())


@query(SCC_SQL + "SELECT scc, count(*) AS files FROM m GROUP BY scc HAVING bool_or(node IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
def cycles_ratchet(spark, sf_dir):
    member = graph.strong_components(customer_graph(spark, sf_dir))
    touched = gates.in_scope(member, table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("path")), "node").select("scc").distinct()
    return member.join(touched, "scc", "left_semi").groupBy("scc").agg(F.count(F.lit(1)).alias("files"))


CALLS_SQL = """
WITH RECURSIVE o AS (SELECT o_custkey AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey),
g AS (SELECT a, a // 12 * 12 + lo // 4 * 7 % 12 AS b FROM o UNION ALL SELECT a, a // 12 * 12 + hi // 4 * 7 % 12 FROM o UNION ALL SELECT a, a + 12 FROM o),
c AS (SELECT c_custkey AS name, (c_acctbal < -900)::INTEGER AS assertions, c_mktsegment <> 'BUILDING' AS helper FROM customer),
h AS (SELECT name FROM c WHERE helper AND assertions > 0 UNION SELECT g.a FROM h JOIN g ON g.b = h.name JOIN c ON c.name = g.a WHERE c.helper)
"""


def functions_and_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers of one segment are tests, the others may be helpers; those with the largest debts assert."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_acctbal") < -900).cast("int").alias("assertions"), (F.col("c_mktsegment") != "BUILDING").alias("helper"))
    return customer, customer_graph(spark, sf_dir).select(F.col("a").alias("caller"), F.col("b").alias("callee"))


@query(CALLS_SQL + "SELECT name FROM h")
def asserting_helpers(spark, sf_dir):
    return testmetric.asserting_helpers(*functions_and_calls(spark, sf_dir))


@query(CALLS_SQL + "SELECT c.name, c.assertions + count(h.name) AS assertions FROM c LEFT JOIN g ON g.a = c.name LEFT JOIN h ON h.name = g.b WHERE NOT c.helper GROUP BY c.name, c.assertions")
def helper_assertions(spark, sf_dir):
    functions, calls = functions_and_calls(spark, sf_dir)
    tests = functions.filter("not helper").select("name", F.col("assertions").cast("long").alias("assertions"))
    return testmetric.with_helper_calls(tests, calls, testmetric.asserting_helpers(functions, calls))


# a rule for each customer: it may not deal with one of 25 regions


RULE_TABLE_SQL = "SELECT 'r' || o_custkey AS rule, 'C' || o_custkey % 97 || '/c' || o_custkey || '/' || left(o_orderpriority, 1) AS from_pkg, 'N' || o_orderkey % 25 || '/x' AS to_pkg, o_orderkey AS file, o_orderstatus AS import FROM orders WHERE o_orderkey % 25 = o_custkey % 25"


def rule_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k, o = F.col("c_custkey"), F.col("o_custkey")
    rules = table(spark, sf_dir, "customer").select(text("r", k).alias("rule"), text("C", k % 97, "/c", k, "/*").alias("source"), F.array(text("N", k % 25, "/**"), F.lit("never/x")).alias("deny"))
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"), text("C", o % 97, "/c", o, "/", F.substring("o_orderpriority", 1, 1)).alias("from_pkg"), F.col("o_orderstatus").alias("import"), text("N", F.col("o_orderkey") % 25, "/x").alias("to_pkg")
    )
    return edges, rules


@query(RULE_TABLE_SQL)
def rule_violations(spark, sf_dir):
    return arch.rule_violations(*rule_table(spark, sf_dir))


@query(RULE_TABLE_SQL + " AND NOT (o_custkey % 3 = 0 AND o_orderpriority LIKE '1%')")
def rule_violations_exceptions(spark, sf_dir):
    """A third of the customers is free in its first package."""
    edges, rules = rule_table(spark, sf_dir)
    free = rules.filter("cast(substr(rule, 2) as int) % 3 = 0").select("rule", F.concat(F.replace("source", F.lit("*"), F.lit("")), F.lit("1")).alias("source"), F.lit("N?*/x").alias("target"))
    return arch.rule_violations(edges, rules, free)


@query()
def cycle_chains(spark, sf_dir):
    edges = customer_graph(spark, sf_dir)
    named = edges.select(F.col("a").cast("string").alias("src"), F.lit(0).alias("ord"), F.col("b").cast("string").alias("dst"))
    return graph.cycles(named).select(F.size("files").alias("size"), F.array_join("chain", ">").alias("chain"))


# links and evidence

LINKS_SQL = """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages),
t AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) AS link FROM pages)
"""


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


@query(LINKS_SQL + "SELECT page_id, link, count(*) AS n FROM h GROUP BY ALL")
def page_links(spark, sf_dir):
    return links_of(spark, sf_dir).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(LINKS_SQL + "SELECT link, count(*) AS n FROM h WHERE link NOT IN (SELECT link FROM t) GROUP BY link")
def unresolved_links(spark, sf_dir):
    targets = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]*(/.*)$", 1).alias("link")).distinct()
    return links_of(spark, sf_dir).join(targets, "link", "left_anti").groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS required, count(l.doc_id) AS analyzed, count(*) - count(l.doc_id) AS n_missing, count(*) > 0 AND count(*) = count(l.doc_id) AS passed FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def evidence_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return gates.evidence(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))).drop("reason", "n_unresolved")


@query("SELECT DISTINCT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def evidence_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return gates.missing(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")))


GLOBS = ["example.com/**", "*.net/a*", "?log*", "**/th*h"]


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, path FROM p WHERE NOT (regexp_full_match(path, 'example\.com/.*(?:/.*)?') OR regexp_full_match(path, '[^/]*\.net/a[^/]*(?:/.*)?') OR regexp_full_match(path, '(?:.*/)?[^/]log[^/]*(?:/.*)?') OR regexp_full_match(path, '(?:.*/)?th[^/]*h(?:/.*)?'))""")
def glob_filter(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return paths.filter(~excluded(F.col("path"), GLOBS))


@query("SELECT greatest(count(*) - 100, 0)::BIGINT AS remaining FROM orders")
def top_n_remaining(spark, sf_dir):
    return gates.top_n(table(spark, sf_dir, "orders"), 100, F.col("o_totalprice").desc())[1]


# clones: words as tokens, windows of 40

WORDS_SQL = r"""
WITH l AS (SELECT doc_id AS file, ps, unnest(range(1, len(ps) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
s AS (SELECT file, line, list_filter(regexp_split_to_array(ps[line], '[ \t\r\f\x0B]+'), lambda x: x <> '') AS ws FROM l),
t AS (SELECT file, flatten(list(ws ORDER BY line)) AS ws, flatten(list(list_transform(ws, lambda x: line) ORDER BY line)) AS ls FROM s GROUP BY file),
w AS (SELECT file, k - 1 AS pos, ls[k] AS start_line, ls[k + 39] AS end_line, array_to_string(ws[k:k + 39], chr(1)) AS win FROM (SELECT *, unnest(range(1, len(ws) - 38)) AS k FROM t WHERE len(ws) >= 40)),
r AS (SELECT w.* FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1))
"""


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupe.repeated_windows(dupe.likely_windows(files_of(spark, sf_dir), 40))


@query(WORDS_SQL + "SELECT file, pos::INTEGER AS pos, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM r")
def dup_windows(spark, sf_dir):
    return _repeated(spark, sf_dir).select("file", "pos", "start_line", "end_line")


@query(WORDS_SQL + "SELECT file, count(DISTINCT l) AS lines FROM (SELECT file, unnest(range(start_line, end_line + 1)) AS l FROM r) GROUP BY file")
def dup_lines(spark, sf_dir):
    return dupe.duplicated_lines(_repeated(spark, sf_dir))


@query("SELECT md5(text) AS key, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def dup_docs(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("key"), F.xxhash64("text").alias("k")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return by.filter("copies > 1").drop("k")


RUNS_SQL = WORDS_SQL + """, f AS (SELECT win, min(struct_pack(file := file, pos := pos, s := start_line, e := end_line)) AS a FROM r GROUP BY win),
d AS (SELECT a.file AS fa, a.s AS sa, a.e AS ea, r.*, pos - a.pos AS dist, pos - row_number() OVER (PARTITION BY a.file, file, pos - a.pos ORDER BY pos) AS run FROM r JOIN f USING (win) WHERE (a.file, a.pos) <> (file, pos)),
runs AS (SELECT fa AS file_a, min(sa)::INTEGER AS start_line_a, max(ea)::INTEGER AS end_line_a, file AS file_b, min(start_line)::INTEGER AS start_line_b, max(end_line)::INTEGER AS end_line_b, count(*) + 39 AS tokens FROM d GROUP BY fa, file, dist, run)
"""
RUN_PERCENT_SQL = RUNS_SQL + """, t2 AS (SELECT coalesce(sum(ls[len(ls)] - ls[1] + 1), 0)::BIGINT AS total_lines FROM t WHERE len(ws) > 0), u AS (SELECT coalesce(sum(end_line_a - start_line_a + 1 + end_line_b - start_line_b + 1), 0)::BIGINT AS duplicated_lines FROM runs{where}),
p AS (SELECT *, CASE WHEN total_lines = 0 THEN 0.0 ELSE round(duplicated_lines / total_lines::DOUBLE * 100, 9) END AS percent FROM t2, u) SELECT *, percent <= 5 AS passed FROM p"""
_RUN_CHANGED = "file_a IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) OR file_b IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)"


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupe.repeat_runs(dupe.likely_windows(files_of(spark, sf_dir), 40), 40)


@query(RUNS_SQL + "SELECT * FROM runs")
def repeat_runs(spark, sf_dir):
    return runs_of(spark, sf_dir)


@query(RUNS_SQL + f"SELECT * FROM runs WHERE {_RUN_CHANGED}")
def repeat_runs_ratchet(spark, sf_dir):
    """Runs of which either side changed."""
    return gates.in_scope(runs_of(spark, sf_dir), changed_docs(spark, sf_dir), "file_a", "file_b")


@query(RUN_PERCENT_SQL.format(where=""))
def repeat_percent(spark, sf_dir):
    return dupe.lines_report(dupe.token_lines(files_of(spark, sf_dir)), runs_of(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


@query(RUNS_SQL + "SELECT * FROM runs ORDER BY tokens DESC, file_a, start_line_a, file_b, start_line_b LIMIT 50")
def top_repeat_runs(spark, sf_dir):
    best = orders.in_order(runs_of(spark, sf_dir), "clones")
    return best.limit(50)


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark, sf_dir).withColumn("file", F.lpad(F.col("file").cast("string"), 12, "0"))


@query()
def clone_pairs(spark, sf_dir):
    return dupe.window_clones(dupe.likely_windows(named_files(spark, sf_dir), 40), 40)


@query()
def dup_percent(spark, sf_dir):
    files = named_files(spark, sf_dir)
    clones = dupe.window_clones(dupe.likely_windows(files, 40), 40)
    return dupe.lines_report(dupe.token_lines(files), clones).withColumn("percent", F.round("percent", 9))
