"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is ``share * budget / characters of the source``: the number of times that each of its documents should
be seen on average. A document is emitted Poisson(rate) times: the quantile of a uniform number that is a hash of the
seed, the document's id and its text. No counter is shared between tasks, so the result is the same for any partitioning
and after any retry, and the expected mix is exact however skewed the sources are.

Rates over ``PART`` are cut into equal parts with a hash each (the sum of independent Poisson numbers is one), so the
table of the distribution function has ``TERMS`` entries for any rate. The share of a source is proportional to
``chars ** exponent`` (tempered mixing), or given in ``weights``: sources that are not named there are left out, and
nothing comes if no document is of a named source with characters and a weight.

Null sources form one source (the result keeps null). Null texts weigh nothing and come at their source's rate, as do
empty ones; without ``weights`` a source without any characters has the rate 1. Rows that repeat id and text get the same
count. An empty table gives an empty result. A null n_chars is not used: characters are counted in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written

PART, TERMS = 16.0, 100
#: Sources up to which their table (a few numbers each) is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, exponent: float, budget_factor: float, weights: dict[str, float] | None, source_col: str, text_col: str) -> DataFrame:
    """source, rate, parts (how many Poisson numbers are added), cdf (distribution function of each): a row per source,
    summed before the shuffle, written once."""
    by = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0)).alias("chars"))
    if weights is None:
        power = F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(float(exponent)))).otherwise(F.lit(0.0))
        by = by.withColumn("weight", power)
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        by = by.join(named, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    by = written(by, "source-sizes")
    # rounded, so that the order of the additions doesn't matter
    total = by.agg(F.sum(F.when(F.col("chars") > 0, F.round("weight", 6).cast("decimal(38,6)"))).cast("double").alias("w"), F.sum("chars").cast("double").alias("c")).first()
    share = F.col("weight") / F.lit(total.w) if total.w else F.lit(0.0)
    rate = F.when(F.col("chars") > 0, share * (F.lit(total.c or 0.0) * budget_factor) / F.col("chars")).otherwise(F.lit(1.0 if weights is None else 0.0))
    rates = by.select("source", rate.alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    return rates.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def poisson_cdf(rate: Column) -> Column:
    """P(N <= 0), P(N <= 1), ...: TERMS entries."""
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), first, more)["cdf"]


def uniform(seed: int, part: Column, doc_id: Column, text_hash: Column) -> Column:
    """52 bits of a hash, as a number in [0, 1)."""
    key = F.concat_ws(":", F.lit(str(seed)), part.cast("string"), doc_id, text_hash)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores at its end as long as a column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def mix_sources(docs: DataFrame, *, exponent: float = 0.5, budget_factor: float = 1.0, weights: dict[str, float] | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of docs, then the number of the copy (``copy``: 0, 1, ...) and its place in the order (``order_key``); a
    name that docs has already gets an underscore at its end. Rows are dealt to partitions by the order's hash and sorted by
    it in each: a global shuffle that a retry repeats exactly, without the second pass that a sort's ranges need."""
    rates = source_rates(docs, exponent, budget_factor, weights, source_col, text_col)
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # the row itself is one column, so that no name of its own can clash
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col(source_col).cast("string").alias("own"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    drawn = rows.join(rates, F.col("own").eqNullSafe(F.col("source")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: uniform(seed, k, F.col("id"), F.col("hash")))
    n = F.aggregate(numbers, F.lit(0), lambda s, u: s + F.size(F.filter("cdf", lambda c: c <= u)))
    drawn = drawn.select("row", "id", "hash", n.alias("n")).filter("n > 0").select("row", "id", "hash", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("number"))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col("number").cast("string"), "id", "hash"))
    shuffled = drawn.select("row", "number", key.alias("key")).repartition("key").sortWithinPartitions("key")
    copy, order = (free_name(c, docs.columns) for c in ("copy", "order_key"))
    return shuffled.select("row.*", F.col("number").alias(copy), F.col("key").alias(order))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


#: For documents whose source may be null; the same steps as above.
def mixing_sql(docs: str = "documents", exponent: float = 0.5, budget_factor: float = 1.0, seed: int = 17) -> str:
    return f"""
WITH by_source AS (
  SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM {docs} GROUP BY source
), weighted AS (
  SELECT *, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {exponent}) ELSE 0.0 END AS weight FROM by_source
), total AS (
  SELECT sum(round(weight, 6)::DECIMAL(38,6))::DOUBLE AS w, sum(chars)::DOUBLE AS c FROM weighted
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / w * (c * {budget_factor}) / chars ELSE 1.0::DOUBLE END AS rate FROM weighted, total
), parts AS (
  SELECT *, greatest(1, ceil(rate / {PART}))::INTEGER AS parts FROM rates
), cdfs AS (
  WITH RECURSIVE terms AS (
    SELECT source, rate / parts AS rate, parts, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parts
    UNION ALL
    SELECT source, rate, parts, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < {TERMS - 1}
  )
  SELECT source, parts, list(c ORDER BY k) AS cdf FROM terms GROUP BY source, parts
), drawn AS (
  SELECT d.*, md5(coalesce(text, '')) AS h, cdf, unnest(range(1, parts + 1)) AS part
  FROM {docs} d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source
), counted AS (
  SELECT doc_id, text, lang, source, n_chars, h, sum(len(list_filter(cdf, lambda x: x <=
    ('0x' || substr(md5('{seed}:' || part || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || h), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0))) AS n
  FROM drawn GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5('order {seed}:' || copy || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || h) AS order_key
FROM (SELECT *, unnest(range(0, n::BIGINT)) AS copy FROM counted WHERE n > 0)
"""
