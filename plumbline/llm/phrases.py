"""Phrases whose words keep company more than chance would have it, from depth-limited count tries.

Each block of documents (see ``blocks``) is a shard. A trie's first level holds the words of a language, the second pairs,
the third triples, each node with its count. Levels are counted one after the other, and a node is only grown where its path
and its suffix can still reach the least count, as no phrase is more frequent than its parts: words first; pairs of frequent
words; triples whose two pairs are frequent, for which a Bloom filter of fixed size stands in the tasks (what passes it
wrongly is counted and dropped by its count, so it never changes a result, only work).

Words are named by the sum of the counts of all words before them, so that the names sort like the words' shares of the
corpus. A shard serialises its level in the order of these names, cut into prefix ranges: the range of a path is the place
of its first two words if words were independent, so a frequent first word is spread over many ranges by its second. A
range's runs from all shards meet in one task and are merged there; it holds about ``RANGE`` nodes.

A node's ancestors are its left parts (a walk up the trie: equal path prefixes), its suffix links lead to its right parts
(equal path suffixes); both are joins between levels that hold frequent nodes only.

Counts are 64-bit, products of counts decimal(38), so scores are exact for counts up to 10^16. Null texts are empty, a null
language is ``und``, repeated rows count as often as they stand; ties are broken as the order says, so results don't depend
on partitions. Empty tables give an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.blocks import WordBlock, byte_set, in_blocks, release, saved, some_rows, written_kinds
from plumbline.llm.common import small_batches, table, written
from plumbline.llm.words import mixed

LEAST, TOP = 10, 2000
#: Occurrences of pairs that fall into one prefix range.
RANGE = 500_000
#: Bits of the filter of frequent pairs, and hashes an entry.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3
BREAKS = byte_set(b".,;:!?\n\x0b\x0c\r")
GAPS = BREAKS | byte_set(b" \t")
KINDS = {"pieces": "block long, ids binary", "words": "block long, word_no int, lang string, word string, n long"}


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little", signed=True)


def phrase_blocks(docs: DataFrame) -> dict[str, DataFrame]:
    """The pieces of each block as numbers of words (-1 before each piece), and its distinct words with their counts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in in_blocks(batches, 1):
            block, langs = WordBlock(GAPS, BREAKS), []
            for batch, texts in own:
                langs.extend(batch.column(0).to_pylist())
                keys = np.array([_lang_key(x) for x in langs[len(langs) - len(texts) :]], np.int64)
                block.add(texts, keys)
            words, first, ids, _ = block.numbered()
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.astype("<i4").tobytes()], pa.binary())], names=["block", "ids"])
            names = np.array(langs, object)[first]
            known = pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(names.tolist(), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)], names=["block", "word_no", "lang", "word", "n"])
            yield from some_rows(known)

    return written_kinds(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")), make, KINDS, "phrases")


def named(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """lang, word, f of words of at least ``least``, each with its name g: the counts before it; and the sum of all counts."""
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            f = batch.column(2).to_numpy()
            upto = np.cumsum(f) + before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - f), pa.array(np.full(len(f), part, np.int32))], names=["lang", "word", "f", "own", "part"])
            before = int(upto[-1]) if len(f) else before

    kept = written(frequent.mapInArrow(running, "lang string, word string, f long, own long, part int"), "phrase-words")
    parts = sorted((r.part, r.f) for r in kept.groupBy("part").agg(F.sum("f").alias("f")).collect())  # a row a partition
    total, offsets = 0, []
    for part, f in parts:
        offsets.append((part, total))
        total += f
    offset = words.sparkSession.createDataFrame(offsets, "part int, before long")
    return kept.join(F.broadcast(offset), "part").select("lang", "word", "f", (F.col("before") + F.col("own")).alias("g")), total


def _ranked(pieces: pa.Table, words: pa.Table) -> pa.Table:
    """A block's pieces with its frequent words numbered in the order of their names, others as breaks."""
    g, f, no = (words.column(c).to_numpy() for c in ("g", "f", "word_no"))
    order = np.argsort(g, kind="stable")
    rows = []
    for block, ids in zip(pieces.column("block").to_pylist(), pieces.column("ids"), strict=True):
        own = np.frombuffer(ids.as_buffer(), "<i4")
        rank = np.full(max(int(own.max(initial=-1)), int(no.max(initial=-1))) + 2, -1, np.int32)  # the last is that of -1
        rank[no[order]] = np.arange(len(order), dtype=np.int32)
        own = rank[own]
        own = own[(own >= 0) | np.append(own[1:] >= 0, False)]  # one break is enough
        rows.append((block, own.astype("<i4").tobytes(), g[order].astype("<i8").tobytes(), f[order].astype("<i8").tobytes()))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    release()
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["block", "ids", "gs", "fs"])


RANKED = "block long, ids binary, gs binary, fs binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(len(batch)):
            yield tuple(np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, "<i4"), (2, "<i8"), (3, "<i8")))


def _nodes(names: list[np.ndarray], counts: np.ndarray, f1: np.ndarray, total: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """A shard's level, in order, with the prefix range of each node."""
    place = names[0] + f1 * (names[1] / total)
    where = np.minimum(place * (ranges / total), ranges - 1).astype(np.int32)
    cols = [where, *names, counts]
    yield from some_rows(pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["range", *(f"g{k + 1}" for k in range(len(names))), "n"]), 100_000)


def merged(nodes: DataFrame, depth: int, least: int, ranges: int) -> DataFrame:
    """The runs of each range merged: a row per node of at least ``least``."""
    names = [f"g{k + 1}" for k in range(depth)]

    def merge(rows: pa.Table) -> pa.Table:
        cols = [rows.column(c).to_numpy() for c in names]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        n = rows.column("n").to_numpy()[order]
        new = np.flatnonzero(np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in cols], axis=0))
        sums = np.add.reduceat(n, new)
        kept = sums >= least
        release()
        return pa.table([*(pa.array(c[new][kept]) for c in cols), pa.array(sums[kept])], names=[*names, "n"])

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartition(max(tasks, min(ranges, 4 * tasks)), "range")  # smaller sorts: all nodes of a level are dealt here
    return dealt.groupBy("range").applyInArrow(merge, ", ".join(f"{c} long" for c in [*names, "n"]))


def pair_nodes(ranked: DataFrame, total: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, gs, fs in _shards(batches):
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            pairs, counts = np.unique(ids[:-1][both].astype(np.int64) << 32 | ids[1:][both], return_counts=True)
            one, two = pairs >> 32, pairs & 0xFFFFFFFF
            del both, pairs
            yield from _nodes([gs[one], gs[two]], counts, fs[one], total, ranges)
        release()

    return ranked.mapInArrow(run, "range int, g1 long, g2 long, n long")


def _places(g1: np.ndarray, g2: np.ndarray, size: int) -> np.ndarray:
    """Bits of the filter, a row for each hash."""
    h = mixed(g1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(g2.view(np.uint64) + np.uint64(77)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.array([(h + np.uint64(k) * step) % np.uint64(size) for k in range(FILTER_HASHES)])


def pair_filter(pairs: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of so many bits as 64-bit words; the driver gets at most a row a word, however many pairs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    found = pairs.select("g1", "g2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def triple_nodes(ranked: DataFrame, pairs: DataFrame, total: int, ranges: int, filter_bits: int) -> DataFrame:
    known = ranked.sparkSession.sparkContext.broadcast(pair_filter(pairs, filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for ids, gs, fs in _shards(batches):
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            key = np.where(both, ids[:-1].astype(np.int64) << 32 | ids[1:], -1)
            distinct, own = np.unique(key, return_inverse=True)
            if not len(gs):
                continue
            real = np.maximum(distinct, 0)
            at = _places(gs[real >> 32], gs[real & 0xFFFFFFFF], filter_bits)
            may = np.all(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1, axis=0) & (distinct >= 0)
            go = np.flatnonzero(may[own][:-1] & may[own][1:])
            del key, both, at, real, may
            triples, counts = np.unique(own[go].astype(np.int64) << 32 | ids[go + 2], return_counts=True)
            pair, three = distinct[triples >> 32], triples & 0xFFFFFFFF
            del distinct, own, go, triples
            yield from _nodes([gs[pair >> 32], gs[pair & 0xFFFFFFFF], gs[three]], counts, fs[pair >> 32], total, ranges)
        release()

    return ranked.mapInArrow(run, "range int, g1 long, g2 long, g3 long, n long")


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that stay, from the frequent nodes of the three levels."""
    word = lambda k: words.select(F.col("g").alias(f"g{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
    two = written(pairs.join(word(1), "g1").join(word(2), "g2"), "phrase-pairs")
    left = two.select("g1", "g2", "lang", "w1", "w2", "f1", F.col("n").alias("f12"))
    right = two.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("w2").alias("w3"), F.col("n").alias("f23"), F.col("f2").alias("f3"))
    three = written(triples.join(left, ["g1", "g2"]).join(right, ["g2", "g3"]), "phrase-triples")
    wide = lambda c: F.col(c).cast("decimal(19,0)")

    def cut(a: str, left: str, right: str) -> F.Column:
        value = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) div (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")
        return F.struct(F.col(left).alias("l"), F.col(right).alias("r"), value.alias("score"))

    held = three.select(F.explode(F.array(F.struct("g1", "g2", "n"), F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "n"))).alias("p")).groupBy("p.g1", "p.g2").agg(F.max("p.n").alias("longer"))
    kept = two.join(held, ["g1", "g2"], "left").filter(F.coalesce(100 * wide("longer") < 50 * wide("n"), F.lit(True)))
    of_two = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), cut("n", "f1", "f2").alias("c"))
    first, second = cut("n", "f1", "f23"), cut("n", "f12", "f3")
    of_three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.when(first["score"] <= second["score"], first).otherwise(second).alias("c"))
    return of_two.unionByName(of_three).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, in_range: int = RANGE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words from docs(text, lang)."""
    kinds = phrase_blocks(docs)
    words, total = named(kinds["words"], least)
    ranges = max(1, -(-total // in_range))
    known = kinds["words"].join(words, ["lang", "word"]).select("block", "word_no", "g", "f")
    ranked = saved(kinds["pieces"].groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_ranked, RANKED), "phrase-shards")
    pairs = saved(merged(pair_nodes(ranked, max(total, 1), ranges), 2, least, ranges), "phrase-level2")
    triples = saved(merged(triple_nodes(ranked, pairs, max(total, 1), ranges, filter_bits), 3, least, ranges), "phrase-level3")
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = scored(words, pairs, triples).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    sizes = kinds["words"].groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mine_phrases(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PHRASES_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS gram FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, gram, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
cuts AS (SELECT c.lang, c.gram, c.a, x.k AS cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.gram = c.gram[1:x.k] JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.gram = c.gram[x.k + 1:c.k]),
best AS (SELECT lang, gram, a, arg_min(struct_pack(l := l, r := r, score := score), score * 4 + cut) AS c FROM cuts GROUP BY lang, gram, a),
inner_pairs AS (SELECT lang, gram, max(a) AS longer FROM (SELECT lang, gram[1:2] AS gram, a FROM c WHERE k = 3 UNION ALL SELECT lang, gram[2:3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_pairs i ON i.lang = best.lang AND i.gram = best.gram WHERE i.longer IS NULL OR 100 * i.longer < 50 * best.a),
named AS (SELECT lang, array_to_string(gram, ' ') AS phrase, a, c.l AS l, c.r AS r, c.score AS score FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= {TOP}"""
