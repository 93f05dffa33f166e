"""Substring dedup of paragraphs by MinHash banding, with repeated passages inside of paragraphs.

Two kinds of units are compared, both by their sets of distinct five-word shingles:

* a paragraph is a line of ``least_words`` words or more. Its bands are chosen for recall: 10 bands of 2 MinHash samples miss
  a pair of similarity 0.75 with a probability of 3e-4 and one of 0.85 with 3e-6;
* a stretch is a run of ``stretch`` words of the whole text, across line ends. A passage that repeats inside of longer
  paragraphs leaves these dissimilar, so texts are also read as overlapping stretches: each window of ``run_words`` - 2 *
  ``MARGIN`` words has a MinHash sample of its grams of ``GRAM_WORDS`` words, the smallest hash, and that gram with MARGIN words
  to both sides is a stretch whose one band is the sample. Equal windows choose equal grams, whatever stands around them, so
  each passage of ``run_words`` words or more that stands in two places has a stretch in common at both.

Units that collide in a band are joined, their exact Jaccard similarity is verified on the full sets, and the links give
components (``neardup.linked``). Units with equal words are one node from the start. A component keeps its first place
(smallest document id, then place); all its other places can be removed.

Null texts and empty lines have no units; null ids come last; documents without a repeated unit have no row. Rows that
repeat an id are told apart by their texts; rows that repeat both are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, written
from plumbline.llm.neardup import CHUNK_BYTES, ODD, Config, Repeats, band_keys, linked, minima, word_sets
from plumbline.llm.substrings import gram_hashes, window_minima
from plumbline.llm.words import mixed, runs, text_words

GRAM_WORDS, MARGIN = 8, 10
STRETCH = GRAM_WORDS + 2 * MARGIN
#: Words of which stretches are cut together, and the bits of a place among them.
CHUNK_WORDS = 100_000
PLACE = np.uint64(2**20 - 1)


@dataclass(frozen=True)
class Units:
    config: Config = Config(bands=10, rows=2, samples=20, sketch_longs=0)
    #: Words of the shortest paragraph that is compared; 1 takes every line that isn't empty.
    least_words: int = 20
    #: Words of a passage that is found wherever it stands.
    run_words: int = 50


def stretches(h: np.ndarray, sizes: np.ndarray, run_words: int) -> tuple[np.ndarray, ...]:
    """For the word hashes of texts of these sizes, one after the other: (text, word that it starts with, its hash, its key)
    of each stretch."""
    window = run_words - 2 * MARGIN
    if len(h) < max(window, STRETCH):
        return (np.zeros(0, np.int64),) * 4
    grams, whole = gram_hashes(h, (GRAM_WORDS, STRETCH))
    assert len(grams) <= int(PLACE) + 1
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (window_minima(packed, window - GRAM_WORDS + 1) & PLACE).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = at[owner[: len(at)] == owner[window - 1 :]]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    start, text = at - MARGIN, owner[at]
    inside = (start >= begins[text]) & (start + STRETCH <= begins[text] + sizes[text])
    start, text, at = start[inside], text[inside], at[inside]
    return text, start - begins[text], whole[start].view(np.int64), (grams[at] | np.uint64(1)).view(np.int64)


NUMBERS = tuple(f"b{k}" for k in range(10))


def _unit_rows(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """From doc, t, no_id, text: paragraphs and stretches. Keys of paragraphs are even, those of stretches odd."""
    config = units.config
    names = ["at", "k1", "k2", "n", *NUMBERS[: config.bands]]
    for batch in batches:
        texts = [t or b"" for t in batch.column(3).to_pylist()]
        row = 0
        while row < len(batch):
            first, size = row, 0
            while row < len(batch) and size < CHUNK_BYTES:
                size += len(texts[row])
                row += 1
            own = texts[first:row]
            h, counts, ends = text_words(own)
            begins = np.append(0, ends[:-1])
            lines = np.array([t.count(b"\n") + 1 for t in own])
            some = np.flatnonzero(ends - begins >= max(units.least_words, 1))
            if len(some):
                doc = np.repeat(np.arange(len(own)), lines)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines)
                yield _placed(batch, doc[some] + first, number[some], _paragraph_numbers(h, begins[some], ends[some], config), names, False)
            # texts of over CHUNK_WORDS words are dealt out by the starts of their windows
            at = 0
            parts: list[tuple[int, int, int, int]] = []  # text, first word here, words, words before
            for r, n in enumerate(counts.tolist()):
                parts += [(r, at + s, min(n - s, units.run_words + CHUNK_WORDS), s) for s in range(0, max(n - units.run_words, 0) + 1, CHUNK_WORDS)]
                at += n
            for part in [parts] if at <= CHUNK_WORDS else [[p] for p in parts]:
                words = h if at <= CHUNK_WORDS else h[part[0][1] : part[0][1] + part[0][2]]
                text, start, whole, key = stretches(words, np.array([p[2] for p in part]), units.run_words)
                if len(text):
                    table = np.array(part)
                    yield _placed(batch, table[text, 0] + first, start + table[text, 3], [whole, key, np.full(len(text), STRETCH - config.words + 1)], names, True)


def _paragraph_numbers(h: np.ndarray, begins: np.ndarray, ends: np.ndarray, config: Config) -> list[np.ndarray]:
    """k1, k2, n (shingles at most) and the band keys of stretches of words."""
    k, sizes = config.words, ends - begins
    bands = np.empty((len(begins), config.bands), np.int64)
    whole = sizes >= k
    if whole.any():
        flat = h[: len(h) - k + 1] + np.uint64(k)
        for i in range(1, k):
            flat = flat * ODD + h[i : len(h) - k + 1 + i]
        bands[whole] = band_keys(minima(mixed(flat), np.stack([begins[whole], ends[whole] - k + 1], axis=1).ravel(), config.samples), config)
    if not whole.all():  # paragraphs of fewer words are one shingle
        flat = runs(h, begins[~whole], ends[~whole])
        bands[~whole] = band_keys(minima(flat, np.repeat(np.arange(len(flat)), 2) + np.tile([0, 1], len(flat)), config.samples), config)
    return [runs(h, begins, ends).view(np.int64), runs(mixed(h + ODD), begins, ends).view(np.int64), np.maximum(sizes - k + 1, 1), *bands.T]


def _placed(batch: pa.RecordBatch, rows: np.ndarray, at: np.ndarray, numbers: list[np.ndarray], names: list[str], stretch: bool) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in (at, *numbers)]
    columns += [pa.nulls(len(rows), pa.int64())] * (len(names) - len(columns))
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(3)), pa.array(np.full(len(rows), stretch)), *columns], names=["doc", "t", "no_id", "stretch", *names])


def _unit_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From text, wanted(node, stretch, at): node, set; rows that repeat both text and id count once a task."""
    known = Repeats()
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            nodes, stretch, at = (c.to_numpy(zero_copy_only=False) for c in wanted.values.flatten())
            if not known.first(int(nodes[0]), 2):
                continue
            h, _, ends = text_words([text.as_py()])
            begins = np.append(0, ends[:-1])
            begin = np.where(stretch, at, begins[np.where(stretch, 0, at)])
            size = np.where(stretch, STRETCH, ends[np.where(stretch, 0, at)] - begin)
            for some in np.array_split(np.arange(len(nodes)), 1 + int(size.sum()) // 500_000):
                here = np.repeat(begin[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
                flat, sizes = word_sets(h[here], size[some], k)
                edges = np.append(0, np.cumsum(sizes)) * 8
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat)])], names=["node", "set"])


def repeated_units(rows: DataFrame, units: Units = Units()) -> DataFrame:
    """rows(doc_id long, text binary) -> doc_id, stretch, start (line, or word of the text), component, first_doc_id, kept."""
    config = units.config
    t = F.xxhash64(F.coalesce("text", F.lit(b"")))
    # a row without an id is told apart by its text
    named = rows.select(F.coalesce("doc_id", t).alias("doc"), t.alias("t"), F.col("doc_id").isNull().alias("no_id"), "text")
    numbers = list(NUMBERS[: config.bands])
    schema = "doc long, t long, no_id boolean, stretch boolean, at long, k1 long, k2 long, n long, " + ", ".join(f"{c} long" for c in numbers)
    found = written(named.mapInArrow(lambda b: _unit_rows(b, units), schema), "units")
    place = [F.min_by(c, F.xxhash64("doc", "t", "at")).alias(c) for c in ("doc", "t", "at")]  # of one row that holds the unit
    lines = found.filter("not stretch").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), *place, *(F.max(c).alias(c) for c in ("n", *numbers)))
    # only stretches whose key stands in several places go on: most don't
    keys = found.filter("stretch").groupBy("k2").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("k2")
    several = written(found.filter("stretch").select("doc", "t", "no_id", "at", "k1", "k2", "n").join(keys, "k2"), "stretches")
    same = several.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), *place, F.max("n").alias("n"))
    columns = ["k1", "k2", "doc", "t", "at", "n", "copies", "stretch", "bands"]
    both = lines.select("*", F.lit(False).alias("stretch"), F.array(*numbers).alias("bands")).select(columns)
    both = both.unionByName(same.select("*", F.lit(True).alias("stretch"), F.array("k2").alias("bands")).select(columns))
    nodes = written(both.select(F.monotonically_increasing_id().alias("node"), *columns, F.array().cast("array<long>").alias("sketch")), "unit-nodes")

    def fetched(wanted: DataFrame) -> DataFrame:
        by = nodes.join(wanted, "node").groupBy("doc", "t").agg(F.collect_list(F.struct("node", "stretch", "at")).alias("wanted"))  # units of one text
        texts = named.join(by, ["doc", "t"]).select("text", "wanted")
        return texts.mapInArrow(lambda b: _unit_sets(b, config.words), "node long, set binary")

    labels = linked(nodes, fetched, config, "units")
    placed = nodes.select("k1", "k2", "copies", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("component").agg(F.sum("copies").alias("size")).filter("size > 1").select("component")
    placed = placed.join(sizes, "component").select("k1", "k2", "component")
    # a component is of one kind, as their keys are
    all_units = found.filter("not stretch").select("doc", "t", "no_id", "at", "k1", "k2", F.lit(False).alias("stretch")).unionByName(several.select("doc", "t", "no_id", "at", "k1", "k2", F.lit(True).alias("stretch")))
    out = written(all_units.join(placed, ["k1", "k2"]).select("doc", "t", "no_id", "at", "stretch", "component"), "repeated-units")
    discard(found, several, nodes)
    first = out.groupBy("component").agg(F.min(F.struct("no_id", "doc", "t", "at")).alias("first"))
    here = F.expr("doc = first.doc and t = first.t and at = first.at and no_id = first.no_id")
    doc_id, first_id = F.expr("if(no_id, null, doc)"), F.expr("if(first.no_id, null, first.doc)")
    return out.join(first, "component").select(doc_id.alias("doc_id"), "stretch", F.col("at").alias("start"), "component", first_id.alias("first_doc_id"), here.alias("kept"))


def paragraph_dedup(docs: DataFrame, units: Units = Units(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated unit: doc_id, unit (paragraph: start and end are lines; passage: they are words, of a stretch),
    component, first_doc_id (where the kept one stands) and kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = F.when(F.col("stretch"), "passage").otherwise("paragraph")
    end = F.col("start") + F.when(F.col("stretch"), STRETCH).otherwise(1)
    return repeated_units(rows, units).select("doc_id", kind.alias("unit"), "start", end.alias("end"), "component", "first_doc_id", "kept")


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    return paragraph_dedup(table(spark, sf_dir, "documents"))
