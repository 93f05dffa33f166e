"""Benchmark decontamination by a prefix-filtered containment join with exact verification.

Words are the maximal runs of letters A-Z (lower-cased), digits and non-ASCII characters. A window is ``window``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document word is hit if it
lies in an occurrence of any window.

Containment of a whole window needs every word of it, so the prefix that must be joined is its rarest word: words are
ordered by their frequency over all documents (a first pass counts them, summed in each task before the shuffle). A
second pass joins document positions with that word on the word, keeps those where the window fits (its words before and
after lie in the document: the positional and length bound), compares a rolling hash of the words there, and then the
words themselves.

Items are taken in blocks of at most ``block_words`` words (a proven bound of what each task holds; longer items are cut
between windows); a larger benchmark is joined block by block, so nothing grows with it but the number of passes. Documents are
never shuffled or collected. Null texts have no words and no hits; null items are skipped, and a null item id is listed
as an empty string; items that repeat an id count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to lower case, other ASCII than letters and digits to spaces; other bytes are letters.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Block:
    """The windows of some items, over word numbers in order of rarity (0: the rarest)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, counts: dict[bytes, int]) -> None:
        vocabulary = sorted({w for _, ws in items for w in ws}, key=lambda w: (counts.get(w, 0), w))
        self.numbers = {w: k for k, w in enumerate(vocabulary)}
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        windows: dict[tuple[int, ...], set[int]] = {}
        for i, ws in items:
            ns = [self.numbers[w] for w in ws]
            for k in range(max(1, len(ns) - window + 1)):
                windows.setdefault(tuple(ns[k : k + window]), set()).add(place[i])
        self.by_length = []
        for n in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == n]
            rows = np.array(own, np.int64)
            rare = rows.argmin(axis=1)
            hashes = rolling(rows.ravel(), n)[:: n]
            order = np.argsort(hashes, kind="stable")
            # (prefix word, its place in the window) pairs that occur: the postings of the join
            pairs = np.unique(np.stack([rows[np.arange(len(own)), rare], rare], axis=1), axis=0)
            self.by_length.append((n, rows[order], hashes[order], pairs, [sorted(windows[own[k]]) for k in order]))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are hit (None: none), and the items (places in ids) whose windows occur."""
        found: set[int] = set()
        marks = None
        ns = np.fromiter(map(self.numbers.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(ns >= 0)
        if not len(known):
            return None, found
        for n, rows, hashes, pairs, owners in self.by_length:
            if len(ns) < n:
                continue
            # windows fit only where all n words are known
            runs = np.concatenate([[0], np.cumsum(ns >= 0)])
            fits = runs[n:] - runs[:-n] == n
            if not fits.any():
                continue
            starts = self._starts(ns, known, pairs, fits, n)
            if not len(starts):
                continue
            h = rolling_at(ns, starts, n)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            ok = hashes[at] == h
            for s, k in zip(starts[ok].tolist(), at[ok].tolist(), strict=True):
                last = int(np.searchsorted(hashes, hashes[k], "right"))
                for j in range(k, last):  # windows whose hashes are equal
                    if (ns[s : s + n] == rows[j]).all():
                        if marks is None:
                            marks = np.zeros(len(ns), bool)
                        marks[s : s + n] = True
                        found.update(owners[j])
        return marks, found

    def _starts(self, ns: np.ndarray, known: np.ndarray, pairs: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
        """Window starts that hold a prefix word at one of its places."""
        values = ns[known]
        lo, hi = np.searchsorted(pairs[:, 0], values, "left"), np.searchsorted(pairs[:, 0], values, "right")
        some = hi > lo
        if not some.any():
            return known[:0]
        counts = (hi - lo)[some]
        which = np.repeat(lo[some], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(known[some], counts) - pairs[which, 1]
        starts = np.unique(starts[(starts >= 0) & (starts <= len(ns) - n)])
        return starts[fits[starts]]


def rolling(ns: np.ndarray, n: int) -> np.ndarray:
    return rolling_at(ns, np.arange(len(ns) - n + 1), n)


def rolling_at(ns: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = h * MULTIPLIER + (ns[starts + k].astype(np.uint64) + np.uint64(1))
    return h


def item_blocks(items: Iterator, block_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words) in lists of at most block_words words; a longer item comes in parts that share window - 1 words,
    so that each of its windows is whole in one."""
    block: list = []
    size = 0
    most = max(block_words, window)
    for row in items:
        all_words = words_of(row[1])
        for at in range(0, max(len(all_words) - window + 1, min(1, len(all_words))), most - window + 1):
            ws = all_words[at : at + most]
            if block and size + len(ws) > block_words:
                yield block
                block, size = [], 0
            block.append(("" if row[0] is None else str(row[0]), ws))
            size += len(ws)
    if block:
        yield block


def _counted(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often the words of a block occur in all documents: at most a number for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {w: k for k, w in enumerate(sorted(vocabulary))}
        totals = np.zeros(len(numbers) + 1, np.int64)
        for batch in batches:
            for text in batch.column(1):
                ws = words_of(text.as_py())
                totals += np.bincount(np.fromiter(map(numbers.get, ws, [len(numbers)] * len(ws)), np.int64, len(ws)), minlength=len(totals))
        at = np.flatnonzero(totals[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], names=["word", "n"])

    names = sorted(vocabulary)
    rows = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {names[r.word]: r.n for r in rows}


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hit_spans (array of word ranges, end exclusive) and items (sorted ids, as strings) per document."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("binary")).toLocalIterator()
    parts: list[DataFrame] = []
    for items in item_blocks(rows, block_words, window):
        block = Block(items, window, _counted(raw, {w for _, ws in items for w in ws}))
        parts.append(_matched(raw, block, not parts))
    if not parts:
        parts.append(_matched(raw, Block([], window, {}), True))
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "hit_spans", "items")
    return _combined(parts)


RESULT = "doc_id long, key long, n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>"


def _matched(raw: DataFrame, block: Block, all_rows: bool) -> DataFrame:
    """The result of one block of items; the first block gives a row to every document, others only where they hit."""
    shared = raw.sparkSession.sparkContext.broadcast(block)  # at most block_words words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                marks, found = block.hits(words)
                if marks is None and not all_rows:
                    continue
                edge = [] if marks is None else np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                rows.append((doc_id, key, len(words), spans, [block.ids[k] for k in sorted(found)]))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "key", "n_words", "hit_spans", "items"])

    return raw.select("doc_id", F.xxhash64("raw").alias("key"), "raw").mapInArrow(run, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item."""
    raw = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("binary")).toLocalIterator()
    for items in item_blocks(rows, block_words, window):
        shared = docs.sparkSession.sparkContext.broadcast(Block(items, window, _counted(raw, {w for _, ws in items for w in ws})))  # at most block_words words
        docs = docs.filter(_clean(shared)(F.col(text_col).cast("binary")))
    return docs


def _clean(shared):
    """A filter: no window of the shared block occurs."""

    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.hits(words_of(t.as_py()))[0] is None for t in texts], pa.bool_())

    return F.arrow_udf(clean, "boolean")


def _combined(parts: list[DataFrame]) -> DataFrame:
    """Adds up the blocks' results by document: spans are merged, items united."""
    rows = parts[0].withColumn("first", F.lit(True))
    for p in parts[1:]:
        rows = rows.unionByName(p.withColumn("first", F.lit(False)))
    by = rows.groupBy("doc_id", "key").agg(
        F.sum(F.col("first").cast("long")).alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    merged = F.aggregate(
        F.array_sort("spans"), F.expr("cast(array() as array<struct<start:long,end:long>>)"),
        lambda s, x: F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["end"] >= x["start"]),
            F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(F.try_element_at(s, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(s, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(s, F.array(x))),
    )
    by = by.withColumn("hit_spans", merged).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return by.select("doc_id", "n_words", "hit_spans", "items")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


#: Words by position, windows by joined text, and the words of documents that lie in them.
DECONTAMINATE_SQL = r"""
WITH item_words AS (
  SELECT item_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS ws FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, list_slice(ws, k, least(k + 9, len(ws))) AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM item_words WHERE ws <> ['']), (SELECT 1)
), lengths AS (
  SELECT DISTINCT len(win) AS n FROM windows
), doc_words AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM doc_words, lengths WHERE len(ws) >= n
), matched AS (
  SELECT doc_id, k, n, item_id FROM (SELECT doc_id, k, n, list_slice(ws, k, k + n - 1) AS win FROM starts) s JOIN windows USING (win)
), hit AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM matched) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM matched) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
