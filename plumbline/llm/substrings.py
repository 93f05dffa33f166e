"""Removal of every byte that a repeated string of ``length`` bytes covers, by common-prefix intervals of suffixes.

Sorting all suffixes of a corpus is not needed to find its long repeats. Every window of ``length`` bytes holds a
content-chosen anchor: its 32-byte gram of the smallest hash. Two equal windows have equal anchors at equal places, so

1. each document emits its anchors, with the run of windows that each stands for; anchors that occur once in the corpus
   can't lie in a repeat and go (a grouped count, combined before the shuffle);
2. the others fetch their context, the bytes of their windows, from the text;
3. the suffixes that start at equal anchors are sorted, which gives an enhanced suffix array of each anchor's
   occurrences with the lengths of common prefixes. A scan with a stack visits its common-prefix intervals (the nodes of
   the suffix tree) bottom-up, and keeps the occurrences of each in the order of what stands to their left. Neighbours there
   that come from different parts of the interval differ in the next byte to the right, and by the length of what they share
   to the left in the next byte there too: a maximal repeat, whose group is all occurrences that share as much;
4. the extents of all occurrences are merged by document, and what they cover is removed.

Runs that a document repeats by itself (periodic texts) are resolved where they are found and emitted once. Anchors of
more than ``most`` occurrences are resolved by counting hashes of their windows, combined before the shuffle, so that no
group is gathered in a task. Matches never cross documents. Null and short texts have no repeats. Rows are told apart by
id and text; rows that repeat both are copies of each other, searched once and removed as such.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, fresh, written

GRAM = 32
CHUNK = 1_000_000
PLACE = np.uint64(2**24 - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
ANCHORS = "h long, k1 long, k2 long, at int, first int, last int"
KEYS = ("k1", "k2")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hashes of the strings of that size at every place (shorter by size - 1): by doubling."""
    level, width, power = mixed(b.astype(np.uint64) + np.uint64(1)), 1, np.array([BASE])
    parts: dict[int, list] = {s: [None, 0] for s in sizes}  # hash of the first bytes so far, how many
    out = {}
    while True:
        for s in sizes:
            if s & width:  # append the string of this width
                h, done = parts[s]
                n = len(b) - s + 1
                piece = level[done : done + n]
                parts[s] = [piece if h is None else h * power + piece, done + width]
                if parts[s][1] == s:
                    out[s] = mixed(parts[s][0][:n])
        if len(out) == len(sizes):
            return [out[s] for s in sizes]
        level, power, width = level[:-width] * power + level[width:], power * power, 2 * width


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    level, w = x, 1
    while 2 * w <= width:
        level, w = np.minimum(level[:-w], level[w:]), 2 * w
    return np.minimum(level[: len(x) - width + 1], level[width - w :][: len(x) - width + 1]) if w < width else level


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For the texts of a chunk: (text, hash, at, first, last) of each run, and (text, start, end) of what it covers twice.

    first..last are the window starts that share the anchor at ``at``, all within the text.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return (none,) * 8
    assert len(b) <= int(PLACE) + 1
    grams, windows = gram_hashes(b, (GRAM, length))
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (window_minima(packed, length - GRAM + 1) & PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(at)] == owner[length - 1 :]
    start = np.flatnonzero(inside)
    if not len(start):
        return (none,) * 8
    at = at[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[start[1:]] != owner[start[:-1]])])
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    at, text = at[new], owner[first]
    key = mixed(mixed(windows[first] * BASE + text.astype(np.uint64)) * BASE + mixed(windows[last] + (last - first).astype(np.uint64)))
    _, index, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    base = (ends - sizes)[text]
    once = np.zeros(len(first), bool)
    once[index] = True
    gram = grams[at].view(np.int64)
    return text[once], gram[once], (at - base)[once], (first - base)[once], (last - base)[once], text[twice], (first - base)[twice], (last - base)[twice] + length


def _emit(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        at = 0
        while at < len(batch):
            texts, rows, shifts, size = [], [], [], 0
            while at < len(batch) and size < CHUNK:
                t = batch.column(2)[at].as_py() or b""
                if len(t) >= length:
                    for s in range(0, len(t) - length + 1, CHUNK):  # long texts by window starts
                        texts.append(t[s : s + CHUNK + length - 1])
                        rows.append(at)
                        shifts.append(s)
                    size += len(t)
                at += 1
            begin, held = 0, 0
            for part in range(len(texts) + 1):  # at most 8 chunks at once, whose places fit
                if part == len(texts) or held and held + len(texts[part]) > 8 * CHUNK:
                    if part > begin:
                        some = slice(begin, part)
                        yield _anchor_batch(texts[some], np.array(rows[some], int), np.array(shifts[some], int), k1, k2, length)
                    begin, held = part, 0
                held += len(texts[part]) if part < len(texts) else 0


def _anchor_batch(texts: list[bytes], rows: np.ndarray, shifts: np.ndarray, k1: np.ndarray, k2: np.ndarray, length: int) -> pa.RecordBatch:
    text, h, at, first, last, own, start, end = anchors(texts, length)
    own, start, end = merged(own, start, end)
    text, move = np.concatenate([text, own]), shifts[np.concatenate([text, own])]
    row = rows[text]
    ints = [np.concatenate([x, y]) + move for x, y in ((at, start), (first, start), (last, end))]
    mask = np.concatenate([np.zeros(len(h), bool), np.ones(len(own), bool)])  # no hash: a range that is covered already
    columns = [pa.array(np.concatenate([h, start]), pa.int64(), mask=mask), pa.array(k1[row], pa.int64()), pa.array(k2[row], pa.int64()), *(pa.array(x, pa.int32()) for x in ints)]
    return pa.RecordBatch.from_arrays(columns, names=["h", "k1", "k2", "at", "first", "last"])


def merged(own: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites ranges of the same owner that overlap or touch; they come sorted by owner and start."""
    if not len(own):
        return own, start, end
    order = np.lexsort((start, own))
    own, start, end = own[order], start[order], end[order]
    reach = np.maximum.accumulate(end + own * 2**40) - own * 2**40  # later owners lie beyond all earlier ones
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > reach[:-1])])
    return own[new], start[new], np.maximum.reduceat(end, np.flatnonzero(new))


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From k1, k2, text, runs: h, k1, k2, at, left (bytes before the anchor, reversed), right (from the anchor on)."""
    names = ["h", "k1", "k2", "at", "left", "right"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for row in range(len(batch)):
            k1, k2, t = (batch.column(c)[row].as_py() for c in range(3))
            for x in batch.column(3)[row].as_py():
                at, first, last = x["at"], x["first"], x["last"]
                out.append((x["h"], k1, k2, at, t[first:at][::-1], t[at : last + length]))
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def repeats(lefts: list[bytes], rights: list[bytes], length: int, want_groups: bool = True) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int, list[int]]]]:
    """Of the occurrences of one anchor, distinct and sorted by rights: for each the extents (bytes before, bytes from the
    anchor on) of the maximal repeats of length or more that no longer one of it contains; and the maximal repeats
    themselves: (bytes before, bytes from the anchor on, an occurrence, the places in the order of the lefts that have it).

    Intervals are united bottom-up, the smaller part into the larger one, so that an occurrence moves a logarithmic number
    of times. Two neighbours by their lefts that come from different parts differ in the next byte to the right; they have
    ``common`` bytes to the left and differ in the next: what they share can be extended to neither side.
    """
    n = len(rights)
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for k, x in enumerate(order):
        rank[x] = k
    extents: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    groups: list[tuple[int, int, int, list[int]]] = []

    def shared(p: int, q: int) -> int:
        return common(lefts[order[p]], lefts[order[q]])

    def united(one: list[int], other: list[int], right: int, found: dict[int, int]) -> list[int]:
        """Both parts of an interval, as sorted ranks; notes how much neighbours of different parts share to the left."""
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        for p in small:
            at = bisect_left(large, p)
            for q in large[max(at - 1, 0) : at + 1]:
                left = shared(p, q)
                if left + right >= length:
                    found[p] = max(found.get(p, 0), left)
                    found[q] = max(found.get(q, 0), left)
        if len(small) * 8 > len(large):
            return list(merge(large, small))
        for p in small:
            insort(large, p)
        return large

    def noted(members: list[int], right: int, found: dict[int, int]) -> None:
        for p, left in found.items():
            own = extents[order[p]]
            if not own or own[-1][0] < left:  # rights only get shorter: longer ones to the left are new
                own.append((left, right))
        seen: set[tuple[int, int]] = set()
        for p, left in found.items() if want_groups else ():
            lo = hi = bisect_left(members, p)
            while left + right >= length:  # all that share as much to the left, and then less
                while lo and shared(members[lo - 1], p) >= left:
                    lo -= 1
                while hi + 1 < len(members) and shared(members[hi + 1], p) >= left:
                    hi += 1
                if (lo, hi) in seen:
                    break
                seen.add((lo, hi))
                groups.append((left, right, order[p], [order[q] for q in members[lo : hi + 1]]))
                left = max(shared(members[lo - 1], p) if lo else -1, shared(members[hi + 1], p) if hi + 1 < len(members) else -1)
                if left < 0:
                    break

    stack: list[tuple[int, list[list[int]]]] = []  # (common bytes, parts of the interval)
    for k in range(n):
        own = [rank[k]]
        p = common(rights[k], rights[k + 1]) if k + 1 < n else -1
        while stack and stack[-1][0] > p:
            right, parts = stack.pop()
            found: dict[int, int] = {}
            for part in parts:
                own = united(own, part, right, found)
            noted(own, right, found)
        if stack and stack[-1][0] == p:
            stack[-1][1].append(own)
        else:
            stack.append((p, [own]))
    return extents, groups


GROUPS = "id long, length int, k1 long, k2 long, start int, end int"


def _repeated(batches: Iterator[pa.RecordBatch], length: int, everywhere: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, right, left (h, k1, k2, at, left, right) -> GROUPS. One anchor is held at a time."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple] = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        places: dict[tuple[bytes, bytes], list] = {}
        for _, k1, k2, at, left, right in group:
            places.setdefault((right, left), []).append((k1, k2, at))
        keys = list(places)

        def emit(key: tuple[bytes, bytes], left: int, right: int, where: list[tuple], out: list = out) -> None:
            text = key[1][:left][::-1] + key[0][:right]
            out += [(xxhash.xxh3_64_intdigest(text) - 2**63, left + right, k1, k2, at - left, at + right) for k1, k2, at in where]

        for k, where in places.items():
            if len(where) > 1:  # alike as far as their windows reach
                emit(k, len(k[1]), len(k[0]), where)
        if len(keys) > 1:
            extents, groups = repeats([k[1] for k in keys], [k[0] for k in keys], length, everywhere)
            if everywhere:
                for left, right, x, members in groups:
                    emit(keys[x], left, right, [w for m in members for w in places[keys[m]]])
            else:
                for k, own in zip(keys, extents, strict=True):
                    for left, right in own if len(places[k]) == 1 else ():
                        emit(k, left, right, places[k])
        if len(out) > 20_000:
            yield _spans(out)
            out.clear()
    if out:
        yield _spans(out)


def _spans(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "length", "k1", "k2", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, start and two hashes of each window of the runs."""
    for batch in batches:
        for row in range(len(batch)):
            k1, k2, t = (batch.column(c)[row].as_py() for c in range(3))
            for x in batch.column(3)[row].as_py():
                b = np.frombuffer(t[x["first"] : x["last"] + length], np.uint8)
                w = gram_hashes(b, (length,))[0]
                v = gram_hashes(b ^ np.uint8(0x5A), (length,))[0]
                n = len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array((np.arange(n) + x["first"]).astype(np.int32)), pa.array(w.view(np.int64)), pa.array(v.view(np.int64))], names=["k1", "k2", "start", "w", "v"]
                )


def repeat_groups(docs: DataFrame, length: int = 200, most: int = 50_000, *, everywhere: bool = True) -> DataFrame:
    """docs(k1, k2, text binary), no row twice -> id, length, k1, k2, start, end: the maximal repeats of length bytes or more
    around each anchor, a row for each of their occurrences; id stands for the repeated string and is null for what a
    document repeats by itself (start, end: what is covered). Repeats that reach beyond the windows of an anchor come in
    overlapping parts, one for each anchor; those of an anchor of over ``most`` occurrences in parts of ``length`` bytes.

    With ``everywhere`` false, an occurrence is left out of the groups whose string lies within a longer repeat of it (its
    rows then don't grow with the depth of the tree, and cover the same bytes).
    """
    found = written(docs.select("k1", "k2", "text").mapInArrow(lambda b: _emit(b, length), ANCHORS), "anchors")
    counts = written(found.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchor-counts")
    repeated = found.join(counts, "h")

    def with_texts(rows: DataFrame) -> DataFrame:
        by = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "at", "first", "last")).alias("runs"))  # as many as a text has anchors
        return docs.select("k1", "k2", "text").join(by, ["k1", "k2"])

    contexts = with_texts(repeated.filter(F.col("n") <= most)).mapInArrow(lambda b: _contexts(b, length), "h long, k1 long, k2 long, at int, left binary, right binary")
    dealt = contexts.repartition("h").sortWithinPartitions("h", "right", "left")
    out = dealt.mapInArrow(lambda b: _repeated(b, length, everywhere), GROUPS)
    itself = found.filter("h is null").select(F.lit(None).cast("long").alias("id"), F.lit(length).alias("length"), "k1", "k2", F.col("first").alias("start"), F.col("last").alias("end"))
    out = out.unionByName(itself)
    if not counts.filter(F.col("n") > most).isEmpty():
        windows = with_texts(repeated.filter(F.col("n") > most)).mapInArrow(lambda b: _windows(b, length), "k1 long, k2 long, start int, w long, v long")
        several = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        hot = windows.join(several, ["w", "v"]).select(F.col("w").alias("id"), F.lit(length).alias("length"), "k1", "k2", "start", (F.col("start") + length).alias("end"))
        out = out.unionByName(hot if everywhere else _ranges(hot))
    return out


def _ranges(spans: DataFrame) -> DataFrame:
    """Ranges of a document that overlap or touch, united: a row for each of the longest, without its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int, int] | None = None
        for batch in batches:
            k1, k2, start, end = (batch.column(c).to_numpy() for c in range(4))
            new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] > end[:-1]))
            at = np.flatnonzero(new)
            rows = list(zip(k1[at].tolist(), k2[at].tolist(), start[at].tolist(), np.maximum.reduceat(end, at).tolist(), strict=True))
            if held and held[:2] == rows[0][:2] and rows[0][2] <= held[3]:
                rows[0] = (*held[:3], max(held[3], rows[0][3]))
            elif held:
                rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield _spans([(None, 0, *r) for r in rows])
        if held:
            yield _spans([(None, 0, *held)])

    rows = spans.select("k1", "k2", "start", "end").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start")
    return rows.mapInArrow(run, GROUPS)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, spans = [], []
        for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = raw or b""
            if own:
                s, e = np.array([x["start"] for x in own]), np.array([x["end"] for x in own])
                _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(raw)]
                texts.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            else:
                texts.append(raw)
                spans.append([])
        size = pa.array([len(r or b"") for r in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(spans, pair), pa.array(texts, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = 200, most: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (maximal ranges of bytes) and kept (the other bytes), for every row of docs."""
    text = F.col(text_col).cast("binary")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    # rows that repeat id and text are searched once, and covered as a whole by each other
    twice = fresh(keyed.filter(F.length("text") >= length).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2"), "repeated-rows")
    once = keyed
    if twice is not None:
        once = keyed.join(twice, ["k1", "k2"], "left_anti").unionByName(keyed.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    spans = repeat_groups(once, length, most, everywhere=False).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = keyed.join(spans, ["k1", "k2"], "left")
    if twice is not None:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
        rows = rows.join(twice.withColumn("twice", F.lit(True)), ["k1", "k2"], "left").withColumn("spans", F.when(F.col("twice"), whole).otherwise(F.col("spans")))
    rows = rows.select(F.when(F.col("k1") != NULL_ID, F.col("k1")).alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_kept, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
