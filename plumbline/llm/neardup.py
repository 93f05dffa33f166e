"""Near-duplicate texts by word shingles: MinHash bands, odd sketches, exact verification, components.

1. Each text becomes its set of distinct shingles (``words`` lower-cased words; a shorter text is one shingle), as 64-bit
   hashes; texts that are equal are one node from here on, so copies cost a row each.
2. MinHash samples of the set give ``bands`` keys of ``rows`` samples. All samples are folded into an odd sketch: sample
   k with value v toggles one bit chosen by (k, v). The XOR of two sketches holds the parity of the samples in which the
   sets differ, and its population count estimates a high similarity precisely.
3. In each bucket of a band every node is paired with the smallest one; pairs whose sketches rule out the threshold
   (by more than ``SURE`` deviations) go; the others are verified on the full sets, and links give components.
4. Buckets that hold more than one component after that are closed exactly: nodes outside of the smallest node's
   component meet all nodes of the bucket, block by block, and what could join two components is verified on the spot.
   No such pair is left out, and tasks emit only links that join components: never the square of a group.

A pair of the threshold similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: for 0.75, 3 rows and 28
bands all but 2e-7. Of each distinct text one row, picked by the smallest ``at``, is fetched for the verification, so a text
that a third of all rows repeat is shingled once. Verification streams through rows sorted by centre: it holds two sets at a
time; large centres are dealt out over several keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, discard, fresh, written
from plumbline.llm.words import mixed, text_words
from plumbline.operators.graph import connected_components

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose shingles are hashed together.
CHUNK_BYTES = 300_000
#: Members of a centre that one task key gets, and shingles of a block.
PER_KEY, BLOCK_SHINGLES = 128, 500_000
SURE = 4.5


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 75
    bands: int = 28
    rows: int = 3
    samples: int = 128
    #: 64-bit numbers of a sketch; without sketches all pairs of the stars are verified.
    sketch_longs: int = 8

    def most_bits(self) -> int:
        """The population count of an XOR over which a pair of the threshold similarity is ruled out."""
        n, k, s = 64 * self.sketch_longs, self.samples, self.percent / 100
        if not n:
            return 0
        differ = k * (1 - s)
        left = (1 - 2 / n) ** (2 * differ)  # a bit's bias after the toggles of both sides
        spread = (2 * left * (k * s * (1 - s)) ** 0.5) ** 2 + n / 4 * (1 - left**2) * (1 - left)
        return int(n / 2 * (1 - left) + SURE * spread**0.5) + 1


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts, one after the other as sorted 64-bit hashes, and their sizes."""
    h, counts, _ = text_words([t or b"" for t in texts])
    return word_sets(h, counts, k)


def word_sets(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts given by the hashes of their words, one after the other."""
    begins = np.cumsum(counts) - counts
    width = np.minimum(counts, k)  # a text of fewer words is one shingle
    many = np.where(counts > 0, counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    firsts = np.cumsum(many) - many
    start = np.arange(len(owner)) + np.repeat(begins - firsts, many)
    out = width[owner].astype(np.uint64)
    for i in range(k):
        some = width[owner] > i
        if some.all():
            out = out * ODD + h[start + i]
        else:
            out[some] = out[some] * ODD + h[start[some] + i]
    out = mixed(out)
    for begin, end in zip(firsts.tolist(), (firsts + many).tolist(), strict=True):
        out[begin:end].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[firsts[many > 0]] = True
    return out[first], np.bincount(owner[first], minlength=len(counts))


def minima(flat: np.ndarray, places: np.ndarray, samples: int) -> np.ndarray:
    """MinHash values (samples rows) of the stretches of flat between each even place and the odd one after it."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 2**32, samples, np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, samples, np.uint32)
    x = np.append((flat >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    values = np.empty((samples, len(places) // 2), np.uint64)
    for k in range(samples):
        values[k] = np.minimum.reduceat(x * a[k] + b[k], places)[::2] if len(places) else 0
    return values


def band_keys(values: np.ndarray, config: Config) -> np.ndarray:
    """Even numbers (int64, bands columns) from the MinHash values of texts."""
    h = np.zeros((config.bands, values.shape[1]), np.uint64) + np.arange(1, config.bands + 1, dtype=np.uint64)[:, None]
    for r in range(config.rows):
        h = mixed(h * ODD + values[r : config.rows * config.bands : config.rows] + np.uint64(1))
    return (h.T & ~np.uint64(1)).astype(np.int64)


def odd_sketches(values: np.ndarray, config: Config) -> np.ndarray:
    """uint64, sketch_longs columns."""
    salt = np.random.default_rng(21).integers(0, 2**63, config.samples).astype(np.uint64)
    bits = mixed(values * ODD + salt[:, None]) % np.uint64(64 * config.sketch_longs)
    one, place = np.uint64(1) << (bits % np.uint64(64)), (bits // np.uint64(64)).astype(int)
    sketches = np.zeros((values.shape[1], config.sketch_longs), np.uint64)
    rows = np.arange(values.shape[1])
    for k in range(config.samples):
        sketches[rows, place[k]] ^= one[k]
    return sketches


def signed(flat: np.ndarray, sizes: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of sets that aren't empty."""
    ends = np.cumsum(sizes)
    values = minima(flat, np.stack([ends - sizes, ends], axis=1).ravel(), config.samples)
    return band_keys(values, config), odd_sketches(values, config)


def text_key(text: str = "text") -> list:
    """128 bits that stand for a text."""
    t = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def _signatures(items: DataFrame, config: Config) -> DataFrame:
    """k1, k2, at, n, and the keys b0, b1, ... and the sketch s0, s1, ... as columns of their own, which Spark can aggregate
    without sorting."""
    numbers = [f"b{k}" for k in range(config.bands)] + [f"s{k}" for k in range(config.sketch_longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(3).to_pylist(), 0
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and size < CHUNK_BYTES:
                    size += len(texts[end] or b"")
                    end += 1
                flat, sizes = shingle_sets(texts[at:end], config.words)
                some = sizes > 0
                keys, sketches = signed(flat, sizes[some], config)
                rows = pa.array(np.flatnonzero(some) + at)
                own = [pa.array(c) for c in (*keys.T, *sketches.view(np.int64).T)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(sizes[some]), *own], names=["k1", "k2", "at", "n", *numbers])
                at = end

    return items.select("k1", "k2", "at", "text").mapInArrow(run, "k1 long, k2 long, at long, n long, " + ", ".join(f"{c} long" for c in numbers))


def _bits(config: Config) -> F.Column:
    out = F.lit(0)
    for k in range(config.sketch_longs):
        out = out + F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}")))
    return out


def _verified(pairs: DataFrame, sets: DataFrame, config: Config, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold: a centre's set goes to each key that its members are dealt to,
    a member's to its centre's."""
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_KEY).cast("int").alias("m")), "a")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("m")).cast("int"))
    needs = salted.select(F.col("b").alias("node"), "a", "salt", F.col("b")).unionByName(salted.select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct())
    dealt = sets.join(needs, "node").select("a", "salt", "b", "set").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for a, salt, b, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if b is None:
                    at, centre = (a, salt), own
                    continue
                assert at == (a, salt)
                both = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * both >= config.percent * (len(centre) + len(own) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return written(dealt.mapInArrow(run, "a long, b long"), name)


def _between_components(nodes: DataFrame, shared: DataFrame, labels: DataFrame, sets: DataFrame, config: Config, name: str) -> DataFrame | None:
    """Verified links (a, b) between components that share a bucket; None if no bucket is open.

    A node outside of the component of the bucket's smallest node (a stray) meets all nodes of the bucket, block by block;
    only pairs that share one of the rarest shingles of each (a prefix filter, exact for the threshold) are looked at, so that
    a bucket of many dissimilar nodes costs its size; sketches and sizes come next, then the sets. A pair is looked at in the
    first band that it shares only, and not if links of its block have already joined its components, so a task emits fewer
    links than it holds nodes.
    """
    of = lambda c, n: labels.select(F.col("node").alias(c), F.col("component").alias(n))
    own = shared.join(of("a", "core"), "a", "left").join(of("b", "component"), "b", "left")
    own = own.select("key", F.col("b").alias("node"), F.coalesce("component", "b").alias("component"), (F.coalesce("component", "b") != F.coalesce("core", "a")).alias("stray"))
    open_ = own.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("stray").alias("strays")).filter("size > 1 and strays > 0").select("key")
    opened = fresh(own.join(open_, "key").join(nodes.select("node", "n"), "node"), f"{name}-open")
    if opened is None:
        return None
    own = opened
    blocks = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES).cast("int")
    counts = own.groupBy("key").agg(blocks(F.col("stray")).alias("strays"), blocks(~F.col("stray")).alias("cores"))
    own = own.join(counts, "key")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("cores"))).cast("int")
    own = own.withColumn("block", block)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    here = F.col("block")
    with_cores = F.when(F.col("cores") > 0, upto(F.greatest(F.col("cores"), F.lit(1)), lambda k: cell("c", here, k))).otherwise(F.array().cast("array<struct<kind:string,i:int,j:int>>"))
    cells = F.when(F.col("stray"), F.concat(upto(F.col("strays"), lambda k: cell("s", F.least(here, k), F.greatest(here, k))), with_cores)).otherwise(upto(F.col("strays"), lambda k: cell("c", k, here)))
    rows = own.withColumn("cell", F.explode(cells)).join(nodes.select("node", "sketch", "bands"), "node").join(sets, "node")
    rows = rows.select("key", "cell.kind", "cell.i", "cell.j", "node", "component", "stray", "block", "sketch", "bands", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (key, kind, i, j), group in groupby(tuples(), key=lambda r: r[:4]):
            rows = [Member(*r[4:]) for r in group]  # at most two blocks
            left = [r for r in rows if (r.stray if kind == "c" else r.block == i)]
            right = [r for r in rows if (not r.stray if kind == "c" else r.block == j)]
            found = _links(left, right, key, config) if left and right else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "node")
    links = fresh(dealt.mapInArrow(run, "a long, b long").distinct(), f"{name}-between")
    discard(opened)
    return links


@dataclass
class Member:
    node: int
    component: int
    stray: bool
    block: int
    sketch: list[int]
    bands: list[int]
    set: bytes


def prefixes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) of the tokens of each set that must hold one of any other set that reaches the threshold with it: the
    rarest of all these sets, ties by token; as many as may be missing, and one."""
    sizes = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.lexsort((tokens, counts[inverse], owner))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = order[place < (sizes - -(-percent * sizes // 100) + 1)[owner]]  # owners come in order
    return owner[kept], tokens[kept]


def _links(left: list[Member], right: list[Member], key: int, config: Config) -> list[tuple[int, int]]:
    """Links between two blocks (or of one with itself) that join components. Pairs that share no prefix token are out."""
    sketch = np.array([r.sketch for r in right], np.int64).view(np.uint64).reshape(len(right), -1)
    bands = np.array([r.bands for r in right], np.int64)
    ids, components = np.array([r.node for r in right]), np.array([r.component for r in right])
    lefts, rights = ([np.frombuffer(r.set, np.uint64) for r in rows] for rows in (left, right))
    sizes = np.array([len(x) for x in rights])
    owner, tokens = prefixes([*lefts, *rights], config.percent)
    at = np.searchsorted(owner, len(left))
    order = np.argsort(tokens[at:], kind="stable")
    posted, holders = tokens[at:][order], (owner[at:] - len(left))[order]
    begins, ends = (np.searchsorted(posted, tokens[:at], side) for side in ("left", "right"))
    edges = np.searchsorted(owner[:at], np.arange(len(left) + 1))
    parent: dict[int, int] = {}
    most = config.most_bits()

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    numbers: dict[int, frozenset] = {}
    found: list[tuple[int, int]] = []
    for k, r in enumerate(left):
        spans = [holders[b:e] for b, e in zip(begins[edges[k] : edges[k + 1]].tolist(), ends[edges[k] : edges[k + 1]].tolist(), strict=True) if e > b]
        if not spans:
            continue
        near = np.unique(np.concatenate(spans))
        own = len(lefts[k])
        near = near[(components[near] != r.component) & (100 * np.minimum(sizes[near], own) >= config.percent * np.maximum(sizes[near], own))]
        if config.sketch_longs and len(near):
            near = near[np.bitwise_count(sketch[near] ^ np.array(r.sketch, np.int64).view(np.uint64)).sum(axis=1) <= most]
        if not len(near):
            continue
        same = bands[near] == np.array(r.bands, np.int64)
        near = near[bands[near, same.argmax(axis=1)] == key]
        members = None
        for i in near.tolist():
            x, y = root(r.component), root(right[i].component)
            if x == y:
                continue
            if members is None:
                members = numbers.setdefault(r.node, frozenset(lefts[k].tolist()))
            if right[i].node not in numbers:
                numbers[right[i].node] = frozenset(rights[i].tolist())
            both = len(members & numbers[right[i].node])
            if 100 * both >= config.percent * (own + sizes[i] - both):
                found.append((min(r.node, right[i].node), max(r.node, right[i].node)))
                parent[max(x, y)] = min(x, y)
    return found


def linked(nodes: DataFrame, fetched: Callable[[DataFrame], DataFrame], config: Config, name: str) -> DataFrame:
    """nodes(node long, n, bands array of keys, sketch array) -> (node, component) of the nodes that are linked with others.

    ``fetched`` gives (node, set: sorted 64-bit hashes, binary) for a table of nodes; a row that comes twice does no harm.
    """
    keys = nodes.select("node", F.explode("bands").alias("key"))
    centres = keys.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(keys.join(centres, "key").filter("node > a").select("key", "a", F.col("node").alias("b")), f"{name}-buckets")
    sets = written(fetched(shared.select(F.explode(F.array("a", "b")).alias("node")).distinct()), f"{name}-sets")
    pairs = shared.select("a", "b").distinct()
    if config.sketch_longs:
        longs = range(config.sketch_longs)
        side = lambda c, s: nodes.select(F.col("node").alias(c), *(F.col("sketch")[k].alias(f"{s}{k}") for k in longs))
        pairs = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").filter(_bits(config) <= config.most_bits()).select("a", "b")
    pairs = written(pairs, f"{name}-pairs")
    links = _verified(pairs, sets, config, f"{name}-links")
    labels = connected_components(links, f"{name}-components")
    more = _between_components(nodes, shared, labels, sets, config, name)
    if more is not None:
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), f"{name}-components")
    discard(shared, sets, pairs, links, more)
    return labels


class Repeats:
    """Which rows come again in a task. Rows of one key stand in few tasks after a join, so what is left over is as little."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def first(self, node: int, copies: int) -> bool:
        if copies == 1:
            return True
        before = len(self.seen)
        self.seen.add(node)
        return len(self.seen) > before


def _text_sets(items: DataFrame, wanted: DataFrame, config: Config) -> DataFrame:
    """node and its set for wanted(node, k1, k2, at, copies); rows that repeat both text and id give it once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Repeats()
        for batch in batches:
            nodes, sets = [], []
            for k, (node, copies) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if known.first(node, copies):
                    nodes.append(node)
                    sets.append(shingle_sets([batch.column(1)[k].as_py()], config.words)[0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return items.join(wanted, ["k1", "k2", "at"]).select("node", "text", "copies").mapInArrow(run, "node long, set binary")


def near_duplicates(items: DataFrame, config: Config, name: str) -> DataFrame:
    """items(k1, k2, at long, text binary) -> one row per distinct text that has words: k1, k2, n (size of its set), copies
    (rows), component (a number that all texts linked with it share). items is read twice."""
    found = _signatures(items, config)
    numbers = found.columns[4:]
    once = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("at").alias("at"), *(F.max(c).alias(c) for c in ("n", *numbers)))
    wide = lambda c: F.array(*(F.col(x) for x in numbers if x[0] == c)).alias({"b": "bands", "s": "sketch"}[c])
    nodes = written(once.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "at", "n", "copies", wide("b"), wide("s")), f"{name}-nodes")
    places = nodes.select("node", "k1", "k2", "at", "copies")
    labels = linked(nodes, lambda wanted: _text_sets(items, places.join(wanted, "node"), config), config, name)
    return nodes.select("k1", "k2", "n", "copies", "node").join(labels, "node", "left").select("k1", "k2", "n", "copies", F.coalesce("component", "node").alias("component"))


# documents


def _items(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*text_key(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("at"), F.col(text_col).cast("binary").alias("text"))


def near_duplicate_documents(docs: DataFrame, config: Config = Config(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept, for every row of docs.

    Null and empty texts and texts without words have an empty set and are linked with nothing. A null id is never a
    component_id unless all of its component are null; such rows are kept. Rows that repeat an id share what it reaches.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col))
    placed = rows.join(near_duplicates(_items(docs, id_col, text_col), config, "neardup"), ["k1", "k2"], "left")
    least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, config: Config = Config(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, without near-duplicates: one row of each component stays, that
    of the smallest id (the smallest hash of the text if several rows have it; null ids come last). Texts without words
    all stay."""
    found = near_duplicates(_items(docs, id_col, text_col), config, "neardup").select("k1", "k2", "component")
    # which rows stay is decided without the texts; they are shuffled once
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    ids = docs.select(F.col(id_col).cast("long").alias("id"), *text_key(text_col))
    first = ids.join(found, ["k1", "k2"]).groupBy("component").agg(F.min(order).alias("first")).select("first.k1", "first.k2", F.col("first.id").alias("first_id"))
    # the row itself is one column, so that no name of its own can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), *text_key(text_col), F.coalesce(F.length(F.btrim(F.col(text_col).cast("string"), F.lit(" \t\n\v\f\r"))) > 0, F.lit(False)).alias("words"))
    # a text may have several rows: those of the first id stay; of equal rows, one
    chosen = rows.filter("words").join(first, ["k1", "k2"]).filter(F.col("id").eqNullSafe(F.col("first_id"))).dropDuplicates(["k1", "k2"])
    return chosen.select("row.*").unionByName(rows.filter("not words").select("row.*"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    return near_duplicate_documents(table(spark, sf_dir, "documents"))


#: Links by counting common shingles of all pairs: for small tables.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
