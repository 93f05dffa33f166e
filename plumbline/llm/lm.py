"""A hashed maximum-entropy language model with a class-factored softmax.

Outcomes are the words of the training texts, the end of a text, and one for all unknown words. The most frequent words are
in classes of ``width`` words each, by rank; the others are in classes by a hash of their last three characters; words that
training met once or twice share the last class with the unknown, whose share of it is that of words met once (Good and
Turing's estimate). So P(word | context) = P(class | context) P(word | class, context), where the second factor is a softmax
over the class for frequent words. The class of a less frequent word is a tree of two levels of ``fan`` children, which two
more softmaxes choose from the context by digits of the word's hash; words that share a leaf divide it by their counts.
So all words met more than twice depend on the context, and all factors sum to one.

The softmaxes are maximum-entropy models over hashed features of the context: the last word, the two before it each on
their own (skips), and the last two together; less frequent words count as their class there, rare and unknown words as one
word, and texts begin with a mark. A constant for each class, word and node is set to its log frequency.

Weights have a fixed size (``buckets`` rows a table). They are trained in ``rounds``: each round takes its share of all
training texts, a task takes gradient steps with per-weight step sizes (AdaGrad) from the common weights over sparse numpy
batches, and what the tasks changed is averaged by row, weighted by how often each task met the row. All training texts take
part, once.

Words are interned by blocks (see ``blocks``): counts are found on the dictionary and come back to the texts by block, so
that no word is a hot key. The driver holds the frequent words (``top``), a number per leaf and the weights. What is known of
a word travels as one number, and tables are deleted as soon as the next one is written, so that the shared folder holds the
texts' symbols alone in the end.

Null texts are empty and have the end alone; a null id is not held out; repeated rows are texts of their own. Without
training texts every token is unknown: base 0 for each, N = V = 0. Empty tables give an empty result. Ties among frequent
words are broken by the word. Other columns don't matter. Scores may differ in their last digits, and by the order of
gradient steps, with the number of tasks; counts and the base score don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.blocks import WordBlock, byte_set, in_blocks, some_rows, split_rows, written_kinds
from plumbline.llm.common import discard, small_batches, table, written

GAPS = byte_set(b" \t\n\x0b\x0c\r")
KINDS = {"texts": "block long, doc_id long, held_out boolean, ids binary", "words": "block long, word_no int, word string, n long"}
TOKENS = "doc_id long, held_out boolean, share int, n_tokens long, n_known long, base_score double, rest double, symbols binary, codes binary"
#: Rows of weights that travel together.
SLICE = 512
_NONE = np.float32(-1e30)
LARGEST = np.float32(60)


@dataclass(frozen=True)
class Shape:
    top: int = 1024  # frequent words
    width: int = 32  # frequent words in a class
    tails: int = 31  # classes of other words
    fan: int = 32  # children of a node in the tree of such a class
    buckets: int = 1 << 13  # rows of each table of weights
    rounds: int = 4
    batch: int = 8192
    rate: float = 0.3
    start: float = 10.0  # squares that a weight begins with, so that little evidence moves it little

    @property
    def heads(self) -> int:
        return self.top // self.width

    @property
    def classes(self) -> int:
        return self.heads + self.tails + 1

    @property
    def leaves(self) -> int:
        return self.fan * self.fan

    @property
    def places(self) -> int:
        """Frequent words by rank, then the leaves of each class of others."""
        return self.top + self.tails * self.leaves

    @property
    def rare(self) -> int:
        return self.top + self.tails

    @property
    def begin(self) -> int:
        return self.rare + 2  # after the unknown


# words and counts


def word_blocks(docs: DataFrame, id_col: str, text_col: str, held_out: F.Column) -> dict[str, DataFrame]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in in_blocks(batches, 2):
            block, ids, out = WordBlock(GAPS, ends=True), [], []
            for batch, texts in own:
                ids.extend(batch.column(0).to_pylist())
                out.append(batch.column(1).to_numpy(zero_copy_only=False))
                block.add(texts, np.zeros(len(texts), np.int64))
            words, _, numbers, sizes = block.numbered()
            out = np.concatenate(out)
            counts = np.bincount(numbers[~np.repeat(out, sizes)], minlength=len(words))
            texts = pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids, pa.int64()), pa.array(out), split_rows(numbers.astype("<i4"), sizes)], names=["block", "doc_id", "held_out", "ids"])
            yield from some_rows(texts, 2000)
            yield from some_rows(pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)], names=["block", "word_no", "word", "n"]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return written_kinds(rows, make, KINDS, "lm")


@dataclass(frozen=True)
class Counts:
    """What the driver knows of the training words: sums, the frequent words by rank, how often each class was met."""

    n: int
    distinct: int
    once: tuple[int, int, int]  # words met once, twice, three times
    top: list[tuple[str, int]]
    tails: list[int]
    leaves: np.ndarray | None = None  # of each class's leaves in turn

    def rare_shares(self) -> tuple[float, float, float]:
        """Shares of the last class: all unknown words, one word met once, one met twice."""
        one, two, three = self.once
        parts = one + 1, 2 * (two + 1) if one else 0, 3 * (three + 1) if two else 0
        return parts[0] / sum(parts), parts[1] / sum(parts) / max(one, 1), parts[2] / sum(parts) / max(two, 1)


def _leaf(shape: Shape) -> F.Column:
    return F.pmod(F.xxhash64("word"), F.lit(shape.leaves)).cast("int").alias("leaf")


def counted(words: DataFrame, shape: Shape) -> tuple[DataFrame, Counts]:
    """The dictionary with each word's count c over all blocks, and its class among the less frequent."""
    same = Window.partitionBy("word")
    tail = F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(shape.tails)).cast("int")
    rows = words.select("block", "word_no", "word", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("block")) == 1).alias("first"))
    rows = written(rows.withColumn("tail", tail), "lm-words")  # not before the window, which would shuffle it
    first = rows.filter("first and c > 0")
    sums = first.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3))).first()
    top = [(r.word, r.c, r.tail, r.leaf) for r in first.filter("c > 2").orderBy(F.col("c").desc(), "word").limit(shape.top).select("word", "c", "tail", _leaf(shape)).collect()]
    leaves = np.zeros((shape.tails, shape.leaves), np.int64)
    found = first.filter("c > 2").groupBy("tail", _leaf(shape)).agg(F.sum("c").alias("c")).toArrow()  # tails * leaves rows at most
    leaves[found.column("tail").to_numpy(), found.column("leaf").to_numpy()] = found.column("c").to_numpy()
    for _, c, t, leaf in top:
        leaves[t, leaf] -= c
    return rows, Counts(sums.n or 0, sums.v, (sums.n1, sums.n2, sums.n3), [(w, c) for w, c, *_ in top], leaves.sum(axis=1).tolist(), leaves)


def symbols(kinds: dict[str, DataFrame], rows: DataFrame, counts: Counts, shape: Shape) -> DataFrame:
    """Of each text: its tokens as symbols (ranks of frequent words, classes of others), the leaves of its less frequent words,
    and the parts of its scores that no context decides: the base score, and the shares of words in their leaves."""
    ranks = rows.sparkSession.createDataFrame([(w, k) for k, (w, _) in enumerate(counts.top)], "word string, rank int")
    place = F.coalesce(F.col("rank"), shape.top + F.col("tail") * shape.leaves + F.col("leaf"))
    known = rows.join(F.broadcast(ranks), "word", "left").select("*", _leaf(shape)).select("block", "word_no", (F.col("c") * shape.places + place).alias("known"))  # ranks: at most shape.top rows
    total, shares, leaves = counts.n + counts.distinct + 1, counts.rare_shares(), np.maximum(counts.leaves, 1).astype(np.float64)
    rounds, top, rare = shape.rounds, shape.top, shape.rare

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        no = words.column("word_no").to_numpy()
        known = np.zeros(int(no.max(initial=-1)) + 1, np.int64)
        known[no] = words.column("known").to_numpy()
        c, symbol = np.divmod(known, shape.places)
        frequent = symbol < top
        tail, leaf = np.divmod(np.where(frequent, 0, symbol - top), shape.leaves)
        rest = np.log10(np.where(frequent, 1.0, np.where(c > 2, c / leaves[tail, leaf], np.where(c == 2, shares[2], np.where(c == 1, shares[1], shares[0])))))
        symbol = np.where(frequent, symbol, np.where(c > 2, top + tail, np.where(c > 0, rare, rare + 1))).astype("<i2")
        base, leaf, placed = np.log10((c + 1) / total), leaf.astype("<i2"), (symbol >= top) & (symbol < rare)
        out = [[] for _ in range(6)]
        for ids in texts.column("ids"):
            own = np.frombuffer(ids.as_buffer(), "<i4")
            for values, v in zip(out, (len(own), int(np.count_nonzero(c[own])), float(base[own].sum()), float(rest[own].sum()), symbol[own].tobytes(), leaf[own[placed[own]]].tobytes()), strict=True):
                values.append(v)
        share = pa.array(np.arange(len(texts), dtype=np.int32) % rounds)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
        return pa.table([texts.column("doc_id"), texts.column("held_out"), share, *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=[x.split()[0] for x in TOKENS.split(", ")])

    return written(kinds["texts"].groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, TOKENS), "lm-symbols")


# the model


class Model:
    """Weights of the four softmaxes; ``heads`` and ``members`` are the constants of classes and of frequent words, ``nodes``
    and ``leaves`` those of the two levels of the less frequent words' trees."""

    def __init__(self, shape: Shape, counts: Counts) -> None:
        self.shape = shape
        sizes = np.zeros(shape.classes)
        words = np.full((shape.heads, shape.width), _NONE, np.float32)
        for k, (_, c) in enumerate(counts.top):
            sizes[k // shape.width] += c
            words[k // shape.width, k % shape.width] = np.log(c)
        sizes[shape.heads : -1] = counts.tails
        sizes[-1] = counts.once[0] + 2 * counts.once[1] + 1
        self.heads = np.where(sizes > 0, np.log(np.maximum(sizes, 1) / max(sizes.sum(), 1)), _NONE).astype(np.float32)
        self.members = words - np.maximum(words.max(axis=1, keepdims=True, initial=0), 0)
        trees = np.ones((shape.tails, shape.fan, shape.fan)) if counts.leaves is None else counts.leaves.reshape(shape.tails, shape.fan, shape.fan)
        self.nodes, self.leaves = (self._shares(x.reshape(-1, shape.fan)) for x in (trees.sum(axis=2), trees))
        self.weights = [np.zeros((shape.buckets, n), np.float32) for n in (shape.classes, shape.width, shape.fan, shape.fan)]

    @staticmethod
    def _shares(sizes: np.ndarray) -> np.ndarray:
        """Logarithms of each row's numbers by its sum."""
        return np.where(sizes > 0, np.log(np.maximum(sizes, 1) / np.maximum(sizes.sum(axis=1, keepdims=True), 1)), _NONE).astype(np.float32)

    def classes_of(self, symbol: np.ndarray) -> np.ndarray:
        s = self.shape
        return np.where(symbol < s.top, symbol // s.width, np.minimum(symbol - s.top, s.tails) + s.heads)

    def features(self, symbol: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Four numbers for each token of some texts, from the tokens before it in its text."""
        seen = np.where(symbol > self.shape.rare, self.shape.rare, symbol).astype(np.int64)
        before = []
        for back in (1, 2, 3):
            moved = np.full(len(seen), self.shape.begin, np.int64)
            if len(seen) > back:
                moved[back:] = np.where(text[back:] == text[:-back], seen[:-back], self.shape.begin)
            before.append(moved)
        wide = np.int64(self.shape.begin + 1)
        return np.array([before[0], before[1] + wide, before[2] + 2 * wide, 3 * wide + before[0] * wide + before[1]])

    def rows(self, features: np.ndarray, classes: np.ndarray | None = None, many: int = 0) -> np.ndarray:
        """The weights' rows of features, together with one of ``many`` classes (``heads`` if not given) if there are any."""
        h = features.astype(np.uint64)
        if classes is not None:
            h = h * np.uint64(many or self.shape.heads) + classes.astype(np.uint64)
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(self.shape.buckets)
        return h.astype(np.uint16 if self.shape.buckets <= 1 << 16 else np.int64)  # short numbers are sorted by digits

    def softmax(self, which: int, rows: np.ndarray, constant: np.ndarray, bound: bool = False) -> np.ndarray:
        """Constants are logarithms of shares, so sums stay far from what a float can't hold, but for a bound, which is looked
        at again only where a total shows that it may be passed."""
        p = np.take(self.weights[which], rows[0], axis=0)
        for more in rows[1:]:
            p += np.take(self.weights[which], more, axis=0)
        p += constant
        if bound:
            np.minimum(p, LARGEST, out=p)
        with np.errstate(over="ignore"):
            np.exp(p, out=p)
            total = np.einsum("ij->i", p)
        if not bound and not total.max(initial=0) < np.exp(LARGEST):
            return self.softmax(which, rows, constant, bound=True)
        p *= np.float32(1) / total[:, None]
        return p

    def parts(self, symbol: np.ndarray, text: np.ndarray, codes: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Which softmax, the tokens it is asked for, their weights' rows, their outcomes, the probabilities of all outcomes:
        batch by batch."""
        features, classes = self.features(symbol, text), self.classes_of(symbol)
        s, in_tree = self.shape, np.flatnonzero((symbol >= self.shape.top) & (symbol < self.shape.rare))
        for at in range(0, len(symbol), self.shape.batch):
            here = slice(at, min(at + self.shape.batch, len(symbol)))
            token, f, c = np.arange(here.start, here.stop), features[:, here], classes[here]
            rows = self.rows(f)
            yield 0, token, rows, c, self.softmax(0, rows, self.heads)
            head = np.flatnonzero(symbol[here] < self.shape.top)
            if len(head):
                rows = self.rows(f[:, head], c[head])
                yield 1, token[head], rows, symbol[here][head] % self.shape.width, self.softmax(1, rows, self.members[c[head]])
            lo, hi = np.searchsorted(in_tree, (here.start, here.stop))
            if codes is not None and hi > lo:
                own = in_tree[lo:hi]
                tree, child, leaf = symbol[own] - s.top, codes[lo:hi] // s.fan, codes[lo:hi] % s.fan
                rows = self.rows(features[:, own], tree, s.tails)
                yield 2, own, rows, child, self.softmax(2, rows, self.nodes[tree])
                rows = self.rows(features[:, own], tree * s.fan + child, s.tails * s.fan)
                yield 3, own, rows, leaf, self.softmax(3, rows, self.leaves[tree * s.fan + child])

    def log10(self, symbol: np.ndarray, text: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """Of each token; without codes, the leaves of the less frequent words, of those words' classes."""
        out = np.zeros(len(symbol))
        for _, token, _, outcome, p in self.parts(symbol, text, codes):
            out[token] += np.log10(np.maximum(p[np.arange(len(p)), outcome], 1e-30))
        return out

    def train(self, symbol: np.ndarray, text: np.ndarray, squares: list[np.ndarray], met: list[np.ndarray], codes: np.ndarray | None = None) -> None:
        """Gradient steps over the tokens; squares: sums of squared gradients; met: tokens that met each row. A batch moves the
        weights of all kinds of features that its tokens have."""
        for which, _, rows, outcome, p in self.parts(symbol, text, codes):
            p[np.arange(len(p)), outcome] -= 1
            own, times, step = row_sums(p, rows)
            met[which][own] += times
            sums = np.take(squares[which], own, axis=0)
            sums += step * step
            squares[which][own] = sums
            sums += np.float32(self.shape.start)
            np.sqrt(sums, out=sums)
            step /= sums
            step *= np.float32(self.shape.rate)
            self.weights[which][own] -= step


#: So many tokens of each row are added at once, token by token; what frequent rows have beyond, row by row.
LAYERS = 32


def row_sums(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights' rows that tokens met, how often, and the sums of p over their tokens; rows: of each kind of feature, a token a
    column."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable") % len(p)
    times = np.bincount(flat)
    own = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]  # frequent ones first
    begin, times = (np.cumsum(times) - times)[own], times[own]
    out = np.take(p, order[begin], axis=0)
    for k in range(1, LAYERS):
        n = int(np.searchsorted(-times, -k))  # rows met more than k times
        out[:n] += np.take(p, order[begin[:n] + k], axis=0)
    for k in range(int(np.searchsorted(-times, -LAYERS))):
        out[k] += np.add.reduce(np.take(p, order[begin[k] + LAYERS : begin[k] + times[k]], axis=0), axis=0)
    return own, times, out


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a batch, and the text of each."""
    own = [np.frombuffer(x.as_buffer(), "<i2") for x in batch.column(column)]
    return np.concatenate([np.zeros(0, np.int16), *own]).astype(np.int64), np.repeat(np.arange(len(own)), [len(x) for x in own])


def _codes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The leaves of all less frequent words of a batch."""
    return np.concatenate([np.zeros(0, np.int16), *(np.frombuffer(x.as_buffer(), "<i2") for x in batch.column(column))]).astype(np.int64)


def trained(tokens: DataFrame, model: Model) -> Model:
    """Distributed gradient updates over all rows of tokens that aren't held out."""
    spark, shape = tokens.sparkSession, model.shape
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    for k in range(shape.rounds):
        now = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            import copy

            begin = now.value
            own = copy.copy(begin)
            own.weights = [w.copy() for w in begin.weights]
            squares, met = [np.zeros_like(w) for w in own.weights], [np.zeros(shape.buckets) for _ in own.weights]
            for batch in batches:
                own.train(*_texts(batch, 0), squares, met, _codes(batch, 1))
            for which in range(len(own.weights)):
                change = (own.weights[which] - begin.weights[which]) * met[which][:, None]
                for at in range(0, shape.buckets, SLICE):
                    n = met[which][at : at + SLICE]
                    if n.any():
                        yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([at], pa.int32()), pa.array([change[at : at + SLICE].astype("<f4").tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["which", "at", "change", "met"])

        def mean(rows: pa.Table) -> pa.Table:
            met = sum(np.frombuffer(x.as_buffer()) for x in rows.column("met"))
            change = sum(np.frombuffer(x.as_buffer(), "<f4").reshape(len(met), -1) for x in rows.column("change"))
            out = (change / np.maximum(met, 1)[:, None]).astype("<f4").tobytes()
            return pa.table([pa.array([rows.column("which")[0].as_py()], pa.int32()), pa.array([rows.column("at")[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["which", "at", "change"])

        part = tokens.filter(f"not held_out and share = {k}").select("symbols", "codes").coalesce(tasks)
        changes = part.mapInArrow(work, "which int, at int, change binary, met binary").groupBy("which", "at").applyInArrow(mean, "which int, at int, change binary")
        for r in changes.toArrow().to_pylist():  # the size of the weights, whatever the corpus
            own = model.weights[r["which"]][r["at"] : r["at"] + SLICE]
            own += np.frombuffer(r["change"], "<f4").reshape(own.shape)
    return model


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(tokens: DataFrame, model: Model, n: int) -> DataFrame:
    known = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol, text = _texts(batch, 5)
            score = np.bincount(text, known.value.log10(symbol, text, _codes(batch, 7)), len(batch)) + batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[2:4], pa.array(np.full(len(batch), n)), batch.column(6), pa.array(score)], names=[x.split()[0] for x in RESULT.split(", ")])

    return tokens.select("doc_id", "held_out", "n_tokens", "n_known", "rest", "symbols", "base_score", "codes").mapInArrow(run, RESULT)


def score_texts(docs: DataFrame, held_out: F.Column, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows that aren't held out and scores all: RESULT."""
    kinds = word_blocks(docs, id_col, text_col, held_out)
    rows, counts = counted(kinds["words"], shape)
    discard(kinds["words"])
    tokens = symbols(kinds, rows, counts, shape)
    discard(kinds["texts"], rows)
    return scored(tokens, trained(tokens, Model(shape, counts)), counts.n)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32 of the id as text leaves 2 when divided by 7."""
    small_batches(spark)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)
