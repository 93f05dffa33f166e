"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

1. Shallow boosted trees are fitted to the labelled rows; every path from a root to a node is a conjunction of
   conditions ``statistic <= bound`` or ``statistic > bound``: a rule.
2. A logistic regression with an L1 penalty over the rules (lasso, by proximal gradient) leaves the few that matter.
3. The surviving rules and their weights become one column expression over the statistics; scoring is a projection.

The fit uses at most ``max_rows`` labelled rows, those of the smallest hashes of the id (a documented bound, the same at
every size); only their statistics come to the driver. Scoring reads every whole text, once, without a shuffle.

Null and empty texts have the statistics of an empty text and get a score as any other. Labels of null ids or null
quality are not used; a document with several labels counts as good if at least half of them say so. Without any label,
or with labels of one kind, the score is the smoothed share of good labels (0.5 without labels).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = (
    "log_bytes", "log_words", "bytes_a_word", "longest_word", "distinct_words", "distinct_pairs", "top_word", "upper", "digits", "symbols", "stops", "commas", "marks", "pipes", "non_ascii", "words_a_line", "repeated_lines", "capital_words",
)
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#$%&*+/<=>@^_~\\{}[]"
ASCII = bytes(range(128))
KEEP_FROM = 0.3


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The values of STATISTICS for one text (UTF-8)."""
    t = text or b""
    words = t.split()
    lines = t.split(b"\n")
    n, nw = max(1, len(t)), max(1, len(words))
    counts = Counter(words)
    share = lambda chars: (len(t) - len(t.translate(None, chars))) / n
    return (
        float(np.log1p(len(t))), float(np.log1p(len(words))), len(t) / nw, float(max(map(len, counts), default=0)), len(counts) / nw, len(set(zip(words, words[1:], strict=False))) / nw,
        max(counts.values(), default=0) / nw, share(UPPER), share(DIGITS), share(SYMBOLS), t.count(b".") / nw, t.count(b",") / nw, t.count(b"!") / nw, t.count(b"|") / nw,
        len(t.translate(None, ASCII)) / n, len(words) / len(lines), 1 - len(set(lines)) / len(lines), sum(w[:1].isupper() for w in words) / nw,
    )


STATISTICS_TYPE = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])


def _statistics(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))


def text_statistics(text: Column) -> Column:
    """A struct of STATISTICS."""
    return F.arrow_udf(_statistics, STATISTICS_TYPE)(text.cast("binary"))


# fitting

Condition = tuple[int, bool, float]  # statistic, above the bound, bound


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, statistics: Column) -> Column:
        """The rules as a column expression over the struct of statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, above, bound in conditions:
                holds = holds & ((statistics[STATISTICS[k]] > bound) if above else (statistics[STATISTICS[k]] <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in conditions:
        out &= (x[:, k] > bound) if above else (x[:, k] <= bound)
    return out


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> list[tuple[tuple[Condition, ...], float]]:
    """Paths to all nodes below the root of one tree, each with the step of its node."""
    paths: list[tuple[tuple[Condition, ...], float]] = []
    leaves = [((), np.arange(len(x)))]
    for _ in range(depth):
        grown = []
        for path, rows in leaves:
            best = (1e-6, None)
            g, h = gradient[rows], hessian[rows]
            base = g.sum() ** 2 / (h.sum() + 1)
            for k, edge in enumerate(edges):
                if not len(edge):
                    continue
                size = len(edge) + 1
                own = bins[rows, k]
                gs, hs, ns = np.cumsum(np.bincount(own, g, size))[:-1], np.cumsum(np.bincount(own, h, size))[:-1], np.cumsum(np.bincount(own, minlength=size))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, float(edge[at])))
            if best[1] is None:
                continue
            k, bound = best[1]
            above = x[rows, k] > bound
            for side in (False, True):
                part = rows[above == side]
                node = (*path, (k, side, bound))
                paths.append((node, float(gradient[part].sum() / (hessian[part].sum() + 1))))
                grown.append((node, part))
        leaves = grown
    return paths


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 0.0015, steps: int = 300) -> RuleModel:
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1], method="higher")) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], "left").astype(np.uint8) for k, e in enumerate(edges)], axis=1)  # 62 edges at most
    margin = np.full(len(y), np.log(prior / (1 - prior)))
    rules: dict[tuple[Condition, ...], None] = {}
    least = max(5, len(y) // 1000)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths = _grow(x, bins, edges, y - p, p * (1 - p), depth, least)
        full = max((len(c) for c, _ in paths), default=0)
        ends = {c for c, _ in paths} - {c[:-1] for c, _ in paths}
        for conditions, step in paths:
            rules[conditions] = None
            if conditions in ends and full:
                margin += rate * step * _holds(x, conditions)
    # the lasso: proximal gradient with momentum over the rules, scaled to a common spread
    seen: dict[bytes, tuple[Condition, ...]] = {}  # of rules that hold for the same rows, the shortest
    for c in sorted(rules, key=len):
        seen.setdefault(hashlib.sha256(np.packbits(_holds(x, c)).tobytes()).digest(), c)
    names = list(seen.values())
    z = np.empty((len(y), len(names)), np.float32)
    for k, c in enumerate(names):
        z[:, k] = _holds(x, c)
    mean = z.mean(axis=0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    z -= mean
    z /= spread
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(z @ v) ** 2) / len(y) + 1e-6)
    w = np.zeros(z.shape[1], np.float32)
    ahead, t, bias = w.copy(), 1.0, float(np.log(prior / (1 - prior)))
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(z @ ahead + bias, -30, 30))) - y
        new = ahead - step * (z.T @ e.astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias -= 2.0 * float(e.mean())
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - w)
        w = new
    w = w / spread
    kept = [(c, float(k)) for c, k in zip(names, w, strict=True) if abs(k) > 1e-4]
    return RuleModel(float(bias - mean @ w), kept)


# Spark jobs


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Fits on at most max_rows labelled rows for which train holds (by default: all that are not held out)."""
    ids = F.col(id_col).cast("long")
    train = ~held_out(F.col("_id")) if train is None else train
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(ids.alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    # twice as many labels as rows: labels may name documents that are not there
    picked = own.filter(train).orderBy(F.xxhash64("_id"), "_id").limit(2 * max_rows)
    rows = docs.select(ids.alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # at most 2 * max_rows pairs of numbers
    measured = rows.select("_id", "_label", text_statistics(F.col("_text")).alias("s")).select("_id", "_label", "s.*")
    rows = measured.orderBy(F.xxhash64("_id"), *measured.columns).limit(max_rows).toArrow()
    columns = [rows[s].to_numpy() for s in STATISTICS]
    return fit_rules(np.stack(columns, axis=1), rows["_label"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns of docs, whatever their names, and the score (in place of a column of that name)."""
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    measured = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text_statistics(F.col(text_col)).alias("statistics"))
    return measured.select("row.*", model.score(F.col("statistics")).alias(score_col))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
