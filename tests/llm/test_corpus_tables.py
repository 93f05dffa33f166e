"""Alignment, phrases and language model against plain versions over whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from conftest import SCHEMA, plain, prose

from plumbline.llm import alignment, lm, phrases


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def awkward(cases):
    """The shared cases and texts that tokenizers and splitters stumble over."""
    texts = ["<|endoftext|> a <s> <0x41> </s>", "  two  spaces   here ", " ", "\n\n a\n b \n", "a　b  c\x1cd \x85e", "a▁b c", "▁", "a ▁", "\x00 \x01a", "naïve café—dash … “q” don't I'll 'S", "日本語 テキスト 🙂🙂 👩‍👩‍👧", "x" * 3000, " " * 500 + "y", "é ﬁ", "a. b, a. b; a b a b\ta b!\ra\x0bb"]
    return cases + [plain(100 + k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def awkward_docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


# 11


def plain_alignment(rows, path_a, path_b):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    chars = sorted(ByteLevel.alphabet())
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in kept} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in kept)}
    assert sorted(byte_of) == chars
    held = []
    for doc_id, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        want = (" " + (text or "")).encode()
        if not text or b"".join(ba) != want or b"".join(bb) != want:
            held.append((doc_id, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links = [(i, j) for i in range(len(ia)) for j in range(len(ib)) if max(ea[i] - len(ba[i]), eb[j] - len(bb[j])) < min(ea[i], eb[j])] if len(ia) < 1000 else None
        if links is None:  # the same by a merge, for long texts
            i = j = 0
            links = []
            while i < len(ia) and j < len(ib):
                links.append((i, j))
                x, y = ea[i], eb[j]
                i, j = i + (x <= y), j + (y <= x)
        at_a, at_b = {x: k + 1 for k, x in enumerate(ea)}, {x: k + 1 for k, x in enumerate(eb)}
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = at_a[end], at_b[end]
            groups.append(",".join(map(str, ia[i:p])) + "|" + ",".join(map(str, ib[j:q])))
            i, j = p, q
        held.append((doc_id, ia, ib, groups, [(ia[i], ib[j]) for i, j in links]))
    count = Counter(pair for *_, links in held for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((d, len(ia), len(ib), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if ia else "") for d, ia, ib, g, links in held), key=str
    )


def test_alignment(awkward_docs, awkward, no_docs):
    P = pytest.importorskip("public_tokenizers")
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    got = alignment.align(awkward_docs, *paths)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(got, *columns) == plain_alignment([(r[0], r[1]) for r in awkward], *paths)
    assert alignment.align(no_docs, *paths).count() == 0


def test_chunks_are_parted_by_both_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    a, b, _ = alignment._tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice("ab  \n\t.,'s1é▁ 日") for _ in range(r.randint(1, 40)))
        chunks = alignment.chunks_of(text)
        assert " ".join(chunks) == text
        assert [i for c in chunks for i in a.encode(" " + c, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for c in chunks for i in b.encode(c)] == b.encode(text)


# 12


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) == 1 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        if len(g) == 2 and any(h[0] == lang and len(h[1]) == 3 and g in (h[1][:2], h[1][1:]) and b >= least and 100 * b >= 50 * a for h, b in f.items()):
            continue
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted(((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])), key=str)


PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "top"), [(2, 10_000), (3, 20), (10, 2000)])
def test_phrases(spark, awkward, no_docs, least, top):
    r = random.Random(9)
    few = [plain(k, " ".join(r.choice("abcd") + r.choice(["", "", ".", "  "]) for _ in range(r.randint(0, 60))), r.choice(["x", "y", None, "und", ""])) for k in range(120)]
    kept = [c for c in awkward if len(c[1] or "") < 20_000] + few
    docs = spark.createDataFrame(kept, SCHEMA).repartition(5)
    assert result(phrases.mine_phrases(docs, least, top), *PHRASE_COLUMNS) == plain_phrases([(c[2], c[1]) for c in kept], least, top)
    assert phrases.mine_phrases(no_docs, least, top).count() == 0


def test_phrases_do_not_depend_on_ranges_and_the_filter(spark):
    r = random.Random(10)
    rows = [plain(k, " ".join(r.choices("abcdefgh", range(8, 0, -1), k=200))) for k in range(60)]
    got = phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA), 10, 500, in_range=500, filter_bits=64)  # nearly everything passes
    assert result(got, *PHRASE_COLUMNS) == plain_phrases([(c[2], c[1]) for c in rows], 10, 500)


def test_scores_of_counts_whose_products_pass_64_bits(spark):
    words = spark.createDataFrame([("x", "u", 5 * 10**12, 0), ("x", "v", 4 * 10**12, 7 * 10**12)], "lang string, word string, f long, g long")
    pairs = spark.createDataFrame([(0, 7 * 10**12, 3 * 10**12 + 1)], "g1 long, g2 long, n long")
    triples = spark.createDataFrame([], "g1 long, g2 long, g3 long, n long")
    got = phrases.scored(words, pairs, triples).first()
    assert (got.phrase, got.score) == ("u v", 10**6 * (3 * 10**12 + 1) ** 2 // (20 * 10**24))


# 13


def learns_not(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_words(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), b""]


SMALL = lm.Shape(top=8, width=4, tails=3, buckets=64, rounds=2, batch=50)


def held(F):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def test_base_scores_and_counts(awkward_docs, awkward, no_docs):
    from pyspark.sql import functions as F

    c = Counter(w for r in awkward if not learns_not(r[0]) for w in plain_words(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], learns_not(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for r in awkward for w in [plain_words(r[1])]), key=str)
    got = lm.score_texts(awkward_docs, held(F), SMALL)
    assert result(got.withColumn("base_score", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert got.filter("score is null or isnan(score) or score > 0").isEmpty()
    assert lm.score_texts(no_docs, held(F), SMALL).isEmpty()


def test_tables_that_nothing_reads_any_more_are_deleted(awkward_docs, spark):
    from pathlib import Path

    from pyspark.sql import functions as F

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.rglob("*.parquet"))
    got = lm.score_texts(awkward_docs, held(F), SMALL)
    left = {p.relative_to(folder).parts[0] for p in set(folder.rglob("*.parquet")) - before}
    assert len(left) == 1 and left.pop().startswith("lm-symbols-")
    assert got.count() == awkward_docs.count()


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    got = lm.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True), SMALL).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def test_probabilities_of_all_outcomes_sum_to_one(spark):
    r = random.Random(5)
    rows = [(k, " ".join("".join(r.choices("abc", (6, 2, 1), k=r.randint(1, 5))) for _ in range(30))) for k in range(20)]
    from pyspark.sql import functions as F

    kinds = lm.word_blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.lit(False))
    words, counts = lm.counted(kinds["words"], SMALL)
    model = lm.Model(SMALL, counts)
    rng = np.random.default_rng(1)
    model.weights = [rng.normal(size=w.shape).astype(np.float32) for w in model.weights]
    # each outcome's symbol and its share of a class
    shares, ranks = counts.rare_shares(), {w: k for k, (w, _) in enumerate(counts.top)}
    outcomes = [(SMALL.rare + 1, shares[0])]
    for w in words.filter("first and c > 0").collect():
        if w.word in ranks:
            outcomes.append((ranks[w.word], 1.0))
        else:
            outcomes.append((SMALL.top + w.tail, w.c / counts.tails[w.tail]) if w.c > 2 else (SMALL.rare, shares[w.c]))
    assert len(outcomes) > 60
    for context in ([], [0], [3, 9], [1, 2, SMALL.rare], [SMALL.rare + 1, 5, 5, 2]):
        runs = [np.array([*context, s]) for s, _ in outcomes]
        text = np.repeat(np.arange(len(runs)), len(context) + 1)
        last = model.log10(np.concatenate(runs), text)[len(context) :: len(context) + 1]
        assert sum(10**x * share for x, (_, share) in zip(last, outcomes, strict=True)) == pytest.approx(1, abs=1e-4)


def test_gradients_are_those_of_the_log_probability(spark):
    WIDE = replace(SMALL, buckets=1 << 15)  # no two features in one row
    counts = lm.Counts(100, 20, (4, 3, 2), [(str(k), 20 - k) for k in range(8)], [5, 6, 7])
    rng = np.random.default_rng(2)
    model = lm.Model(WIDE, counts)
    model.weights = [rng.normal(size=w.shape).astype(np.float32) * 0.3 for w in model.weights]
    symbol, text = rng.integers(0, WIDE.rare + 1, 40), np.repeat([0, 1], 20)
    before, start = model.log10(symbol, text).sum(), [w.copy() for w in model.weights]
    squares, met = [np.zeros_like(w) for w in model.weights], [np.zeros(WIDE.buckets) for _ in model.weights]
    model.train(symbol, text, squares, met)
    for which in (0, 1):
        row = int(met[which].argmax())
        gradient = -np.sqrt(squares[which][row]) * np.sign(model.weights[which][row] - start[which][row]) * -1
        for column in range(gradient.size):
            probe = lm.Model(WIDE, counts)
            probe.weights = [w.astype(np.float64) for w in start]
            probe.weights[which][row, column] += 1e-4
            assert (probe.log10(symbol, text).sum() - before) / 1e-4 == pytest.approx(math.log10(math.e) * gradient[column], abs=0.02)


def test_a_batch_moves_all_kinds_of_features():
    shape = replace(SMALL, buckets=1 << 15)
    model = lm.Model(shape, lm.Counts(100, 20, (4, 3, 2), [(str(k), 20 - k) for k in range(8)], [5, 6, 7]))
    rng = np.random.default_rng(3)
    symbol, text = rng.integers(0, shape.rare + 1, shape.batch), np.repeat([0, 1], shape.batch // 2)
    model.train(symbol, text, [np.zeros_like(w) for w in model.weights], [np.zeros(shape.buckets) for _ in model.weights])
    for which, (features, *classes) in enumerate(((model.features(symbol, text),), (model.features(symbol, text)[:, symbol < shape.top], symbol[symbol < shape.top] // shape.width))):
        for kind in model.rows(features, *classes):
            assert np.abs(model.weights[which][kind]).max(axis=1).min() > 0


def test_sums_of_rows():
    rng = np.random.default_rng(4)
    for n, many in ((1, 5), (300, 7), (300, 1 << 14)):
        p, rows = rng.normal(size=(n, 3)).astype(np.float32), rng.integers(0, many, (4, n)).astype(np.uint16)
        rows[0, : n // 2] = 2
        want, met = np.zeros((many, 3)), np.bincount(rows.ravel(), minlength=many)
        for kind in rows:
            np.add.at(want, kind, p)
        own, times, got = lm.row_sums(p, rows)
        assert sorted(own) == np.flatnonzero(met).tolist() and times.tolist() == met[own].tolist()
        assert np.allclose(got, want[own], atol=1e-4)


def test_sums_beyond_what_a_float_holds_are_bounded():
    model = lm.Model(SMALL, lm.Counts(100, 20, (4, 3, 2), [(str(k), 20 - k) for k in range(8)], [5, 6, 7]))
    model.weights[0][3] = [70, 50, 200, 0, 0, 0]
    rows = np.array([[3, 4], [3, 3]])  # sums of 400 and of 200
    sums = np.minimum(model.weights[0][rows].astype(float).sum(axis=0) + model.heads, 60)
    want = np.exp(sums - sums.max(axis=1, keepdims=True))
    assert np.allclose(model.softmax(0, rows, model.heads), want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_context_helps_on_held_out_texts(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    follow = {w: r.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def text():
        words = [r.choice("abcdefghijklmnop")]
        for _ in range(60):
            words.append(r.choice(follow[words[-1]]))
        return " ".join(words)

    rows = [(k, text()) for k in range(400)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), held(F), lm.Shape(top=32, width=8, tails=2, buckets=1024, batch=256)).filter("held_out")
    sums = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert sums.s / sums.n > -0.45 and sums.s > sums.b + 0.5 * sums.n  # a choice of two is 0.3


def test_less_frequent_words_depend_on_the_context(spark):
    """Words beyond the frequent ones: probabilities of all sum to one in each context, and the context decides among them."""
    from pyspark.sql import functions as F

    r = random.Random(7)
    pairs = [(f"k{k}", f"w{k}ing") for k in range(12)]  # all second words end alike: one class
    rows = [(k, " ".join([first for first, _ in pairs] + [w for _ in range(30) for w in r.choice(pairs)])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shape = lm.Shape(top=12, width=12, tails=3, fan=8, buckets=1024, batch=256)  # the first words
    kinds = lm.word_blocks(docs, "doc_id", "text", held(F))
    words, counts = lm.counted(kinds["words"], shape)
    tokens = lm.symbols(kinds, words, counts, shape)
    model = lm.trained(tokens, lm.Model(shape, counts))
    outcomes, ranks = [(shape.rare + 1, 0, counts.rare_shares()[0])], {w: k for k, (w, _) in enumerate(counts.top)}
    for w in words.filter("first and c > 0").select("*", lm._leaf(shape)).collect():
        assert w.c > 2
        outcomes.append((ranks[w.word], 0, 1.0) if w.word in ranks else (shape.top + w.tail, w.leaf, w.c / counts.leaves[w.tail, w.leaf]))
    outcomes.append((shape.rare, 0, 0.0))
    for context in ([], [1], [3, 9]):
        symbols = np.concatenate([[*context, s] for s, *_ in outcomes])
        codes = np.array([c for s, c, _ in outcomes if shape.top <= s < shape.rare])
        last = model.log10(symbols, np.repeat(np.arange(len(outcomes)), len(context) + 1), codes)[len(context) :: len(context) + 1]
        assert sum(10**x * share for x, (*_, share) in zip(last, outcomes, strict=True)) == pytest.approx(1, abs=1e-4)
    assert sorted(ranks) == sorted(first for first, _ in pairs)
    sums = lm.scored(tokens, model, counts.n).filter("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert sums.s / sums.n > -0.7  # 30 choices of twelve in 73 tokens are 0.44; with another 30 inside of the class 0.89
