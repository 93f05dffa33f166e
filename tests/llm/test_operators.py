"""Each operator against a plain version, on rows with every awkward case; and on empty tables."""

import hashlib
import random
import re

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import audio, decontam, html, mixing, neardup, paragraphs, pii, quality, substrings, tokens


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# plain versions


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(sets, percent=75):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    return [root(k) for k in range(len(sets))]


def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for t in raw:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] += 1
    out = []
    for t in raw:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


# 1


@pytest.mark.parametrize("least_words", [1, 20])
def test_paragraphs(docs, no_docs, cases, least_words):
    units = paragraphs.Units(least_words=least_words)
    found = paragraphs.paragraph_dedup(docs, units).cache()
    lines = [(c[0], k, line) for c in cases for k, line in enumerate((c[1] or "").split("\n")) if len(line.encode().split()) >= least_words]
    of = classes([shingle_set(line) for _, _, line in lines])
    size = defaultdict(int)
    for c in of:
        size[c] += 1
    want = sorted(((u[0], u[1]) for u, c in zip(lines, of, strict=True) if size[c] > 1), key=str)
    assert result(found.filter("unit = 'paragraph'"), "doc_id", "start") == want
    by_class = defaultdict(set)
    for u, c in zip(lines, of, strict=True):
        by_class[c].add((u[0], u[1]))
    by_component = defaultdict(set)
    for r in found.filter("unit = 'paragraph'").collect():
        by_component[r.component].add((r.doc_id, r.start))
    assert sorted(map(sorted_places, by_component.values())) == sorted(sorted_places(v) for c, v in by_class.items() if size[c] > 1)
    for unit in ("paragraph", "passage"):
        own = found.filter(F.col("unit") == unit)
        assert own.filter("kept").select("component").distinct().count() == own.select("component").distinct().count() > 0
    passage = {r.doc_id for r in found.filter("unit = 'passage'").collect()}
    assert {11, 12, 1, 2, 13, 15, None} <= passage and not passage & {4, 5, 6, 7, 14, 17, 20}
    assert paragraphs.paragraph_dedup(no_docs, units).count() == 0


def sorted_places(places):
    return sorted(map(str, places))


def test_passages_anywhere(spark):
    """Passages of fifty words or more are found in both texts; what is found is similar; nothing else is."""
    r = random.Random(5)
    prose = lambda r, n: " ".join(str(r.randrange(5000)) for _ in range(n))
    texts, planted = [], []
    for n in (*range(50, 81), 200) * 4:
        passage = prose(r, n)
        for _ in range(2):
            before = r.randint(0, 70)
            sep = r.choice([" ", "\n", " \t"])
            texts.append(f"{prose(r, before)}{sep}{passage.replace(' ', r.choice([' ', '  ']), 9)}{sep}{prose(r, r.randint(0, 70))}".strip())
            planted.append((before, before + n))
    alone = range(len(texts), len(texts) + 60)
    texts += [prose(r, r.randint(1, 200)) for _ in alone]
    texts += [" ".join([*texts[0].split()[planted[0][0] :][:20], *prose(r, 40).split()])]  # twenty words are too few
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = paragraphs.paragraph_dedup(df, paragraphs.Units(least_words=10**6)).collect()
    of_component = defaultdict(list)
    for u in found:
        of_component[u.component].append(u)
    inside = defaultdict(set)
    for u in found:
        if u.doc_id < len(planted) and planted[u.doc_id][0] <= u.start and u.end <= planted[u.doc_id][1]:
            inside[u.doc_id].add(u.component)
    assert all(inside[k] & inside[k + 1] for k in range(0, len(planted), 2))
    assert not {u.doc_id for u in found} & {*alone, len(texts) - 1}
    words = [t.split() for t in texts]
    for own in of_component.values():
        assert len(own) > 1 and [(u.doc_id, u.start) for u in own if u.kept] == [min((u.doc_id, u.start) for u in own)]
        assert len(set(classes([shingle_set(" ".join(words[u.doc_id][u.start : u.end])) for u in own]))) == 1


def test_stretches_of_long_texts(monkeypatch):
    """Every window of run_words has a stretch, also where a long text is cut."""
    r = random.Random(6)
    for n in (50, 51, 64, 129, 300, 701):
        text = b" ".join(b"%d" % r.randrange(10**6) for _ in range(n))
        seen = []
        for chunk in (100_000, 60):
            monkeypatch.setattr(paragraphs, "CHUNK_WORDS", chunk)
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([False]), pa.array([text])], names=["doc", "t", "no_id", "text"])
            rows = [x for b in paragraphs._unit_rows(iter([batch]), paragraphs.Units(least_words=10**6)) for x in b.to_pylist()]
            seen.append({(x["at"], x["k1"], x["k2"]) for x in rows})
            starts = sorted(x["at"] for x in rows)
            assert all(any(k <= s and s + paragraphs.STRETCH <= k + 50 for s in starts) for k in range(n - 49))
        assert seen[0] == seen[1]


def test_word_hashes(monkeypatch):
    from plumbline.llm import words

    r = random.Random(4)
    texts = ["".join(r.choice("aAbB \n\t\x0bé\u00a0.") for _ in range(r.randint(0, 60))).encode() for _ in range(300)]
    for piece in (1 << 19, 64, 5):
        monkeypatch.setattr(words, "PIECE", piece)
        h, counts, ends = words.text_words(texts)
        split = [t.lower().split() for t in texts]
        assert counts.tolist() == [len(w) for w in split]
        flat = [w for ws in split for w in ws]
        of = dict(zip(flat, h.tolist(), strict=True))
        assert [of[w] for w in flat] == h.tolist() and len(set(of.values())) == len(of)
        assert np.diff(ends, prepend=0).tolist() == [len(line.split()) for t in texts for line in t.split(b"\n")]
    assert [len(x) for x in words.text_words([])] == [0, 0, 0] and words.text_words([b"", b" "])[1].tolist() == [0, 0]


# 2


@pytest.mark.parametrize("most", [50_000, 2])
def test_repeated_substrings(docs, cases, most):
    want = sorted(((c[0], hashlib.sha256(k).hexdigest()) for c, k in zip(cases, without_repeats([c[1] for c in cases], 200), strict=True)), key=str)
    out = substrings.remove_repeats(docs, most=most).cache()
    assert result(out, "doc_id", F.sha2("kept", 256)) == want
    assert out.filter("doc_id = 7").select("n_bytes", F.size("removed")).collect()[0] == (7, 0)


def test_repeated_substrings_at_random(spark):
    r = random.Random(8)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(40, 300))) for _ in range(12)]
    texts = ["".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice("ab") for _ in range(60)) for _ in range(r.randint(1, 6))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (50_000, 3):
        got = [r.kept for r in substrings.remove_repeats(df, length=80, most=most).orderBy("doc_id").collect()]
        assert [bytes(x) for x in got] == without_repeats(texts, 80)


def test_anchors_of_texts_of_many_chunks(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    monkeypatch.setattr(substrings, "PLACE", np.uint64(2**14 - 1))
    r = random.Random(9)
    texts = [r.randbytes(n) for n in (300, 40_000, 199, 0, 8_500, 700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["k1", "k2", "text"])
    rows = [x for b in substrings._emit(iter([batch]), 200) for x in b.to_pylist()]
    assert sorted((x["k1"], k) for x in rows for k in range(x["first"], x["last"] + 1)) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 199)]
    grams = [substrings.gram_hashes(np.frombuffer(t, np.uint8), (32,))[0].view(np.int64) if len(t) > 31 else [] for t in texts]
    assert all(x["last"] <= x["at"] <= x["first"] + 168 and grams[x["k1"]][x["at"]] == x["h"] for x in rows)


def test_no_repeats_in_nothing(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


def plain_groups(texts, length):
    """Maximal repeats: string -> places, for strings of length or more whose occurrences differ on both sides."""
    where = defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for e in range(a + length, len(t) + 1):
                where[t[a:e]].append((i, a))
    out = {}
    for x, places in where.items():
        side = lambda k, x=x: {(texts[i][a - 1 : a] or (i, a)) if k else (texts[i][a + len(x) : a + len(x) + 1] or (i, a)) for i, a in places}
        if len(places) > 1 and len(side(0)) > 1 and len(side(1)) > 1:
            out[x] = sorted(places)
    return out


def test_maximal_repeats_of_an_anchor():
    r = random.Random(7)
    for _ in range(300):
        n = r.randint(2, 12)
        anchor = b"|##|"
        pairs = sorted({("".join(r.choice("ab") for _ in range(r.randint(0, 5))), "".join(r.choice("ab") for _ in range(r.randint(0, 5)))) for _ in range(n)})
        texts = [a.encode()[::-1] + anchor + b.encode() for a, b in pairs]
        keys = sorted((anchor + b.encode(), a.encode()) for a, b in pairs)
        extents, groups = substrings.repeats([k[1] for k in keys], [k[0] for k in keys], 6)
        got = {k[1][:left][::-1] + k[0][:right]: sorted(m) for left, right, x, m in groups for k in [keys[x]]}
        of = {keys[k]: k for k in range(len(keys))}
        back = [of[t[t.index(b"|") :], t[: t.index(b"|")][::-1]] for t in texts]
        want = {x: sorted(back[i] for i, _ in p) for x, p in plain_groups(texts, 6).items() if anchor in x}
        assert got == want
        for k, own in enumerate(extents):  # those that no longer one of the occurrence contains
            mine = [(x.index(anchor), len(x) - x.index(anchor)) for x, m in want.items() if k in m]
            assert {e for e in own} == {e for e in mine if not any(f != e and f[0] >= e[0] and f[1] >= e[1] for f in mine)}


def test_large_groups_of_repeats_are_quick():
    """Nested texts: each shares one byte more with the next, on both sides."""
    import time

    n = 20_000
    keys = sorted((b"#" * 32 + b"a" * (k % 150) + b"b" * (k // 150), b"c" * (k * 7 % 167)) for k in range(n))
    began = time.time()
    extents, _ = substrings.repeats([k[1] for k in keys], [k[0] for k in keys], 100, False)
    assert sum(map(len, extents)) >= n // 2 and time.time() - began < 30


def test_repeat_groups(spark):
    r = random.Random(3)
    passage, other = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (90, 120))
    prose = lambda n: "".join(r.choice("ijklmnop") for _ in range(n))
    texts = [prose(30) + passage + prose(9), passage + prose(40), prose(5) + other + prose(7) + passage[:80], other, prose(300)]
    rows = spark.createDataFrame([(i, 0, bytearray(t.encode())) for i, t in enumerate(texts)], "k1 long, k2 long, text binary")
    found = defaultdict(set)
    for x in substrings.repeat_groups(rows, 60).collect():
        assert x.length == x.end - x.start
        found[x.id].add((texts[x.k1][x.start : x.end], x.k1, x.start))
    assert all(len({t for t, *_ in g}) == 1 and len(g) > 1 for g in found.values())
    covered = {(i, k) for g in found.values() for t, i, a in g for k in range(a, a + len(t))}
    gone = without_repeats(texts, 60)
    assert all(len(t) - len([1 for i, _ in covered if i == n]) == len(gone[n]) for n, t in enumerate(texts))
    for g in found.values():  # all places of its string
        t = next(iter(g))[0]
        assert {(i, a) for _, i, a in g} == {(i, a) for i, x in enumerate(texts) for a in range(len(x)) if x.startswith(t, a)}


def test_many_equal_rows_and_periodic_texts(spark):
    r = random.Random(12)
    same, period = "".join(r.choice("abcdef") for _ in range(2000)), "xyz" * 400
    texts = [(None, same)] * 2000 + [(None, "short")] * 50 + [(5, same[500:900] + "!"), (6, period), (7, period[:1000] + "q"), (8, "a" * 3000), (8, "a" * 3000), (9, "only here " * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = substrings.remove_repeats(df).groupBy("doc_id", "n_bytes", F.col("kept").cast("string")).count().collect()
    assert {tuple(x) for x in got} == {(None, 2000, "", 2000), (None, 5, "short", 50), (5, 401, "!", 1), (6, 1200, "", 1), (7, 1001, "q", 1), (8, 3000, "", 2), (9, 30, "only here " * 3, 1)}


def test_repeats_in_a_text_of_many_megabytes(spark):
    r = random.Random(13)
    passage, far = r.randbytes(400).hex()[:400], r.randbytes(300).hex()[:300]
    body = np.random.default_rng(1).integers(97, 123, 20_000_000, np.uint8).tobytes().decode()
    big = body[:17_500_000] + passage + body[17_500_000:18_500_000] + far + body[18_500_000:] + far
    df = spark.createDataFrame([(1, big), (2, "x" + passage + "y")], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.removed] for x in substrings.remove_repeats(df).select("doc_id", "removed").collect()}
    second = 18_500_400
    assert got == {1: [(17_500_000, 17_500_400), (second, second + 300), (len(big) - 300, len(big))], 2: [(1, 401)]}


# 3


def test_quality_of_unseen(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)) for _ in range(8))
    bad = [lambda: "The " * r.randint(20, 90), lambda: " ".join(word().upper() + "!!" for _ in range(50)), lambda: " | ".join(word() for _ in range(60))]
    rows = [(k, good() if k % 4 else r.choice(bad)()) for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, "x"), (9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(600)] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 200
    scored = quality.score_quality(docs, model).cache()
    assert scored.count() == 603 and scored.filter("score between 0 and 1").count() == 603
    unseen = scored.filter(quality.held_out(F.col("doc_id")) & (F.col("doc_id") < 600)).collect()
    assert len(unseen) > 60
    assert np.mean([(x.score >= 0.3) == (x.doc_id % 4 > 0) for x in unseen]) > 0.97
    none = quality.fit_quality(docs, labels.limit(0))
    assert quality.score_quality(docs, none).select("score").distinct().collect()[0].score == 0.5


def test_compiled_rules_against_numpy(spark, cases):
    """The column expression gives what the rules give in numpy."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 5] < 0.5) | (x[:, 7] > 1)).astype(float)
    model = quality.fit_rules(x, y)
    assert any(len(c) > 1 for c, _ in model.rules)
    total = model.bias + sum(w * quality._holds(x, c) for c, w in model.rules)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in quality.STATISTICS)).select(F.struct("*").alias("s"))
    got = [row[0] for row in df.select(model.score(F.col("s"))).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    texts = [c[1] for c in cases]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(quality.text_statistics(F.col("text")).alias("s")).select("s.*").collect()
    assert np.allclose([tuple(row) for row in rows], [quality.statistics(None if t is None else t.encode()) for t in texts])


def test_quality_columns(docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert quality.score_quality(docs, model, score_col="_s").columns == [*docs.columns, "_s"]
    assert quality.score_quality(no_docs, model, score_col="_s").count() == 0


# 4


def test_mixing(spark, docs, no_docs):
    rows = [(k, f"text {k}" * (1 + k % 3), "big" if k % 10 else "small") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r["source"]: r["n"] for r in mixing.mix_sources(df, weights={"big": 0.5, "small": 0.5}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(len(t) for _, t, _ in rows)
    assert all(abs(c - total / 2) < 0.1 * total for c in counts.values())
    again = mixing.mix_sources(df.repartition(7), weights={"big": 0.5, "small": 0.5})
    assert result(again, "order_key") == result(mixing.mix_sources(df, weights={"big": 0.5, "small": 0.5}), "order_key")
    far = mixing.mix_sources(df, weights={"small": 1.0}, budget_factor=4.0).groupBy("doc_id").count().agg(F.avg("count"), F.var_pop("count")).collect()[0]
    assert 34 < far[0] < 46 and 25 < far[1] < 60
    assert mixing.mix_sources(df, weights={}).count() == 0 == mixing.mix_sources(df, weights={"none": 2.0, "big": 0.0}).count()
    assert {r.source for r in mixing.mix_sources(df, weights={"big": 1.0, "none": 1.0}).select("source").collect()} == {"big"}
    assert mixing.mix_sources(no_docs).count() == 0


CLASHES = "copy string, order_key string, id int, row int, own int, _source string, source_ string, hash string, _hash string, n int, number int, key string, rate string, parts int, cdf int, k1 int, k2 int, component int, component_id int, first boolean, first_id int, _statistics string, s string, _id int, _label int, score string, _score double, items string, hit_spans string, n_words int, node int, at int, raw int"


def test_columns_with_clashing_names(spark, cases):
    """Operators and stages that pass rows on keep every column as it is."""
    extra = [c.split() for c in CLASHES.split(", ")]
    value = {"string": "v", "int": 5, "boolean": None, "double": 0.25}
    rows = [(*c[:5], *(value[t] for _, t in extra)) for c in cases]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)
    bench = spark.createDataFrame([(1, " ".join(cases[0][1].split()[5:25]))], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    for out in (mixing.mix_sources(docs), neardup.drop_near_duplicates(docs), decontam.drop_contaminated(docs, bench), quality.score_quality(docs, model, score_col="quality_score")):
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.select(*docs.columns).collect()
        assert got and {tuple(r)[5:] for r in got} == {tuple(value[t] for _, t in extra)} and {tuple(r)[:5] for r in got} <= {c[:5] for c in cases}
    assert mixing.mix_sources(docs).columns[-2:] == ["copy_", "order_key_"]


def test_poisson_cdf(spark):
    got = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("c")).collect()[0].c
    want, p = [], np.exp(-2.5)
    for k in range(mixing.TERMS):
        want.append(p if not want else want[-1] + p)
        p *= 2.5 / (k + 1)
    assert np.allclose(got, want)


# 5


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_token_records(spark, docs, no_docs, cases, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    path = f"file://{tmp_path}/records"
    tokens.write_records(docs, path, tokenizer)
    got = sorted(tokens.read_records(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([c[0] for c in cases], key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = sorted((str(c[0]), t.encode(c[1] or "", add_special_tokens=False).ids + [1]) for c in cases)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    mixed = tokens.read_records(spark, path, shuffle_seed=4).collect()
    assert sorted(r.start for r in mixed) == [r.start for r in got] and [r.start for r in mixed] != [r.start for r in got]
    tokens.write_records(no_docs, f"file://{tmp_path}/none", tokenizer)
    assert tokens.read_records(spark, f"file://{tmp_path}/none").count() == 0


def test_appended_records(spark, tokenizer, tmp_path):
    path = f"file://{tmp_path}/more"
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    tokens.write_records(rows(1, 2), path, tokenizer)
    tokens.write_records(rows(3), path, tokenizer)
    got = sorted(tokens.read_records(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 3] and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_tokenizers_that_keep_spaces(tmp_path, tokenizer):
    import json

    assert tokens.parts_at_spaces(json.load(open(tokenizer)))
    for kept in ({"type": "ByteLevel"}, {"type": "Metaspace"}, {"type": "Split", "pattern": {"Regex": ".+"}, "behavior": "Removed", "invert": True}, {"type": "Split", "pattern": {"Regex": "[^a]+"}, "behavior": "Removed", "invert": True}):
        assert not tokens.parts_at_spaces({"pre_tokenizer": kept})
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({c: k for k, c in enumerate("Ġabn")}, []))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "t.json"))
    assert np.frombuffer(tokens._tokenizer(str(tmp_path / "t.json"))("a b  a"), "<u2").tolist() == t.encode("a b  a").ids == [1, 0, 2, 0, 0, 1]


def test_broken_records_are_noticed(spark, docs, tokenizer, tmp_path):
    tokens.write_records(docs, f"file://{tmp_path}/r", tokenizer)
    file = next((tmp_path / "r").glob("*.rec"))
    data = bytearray(file.read_bytes())
    data[30] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="broken"):
        tokens.read_records(spark, f"file://{tmp_path}/r").collect()


def test_chunks_of_odd_texts(tokenizer):
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokenizer), tokens._tokenizer(tokenizer)
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "B", "'s", " ", "\n", "\t", "\x1c", "́", " ", "é", "1", "!!", "<|endoftext|>", "Σ", "日", "\r\n"]) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


# 6

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    ok = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": pii.card_number, "phone": lambda x: 9 <= len(pii.digits(x)) <= 15}
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_patterns():
    r = random.Random(6)
    for _ in range(3000):
        text = "".join(r.choice("a1.@- +()%1.1@25") for _ in range(40))
        assert pii.base_spans(text) == plain_spans(text), text
    long = "1" * 200_000 + "a" * 200_000 + "@" * 1000
    assert pii.base_spans(long) == []


def test_personal_data(docs, no_docs, cases):
    named = lambda c: F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    found = {(r.doc_id, r.i): r for r in pii.find_personal_data(docs).select("doc_id", named("base").alias("base"), named("spans").alias("spans"), F.lit(0).alias("i")).collect()}
    for c in cases:
        if c[0] is not None:
            assert found[c[0], 0].base == [":".join(map(str, s)) for s in plain_spans(c[1] or "")]
            assert set(found[c[0], 0].base) <= set(found[c[0], 0].spans)
    assert found[16, 0].base[:1] == ["email:5:22"] and len(found[16, 0].base) == 4
    assert pii.find_personal_data(no_docs).count() == 0


def made_rows(rows, seed):
    """Texts with their spans from random words and numbers: another source than the labelled table."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdeghilmnoprstuvw") for _ in range(r.randint(2, 8)))
    host = lambda: f"{word()}.{r.choice(['com', 'org', 'net', 'example.com'])}"

    def card(sep):
        while not pii.luhn(x := "4" + n(15)):
            pass
        return sep.join(x[k : k + 4] for k in (0, 4, 8, 12))

    made = {
        "email": [lambda: f"{word()}@{host()}", lambda: f"{word()}.{n(2)}@{host()}", lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()} [at] {word()} [dot] org", lambda: f"{word()} (at) {host()}", lambda: f"{word()} at {word()} dot com", lambda: f"{word()} AT {word()} DOT {word()} DOT net"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)), lambda: f"2001:db8:{r.randrange(65536):x}::{r.randrange(65536):x}"],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card(".")],
        "phone": [lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+49 {n(3)} {n(7)}", lambda: f"{n(3)}.{n(3)}.{n(4)}"],
    }
    none = [
        lambda: f"{r.randint(1500, 2100)}", lambda: n(r.randint(1, 6)), lambda: f"{n(2)}.{n(1)}.{n(1)}", lambda: f"{r.randint(1990, 2030)}-{n(2)}-{n(2)}", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"{n(2)}.{n(2)}%", lambda: f"#{n(5)}", lambda: f"v{n(1)}.{n(1)}",
        lambda: f"{word()}{n(2)}", lambda: f"${n(3)}.{n(2)}", lambda: f"{n(9)}", lambda: f"@{word()}", lambda: "dot", lambda: f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"{n(1)} {n(1)} {n(2)}",
        lambda: f"{word()} at the dot", lambda: f"dot {word()} at {word()}", lambda: f"{word()} dot {word()} {word()}",
    ]
    out = []
    for k in range(rows):
        text = " ".join(word() for _ in range(r.randint(1, 4))) + " "
        kind = pii.KINDS[k // 2 % 4]
        data = r.choice(made[kind])() if k % 2 else r.choice(none)()
        spans = [(kind, len(text), len(text) + len(data))] if k % 2 else []
        out.append((f"{text}{data}{r.choice(['', '.', ',', '!!'])} {word()} {word()}", spans))
    return out


def test_crf_of_unseen():
    model = pii.fit_crf(pii.labelled_table())
    table = made_rows(1000, 77)
    more = pii.decoded([t for t, _ in table], model)
    right = wrong = base = 0
    for (text, spans), found in zip(table, more, strict=True):
        own = pii.base_spans(text)
        both = pii.all_spans(own, found)
        right += len(set(both) & set(spans))
        wrong += len(set(both) - set(spans))
        base += len(set(own) & set(spans))
    assert right >= 0.95 * 500 and wrong <= 0.03 * 500 and base < 0.6 * 500  # measured: 0.99, 0.01, 0.5
    (spans,) = pii.decoded(["please write to jane (at) example (dot) com today"], model)
    assert spans == [("email", 16, 43)]
    found = pii.decoded(["mail jane at example dot com", "or jane AT example DOT com now", "we met at noon near the dot on the map", "stop at the dot please"], model)
    assert found == [[("email", 5, 28)], [("email", 3, 26)], [], []]


def test_viterbi_against_all_paths():
    from itertools import product

    r = np.random.default_rng(4)
    model = pii.Crf({}, r.normal(size=(5, 5)).astype(np.float32), frozenset())
    runs = [r.normal(size=(n, 5)).astype(np.float32) for n in (1, 2, 3, 4, 5, 3, 1)]
    for e, path in zip(runs, model.decode(runs), strict=True):
        score = lambda p, e=e: model.steps[0, p[0]] + sum(e[t, x] for t, x in enumerate(p)) + sum(model.steps[x, y] for x, y in zip(p, p[1:], strict=False)) + model.steps[p[-1], 0]
        assert score(tuple(path)) == pytest.approx(max(map(score, product(range(5), repeat=len(e)))), abs=1e-4)


def test_spans_are_merged_in_time():
    import time

    r = random.Random(5)
    for _ in range(300):
        spans = lambda n: [(r.choice(pii.KINDS), a, a + r.randint(1, 9)) for a in (r.randrange(80) for _ in range(n))]
        base, more = spans(r.randint(0, 6)), spans(r.randint(0, 6))
        want = base + [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        assert pii.all_spans(base, more) == sorted(want, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    text = "write to joe (at) example (dot) com or 1.2.3.4 " * 22_000  # a megabyte
    model = pii.fit_crf(pii.labelled_table(), rounds=30)
    began = time.time()
    base = pii.base_spans(text)
    assert len(pii.all_spans(base, pii.decoded([text], model)[0])) >= len(base) == 22_000 and time.time() - began < 60


# 7


def test_near_duplicates(docs, no_docs, cases):
    sets = [shingle_set(c[1]) for c in cases]
    of = classes(sets)
    least = {}
    for c, k in zip(cases, of, strict=True):
        if c[0] is not None:
            least[k] = min(c[0], least.get(k, c[0]))
    want = []
    for c, k, s in zip(cases, of, sets, strict=True):
        component = least.get(k) if s else c[0]
        want.append((c[0], len(s), component, c[0] == component))
    assert result(neardup.near_duplicate_documents(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, None], key=str)
    assert neardup.near_duplicate_documents(no_docs).count() == 0 and neardup.drop_near_duplicates(no_docs).count() == 0


def test_chains_of_near_copies(spark):
    """Variants of one text that mostly miss the threshold with each other, and reach it by steps."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = classes([shingle_set(t) for t in texts])
    least = {}
    for i, c in enumerate(of):
        least.setdefault(c, i)
    assert result(neardup.near_duplicate_documents(df), "doc_id", "component_id") == sorted(((i, least[c]) for i, c in enumerate(of)), key=str)


def test_a_bucket_of_many_dissimilar_texts():
    """All pairs of a bucket against the prefix filter, and in time for a large one."""
    import time

    r = np.random.default_rng(3)
    config = neardup.Config(bands=1, rows=1, samples=1, sketch_longs=0)
    member = lambda i, x: neardup.Member(i, i, True, 0, [], [7], np.unique(np.array(x, np.uint64)).tobytes())
    base = [r.integers(0, 2**62, 24) for _ in range(20)]
    sets = [np.concatenate([b[: r.integers(14, 25)], r.integers(0, 60, r.integers(0, 8))]) for b in base for _ in range(6)]
    rows = [member(i, x) for i, x in enumerate(sets)]
    of = classes([frozenset(np.frombuffer(m.set, np.uint64).tolist()) for m in rows])
    got = {i: i for i in range(len(rows))}
    for a, b in neardup._links(rows, rows, 7, config):
        assert of[a] == of[b]
        got = {k: got[a] if v == got[b] else v for k, v in got.items()}
    assert all((got[a] == got[b]) == (of[a] == of[b]) for a, b in combinations(range(len(rows)), 2))
    many = [member(i, np.concatenate([r.integers(0, 2**62, 20), np.arange(4)])) for i in range(20_000)]
    began = time.time()
    assert neardup._links(many, many, 7, config) == [] and time.time() - began < 20


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.84: bands, sketches and verification together find them."""
    r = random.Random(21)
    texts, want = [], 0
    for k in range(400):
        w = [f"{k}x{r.randrange(10**6)}" for _ in range(r.randint(60, 200))]
        v = list(w)
        while True:
            u = list(v)
            u[r.randrange(len(u))] = f"y{r.randrange(10**9)}"
            a, b = shingle_set(" ".join(w)), shingle_set(" ".join(u))
            if 100 * len(a & b) < 75 * len(a | b):
                break
            v = u
        texts += [" ".join(w), " ".join(v)]
        a, b = shingle_set(texts[-2]), shingle_set(texts[-1])
        assert 75 <= 100 * len(a & b) / len(a | b) < 90
        want += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(x.doc_id, x.component_id) for x in neardup.near_duplicate_documents(df).collect()}
    assert sum((2 * k + 1, 2 * k) in found for k in range(want)) >= 0.99 * want


# 8

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies, do you accept them all</div><div id="sidebar"><p>side words here and there</p></div><div class="ad">buy this now</div>
<article><header><h1>The  title</h1></header><p>Hello &amp; <b>w</b>orld&nbsp;x<br>y</p><aside class="ad">buy again</aside><p>Second &lt;tag&gt;<p>Third<form>mail <input></form><section class="comments"><p>me too I say so</p></section></article><footer>&copy; foot words</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>just</p> text"), (5, "u", "<div class='ad'>a b c</div><footer>x y</footer>"), (6, "u", "<p>" + "long words " * 50_000 + "</p>"), (1, "u", PAGE), (7, "u", "a < b <!-- open"), (8, "u", "<article>one</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: "\n".join(r.blocks) for r in html.extract_main_text(pages.withColumn("blocks", F.lit(1))).collect()}
    assert found[1] == "The title\nHello & world x y\nSecond <tag>\nThird"
    assert (found[2], found[3], found[None], found[5], found[7], found[8]) == ("", "", "just\ntext", "", "a < b", "one")
    assert len(found[6].split()) == 100_000
    assert html.extract_main_text(pages.limit(0)).count() == 0


# pages with other names than the labelled ones, and their main text
HELD_OUT = [
    ("""<html><head><title>t</title></head><body class="home"><div id="top-nav-bar"><a href=/>Home</a> <a>About us</a></div><div class="gdpr-cookie-banner">We use cookies <button>OK</button></div>
<div class="layout"><div class="left-sidebar widgets"><h3>Latest</h3><ul><li>one thing</li><li>other thing</li></ul></div><div class="post-content entry"><h1>Rain in the hills</h1><p>It rained for <em>nine</em> days.</p><div class="ad-slot-1">Buy umbrellas</div><p>Then the sun came.</p><ol><li>First cloud</li><li>Second cloud</li></ol></div></div><div class="site-footer">Copyright 2020</div></body></html>""","Rain in the hills\nIt rained for nine days.\nThen the sun came.\nFirst cloud\nSecond cloud"),
("""<body><header class="page-header"><a>Logo</a><nav class=mainmenu><a>News</a><a>Sport</a></nav></header><main role="main"><h2>Bread</h2><p>Flour &amp; water.</p><blockquote>Quote here</blockquote><form class="newsletter-form">Your mail <input></form><p>Bake it.</p><section id="reader-comments"><h3>Comments</h3><p>Nice!</p></section></main><aside class="related-articles"><p>More to read about bread and butter</p></aside><footer>Imprint</footer></body>""","Bread\nFlour & water.\nQuote here\nBake it."),
("""<div class="search-box">Search</div><div id="main-story"><h1>Title</h1><p>Body text one two three.</p><p>Body text four five.</p><div class="social-share-buttons">Share this</div></div><div class="comment-list"><div>anna: I agree with all of this very much</div></div><div class="subscribe-popup">Subscribe now</div>""","Title\nBody text one two three.\nBody text four five."),
("""<p>No chrome at all.</p><p>Two blocks.</p>""","No chrome at all.\nTwo blocks."),]


def test_main_text_of_unseen_names():
    weights = html.Weights(html.labelled_pages())
    for page, want in HELD_OUT:
        assert "\n".join(html.main_blocks(page, weights)) == want


def test_hostile_pages_take_linear_time():
    import time

    weights = html.Weights(html.labelled_pages())
    for page in ("<a " * 350_000, '<a " ' * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<!" * 500_000, "<script>" + "</script " * 110_000, "<!--" * 250_000, "<a '\"" * 200_000, "<a " + 'class="' * 140_000 + ">"):
        began = time.time()
        html.main_blocks(page, weights)
        assert time.time() - began < 20, page[:20]


# 9


def plain_hits(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_blocks_keep_every_window():
    r = random.Random(2)
    items = [(k, " ".join(str(r.randrange(50)) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 12, 40]))).encode()) for k in range(60)]
    windows = lambda ws: {tuple(ws[k : k + 10]) for k in range(max(1, len(ws) - 9))} if ws else set()
    for most in (8, 10, 11, 25, 10_000):
        blocks = list(decontam.item_blocks(iter(items), most, 10))
        assert all(sum(len(ws) for _, ws in b) <= max(most, 10) for b in blocks)
        got = defaultdict(set)
        for b in blocks:
            for i, ws in b:
                got[i] |= windows(ws)
        assert got == {str(i): windows(t.split()) for i, t in items if t}


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_decontamination(spark, docs, no_docs, cases, block_words):
    base = cases[0][1].split()
    items = [(1, " ".join(base[5:25])), (2, "one TWO"), (3, None), (4, "..."), (None, " ".join(base[40:50])), (10, " ".join(base[20:32])), (10, " ".join(base[20:32])), (11, "never seen words at all"), (12, "The"), (13, "ünï")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = decontam.decontaminate(docs, bench, block_words=block_words)
    want = plain_hits([(c[0], c[1]) for c in cases], items)
    assert result(found, "doc_id", "n_words", n_hit, "items") == want
    kept = decontam.drop_contaminated(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    assert result(decontam.decontaminate(docs, bench.limit(0)), F.size("items")) == [(0,)] * len(cases)
    assert decontam.decontaminate(no_docs, bench).count() == 0


# 10


def plain_features(raw):
    """Log-mel tensors by direct sums: a low-pass filter at twice the rate, every third sample, a Fourier sum per frame."""
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    n = np.arange(48) - 23.5
    taps = np.sinc(n / 3) * np.hamming(48)
    taps *= 2 / taps.sum()
    wide = np.zeros(2 * len(x))
    wide[::2] = x
    y = np.convolve(wide, taps)[: 2 * len(x)][::3]
    length = 2 * len(x) // 3
    count = 1 + max(0, -(-(length - 400) // 160))
    y = np.append(y[:length], np.zeros(count * 160 + 400))
    tail = np.convolve(wide, taps)[::3]  # the filter rings on after the last sample
    y[: len(tail)] = tail
    mels = []
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42) / 2595) - 1)
    for f in range(count):
        frame = y[f * 160 : f * 160 + 400]
        frame = (frame - frame.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
        power = np.array([abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(400) / 512))) ** 2 for k in range(257)])
        hz = np.arange(257) * 16000 / 512
        weights = [np.interp(hz, edges[m : m + 3], [0, 1, 0]) for m in range(40)]
        mels.append([np.log(power @ w + 1e-6) for w in weights])
    mels = np.array(mels)
    pooled = np.array([mels[k : k + 4].mean(axis=0) for k in range(0, count, 4)])
    full = np.full((-(-len(pooled) // 24) * 24, 40), np.log(1e-6))
    full[: len(pooled)] = pooled
    return count, full.reshape(-1, 24 * 40)


def test_audio_against_direct_sums():
    r = np.random.default_rng(5)
    for raw in (b" " * 192, r.integers(0, 256, 192 * 3, np.uint8).tobytes(), r.integers(60, 200, 192 * 130, np.uint8).tobytes()):
        n, segments, spans, tensors, means = audio.features(raw)
        count, want = plain_features(raw)
        assert n == count and tensors.shape == want.shape and np.allclose(tensors, want, atol=5e-2)
        assert len(spans) == len(want) and all(s["start_s"] < s["end_s"] for s in (*spans, *segments))


def test_spans_and_open_segments_reach_the_end_of_the_payload():
    r = np.random.default_rng(8)
    for blocks in (*range(1, 10), 120, 121, 122, 241):  # with 121, the frames fill the last tensor
        raw = bytes([128]) * (192 * (blocks - blocks // 2)) + r.integers(0, 256, 192 * (blocks // 2), np.uint8).tobytes()
        n, segments, spans, tensors, _ = audio.features(raw)
        assert spans[0]["start_s"] == 0 and spans[-1]["end_s"] == round(len(raw) / 24000, 6) and len(spans) == len(tensors)
        assert all(a["end_s"] == b["start_s"] for a, b in zip(spans, spans[1:]))
        if blocks > 100:  # loud to the end
            assert segments[-1]["end_s"] == round(len(raw) / 24000, 6)
        assert all(s["start_s"] < s["end_s"] for s in (*spans, *segments))


def test_audio(spark, docs, no_docs, cases, tmp_path):
    folder = f"file://{tmp_path}/tensors"
    media = audio.store_media(docs)
    audio.audio_features(media, folder).write.parquet(f"file://{tmp_path}/a")
    rows = audio.with_tensors(spark.read.parquet(f"file://{tmp_path}/a"), folder).collect()
    want = sorted(((c[1] or "").encode() for c in cases), key=lambda w: (len(w), w))
    got = sorted((r for r in rows), key=lambda r: (r.n_bytes, r.payload))
    assert [bytes(g.payload) for g in got] == [w + b" " * (-len(w) % 192 or (0 if w else 192)) for w in want]
    assert all(audio.from_wav(bytes(r.media)) == bytes(r.payload) for r in rows)
    for r in rows:
        assert len(r.tensors) == len(r.tensor_spans) == r.n_tensors >= 1
        n, segments, spans, tensors, _ = audio.features(bytes(r.payload))
        assert n == r.n_frames and np.allclose(r.tensors, tensors, atol=1e-5)
        assert [s.asDict() for s in r.segments] == segments and [s.asDict() for s in r.tensor_spans] == spans
    file = next((tmp_path / "tensors").glob("*.arrow"))
    assert isinstance(pa.ipc.open_file(str(file)).schema.field("tensor").type, pa.FixedShapeTensorType)
    none = audio.store_media(no_docs)
    assert audio.with_tensors(audio.audio_features(none, folder), folder).count() == 0


def test_resampling_is_the_same_in_blocks():
    x = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    whole = audio.resampled(x, 0, 3000)
    assert np.allclose(whole, np.concatenate([audio.resampled(x, 0, 1000), audio.resampled(x, 1000, 3000)]), atol=1e-5)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(24000) / 24000)).astype(np.uint8)
    spectrum = np.abs(np.fft.rfft(audio.resampled(tone, 0, 16000)))
    assert spectrum.argmax() == 1000


def test_hysteresis():
    e = np.array([0, 0, 9, 5, 5, 0, 5, 9, 9, 0], float)
    assert audio.hysteresis(e) == [(2, 5), (7, 9)]


# all queries, and the pipeline



def test_pipeline(spark, cases, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    text = lambda: ". ".join(" ".join(word() for _ in range(9)) for _ in range(8))
    rows = [(k, text() if k % 4 else "The " * (20 + k), "en", f"s{k % 3}") for k in range(200)]
    rows += [(1000 + k, rows[1][1], "en", "s0") for k in range(5)] + [(2000, rows[2][1] + " " + "benchmark item words that nobody else uses in this whole set of texts", "en", "s1")]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, "benchmark item words that nobody else uses in this whole set of texts")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{d}/out-{name}")
        docs = spark.read.parquet(f"{d}/out-{name}")
        seen[name] = docs
    ids = {n: sorted(r.doc_id for r in x.select("doc_id").collect()) for n, x in seen.items()}
    assert ids["quality"] == sorted(i for i, *_ in rows if i % 4 or i >= 1000)
    assert not set(range(1000, 1005)) & set(ids["near_duplicates"]) and 1 in ids["near_duplicates"]
    assert len(ids["near_duplicates"]) == len(set(ids["near_duplicates"]))
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) <= {2000, 2}
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert ids["token_records"] == ids["mixing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()) == ids["token_records"]


def test_pipeline_of_awkward_rows(spark, cases, docs, no_docs, tmp_path):
    """Nulls in any column, empty texts, repeated rows, further columns with clashing names; empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("some", docs), ("none", no_docs)):
        d = f"file://{tmp_path}/{name}"
        rows.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(2, None, 0), (None, 1, 0)] if name == "some" else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(0, None), (None, "")] if name == "some" else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            run(spark, now, d).write.parquet(f"{d}/out-{stage}")
            before, now = now, spark.read.parquet(f"{d}/out-{stage}")
            if stage != "token_records":
                assert now.columns == before.columns
            if stage in ("quality", "decontamination"):
                assert now.count() == before.count()
            if stage == "near_duplicates" and name == "some":
                assert sorted((r.doc_id for r in now.collect()), key=str) == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, None], key=str)
        assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert now.count() == before.count() if name == "some" else not now.count()
