import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, copy int, order_key string, k1 long, component string, start int, raw string"


def prose(r: random.Random, words: int) -> str:
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words))


def plain(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), None, 0.5, 7, "x", 1, "c", 2, "r")


@pytest.fixture(scope="session")
def cases():
    """Rows with nulls in any column, empty and long texts, ties, repeated rows, copies, near copies, shared passages;
    extra columns carry names that operators use themselves."""
    r = random.Random(3)
    base, passage = prose(r, 60), prose(r, 55)
    near = base.split()
    near[30] = "changed"
    rows = [plain(1, base), plain(2, base), plain(2, base), plain(None, base, None, None), plain(3, " ".join(near)), plain(4, None), plain(5, ""), plain(6, " \n\t "), plain(7, "one two"), plain(8, "ONE  two"), plain(9, "é" * 300), plain(10, "é" * 301)]
    rows += [plain(11, prose(r, 30) + " " + passage + " " + prose(r, 20)), plain(12, prose(r, 9) + "\n" + prose(r, 25) + " " + passage + " " + prose(r, 3)), plain(13, "The " * 400), plain(14, prose(r, 12_000)), plain(15, "\n".join([base, prose(r, 20), base]))]
    rows += [plain(None, None, None, None), plain(16, "mail a.b@c.example.com or 1.2.3.4, 999.1.1.1 and +1 (017) 555-7713; 4111 1111 1111 1111 x@y\n@ 12 @z.de"), plain(17, "\U0001f600 ünï " + prose(r, 40), "fr", "s1"), plain(20, prose(r, 40).upper(), "de", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(cases, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
