"""Personal data: base patterns, and a linear-chain CRF over word shapes that adds what they miss.

The base patterns (e-mail, IPv4 address, card number, phone number with a country code) are matched leftmost and without
overlap, kind by kind; a match that fails its check (parts up to 255, Luhn, number of digits) is dropped.

The CRF labels words (runs between white space) with a kind or with none. Its features are the shape of the word and of
its neighbours, and the neighbours' lower-cased words where they are known from the labelled table. Words without a digit
or ``@`` that are not near a spelled-out ``(at)`` or ``dot`` always have the label none; given that, the chain parts at
such words, so the exact Viterbi path of a document is that of the short runs between them. Runs of a whole batch are
decoded together, padded by length, in numpy. Decoded spans are trimmed to their letters and digits, checked, and added
if they overlap no base span. The model is fitted to a small labelled table (``pii_labels``, by hand) by gradient steps on its likelihood.

Offsets are code points, end exclusive. Null texts count as empty. Rows are independent: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.pii_labels import LABELLED

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
Span = tuple[str, int, int]

# base patterns; possessive repeats and the guards before runs only save time, the matches are the same
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    doubled = [int(c) for c in number[-2::-2]]
    return (sum(int(c) for c in number[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def ip_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def card_number(text: str) -> bool:
    d = digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            # the local part of the next can't begin before this @
            free = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Ordered by kind, then start."""
    out = emails(text)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if ip_parts(m[0])]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if card_number(m[0])]
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# words and runs

WORD = re.compile(r"\S+")
ACTIVE = re.compile(r"[0-9@]|(?i:[(\[{]at[)\]}]|(?<!\S)dot(?!\S)|[(\[{]dot[)\]}])")
SPELLED = re.compile(r"(?i)[(\[{](?:at|dot)[)\]}]|dot")
SPACES = frozenset(" \t\n\r\v\f")
NEAR = 3


def runs(text: str) -> list[list[tuple[int, int, bool]]]:
    """Words (start, end, may have a kind) around those that may: each run has a word of context on both sides."""
    found = [m.start() for m in ACTIVE.finditer(text)]
    if not found:
        return []
    words: dict[int, tuple[int, bool]] = {}

    def word_at(p: int) -> tuple[int, int]:
        a, b = p, p
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        return a, b

    done = -1
    for p in found:
        if p < done:
            continue
        a, done = word_at(p)
        words[a] = (done, True)
        near = NEAR if SPELLED.search(text, a, done) else 0
        for step in (-1, 1):
            x, y = a, done
            for k in range(near + 1):
                q = x - 1 if step < 0 else y
                while 0 <= q < len(text) and text[q].isspace():
                    q += step
                if not 0 <= q < len(text):
                    break
                x, y = word_at(q)
                active = k < near
                if x not in words or active:
                    words[x] = (y, active or words.get(x, (0, False))[1])
    out: list[list[tuple[int, int, bool]]] = []
    last = None
    for a in sorted(words):
        b, active = words[a]
        if last is not None and text[last:a].isspace():
            out[-1].append((a, b, active))
        else:
            out.append([(a, b, active)])
        last = b
    return [r for whole in out for r in parted(whole)]


def parted(words: list[tuple[int, int, bool]]) -> Iterator[list[tuple[int, int, bool]]]:
    """Cuts at words that always have the label none; these stay, as context, on both sides."""
    begin = 0
    for k, w in enumerate(words):
        if not w[2] and k > begin:
            if any(x[2] for x in words[begin : k + 1]):
                yield words[begin : k + 1]
            begin = k
    if any(x[2] for x in words[begin:]):
        yield words[begin:]


IP6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
NUMERIC = re.compile(r"\+?[0-9().-]*[0-9][0-9().-]*")
SHAPES = [(re.compile(r"[A-Z]+"), "A"), (re.compile(r"[a-z\u0080-\U0010FFFF]+"), "a"), (re.compile(r"[0-9]+"), lambda m: f"{min(len(m[0]), 20) // 2 * 2 + 1 if len(m[0]) > 6 else len(m[0])}d")]


def shape(word: str) -> str:
    for pattern, mark in SHAPES:
        word = pattern.sub(mark, word)
    return word


def kind_of_chars(word: str) -> str:
    d = len(digits(word))
    return f"{'@' if '@' in word else ''}{':' * min(3, word.count(':'))}{'.' * min(4, word.count('.'))}{'-' * min(3, word.count('-'))}{'+' if word[:1] == '+' else ''}{'x' if any(c.isalpha() for c in word) else ''}{d if d < 5 else d // 3 * 3}"


def features(text: str, run: list[tuple[int, int, bool]], known: frozenset[str]) -> list[list[str]]:
    words = [text[a:b].rstrip(".,;:!?&$#%*\"'") for a, b, _ in run]
    numeric = [bool(NUMERIC.fullmatch(w)) for w in words]
    out = []
    for k, w in enumerate(words):
        before, after = (words[k - 1] if k else ""), (words[k + 1] if k + 1 < len(words) else "")
        fs = ["bias", f"w={shape(w)}", f"c={kind_of_chars(w)}", f"p={shape(before)}", f"n={shape(after)}", f"cp={kind_of_chars(before)}|{kind_of_chars(w)}", f"cn={kind_of_chars(w)}|{kind_of_chars(after)}"]
        if "@" in w:
            fs.append("address" if DOMAIN.search(w) and w[0] != "@" else "mention")
        elif (d := len(digits(w))) > 4:
            fs.append(f"long={d >= 13}{card_number(w)}{'.' in w}{':' in w}")
        if numeric[k]:  # the numbers that stand together here: how many digits, in how many words
            lo = hi = k
            while lo and numeric[lo - 1] and hi - lo < 8:
                lo -= 1
            while hi + 1 < len(words) and numeric[hi + 1] and hi - lo < 16:
                hi += 1
            d = digits("".join(words[lo : hi + 1]))
            fs.append(f"g={min(hi - lo, 4)}:{len(d) // 3}:{13 <= len(d) <= 19 and luhn(d)}:{words[lo][0] if words[lo][0] in '+(' else 0}")
            fs.append(f"luhn={13 <= len(d) <= 19 and luhn(d)}")
        if IP6.fullmatch(w):
            fs.append("colons")
        for tag, x in (("W", w), ("P", before), ("N", after)):
            x = x.lower()
            if x in known:
                fs.append(f"{tag}={x}")
        out.append(fs)
    return out


@dataclass
class Crf:
    weights: dict[str, np.ndarray]  # by feature: one number a label
    steps: np.ndarray  # from label to label
    known: frozenset[str]

    def emissions(self, text: str, run: list[tuple[int, int, bool]]) -> np.ndarray:
        out = np.zeros((len(run), len(LABELS)), np.float32)
        for k, fs in enumerate(features(text, run, self.known)):
            for f in fs:
                if (w := self.weights.get(f)) is not None:
                    out[k] += w
            if not run[k][2]:
                out[k, 1:] = -1e4
        return out

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of many runs: those of similar length together, padded with words that must be none."""
        paths: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        at = 0
        while at < len(order):
            longest = len(runs[order[min(at + 255, len(order) - 1)]])
            part = order[at : at + max(1, min(256, 200_000 // max(1, longest)))]
            at += len(part)
            longest = max(len(runs[k]) for k in part)
            e = np.full((len(part), longest, len(LABELS)), -1e4, np.float32)
            e[:, :, 0] = 0
            for row, k in enumerate(part):
                e[row, : len(runs[k])] = runs[k]
            score = e[:, 0] + self.steps[0]
            back = np.zeros((len(part), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                way = score[:, :, None] + self.steps
                back[:, t] = way.argmax(axis=1)
                score = way.max(axis=1) + e[:, t]
            label = (score + self.steps[:, 0]).argmax(axis=1)
            path = np.zeros((len(part), longest), np.int8)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = back[np.arange(len(part)), t, label]
            for row, k in enumerate(part):
                paths[k] = path[row, : len(runs[k])]
        return paths


# the labelled table and the fit


MARK = re.compile(r"\[\[(email|ip|card|phone):(.*?)\]\](?!\])")


def labelled_table(text: str = LABELLED) -> list[tuple[str, list[Span]]]:
    """Lines and their spans, from lines in which data stands as ``[[kind:data]]``."""
    out = []
    for line in text.strip().split("\n"):
        plain, spans, at = "", [], 0
        for m in MARK.finditer(line):
            plain += line[at : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain, at = plain + m[2], m.end()
        out.append((plain + line[at:], spans))
    return out


def telling_words(table: list[tuple[str, list[Span]]]) -> frozenset[str]:
    """Words without digits that stand in spans or next to them in two rows or more."""
    counts: Counter[str] = Counter()
    for text, spans in table:
        found = set()
        for _, a, b in spans:
            near = [*text[:a].split()[-1:], *text[b:].split()[:1], *text[a:b].split()]
            found.update(w.rstrip(".,;:!?&$#%*\"'").lower() for w in near)
        counts.update(w for w in found if w and not DIGIT.search(w) and "@" not in w)
    return frozenset(w for w, n in counts.items() if n > 1)


def fit_crf(table: list[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.1, decay: float = 0.002) -> Crf:
    known = telling_words(table)
    index: dict[str, int] = {}
    rows: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
    for text, spans in table:
        for run in runs(text):
            fs = [np.array([index.setdefault(f, len(index)) for f in x]) for x in features(text, run, known)]
            y = np.array([next((LABELS.index(k) for k, s, e in spans if a < e and b > s), 0) if active else 0 for a, b, active in run])
            rows.append((fs, y, np.array([x[2] for x in run])))
    size = len(LABELS)
    longest = max(len(y) for _, y, _ in rows)
    # all runs at once, padded
    places = np.array([(i, t) for i, (fs, _, _) in enumerate(rows) for t in range(len(fs)) for _ in fs[t]])
    which = np.concatenate([f for fs, _, _ in rows for f in fs])
    w, steps = np.zeros((len(index), size)), np.zeros((size, size))
    force = np.full((len(rows), longest, size), -1e4)
    force[:, :, 0] = 0
    gold = np.zeros((len(rows), longest), int)
    real = np.zeros((len(rows), longest), bool)
    for i, (_, y, active) in enumerate(rows):
        force[i, : len(y)][active] = 0
        gold[i, : len(y)] = y
        real[i, : len(y)] = True
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(steps), np.zeros_like(steps)]
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)) + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))
    for step in range(1, rounds + 1):
        e = force.copy()
        np.add.at(e, (places[:, 0], places[:, 1]), w[which])
        a = np.zeros_like(e)
        b = np.zeros_like(e)
        a[:, 0] = e[:, 0] + steps[0]
        for t in range(1, longest):
            a[:, t] = e[:, t] + soft(a[:, t - 1][:, :, None] + steps, 1)[:, 0]
        b[:, -1] = steps[:, 0]
        for t in range(longest - 2, -1, -1):
            b[:, t] = soft(steps + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)[:, :, 0]
        z = soft(a[:, -1] + steps[:, 0], 1)
        p = np.exp(a + b - z[:, None])
        g = -p
        np.put_along_axis(g, gold[:, :, None], np.take_along_axis(g, gold[:, :, None], 2) + 1, 2)
        g[~real] = 0
        gw = np.zeros_like(w)
        np.add.at(gw, which, g[places[:, 0], places[:, 1]])
        gs = np.zeros_like(steps)
        for t in range(1, longest):
            pair = np.exp(a[:, t - 1][:, :, None] + steps + (e[:, t] + b[:, t])[:, None, :] - z[:, :, None])
            gs -= pair.sum(axis=0)
            np.add.at(gs, (gold[:, t - 1], gold[:, t]), 1)
        for k, (x, gx) in enumerate(((w, gw - decay * len(rows) * w), (steps, gs - decay * len(rows) * steps))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf({f: w[k].astype(np.float32) for f, k in index.items()}, steps.astype(np.float32), known)


PHONE_FORM = re.compile(r"\+?[0-9(][\x20().0-9-]*[0-9]")


#: An address; its signs may be spelled out, in brackets or bare. A bare "at" needs a spelled "dot" after it.
_LOCAL, _DOT = r"[\w.+-]+(?:\s+dot\s+[\w+-]+)*", r"(?:\.|\s*[(\[{]dot[)\]}]\s*|\s+dot\s+)"
ADDRESS = re.compile(rf"(?i){_LOCAL}(?:(?:@|\s*[(\[{{]at[)\]}}]\s*)[\w-]+(?:{_DOT}[\w-]+)+|\s+at\s+[\w-]+(?:{_DOT}[\w-]+)*\s+dot\s+[\w-]+)")


def valid(kind: str, text: str) -> bool:
    d = len(digits(text))
    if kind == "email":
        return bool(ADDRESS.fullmatch(text))
    if kind == "ip":
        return bool(IP6.fullmatch(text)) or bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text)) and ip_parts(text)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\x20.-]?[0-9])+", text)) and card_number(text)
    return bool(PHONE_FORM.fullmatch(text)) and 9 <= d <= 15 and len(re.findall("[0-9]+", text)) >= 3


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    return a, b


def decoded(texts: list[str], model: Crf) -> list[list[Span]]:
    """Spans that the CRF finds, checked."""
    where, emitted = [], []
    for i, text in enumerate(texts):
        for run in runs(text):
            where.append((i, run))
            emitted.append(model.emissions(text, run))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, run), path in zip(where, model.decode(emitted), strict=True):
        k = 0
        while k < len(run):
            end = k + 1
            while end < len(run) and path[end] == path[k]:
                end += 1
            if path[k]:
                a, b = trimmed(texts[i], run[k][0], run[end - 1][1])
                if valid(LABELS[path[k]], texts[i][a:b]):
                    out[i].append((LABELS[path[k]], a, b))
            k = end
    return out


def all_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """The base and those of the others that overlap none of it."""
    ranges = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in ranges]
    reach = list(accumulate((b for _, b in ranges), max))
    added = []
    for s in more:
        k = bisect_left(starts, s[2])  # those before it begin before the span ends
        if not k or reach[k - 1] <= s[1]:
            added.append(s)
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:long,end:long>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(docs: DataFrame, *, labelled: list[tuple[str, list[Span]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (these and what the CRF adds), each by kind, then start."""
    model = fit_crf(labelled_table() if labelled is None else labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            base = [base_spans(t) for t in texts]
            spans = [all_spans(b, m) if m else b for b, m in zip(base, decoded(texts, model), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([named(s) for s in base], ARROW_SPANS), pa.array([named(s) for s in spans], ARROW_SPANS)], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import small_batches, table

    small_batches(spark)
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
