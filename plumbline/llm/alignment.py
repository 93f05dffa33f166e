"""Alignment of two tokenizers by a dictionary of groups.

Tokenizer A (byte-level) reads a space and the text, B (pieces) reads the text and adds the space itself. Byte offsets where
tokens of both end cut a text into groups; inside of a group every pair of tokens whose bytes overlap is linked, which the
ids alone decide: a group of m and n tokens has one link for each of its m + n - 1 stretches between token ends.

A block of texts (see ``blocks``) is cut into chunks before single spaces, where both tokenizers always part, and each
distinct chunk is encoded once. Its groups are interned: one entry per block and distinct group. Links are expanded once per
distinct group. A pair's count is the number of documents that hold it linked: within a block the distinct groups of a
document give its distinct pairs, which are counted there (a document lies in one block), and the blocks' counts are summed.
Counts come back to the groups by a join of distinct groups' links, from there to the dictionary by the group's key, and to
the documents by their block, multiplied by how often a document holds each group.

Memory: a task holds one block and its dictionary. Nothing is broadcast or collected.

Null and empty texts, and texts whose tokens' bytes differ from space and text (B reads U+2581 as a space), have no tokens:
zeros and an empty digest. Repeated rows are documents of their own and count as such; ties for an id's best count all count.
A null doc_id stays null. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import in_blocks, some_rows, split_rows, written_kinds
from plumbline.llm.common import small_batches, table, written
from plumbline.llm.words import mixed, runs

#: A single space after neither a space nor U+2581 (which is B's space) and before no white space: tokens of A start there, and
#: no piece of B holds a space but at its begin.
CUT = re.compile("(?<=[^ ▁]) (?=\\S)")
SLOW = re.compile("^ | $|▁| \\s")
KINDS = {
    "docs": "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, members binary, times binary",
    "groups": "block long, member int, key string",
    "pairs": "a int, b int, docs long",
}


def chunks_of(text: str) -> list[str]:
    """The text cut where both tokenizers part; the space before each chunk (the first has the added one) is left out."""
    return CUT.split(text) if SLOW.search(text) else text.split(" ")


@lru_cache(maxsize=2)
def _lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token, by id."""
    a, b = _tokenizers(path_a, path_b)[:2]
    return np.array([len(a.id_to_token(i) or "") for i in range(a.get_vocab_size())]), np.array([len(_piece_bytes(b, i)) for i in range(b.get_piece_size())])


def _piece_bytes(b, i: int) -> bytes:
    return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=path_b)
    return a, b, [_piece_bytes(b, i) for i in range(b.get_piece_size())]


def linked(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens a, b of groups of_a, of_b (in order): the group, A's id and B's id of every link."""
    ends_a, ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])  # groups are equally long on both sides
    stretches = np.union1d(ends_a, ends_b)
    at = np.searchsorted(ends_a, stretches)
    return of_a[at], a[at], b[np.searchsorted(ends_b, stretches)]


def links_of(keys: list[str], lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from groups as texts; a group's number is its place."""
    sides, owners = [], []
    for s in (0, 1):
        own = [k.split("|")[s] for k in keys]
        sides.append(np.array(",".join(own).split(",") if own else [], np.int64))
        owners.append(np.repeat(np.arange(len(own)), [k.count(",") + 1 for k in own]))
    return linked(sides[0], owners[0], sides[1], owners[1], lengths)


def encoded(chunks: list[str], path_a: str, path_b: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of both tokenizers: the ids of all chunks, one after the other, and how many each has; and which chunks either of them
    doesn't give back. These have no ids."""
    a, b, pieces = _tokenizers(path_a, path_b)
    lengths = _lengths(path_a, path_b)
    ids, sizes, bad = ([], []), ([], []), []
    for at in range(0, len(chunks), 10_000):
        some = chunks[at : at + 10_000]
        raw = [b" " + c.encode() for c in some]
        own = ([e.ids for e in a.encode_batch_fast([" " + c for c in some], add_special_tokens=False)], b.encode(some, num_threads=1))
        flat = [np.array(list(chain.from_iterable(x)), np.int64) for x in own]
        n = [np.array(list(map(len, x))) for x in own]
        size = np.array(list(map(len, raw)))
        wrong = np.zeros(len(some), bool)
        for k in (0, 1):
            wrong |= np.bincount(np.repeat(np.arange(len(some)), n[k]), lengths[k][flat[k]], len(some)) != size
        if b"".join(map(pieces.__getitem__, flat[1].tolist())) != b"".join(raw):
            wrong |= [b"".join(map(pieces.__getitem__, x)) != r for x, r in zip(own[1], raw, strict=True)]
        for k in (0, 1):
            ids[k].append(flat[k][~np.repeat(wrong, n[k])].astype(np.int32))
            sizes[k].append(np.where(wrong, 0, n[k]))
        bad.append(wrong)
    return [np.concatenate(x) for x in ids], [np.concatenate(x) for x in sizes], np.concatenate(bad)


def grouped(ids: list[np.ndarray], sizes: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct groups of all chunks as texts; the groups of the chunks, one after the other; how many each chunk has.
    Within a block groups are told apart by 64-bit hashes of their ids."""
    ends = [np.cumsum(lengths[k][ids[k]]) for k in (0, 1)]
    both = np.intersect1d(*ends, assume_unique=True)
    to = [np.searchsorted(e, both) + 1 for e in ends]
    begin = [np.concatenate([[0], t[:-1]]) for t in to]
    hashes = [runs(mixed(ids[k].astype(np.uint64) + np.uint64(k)), begin[k], to[k]) for k in (0, 1)]
    _, first, member = np.unique(mixed(hashes[0]) + hashes[1], return_index=True, return_inverse=True)
    shown = []
    for k in (0, 1):
        text = list(map(str, ids[k].tolist()))
        shown.append([text[i] if j == i + 1 else ",".join(text[i:j]) for i, j in zip(begin[k][first].tolist(), to[k][first].tolist(), strict=True)])
    upto = np.concatenate([[0], np.cumsum(lengths[0][ids[0]])])[np.cumsum(sizes[0])]  # where the chunks end, in bytes
    return [f"{x}|{y}" for x, y in zip(*shown, strict=True)], member.astype(np.int32), np.diff(np.searchsorted(both, upto, "right"), prepend=0)


def _taken(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of counts."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts) + np.repeat(starts, counts)


def align_block(number: int, batches: Iterator[tuple[pa.RecordBatch, list[bytes]]], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    chunks: defaultdict[str, int] = defaultdict()
    chunks.default_factory = chunks.__len__
    ids, held = [], []
    for batch, texts in batches:
        ids.extend(batch.column(0).to_pylist())
        for raw in texts:
            text = raw.decode()
            held.append(np.array(list(map(chunks.__getitem__, chunks_of(text))) if text else [], np.int32))
    flat_ids, (per_a, per_b), bad = encoded(list(chunks), path_a, path_b) if chunks else ([np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int64)] * 2, np.zeros(0, bool))
    lengths = _lengths(path_a, path_b)
    groups, members, counts = grouped(flat_ids, [per_a, per_b], lengths)
    del chunks, flat_ids
    held = [h[:0] if bad[h].any() else h for h in held]
    own = list(map(groups.__getitem__, members.tolist()))
    to = np.cumsum(counts).tolist()
    shown = [own[j - 1] if n == 1 else ";".join(own[j - n : j]) for j, n in zip(to, counts.tolist(), strict=True)]
    digests = [hashlib.sha256(";".join(map(shown.__getitem__, h.tolist())).encode()).hexdigest() if len(h) else "" for h in held]
    del own, shown
    sizes = np.array([len(h) for h in held])
    doc, flat = np.repeat(np.arange(len(ids)), sizes), np.concatenate(held).astype(np.int64)
    del held
    summed = lambda v: np.bincount(doc, v[flat], len(ids)).astype(np.int64)
    # distinct chunks of each document, then its distinct groups
    pairs, times = np.unique(doc << 32 | flat, return_counts=True)
    d, c = pairs >> 32, pairs & 0xFFFFFFFF
    starts = np.cumsum(counts) - counts
    member = members[_taken(starts[c], counts[c])].astype(np.int64)
    of = np.repeat(d, counts[c]) << 32 | member
    distinct, at = np.unique(of, return_inverse=True)
    times = np.bincount(at, np.repeat(times, counts[c]), len(distinct)).astype(np.int32)
    d, member = distinct >> 32, distinct & 0xFFFFFFFF
    n = np.bincount(d, minlength=len(ids))
    docs = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), number)), pa.array(ids, pa.int64()), *(pa.array(summed(v)) for v in (per_a, per_b, counts)), pa.array(digests, pa.string()), split_rows(member.astype("<i4"), n), split_rows(times.astype("<i4"), n)],
        names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "members", "times"],
    )
    yield from some_rows(docs, 2000)
    keys = pa.RecordBatch.from_arrays([pa.array(np.full(len(groups), number)), pa.array(np.arange(len(groups), dtype=np.int32)), pa.array(groups, pa.string())], names=["block", "member", "key"])
    yield from some_rows(keys)
    # links once per distinct group, then the distinct pairs of each document
    group, a, b = links_of(groups, lengths)
    names, pair = np.unique(a << 32 | b, return_inverse=True)
    links = np.bincount(group, minlength=len(groups))
    begin = np.cumsum(links) - links
    seen = np.unique(np.repeat(d, links[member]) << 32 | pair[_taken(begin[member], links[member])])
    docs_of = np.bincount(seen & 0xFFFFFFFF, minlength=len(names))
    held_by = docs_of > 0
    counted = pa.RecordBatch.from_arrays([pa.array((names[held_by] >> 32).astype(np.int32)), pa.array((names[held_by] & 0xFFFFFFFF).astype(np.int32)), pa.array(docs_of[held_by])], names=["a", "b", "docs"])
    yield from some_rows(counted)


def group_links(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """From key (a group's ids as text): a row per link, key, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path_a, path_b)
        for batch in batches:
            keys = batch.column(0)
            group, a, b = links_of(keys.to_pylist(), lengths)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(group)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["key", "a", "b"])

    return groups.select("key").mapInArrow(run, "key string, a int, b int")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _by_document(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A block's documents with the counts of its groups (member, best, total)."""
    order = known.column("member").to_numpy()
    best, total = np.zeros((2, int(order.max(initial=-1)) + 1), np.int64)
    best[order], total[order] = known.column("best").to_numpy(), known.column("total").to_numpy()
    n_best, count_sum = [], []
    for m, t in zip(docs.column("members"), docs.column("times"), strict=True):
        member, times = np.frombuffer(m.as_buffer(), "<i4"), np.frombuffer(t.as_buffer(), "<i4").astype(np.int64)
        n_best.append(int(best[member] @ times))
        count_sum.append(int(total[member] @ times))
    col = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
    links = pa.array(col["n_a"].to_numpy() + col["n_b"].to_numpy() - col["n_groups"].to_numpy(), pa.int64())
    return pa.table([col["doc_id"], col["n_a"], col["n_b"], col["n_groups"], links, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), col["groups_sha256"]], names=[c.split()[0] for c in RESULT.split(", ")])


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, docs (documents that hold the pair linked), best (whether no other pair of a is in more), from the blocks' counts."""
    pairs = found.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    pairs = written(pairs, "alignment-pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: RESULT. path_a: a byte-level tokenizer's file; path_b: a piece model."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in in_blocks(batches, 1):
            yield from align_block(number, own, path_a, path_b)

    kinds = written_kinds(rows, make, KINDS, "alignment")
    distinct = kinds["groups"].select("key").distinct()
    links = group_links(distinct, path_a, path_b).join(pair_counts(kinds["pairs"]), ["a", "b"])
    known = links.groupBy("key").agg(F.sum("best").alias("best"), F.sum("docs").alias("total"))
    members = kinds["groups"].join(known, "key").select("block", "member", "best", "total")
    return kinds["docs"].groupBy("block").cogroup(members.groupBy("block")).applyInArrow(_by_document, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE against pieces, over all documents."""
    import public_tokenizers

    small_batches(spark)
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
