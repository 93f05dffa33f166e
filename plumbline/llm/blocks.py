"""Interning by blocks: what the operators on tokens, phrases and language models share.

A task cuts its rows into blocks of at most ``BLOCK_BYTES`` of text (one longer text is a block of its own) and numbers the
distinct entries of each: words, or groups of token ids. Documents then hold small numbers only, and the dictionary has a row
per block and distinct entry. Whatever is to be known of an entry over the whole corpus is found on the dictionary, where a
frequent entry has one row per block instead of one per occurrence, and comes back by a cogroup on the block: no document is
ever shuffled by a word of its own, so no frequent word makes a hot key, and a block's share of both sides has a bound.

Blocks are written to the shared folder before anything reads them, so that their numbers stay as they are when an executor
is lost.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import new_path
from plumbline.llm.words import runs

#: Small, as executors of 3 GB are to hold several tasks; a larger block has fewer entries per text.
BLOCK_BYTES = 8 << 20
#: Of text whose words are found together.
PART_BYTES = 3 << 20
#: Bytes that are hashed together.
HASHED = 1 << 19
_NUMBERS = np.random.default_rng(47).integers(0, 2**64, 256, np.uint64)
#: The end of a text as a word: no word is empty.
END = b""


def release() -> None:
    """Gives freed memory back to the system: a Python worker stays when its task ends, beside the workers of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words b[start:end]."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + HASHED)))
        base = start[at]
        out[at:to] = runs(_NUMBERS[b[base : end[to - 1]]], start[at:to] - base, end[at:to] - base)
        at = to
    return out


class WordBlock:
    """The words of some texts, numbered; a word is a run of bytes outside of ``gaps``, A-Z as a-z. Words of texts with other
    ``keys`` (one number a text) are other entries. ``breaks``, a line end among them, part a text into pieces, each of which
    comes after a number -1; ``ends`` adds the entry END to each text."""

    def __init__(self, gaps: np.ndarray, breaks: np.ndarray | None = None, ends: bool = False) -> None:
        self.gaps, self.breaks, self.ends = gaps, breaks, ends
        self.hashes: list[np.ndarray] = []
        self.words: list[list[bytes]] = []
        self.firsts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.size = self.rows = 0

    def add(self, texts: list[bytes], keys: np.ndarray) -> None:
        begin = size = 0
        for k, t in enumerate(texts):
            if size and size + len(t) > PART_BYTES:
                self._add(texts[begin:k], keys[begin:k])
                begin, size = k, 0
            size += len(t)
        self._add(texts[begin:], keys[begin:])

    def _add(self, texts: list[bytes], keys: np.ndarray) -> None:
        joined = b"\n".join([*texts, b""]).lower()
        b = np.frombuffer(joined, np.uint8)
        gap = self.gaps[b]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        upto = np.searchsorted(start, begins)
        sizes = np.diff(upto)
        text = np.repeat(np.arange(len(texts)), sizes)
        h = word_hashes(b, start, end)
        h = (h ^ keys[text].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) if len(h) else h
        if self.ends:
            h, text = np.insert(h, upto[1:], np.uint64(1)), np.insert(text, upto[1:], np.arange(len(texts)))
            start, end = np.insert(start, upto[1:], begins[1:] - 1), np.insert(end, upto[1:], begins[1:] - 1)
            sizes = sizes + 1
        distinct, first, own = np.unique(h, return_index=True, return_inverse=True)
        own = own.astype(np.int32)
        self.words.append([joined[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        self.hashes.append(distinct)
        self.firsts.append(text[first] + self.rows)
        if self.breaks is not None:  # -1 before each piece
            piece = np.cumsum(self.breaks[b], dtype=np.int32)[start]
            own = np.insert(own, np.flatnonzero(np.diff(piece, prepend=-1)), -1)
        self.ids.append(own)
        self.sizes.append(sizes)
        self.rows += len(texts)
        self.size += len(joined)

    def numbered(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words; the text where each stands first; the numbers of all words in order; how many each text has."""
        distinct, first = np.unique(np.concatenate(self.hashes), return_index=True)
        words = [w for some in self.words for w in some]
        texts = np.concatenate(self.firsts)
        ids = []
        for h, own in zip(self.hashes, self.ids, strict=True):
            to = np.append(np.searchsorted(distinct, h), -1).astype(np.int32)
            ids.append(to[own])
        return [words[k] for k in first.tolist()], texts[first], np.concatenate(ids), np.concatenate(self.sizes)


def in_blocks(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[tuple[int, Iterator[tuple[pa.RecordBatch, list[bytes]]]]]:
    """The number of each block and its batches, with their texts as bytes (null: empty)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, size, number = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        texts = [t or b"" for t in batch.column(text_column).cast(pa.binary()).to_pylist()]
        new = sum(map(len, texts))
        if held and size + new > BLOCK_BYTES:
            yield (part << 32) + number, iter(held)
            held, size, number = [], 0, number + 1
        held.append((batch, texts))
        size += new
    if held:
        yield (part << 32) + number, iter(held)


def split_rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value a row: the little-endian bytes of its share of values."""
    values = np.ascontiguousarray(values)
    wide = values.dtype.itemsize
    ends = np.concatenate([[0], np.cumsum(sizes)]) * wide
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def some_rows(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


#: Bytes of a kind that a task holds before it writes them.
HELD_BYTES = 8 << 20


def written_kinds(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: dict[str, str], name: str) -> dict[str, DataFrame]:
    """Runs ``make``, whose batches hold the columns of one kind each, once; a table of the shared folder for each kind,
    which ``discard`` deletes.

    A task writes a Parquet file of each kind itself, so that what it makes doesn't pass through the JVM once more; the driver
    gets the names, a row a file, of tasks that ended. Files of failed attempts are never named."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    names = {k: [c.strip().split(" ")[0] for c in spec.split(",")] for k, spec in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, root = pafs.FileSystem.from_uri(path)
        held: dict[str, list[pa.RecordBatch]] = {k: [] for k in kinds}
        files: dict[str, tuple[str, pq.ParquetWriter]] = {}

        def flush(kind: str) -> None:
            if held[kind]:
                if kind not in files:
                    fs.create_dir(f"{root}/{kind}", recursive=True)
                    file = f"{kind}/{uuid.uuid4().hex}.parquet"
                    files[kind] = file, pq.ParquetWriter(f"{root}/{file}", held[kind][0].schema, compression="zstd", filesystem=fs)
                files[kind][1].write_table(pa.Table.from_batches(held[kind]))
                held[kind].clear()

        for batch in make(batches):
            kind = next(k for k in kinds if names[k] == batch.schema.names)
            held[kind].append(batch)
            if sum(b.nbytes for b in held[kind]) > HELD_BYTES:
                flush(kind)
        for kind in kinds:
            flush(kind)
        for _, writer in files.values():
            writer.close()
        release()
        yield pa.RecordBatch.from_arrays([pa.array(list(files)), pa.array([f for f, _ in files.values()], pa.string())], names=["kind", "file"])

    made = rows.mapInArrow(run, "kind string, file string").collect()
    out = {}
    for kind, spec in kinds.items():
        own = sorted(f"{path}/{r.file}" for r in made if r.kind == kind)
        out[kind] = spark.read.schema(spec).parquet(*own) if own else spark.createDataFrame([], spec)
        out[kind].written_path = f"{path}/{kind}"
    return out


def saved(rows: DataFrame, name: str) -> DataFrame:
    """As ``written``, for rows that come out of Python: the tasks that make them write them."""
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return written_kinds(rows, lambda batches: batches, {"rows": spec}, name)["rows"]
