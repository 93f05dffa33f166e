"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A record file holds one frame per document, in ascending order of the document's id:

    uint64  length of the data            uint32  masked CRC-32 of those eight bytes
    data    width (uint8: 2 or 4), id present (uint8), id (int64), token ids of that width, all little-endian
    uint32  masked CRC-32 of the data

The mask rotates the CRC right by 15 bits and adds 0xA282EAD8, so that a CRC over data that holds CRCs stays useful.
Beside ``x.rec`` lies ``x.idx`` with three int64 a record: byte offset, document id, number of tokens; a reader finds
any record by it without a scan, which is what the option ``shuffle_seed`` uses. ``MANIFEST.json`` names the files that
the job committed, in order, with the number of tokens before each. Files of failed attempts are never named in it.

Nulls count as empty texts and give the end id alone; a null id sorts first and is read back as null; rows that repeat
an id follow each other in the order of a hash of their text; an empty table gives a manifest without files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 1
#: Chunks between spaces whose ids a worker remembers (twice as many with older ones), and the longest that it remembers.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 48
READ = "doc_id long, start long, n_tokens long, ids binary, file int, offset long"
HEAD, META = struct.Struct("<QI"), struct.Struct("<BBq")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


# encoding


@lru_cache(maxsize=2)
def id_width(path: str) -> int:
    """Bytes that hold every id of a tokenizer, from its file alone."""
    with open(path) as f:
        spec = json.load(f)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ())), END_ID]
    return 2 if max(ids) < 65536 else 4


#: Fixed names of the tokenizer format: pre-tokenizers that part words at white space and drop it, and normalizers that work
#: character by character within words.
PARTING = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
WITHIN_WORDS = {"Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents", "BertNormalizer"}


def _drops_spaces(pre: dict) -> bool:
    """Whether a pre-tokenizer keeps matches of a pattern only, none of which can hold white space, or is known for it."""
    if pre.get("type") != "Split":
        return pre.get("type") in PARTING
    pattern = re.sub(r"\[\^\\s[^\[\]]*\]", "", pre["pattern"].get("Regex", " "))
    return pre.get("behavior") == "Removed" and pre.get("invert", False) and not re.search(r"\s|\\s|\.|\[\^|\\[WPDSXRhv]", pattern)


def _within_words(norm: dict) -> bool:
    spaces = norm.get("type") == "Replace" and norm["pattern"] == {"Regex": "\\s+"} and norm["content"] == " "
    return norm.get("type") in WITHIN_WORDS or spaces


def parts_at_spaces(spec: dict) -> bool:
    """Whether the ids of a text are those of its chunks between spaces and line ends, joined."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0] if pre.get("type") == "Sequence" else pre
    norms = norm.get("normalizers", []) if norm.get("type") == "Sequence" else [norm] if norm else []
    spans = any(set(" \n") & set(t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ()))
    return _drops_spaces(first) and all(map(_within_words, norms)) and not spans


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian integers. Where the tokenizer's file says that spaces and line ends always part words,
    the chunks between them are encoded once each and remembered; else the whole text is encoded.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    kind = np.dtype(f"<u{id_width(path)}")
    with open(path) as f:
        parting = parts_at_spaces(json.load(f))

    def whole(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, kind).tobytes()

    known: dict[str, bytes] = {"": b""}
    older: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        nonlocal known, older
        chunks = text.replace("\n", " ").split(" ")
        distinct = dict.fromkeys(chunks)
        new = [c for c in distinct if c not in known]
        if not new:
            return b"".join(map(known.__getitem__, chunks))
        if len(known) + len(new) > CACHE_CHUNKS:  # frequent chunks come back from the older ones
            older, known = known, {"": b""}
            new = [c for c in distinct if c]
        extra: dict[str, bytes] = {}
        missing = []
        for c in new:
            if (ids := older.get(c)) is None:
                missing.append(c)
            else:
                known[c] = ids
        for c, e in zip(missing, t.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            (known if len(c) <= CACHE_CHARS and len(known) < CACHE_CHUNKS else extra)[c] = np.array(e.ids, kind).tobytes()
        if extra:
            return b"".join([extra[c] if c in extra else known[c] for c in chunks])
        return b"".join(map(known.__getitem__, chunks))

    chosen = encode if parting else whole
    chosen.end = np.array([END_ID], kind).tobytes()
    return chosen


# the file format


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _manifest(path: str) -> dict | None:
    fs, root = _fs(path)
    if fs.get_file_info(f"{root}/MANIFEST.json").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/MANIFEST.json") as f:
        return json.loads(f.read())


WRITTEN = "part int, name string, records long, tokens long"


def write_partition(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, width: int) -> Iterator[pa.RecordBatch]:
    """Encodes doc_id, text and writes them as one file with its index; gives one row about it (WRITTEN)."""
    from pyspark import TaskContext

    encode = _tokenizer(tokenizer)
    part = TaskContext.get().partitionId()
    name = f"part-{part:05d}-{uuid.uuid4().hex}"
    fs, root = _fs(path)
    out, index, tokens, offset = None, [], 0, 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.rec")
            ids = encode(text.as_py() or "") + encode.end
            data = META.pack(width, doc_id is not None, doc_id or 0) + ids
            size = struct.pack("<Q", len(data))
            out.write(b"".join((size, struct.pack("<I", masked_crc(size)), data, struct.pack("<I", masked_crc(data)))))
            index.append((offset, doc_id or 0, len(ids) // width))
            tokens += len(ids) // width
            offset += len(data) + HEAD.size + 4
    if out is not None:
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array(index, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "name", "records", "tokens"])


def read_partition(batches: Iterator[pa.RecordBatch], path: str, seed: int | None) -> Iterator[pa.RecordBatch]:
    """From number, name, start of files: their records (READ)."""
    fs, root = _fs(path)
    for batch in batches:
        for number, name, begin in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            with fs.open_input_stream(f"{root}/{name}.idx") as f:
                index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
            starts = begin + np.cumsum(index[:, 2]) - index[:, 2]
            order = np.arange(len(index))
            if seed is not None:
                order = np.random.default_rng([seed, number]).permutation(order)
            with fs.open_input_file(f"{root}/{name}.rec") as f:
                rows, size = [], 0
                for k in order:
                    f.seek(int(index[k, 0]))
                    length, crc = HEAD.unpack(f.read(HEAD.size))
                    if crc != masked_crc(struct.pack("<Q", length)):
                        raise ValueError(f"{name}: broken length at {index[k, 0]}")
                    data = f.read(length)
                    if struct.unpack("<I", f.read(4))[0] != masked_crc(data):
                        raise ValueError(f"{name}: broken data at {index[k, 0]}")
                    width, present, doc_id = META.unpack_from(data)
                    ids = np.frombuffer(data, f"<u{width}", offset=META.size).astype("<u4").tobytes()
                    rows.append((doc_id if present else None, int(starts[k]), len(ids) // 4, ids, number, int(index[k, 0])))
                    size += len(ids)
                    if size >= 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    names = ["doc_id", "start", "n_tokens", "ids", "file", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_records(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the record files in ascending order of the ids (one range of ids a file). Tasks encode
    and write; the driver gets a row a file. Files that the folder holds already stay, and come before the new ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    width = id_width(tokenizer)
    done = ordered.mapInArrow(lambda b: write_partition(b, path, tokenizer, width), WRITTEN).collect()
    before = _manifest(path)
    files, start = (list(before["files"]), before["tokens"]) if before else ([], 0)
    for r in sorted(done, key=lambda r: r.part):
        files.append({"name": r.name, "records": r.records, "tokens": r.tokens, "start": start})
        start += r.tokens
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    new = f"{root}/MANIFEST-{uuid.uuid4().hex}.json"
    with fs.open_output_stream(new) as out:
        out.write(json.dumps({"tokens": start, "files": files}).encode())
    fs.move(new, f"{root}/MANIFEST.json")  # readers see the old list or the new one


def read_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, start (tokens before it), n_tokens, ids (little-endian uint32), and where the record lies (file, offset).

    Checks every checksum. With ``shuffle_seed`` files and the records in each come in a random order, by the index.
    """
    manifest = _manifest(path)
    if manifest is None:
        raise ValueError(f"{path} holds no MANIFEST.json")
    files = [(k, x["name"], x["start"]) for k, x in enumerate(manifest["files"])]
    rank = np.arange(len(files)) if shuffle_seed is None else np.random.default_rng(shuffle_seed).permutation(len(files))
    listed = spark.createDataFrame([(*f, int(r)) for f, r in zip(files, rank, strict=True)], "number int, name string, start long, rank int")
    dealt = listed.repartitionByRange(max(len(files), 1), "rank") if len(files) > 1 else listed
    return dealt.mapInArrow(lambda b: read_partition(b, path, shuffle_seed), READ)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the record files of ``documents`` and reads them back."""
    from plumbline.llm.common import table

    return token_rows(spark, table(spark, sf_dir, "documents"))


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.common import shared_dir, small_batches

    small_batches(spark)
    path = f"{shared_dir(spark)}/token-records-{uuid.uuid4().hex}"  # the files are the result: they stay
    write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
