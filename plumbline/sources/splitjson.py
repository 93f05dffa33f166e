"""JSON reports that are too large for a task, read by byte ranges.

A JSON text can be cut anywhere once two things are known at the cut: whether it lies in a string, and how deep. Both follow
from all bytes before, but each range can say what it changes, for either state it may begin in: a first pass gives a row a
range, the driver adds them up, and then every task can find the members of an object in its range by itself, reading on
over its end to finish the last one. So a report of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 16 << 20
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"{[")], _DEPTH[list(b"}]")] = 1, -1


def _read(path: str, start: int, length: int) -> bytes:
    fs, own = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(own) as f:
        f.seek(start)
        return f.read(length)


def _backslashes(path: str, at: int) -> int:
    """How many stand right before a place."""
    count = 0
    while at - count > 0:
        size = min(4096, at - count)
        raw = _read(path, at - count - size, size)
        run = len(raw) - len(raw.rstrip(b"\\"))
        count += run
        if run < size:
            break
    return count


def _quotes(raw: np.ndarray, before: int) -> np.ndarray:
    """1 at each quotation mark that no backslash escapes; before: backslashes that stand before the range."""
    place = np.arange(len(raw))
    other = np.maximum.accumulate(np.where(raw != 92, place, -1))  # the last place that is no backslash
    run = np.where(np.append(-1, other[:-1]) < 0, place + before, place - 1 - np.append(-1, other[:-1]))
    return (raw == 34) & (run % 2 == 0)


def _depths(raw: np.ndarray, quotes: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is outside of strings, and its change of the depth (0 within strings)."""
    outside = ((np.cumsum(quotes) + within) % 2 == 0) & ~quotes
    return outside, np.where(outside, _DEPTH[raw], 0)


def _member_name(path: str, at: int) -> str | None:
    """The name of the member whose value begins at a place; None in arrays and at the top."""
    size = 256
    while True:
        start = max(0, at - size)
        raw = _read(path, start, at - start).rstrip()
        if not raw.endswith(b":"):
            return None
        raw = raw[:-1].rstrip()
        end = len(raw) - 1  # the closing quotation mark
        k = raw.rfind(b'"', 0, end)
        while k > 0 and (k - len(raw[:k].rstrip(b"\\"))) % 2:
            k = raw.rfind(b'"', 0, k)
        if k > 0 or (k == 0 and start == 0):
            return json.loads(raw[k:])
        if start == 0:
            return None
        size *= 4


def _ranges(spark: SparkSession, path: str, size: int) -> list[tuple[str, int, int]]:
    fs, own = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(own)
    infos = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(own, recursive=True)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))]
    head = path[: len(path) - len(own)] if path.endswith(own) else "file://"
    return [(head + x.path, start, min(size, x.size - start)) for x in infos for start in range(0, x.size, size)]


def _tasks(spark: SparkSession, ranges: list[tuple]) -> int:
    """Small ranges share tasks: one for each ``RANGE_BYTES``, or a few for each core if that is more."""
    return max(1, min(len(ranges), max(4 * spark.sparkContext.defaultParallelism, sum(r[2] for r in ranges) // RANGE_BYTES)))


def _scan(spark: SparkSession, ranges: list[tuple], columns: str, work, schema: str) -> DataFrame:
    rows = spark.createDataFrame(ranges, columns).repartition(_tasks(spark, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        fields = [pa.field(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                out = list(work(**r))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f.name for f in fields])

    return rows.mapInArrow(run, schema)


def json_members(spark: SparkSession, path: str, member: str | None, size: int = RANGE_BYTES) -> DataFrame:
    """key, value (JSON text): the members of the objects below path; of that object which is the top level's ``member``, or of
    the top level itself (None). path: a file or a folder of files, each one or several JSON texts. ``size``: bytes of a range; it
    doesn't change the result. A text that ends early gives what it has whole."""
    level = 1 if member is None else 2
    ranges = _ranges(spark, path, size)
    if not ranges:
        return spark.createDataFrame([], "key string, value string")

    def changes(path: str, start: int, length: int):
        raw = np.frombuffer(_read(path, start, length), np.uint8)
        quotes = _quotes(raw, _backslashes(path, start))
        yield path, start, int(quotes.sum() % 2), *(int(_depths(raw, quotes, w)[1].sum()) for w in (0, 1))

    def last_open(path: str, start: int, length: int, within: int, depth: int):
        """The last value that begins or ends at the level of the members' object: whether members follow it."""
        raw = np.frombuffer(_read(path, start, length), np.uint8)
        change = _depths(raw, _quotes(raw, _backslashes(path, start)), within)[1]
        after = depth + np.cumsum(change)
        event = np.flatnonzero(((change > 0) & (after == level)) | ((change < 0) & (after == level - 1)))
        if len(event):
            k = int(event[-1])
            yield path, start, bool(raw[k] == ord("{") and (member is None or _member_name(path, start + k) == member))

    def members(path: str, start: int, length: int, within: int, depth: int, inside: bool):
        block, raw, ended = length, b"", False
        while True:  # until the last member that begins in the range is whole
            raw = _read(path, start, block)
            ended = len(raw) < block
            data = np.frombuffer(raw, np.uint8)
            outside, change = _depths(data, _quotes(data, _backslashes(path, start)), within)
            after = depth + np.cumsum(change)
            comma = outside & (data == ord(",")) & (after == level)
            opens, closes = (change > 0) & (after == level), (change < 0) & (after == level - 1)
            cuts = np.flatnonzero(comma | opens | closes)
            if ended or (len(cuts) and cuts[-1] >= length):
                break
            block *= 2
        now, begin = inside, None  # what stands before the first cut belongs to the range before
        for k in cuts.tolist():
            if begin is not None and now:
                yield _pair(raw[begin:k])
            if k >= length:
                return
            if opens[k]:
                now = bool(data[k] == ord("{") and (member is None or _member_name(path, start + k) == member))
            begin = None if closes[k] else k + 1

    def composed(found: list, columns: int, begin: tuple, step) -> list[tuple]:
        """Each range with the state that the ranges of its file before it lead to."""
        by = {(r[0], r[1]): r for r in found}
        out, state, last = [], begin, None
        for r in ranges:
            state = begin if r[0] != last else state
            last = r[0]
            out.append((*r, *state))
            state = step(state, by.get(r[:2]))
        return out

    kinds = "path string, start long, length long"
    first = _scan(spark, ranges, kinds, changes, "path string, start long, odd int, out int, own int").collect()  # a row a range
    states = composed(first, 5, (0, 0), lambda s, r: (s[0] ^ r[2], s[1] + r[3 + s[0]]))
    opened = _scan(spark, states, f"{kinds}, within int, depth int", last_open, "path string, start long, inside boolean").collect()
    inside = composed(opened, 3, (False,), lambda s, r: s if r is None else (r[2],))
    full = [(*s, i[-1]) for s, i in zip(states, inside, strict=True)]
    return _scan(spark, full, f"{kinds}, within int, depth int, inside boolean", members, "key string, value string").filter("key is not null")


def _pair(raw: bytes) -> tuple[str | None, str | None]:
    """Name and value of ``"name": value``; nothing of an empty text."""
    text = raw.decode("utf-8", "replace").strip()
    if not text.startswith('"'):
        return None, None
    name, end = json.decoder.scanstring(text, 1)
    return name, text[end:].lstrip().removeprefix(":").strip()


def as_reports(members: DataFrame, member: str | None) -> DataFrame:
    """report: a small report for each member, which the parsers of whole reports take."""
    name = F.regexp_extract(F.to_json(F.array("key")), r"(?s)\A\[(.*)\]\z", 1)
    own = F.concat(F.lit("{"), name, F.lit(":"), "value", F.lit("}"))
    return members.select((own if member is None else F.concat(F.lit("{" + json.dumps(member) + ":"), own, F.lit("}"))).alias("report"))
