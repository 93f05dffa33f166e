"""Source trees as tables, listed level by level: Spark's own listing leaves out names that begin with ``_`` or ``.``, and
gathers all names on the driver."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.config import inside
from plumbline.sources.shared import written
from plumbline.sources.walks import Walk, walked

#: Bytes and files of one partition that reads contents.
BYTES_A_PARTITION, FILES_A_PARTITION = 64 << 20, 256
FOUND = "place string, file string, folder boolean, size long"


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def listed(spark: SparkSession, path: str, skip: set[str] = frozenset()) -> DataFrame:
    """place, file (relative to path), size of all files below path; folders whose name is in ``skip`` or begins with a dot aren't
    entered, links that lead out are left aside. A round lists all folders of one depth in parallel, and is written."""
    top = _uri(path)
    root = pafs.FileSystem.from_uri(top)[1]

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(top)[0]
        for batch in batches:
            for place, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for x in fs.get_file_info(pafs.FileSelector(place)):
                    folder = x.type == pafs.FileType.Directory
                    if (x.base_name not in skip and not x.base_name.startswith(".")) if folder else inside(top, x.path):
                        rows.append((x.path, posixpath.join(at, x.base_name), folder, x.size))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["place", "file", "folder", "size"])

    folders = spark.createDataFrame([(root, "")], "place string, file string")
    levels: list[DataFrame] = []
    while True:
        found = written(folders.mapInArrow(children, FOUND), "tree-level")
        levels.append(found)
        folders = found.filter("folder").select("place", "file")
        if folders.isEmpty():
            break
        folders = folders.repartition("place")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.filter("not folder").select("place", "file", "size")


def in_walk_order(files: DataFrame) -> DataFrame:
    """walk_ord: the place of each file in a walk that takes the entries of every folder by name. Rows are sorted by their
    paths' parts over partitions and numbered in each; the driver adds up a row a partition."""
    rows = files.orderBy(F.split("file", "/"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(range(at, at + len(batch)), pa.int64())], names=[*batch.schema.names, "part", "own"])
            at += len(batch)

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    placed = written(rows.mapInArrow(running, f"{spec}, part int, own long"), "tree-order")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    offset = files.sparkSession.createDataFrame(offsets, "part int, begin long")
    return placed.join(F.broadcast(offset), "part").withColumn("walk_ord", (F.col("begin") + F.col("own")).cast("int")).drop("part", "own", "begin")


def source_tree(spark: SparkSession, path: str, walk: Walk) -> DataFrame:
    """file (relative to path), walk_ord, content of the files below path that the walk takes. Contents are read by partitions
    of about as many bytes."""
    top = _uri(path)
    files = in_walk_order(listed(spark, path, walk.skip)).filter(walked(F.col("file"), walk))
    size = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    parts = max(1, -(-size.bytes // BYTES_A_PARTITION), -(-size.files // FILES_A_PARTITION))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(top)[0]
        for batch in batches:
            for k, place in enumerate(batch.column(0).to_pylist()):
                with fs.open_input_stream(place) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), batch.column(2).slice(k, 1), pa.array([text])], names=["file", "walk_ord", "content"])

    return files.select("place", "file", "walk_ord").repartition(parts, "place").mapInArrow(contents, "file string, walk_ord int, content string")
