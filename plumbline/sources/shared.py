"""Tables that cut a lineage: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on a local master without one, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_within: ContextVar[str] = ContextVar("_within", default="")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_within.get()}{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written into the shared folder inside of this block is deleted at its end."""
    folder = f"scratch-{uuid.uuid4().hex}/"
    before = _within.set(folder)
    try:
        yield
    finally:
        _within.reset(before)
        deleted(spark, f"{shared_dir(spark)}/{folder}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: survives lost executors, keeps no lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that no later result reads."""
    for t in tables:
        if t is not None:
            deleted(t.sparkSession, t.written_path)
