"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.shared import discard, new_path, shared_dir, written

__all__ = ["NULL_ID", "discard", "fresh", "new_path", "shared_dir", "small_batches", "table", "written"]

#: Rows and bytes of one Arrow batch; whole texts travel in them, so the default of 10,000 rows is too many.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20

NULL_ID = -(2**63)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go through Arrow in batches of at most so many rows and bytes, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> DataFrame | None:
    """As ``written``; None for an empty table."""
    out = written(df, name)
    if out.isEmpty():
        discard(out)
        return None
    return out
