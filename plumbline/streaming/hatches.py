"""An extension for files that arrive over time: hits per pattern and window of arrival, as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.escape import hatches


def hit_counts(files: DataFrame, patterns: dict[str, str], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """files: a stream of file, content, arrived -> window, pattern, hits. Late files count up to the watermark."""
    stamped = files.withWatermark("arrived", late)
    # the arrival time travels in the file column's place: hits are found line by line, without state
    keyed = stamped.select(F.struct("file", "arrived").alias("file"), "content")
    found = hatches(keyed, patterns).select(F.col("file.arrived").alias("arrived"), "pattern")
    return found.groupBy(F.window("arrived", window).alias("window"), "pattern").agg(F.count(F.lit(1)).alias("hits"))
