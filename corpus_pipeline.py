"""The five stages from raw documents to token files; each is written as Parquet and read again by the next.

A stage takes documents with any further columns, and all but the last return the columns they got. Null and empty texts
are scored like others, have no near-duplicates and no benchmark windows, come at their source's rate, and are records of the
end id alone; rows with a null id are kept as the rows they are. Repeated rows are one group of near-duplicates if their
text has words. Empty tables pass through all stages. Labels may be missing: then all documents stay (score 0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import new_path, small_batches, table
from plumbline.llm.decontam import drop_contaminated
from plumbline.llm.mixing import free_name, mix_sources
from plumbline.llm.neardup import drop_near_duplicates
from plumbline.llm.quality import KEEP_FROM, fit_quality, score_quality
from plumbline.llm.tokens import token_rows
from plumbline.sources.shared import deleted, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name("score", docs.columns)
    return score_quality(docs, model, score_col=score).filter(F.col(score) >= KEEP_FROM).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the rates of their sources say, in a random order."""
    mixed = mix_sources(docs)
    return mixed.drop(*mixed.columns[len(docs.columns) :])


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the record files; the rows describe the records read back."""
    return token_rows(spark, docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_records", token_records)]

#: A fitted classifier and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes beside its result is deleted when the result is written, and the
    result when the next one is; the token files stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
