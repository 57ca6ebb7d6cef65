"""The corpus pipeline: five stages over ``documents``, each one of the operators of ``tracelake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; where a text changes, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.decontaminate import remove_contamination
from tracelake.llm.jaccard_join import keep_one
from tracelake.llm.mixing import mix_report
from tracelake.llm.scratch import Scratch
from tracelake.llm.secret_scan import redact
from tracelake.llm.toxicity import fit, with_score


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that may have changed, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; nulls and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, fit(docs, labels), name).where(F.col(name) < 0.5).select(docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; texts without words all stay."""
    return keep_one(docs, words_per_shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts; other texts stay byte by byte."""
    return _counted(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; other texts stay."""
    return _counted(redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: a row per document with the words it takes and its training position."""
    return mix_report(docs)


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: The score of the first stage is a fitted model's, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
