"""The corpus pipeline: from ``documents`` to a mix for training.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; stages are written as Parquet in the shared folder and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import kernels, op3_jaccard, op4_langid, op5_decontaminate, op6_mixing, op10_lines
from simloom.plans import durable

#: SQL can't express a trained network or earliest-deadline-first scheduling.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; lang becomes the prediction where it is null and a language could be learned.

    Null and empty texts have no letter and go; very long texts are read whole.
    Repeated rows go or stay together. Rows with a null doc_id are treated like others.
    """
    pred, score = (kernels.unused(c, docs.columns) for c in ("_pred", "_score"))
    told = op4_langid.predict(docs, op4_langid.train(docs), docs.columns, pred, score)
    told = told.where((F.col(pred) != "und") | F.col("text").rlike(r"\p{L}"))
    return told.withColumn("lang", F.coalesce("lang", F.nullif(F.col(pred), F.lit("und")))).select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one; an empty text stays empty, rows with a null doc_id keep all lines."""
    return op10_lines.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest doc_id, in one row; documents without words stay."""
    return op3_jaccard.near_copies_removed(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all their rows; documents without words or doc_id stay."""
    return op5_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row in the mix of sources; a null source is a source of its own."""
    return op6_mixing.mix(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable.table(stage(spark, docs, sf_dir), name)
    return docs
