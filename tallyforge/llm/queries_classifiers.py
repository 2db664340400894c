"""Queries of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import shared, toxicity
from tallyforge.llm.language import identified, train
from tallyforge.llm.toxicity import scored


def fold(folds: int):
    """crc32 of the id's text, by the number of folds. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.cased(shared.documents(spark, sf_dir), "doc_id", "text", "lang")
    model = train(docs.filter(fold(4) != 2))
    return identified(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    labels = shared.cased(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic").filter(fold(3) != 1)
    return scored(docs, toxicity.train(docs, labels)).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")
