"""Query of nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.ann import nearest


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
