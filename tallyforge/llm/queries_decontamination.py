"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import shared
from tallyforge.llm.decontamination import leaks


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
