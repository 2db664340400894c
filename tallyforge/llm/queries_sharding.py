"""Query of sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import shared
from tallyforge.llm.sharding import sharded


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(shared.documents(spark, sf_dir), shards=8)


#: DuckDB has no CRC-32: a table of 256 numbers and a step for each byte would be the slow way for whole texts,
#: so no SQL is given for the query; tests hold it against brute force.
ORACLE_SQL: dict[str, str] = {}
