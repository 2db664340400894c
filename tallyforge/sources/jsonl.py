"""Strict JSON Lines datasets: one case a line, blank lines and ``//`` comments skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id string, input string, expected string, tags array<string>"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` with line numbers from 1. Files are read whole: they are hand-written datasets."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "value")).select("file", (F.col("pos") + 1).alias("line"), F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))


def cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cases of all files. Broken JSON, a key that isn't known, an empty or repeated id, or no case at all is an error
    that names file and line."""
    rows = None
    for p in paths:
        one = numbered(spark, p).filter((F.col("value") != "") & ~F.col("value").startswith("//"))
        rows = one if rows is None else rows.unionByName(one)
    keys = F.expr("json_object_keys(value)")
    parsed = rows.select("file", "line", F.from_json("value", CASE).alias("c"), keys.alias("keys"))
    bad = parsed.select("file", "line", F.when(F.col("keys").isNull() | F.col("c").isNull(), "is no JSON object").when(F.size(F.array_except("keys", F.array(*map(F.lit, ("id", "input", "expected", "tags"))))) > 0, "has an unknown key").when(F.coalesce(F.col("c.id"), F.lit("")) == "", "has no id").alias("why")).filter("why IS NOT NULL").orderBy("file", "line").first()
    if bad:
        raise ValueError(f"{bad.file}, line {bad.line}: it {bad.why}")
    out = parsed.select("file", "line", "c.*")
    twice = out.groupBy("id").agg(F.count("*").alias("n"), F.max("line").alias("line")).filter("n > 1").orderBy("line").first()
    if twice:
        raise ValueError(f"line {twice.line}: id {twice.id} is there {twice.n} times")
    if out.isEmpty():
        raise ValueError("there is no case")
    return out.select("id", "input", "expected", "tags")


def digest(spark: SparkSession, path: str) -> str:
    """The first 12 hex digits of a file's SHA-256."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 12)).first()[0]
