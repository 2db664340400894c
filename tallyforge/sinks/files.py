"""Files that are written whole or not at all, through the file system of their path, so that any store will do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _paths(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, *, replace: bool = True) -> str:
    """Writes a small text under a hidden name and moves it into place. Without ``replace`` a file that is there is an error."""
    fs, p = _paths(spark, path)
    if fs.exists(p) and not replace:
        raise FileExistsError(path)
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    hidden = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex[:8]}")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(hidden, p):
        raise OSError(f"{path} can't be written")
    return path


def free_name(spark: SparkSession, folder: str, base: str, suffix: str) -> str:
    """A name that no file has yet: the base, else with -2, -3 and so on."""
    n, path = 1, f"{folder}/{base}{suffix}"
    while exists(spark, path):
        n += 1
        path = f"{folder}/{base}-{n}{suffix}"
    return path


def write_rows(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON Lines in an order that goes on from file to file; null fields are written."""
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log, which is never rewritten."""
    rows.write.mode("append").parquet(path)


def write_vectors(vectors: DataFrame, folder: str, version: str, keep: int = 1) -> None:
    """A version of a vector store (``text_key, v``); all but the newest ``keep`` others are swept once it is complete."""
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{folder}/version={version}")
    fs, p = _paths(spark, folder)
    others = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("version=") and s.getPath().getName() != f"version={version}"), key=lambda s: s.getModificationTime(), reverse=True)
    for old in others[keep - 1 :]:
        fs.delete(old.getPath(), True)


def read_vectors(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """A version of the store; an empty one if it isn't there or was never completed."""
    path = f"{folder}/version={version}"
    if not exists(spark, f"{path}/_SUCCESS"):
        return spark.createDataFrame([], "text_key string, v array<double>")
    return spark.read.schema("text_key string, v array<double>").parquet(path)
