"""Sizes that decide how plans run: what may be broadcast, how hot keys are joined, whether an input is spread out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most bytes of rows that are broadcast, and the most keys that count as hot beyond them.
BROADCAST_BYTES, HOT_KEYS = 32 << 20, 10_000


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""

    def width(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.greatest(F.size(column), F.lit(0)) * 16 + 16
        if isinstance(kind, T.StructType):
            return sum((width(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))


def small(df: DataFrame) -> bool:
    """Whether all rows together may be broadcast. ``df`` is read for this, so it should be cheap or written."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows take few bytes, else as it is."""
    return F.broadcast(df) if small(df) else df


def joined_by_size(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` with the row of ``right`` (a written table, one row a key) of its keys; ``how`` is inner or left.

    A small ``right`` is broadcast. Of a larger one, those keys are that stand for more than one ``HOT_KEYS``-th of all
    ``weight`` (rows of ``left`` with the key), which are fewer than ``HOT_KEYS``; the others are joined by a shuffle, in
    which no key then has more than that share. ``weight`` isn't returned."""
    if small(right):
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    total = right.agg(F.sum(weight)).first()[0]
    hot = right.filter(F.col(weight) * HOT_KEYS > total).drop(weight)
    rest = right.filter(F.col(weight) * HOT_KEYS <= total).drop(weight)
    there = left.join(F.broadcast(hot), keys)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return there.unionByName(others)


def spread(df: DataFrame) -> DataFrame:
    """Rows read from files, dealt over all cores if the input has fewer splits than there are. Inputs of many splits, and
    what is more than a scan, are left alone."""
    plan = df._jdf.queryExecution()
    if any(name in plan.optimizedPlan().toString() for name in ("Join", "Aggregate", "Window", "Repartition", "Sort", "Generate", "Union")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, for work that takes far longer than a shuffle of what it reads: splits of a file can
    be as many as the cores and yet hold all rows in one."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """For rows written within it: sides of a join that are both dealt by some of its keys aren't dealt again by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def placed(rows: DataFrame, order: list, by: list[str] | None = None, value: str | None = None, name: str = "place") -> DataFrame:
    """Rows with their place from 0 in an order, within each group of ``by`` if given, and with ``value`` the sum of it up to
    the row as ``total``.

    Rows are dealt to ranges of the order; each range numbers its own, and the counts and sums of ranges before it, a row a
    range and group, are added. So no task needs a whole group, however few there are. Ranges are kept, as another deal might
    part them elsewhere."""
    by = by or []
    ranges = rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()).persist()
    own = Window.partitionBy("_p", *by).orderBy(*order)
    inner = ranges.withColumn("_i", F.row_number().over(own) - 1)
    sums = [F.count("*").alias("_n")] + ([F.sum(value).alias("_s")] if value else [])
    of = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_p", *by).agg(*sums).withColumn("_before", F.coalesce(F.sum("_n").over(of), F.lit(0)))
    if value:
        inner = inner.withColumn("_v", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        before = before.withColumn("_sum", F.coalesce(F.sum("_s").over(of), F.lit(0.0)))
    keys = F.col("_p") == F.col("_q")
    for c in by:
        keys = keys & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    side = before.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_by_{c}") for c in by], "_before", *(["_sum"] if value else []))
    out = inner.join(sized(side), keys).withColumn(name, F.col("_before") + F.col("_i"))
    if value:
        out = out.withColumn("total", F.col("_sum") + F.col("_v"))
    return out.select(*rows.columns, name, *(["total"] if value else []))
