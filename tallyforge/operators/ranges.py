"""Joins by order: the latest row before, and points within intervals. No task needs a whole key, however large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _present(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, values: list[str], *, within: Column | None = None) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the latest row of ``right`` of the same ``on`` whose ``at`` isn't after theirs; null if
    there is none. Of right rows at the same place the one with the greatest values (in their order) counts. ``within``: a condition
    on ``at`` and ``found_at`` that the row found must meet, else the values are null. Rows without a key or place find nothing.

    Both sides are one table, dealt to ranges of (on, at): in each range the last right row is carried forward. What a key that
    goes on from earlier ranges brings along is a row a range, so that a key of most rows is many tasks' work. Ranges are kept
    until the session ends or storage is needed, as another deal might part them elsewhere."""
    names = [c for c in left.columns if c not in on and c != at]
    mine = left.select(*on, at, F.lit(1).alias("_tag"), F.struct(*names, F.lit(0).alias("_")).alias("_row"))
    kind = right.select(F.struct(F.col(at).alias("found_at"), *values).alias("v")).schema["v"].dataType
    theirs = right.filter(_present([*on, at])).select(*on, at, F.lit(0).alias("_tag"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.struct(F.col(at).alias("found_at"), *values).alias("_hit"))
    both = theirs.unionByName(mine.filter(_present([*on, at])).withColumn("_hit", F.lit(None).cast(kind)))
    dealt = both.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(*on, at, "_tag", "_own").withColumn("_p", F.spark_partition_id()).persist()
    order = Window.partitionBy("_p", *on).orderBy(at, "_tag", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("_hit", F.last("_hit", ignorenulls=True).over(order)).filter("_tag = 1")
    # keys of several ranges: what each range inherits, a row a range and such a key, of which a range has two at most
    spans = dealt.groupBy(*on).agg(F.min("_p").alias("_a"), F.max("_p").alias("_z")).filter("_a < _z").select(*on, F.explode(F.sequence("_a", "_z")).alias("_p"))
    ends = dealt.filter("_tag = 0").groupBy("_p", *on).agg(F.max("_hit").alias("_end"))
    before = Window.partitionBy(*on).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(ends, ["_p", *on], "left").withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select("_p", *on, "_before")
    found = filled.join(F.broadcast(carried), ["_p", *on], "left").withColumn("_hit", F.coalesce("_hit", "_before"))
    out = found.select(*on, at, *[F.col(f"_row.{c}").alias(c) for c in names], F.col("_hit.found_at").alias("found_at"), *[F.col(f"_hit.{c}").alias(c) for c in values])
    if within is not None:
        fits = F.coalesce(within, F.lit(False))
        out = out.withColumns({c: F.when(fits, F.col(c)) for c in values}).withColumn("found_at", F.when(fits, F.col("found_at")))
    lost = left.filter(~_present([*on, at])).select(*on, at, *names, *[F.lit(None).cast(kind[c].dataType).alias(c) for c in ("found_at", *values)])
    return out.unionByName(lost).select(*left.columns, "found_at", *values)


def within(points: DataFrame, windows: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """Every point with every window of the same ``on`` that it lies in, ends included: columns of both. ``at``, ``low`` and ``high``
    are whole numbers. Points and windows without a key or place meet nothing; a window that ends before it begins is empty.

    A window lies in one or two bins of the least power of two that is no shorter than it; a point has one bin of each such width
    that windows have. So neither side is copied by the other's size, windows may be of any length, and a bin where much meets
    is a key of an inner join, which Spark splits when it is skewed."""
    length = F.col(high).cast("long") - F.col(low).cast("long") + 1
    w = windows.filter(_present([*on, low, high]) & (length > 0)).withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    bins = F.array_distinct(F.array(*[F.expr(f"shiftright(CAST(`{c}` AS BIGINT), _level)") for c in (low, high)]))
    w = w.withColumn("_bin", F.explode(bins))
    levels = [r[0] for r in w.select("_level").distinct().collect()]  # 64 at most
    p = points.filter(_present([*on, at]))
    places = F.array(*[F.struct(F.lit(v).alias("_level"), F.shiftright(F.col(at).cast("long"), v).alias("_bin")) for v in sorted(levels)]) if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")
    p = p.select("*", F.inline(places))
    return p.join(w, [*on, "_level", "_bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_bin")
