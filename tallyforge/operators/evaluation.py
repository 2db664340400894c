"""Evaluation: graders as columns, reports as aggregates, unions of runs, draws and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sizes import placed, sized


def report(scores: DataFrame) -> DataFrame:
    """``variant, grader, cases, passed, rate, mean_value`` of ``scores(variant, grader, case_id, passed, value, error)``.

    Rows with an error are in no denominator; a null value is not scoreable and in no mean."""
    ok = scores.filter(F.col("error").isNull())
    return ok.groupBy("variant", "grader").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg("value").alias("mean_value")).withColumn("rate", F.try_divide(F.col("passed").cast("double"), F.col("cases").cast("double")))


def per_field(scores: DataFrame) -> DataFrame:
    """Pass rates of the parts (a map) of each score."""
    parts = scores.select("variant", F.explode("parts").alias("field", "ok"))
    return parts.groupBy("variant", "field").agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"))


def combined(runs: list[DataFrame]) -> DataFrame:
    """Union of runs' rows (``variant, case_id, ...``); a variant in two runs is an error."""
    out = runs[0]
    for r in runs[1:]:
        both = out.select("variant").distinct().join(r.select("variant").distinct(), "variant", "left_semi")
        if not both.isEmpty():
            raise ValueError("a variant is in several runs")
        out = out.unionByName(r)
    return out


def verdicts(scores: DataFrame) -> DataFrame:
    """A row passes if it has scores, all pass, and there is no error."""
    return scores.groupBy("variant", "case_id").agg((F.bool_and(F.coalesce("passed", F.lit(False))) & F.bool_and(F.col("error").isNull())).alias("passed"))


def right_tools(called: Column, needed: Column, forbidden: Column) -> Column:
    return (F.size(F.array_except(needed, called)) == 0) & ~F.arrays_overlap(called, forbidden)


def in_order(called: Column, before: Column, after: Column) -> Column:
    """``after`` first occurs only once ``before`` has."""
    b, a = F.array_position(called, before), F.array_position(called, after)
    return (a == 0) | ((b > 0) & (b < a))


def multiset_match(want: DataFrame, got: DataFrame, by: list[str]) -> DataFrame:
    """``case_id, found, missed, extra``: each wanted row uses up one equal row that was got. Equality classes are counted,
    so that no rows are paired."""
    w = want.groupBy("case_id", *by).agg(F.count("*").alias("w"))
    g = got.groupBy("case_id", *by).agg(F.count("*").alias("g"))
    both = w.join(g, ["case_id", *by], "full_outer").select("case_id", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("g", F.lit(0)).alias("g"))
    return both.groupBy("case_id").agg(F.sum(F.least("w", "g")).alias("found"), F.sum(F.greatest(F.col("w") - F.col("g"), F.lit(0))).alias("missed"), F.sum(F.greatest(F.col("g") - F.col("w"), F.lit(0))).alias("extra"))


def stratified(rows: DataFrame, strata: list[str], key: str, quota: int, seed: int = 7) -> DataFrame:
    """``quota`` rows a stratum in the order of a seeded hash (MD5, which any engine has)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("draw", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).filter(F.col("draw") <= quota)


def evenly(rows: DataFrame, by: str, key: str, m: int) -> DataFrame:
    """``m`` rows of each group at even places ``round(i * (n - 1) / (m - 1))``, half to even."""
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"))
    numbered = placed(rows, [key], [by]).withColumn("place", F.col("place").cast("int"))
    of = numbered.join(sized(sizes), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    places = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (F.col("n") - 1) / max(m - 1, 1)).cast("int"))
    return of.filter((F.col("n") <= m) | F.array_contains(places, F.col("place"))).drop("n")


def ledger(usage: DataFrame, prices: DataFrame, limit: float, *, by: str, order: str) -> DataFrame:
    """Cost of each call from token counts and prices per million, the running sum, and whether it trips the limit."""
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6 * F.when(F.col("batched"), 0.5).otherwise(1.0)
    priced = usage.join(sized(prices), "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0)))
    return placed(priced, [order], [by], "cost").withColumnRenamed("total", "spent").drop("place").withColumn("tripped", F.col("spent") > limit)
