"""The fact table: keys, snapshots, look-ups, checks, share events.

A fact is one row: concept, period (start null for an instant), segment, value, unit, decimals, tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sizes import sized

KEY = ("concept", "period_start", "period_end", "segment", "unit")
CHECKED = ("xbrl", "xbrl-filed", "row", "read", "derived")
UNCHECKED = "xbrl-ai"


def fact_key() -> list[Column]:
    """Null start and segment compare as empty."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in KEY]


def sync(held: DataFrame, parsed: DataFrame, by: tuple[str, ...] = (), rest: bool = False) -> DataFrame:
    """Makes a filing's facts equal its parse. ``filing_id``, the key, value, decimals of both; tier and verified_by of
    what is held. Returns all rows with ``change``: kept, added, changed or removed; of a changed fact the tier goes back
    to unchecked and its verification is cleared. One join on the key; only filings that were parsed take part, or with
    ``rest`` the facts of others come along as ``other``. ``by`` are columns of both that follow from the filing: sides that
    are dealt by them aren't dealt again, and they are returned."""
    asked = parsed.select(*by, "filing_id").distinct().withColumn("asked", F.lit(True))
    ours = held.join(asked, [*by, "filing_id"], "left" if rest else "inner").select(*by, "filing_id", *fact_key(), *KEY, "value", "decimals", "tier", "verified_by", "asked")
    new = parsed.select(*by, "filing_id", *fact_key(), *[F.col(c).alias(f"n_{c}") for c in (*KEY, "value", "decimals")], F.lit(True).alias("here"))
    both = ours.withColumn("there", F.lit(True)).join(new, [*by, "filing_id", *[f"k_{c}" for c in KEY]], "full_outer")
    same = F.col("value").eqNullSafe(F.col("n_value")) & F.col("decimals").eqNullSafe(F.col("n_decimals"))
    change = F.when(F.col("there").isNull(), "added").when(F.col("asked").isNull(), "other").when(F.col("here").isNull(), "removed").when(same, "kept").otherwise("changed")
    fresh = F.col("change").isin("added", "changed")
    return both.withColumn("change", change).select(
        *by,
        "filing_id",
        *[F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c) for c in KEY],
        *[F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "decimals")],
        F.when(fresh, UNCHECKED).otherwise(F.col("tier")).alias("tier"),
        F.when(~fresh, F.col("verified_by")).alias("verified_by"),
        "change",
    )


def without_dependants(derived: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """Derived facts none of whose inputs (``links(fact_id, input_id)``) are among ``changed(input_id)``."""
    return derived.join(links.join(changed.select("input_id"), "input_id", "left_semi").select("fact_id").distinct(), "fact_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str], keep_if_null: list[str]) -> DataFrame:
    """New rows replace old ones by key; columns in ``keep_if_null`` keep the old value where the new one is null."""
    n = new.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in (*update, *keep_if_null)], F.lit(True).alias("n_here"))
    return old.join(n, key, "full_outer").select(key, *[F.when(F.col("n_here"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in update], *[F.coalesce(f"n_{c}", c).alias(c) for c in keep_if_null])


def lookup(facts: DataFrame, wanted: DataFrame, *, k: int = 5) -> DataFrame:
    """One fact a concept, ``wanted(concept, place)``: checked before unchecked, then the earliest filing (null first);
    concepts in the order asked, at most ``k``."""
    order = F.row_number().over(Window.partitionBy("concept").orderBy((~F.col("tier").isin(*CHECKED)).cast("int"), F.col("filed").asc_nulls_first(), "fact_id"))
    best = facts.join(sized(wanted), "concept").withColumn("o", order).filter("o = 1").drop("o")
    return best.orderBy("place").limit(k)


def mostly_instants(facts: DataFrame) -> DataFrame:
    """Concepts with more instants than durations."""
    return facts.groupBy("concept").agg(F.count_if(F.col("period_start").isNull()).alias("instants"), F.count_if(F.col("period_start").isNotNull()).alias("durations")).filter("instants > durations")


def sum_issues(facts: DataFrame, total: str, parts: list[str], optional: list[str], by: list[str]) -> DataFrame:
    """Where a total differs from the sum of its parts by more than the roundings allow. Without a needed part or the
    total nothing is checked."""
    names = [total, *parts, *optional]
    pick = lambda c, what: F.max(F.when(F.col("concept") == c, F.col(what)))
    wide = facts.filter(F.col("concept").isin(names)).groupBy(*by).agg(*[pick(c, "value").alias(f"v{i}") for i, c in enumerate(names)], *[F.max(F.when(F.col("concept") == c, 0.5 * F.pow(F.lit(10.0), -F.coalesce("decimals", F.lit(2))))).alias(f"t{i}") for i, c in enumerate(names)])
    n = len(parts)
    added = sum((F.col(f"v{i}") for i in range(1, n + 1)), F.lit(0.0)) + sum((F.coalesce(f"v{i}", F.lit(0.0)) for i in range(n + 1, len(names))), F.lit(0.0))
    slack = sum((F.coalesce(f"t{i}", F.lit(0.0)) for i in range(len(names))), F.lit(0.0))
    return wide.select(*by, F.col("v0").alias("stated"), added.alias("added"), slack.alias("slack")).filter(F.abs(F.col("stated") - F.col("added")) > F.col("slack"))


def promote(derived: DataFrame, links: DataFrame, facts: DataFrame) -> DataFrame:
    """Derived facts all of whose inputs are checked."""
    open_ = links.join(facts.filter(~F.col("tier").isin(*CHECKED)).select(F.col("fact_id").alias("input_id")), "input_id", "left_semi").select("fact_id").distinct()
    return derived.join(open_, "fact_id", "left_anti")


def jumps(counts: DataFrame, events: DataFrame | None = None, *, by: str = "ticker", share: float = 0.05) -> DataFrame:
    """Consecutive counts (``by, period_end, count``) that differ by more than ``share`` with no dated event after the
    first and up to the second: ``by, seen_from, seen_to, seen_ratio``."""
    w = Window.partitionBy(by).orderBy("period_end")
    pairs = counts.select(by, F.lag("period_end").over(w).alias("seen_from"), F.col("period_end").alias("seen_to"), F.try_divide(F.col("count").cast("double"), F.lag("count").over(w).cast("double")).alias("seen_ratio"))
    found = pairs.filter(F.abs(F.col("seen_ratio") - 1) > share)
    if events is None:
        return found
    e = events.select(F.col(by).alias("e_by"), "effective")
    return found.join(e, (F.col(by) == F.col("e_by")) & (F.col("effective") > F.col("seen_from")) & (F.col("effective") <= F.col("seen_to")), "left_anti")


def restated(inputs: DataFrame, events: DataFrame, *, by: str = "ticker") -> DataFrame:
    """Per-share values (``by, input_id, published, value``) on the share basis of the latest publication of their
    company: times before / after of each event (``by, effective, multiplier, checked``) since. An unchecked event in
    between leaves the value null."""
    latest = inputs.withColumn("latest", F.max("published").over(Window.partitionBy(by)))
    e = events.select(F.col(by).alias("e_by"), "effective", "multiplier", "checked")
    joined = latest.join(e, (F.col(by) == F.col("e_by")) & (F.col("effective") > F.col("published")) & (F.col("effective") <= F.col("latest")), "left")
    factor = F.coalesce(F.product(F.when(F.col("multiplier") != 1, F.col("multiplier"))), F.lit(1.0))
    return joined.groupBy(by, "input_id", "published", "value").agg(factor.alias("factor"), F.coalesce(F.bool_or(~F.col("checked")), F.lit(False)).alias("open")).select(by, "input_id", F.when(~F.col("open"), F.col("value") * F.col("factor")).alias("restated"))
