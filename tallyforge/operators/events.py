"""Changes of share counts: events found and seeded, checked by a person, and what they do to figures per share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.lookup import event_multiplier, event_text, event_within, ratio_parsed

#: The least jump of a share count, and kinds of events.
JUMP, RESTATING = 0.05, ("bonus", "split")


def detected(counts: DataFrame, events: DataFrame, share: float = JUMP) -> DataFrame:
    """``ticker, kind, seen_from, seen_to, seen_ratio, tier`` of each move of a company's share count (``ticker, period_end,
    count``) between two filings that no event held (``ticker, effective, seen_from, seen_to``) may explain."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    moves = counts.select("ticker", F.lag("period_end").over(w).alias("seen_from"), F.col("period_end").alias("seen_to"), (F.col("count") / F.lag("count").over(w)).alias("seen_ratio")).filter(F.abs(F.col("seen_ratio") - 1) > share)
    e = events.select(F.col("ticker").alias("e_ticker"), F.col("effective").alias("e_day"), F.col("seen_from").alias("e_from"), F.col("seen_to").alias("e_to"))
    near = (F.col("ticker") == F.col("e_ticker")) & event_within(F.col("e_day"), F.col("e_from"), F.col("e_to"), F.col("seen_from"), F.col("seen_to"))
    return moves.join(e, near, "left_anti").select("ticker", F.lit("unknown").alias("kind"), "seen_from", "seen_to", "seen_ratio", F.lit("share-event-ai").alias("tier"))


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("ticker", F.coalesce("effective", "seen_to"), "id")


def verified(events: DataFrame, checks: DataFrame) -> DataFrame:
    """Events with a person's checks (``id, person, kind, effective, ratio``): ``refusal`` why a check doesn't hold, else the event
    with what the person says, of tier share-event, and whether that changed anything.

    A check needs a person; an unknown event needs its kind and its day, which must lie in its window, and a bonus or split
    its ratio; an issue has none."""
    c = checks.select("id", F.col("person").alias("c_person"), F.col("kind").alias("c_kind"), F.col("effective").alias("c_day"), F.col("ratio").alias("c_ratio"))
    rows = events.join(c, "id")
    kind = F.coalesce("c_kind", F.when(F.col("kind") != "unknown", F.col("kind")))
    day, given = F.coalesce("c_day", "effective"), ratio_parsed(F.col("c_ratio"))
    rows = rows.withColumns({"new_kind": kind, "new_day": day, "given": given})
    restates = F.col("new_kind").isin(*RESTATING)
    said = F.coalesce(F.trim("c_ratio"), F.lit("")) != ""
    why = (
        F.when(F.coalesce(F.trim("c_person"), F.lit("")) == "", "say who checked it")
        .when(F.col("new_kind").isNull(), "an unknown event needs its kind")
        .when(~F.col("new_kind").isin(*RESTATING, "issue"), "kind is bonus, split or issue")
        .when(F.col("new_day").isNull(), "an unknown event needs its day")
        .when(F.col("seen_from").isNotNull() & ~((F.col("new_day") > F.col("seen_from")) & (F.col("new_day") <= F.col("seen_to"))), "its day is outside the window")
        .when(~restates & said, "an issue restates nothing; give no ratio")
        .when(restates & said, F.col("given.refusal"))
        .when(restates & F.col("after").isNull(), "a bonus or split needs its ratio")
    )
    rows = rows.withColumn("refusal", why)
    after = F.when(restates, F.when(said, F.col("given.after")).otherwise(F.col("after")))
    before = F.when(restates, F.when(said, F.col("given.before")).otherwise(F.col("before")))
    rows = rows.withColumns({"new_after": after, "new_before": before})
    same = (F.col("tier") == "share-event") & F.col("kind").eqNullSafe(F.col("new_kind")) & F.col("effective").eqNullSafe(F.col("new_day")) & F.col("after").eqNullSafe(F.col("new_after")) & F.col("before").eqNullSafe(F.col("new_before"))
    fine = F.col("refusal").isNull()
    pick = lambda new, old: F.when(fine, F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select("id", "ticker", pick("new_kind", "kind"), pick("new_day", "effective"), pick("new_after", "after"), pick("new_before", "before"), F.when(fine, "share-event").otherwise(F.col("tier")).alias("tier"), F.when(fine & ~same, F.trim("c_person")).otherwise(F.col("verified_by")).alias("verified_by"), "refusal", (fine & ~same).alias("changed"))


def restatements(inputs: DataFrame, events: DataFrame) -> DataFrame:
    """``query_id, path, multiplier, events, refusal`` of per-share inputs (``query_id, ticker, path, published``) whose filing came
    before a change of shares: the product of the changes up to the day of the question's latest filing.

    Companies without events, and questions of one input, have none. A missing day of publication, or an unchecked event
    in between, is refused; events that change no figure don't count."""
    known = events.select("ticker").distinct().withColumn("has", F.lit(True))
    rows = inputs.join(known, "ticker", "left_semi")
    of = Window.partitionBy("query_id")
    rows = rows.withColumns({"n": F.count("*").over(of), "latest": F.max("published").over(of), "unknown": F.max(F.col("published").isNull()).over(of)}).filter("n > 1")
    e = events.select(F.col("ticker").alias("e_ticker"), "effective", "seen_from", "seen_to", event_multiplier(F.col("before"), F.col("after")).alias("m"), (F.col("tier") == "share-event").alias("checked"), event_text(F.struct(*[c for c in events.columns])).alias("said"))
    near = (F.col("ticker") == F.col("e_ticker")) & event_within(F.col("effective"), F.col("seen_from"), F.col("seen_to"), F.col("published"), F.col("latest"))
    joined = rows.join(e, near, "left")
    counts = F.col("checked") & (F.col("m") != 1)
    g = joined.groupBy("query_id", "path", "unknown").agg(F.product(F.when(counts, F.col("m"))).alias("multiplier"), F.array_sort(F.collect_list(F.when(counts, F.col("said")))).alias("events"), F.count_if(~F.col("checked")).alias("open"))
    why = F.when(F.col("unknown"), "a day of publication is not held").when(F.col("open") > 0, "filed before a change of shares that nobody has checked")
    out = g.withColumn("refusal", why)
    return out.select("query_id", "path", F.when(F.col("refusal").isNull(), F.col("multiplier")).alias("multiplier"), "events", "refusal").filter("multiplier IS NOT NULL OR refusal IS NOT NULL")


def publication_days(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts with the day on which their filing was published, null if it isn't known."""
    return facts.join(filings.select("filing_id", F.to_date("broadcast").alias("published")), "filing_id", "left")


def multiplied(value: Column, multiplier: Column) -> Column:
    return value * F.coalesce(multiplier, F.lit(1.0))
