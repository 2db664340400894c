"""Fiscal times as they are asked for, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.periods import PERIODS, span

LENGTHS = {3: "3M", 6: "6M", 9: "9M", 12: "12M"}
QUARTERS = ("Q1", "Q2", "Q3", "Q4")


def _by_period(period: Column, value) -> Column:
    out = F.lit(None)
    for row in PERIODS:
        out = F.when(period == row[0], F.lit(value(row))).otherwise(out)
    return out


def as_time(period: Column) -> Column:
    """``struct<quarter, length>`` of a period: the quarter at whose end it ends, and how long it is."""
    return F.struct(_by_period(period, lambda r: r[3]).alias("quarter"), _by_period(period, lambda r: LENGTHS[r[4]]).alias("length"))


def as_period(quarter: Column, length: Column, snapshot: Column) -> Column:
    """``struct<period, refusal>`` of a quarter and a length. A snapshot has no length and is as at the quarter's end; a
    flow has one, and ends where a filing has such a span."""
    wanted = F.coalesce(length, F.lit("3M"))
    period = F.lit(None).cast("string")
    for row in PERIODS:
        period = F.when((quarter == row[3]) & (wanted == LENGTHS[row[4]]), row[0]).otherwise(period)
    refusal = (
        F.when(snapshot & length.isNotNull(), "a snapshot has no length")
        .when(~snapshot & length.isNull(), "a flow needs a length")
        .when(period.isNull(), "no filing holds such a span")
    )
    return F.struct(F.when(refusal.isNull(), period).alias("period"), refusal.alias("refusal"))


def opening_of(year: Column, period: Column) -> Column:
    """``struct<year, period>`` of the quarter whose end is the day before a period begins."""
    first = _by_period(period, lambda r: r[1])
    quarter = F.concat(F.lit("Q"), F.floor((first - 1) / 3).cast("string"))
    return F.struct(F.when(first == 1, year - 1).otherwise(year).alias("year"), F.when(first == 1, "Q4").otherwise(quarter).alias("period"))


def span_of(year: Column, period: Column) -> tuple[Column, Column]:
    """First and last day of a period."""
    return span(year, _by_period(period, lambda r: r[1]), _by_period(period, lambda r: r[2]))


def interval_refusal(year: Column, period: Column, was_year: Column, was: Column) -> Column:
    """Why an earlier time can't be compared with a later one; null if it can: as long, and over before it begins."""
    alike = (period == was) | (period.isin(*QUARTERS) & was.isin(*QUARTERS))
    return F.when(~alike, "not as long").when(span_of(was_year, was)[1] >= span_of(year, period)[0], "does not end before")


def named(year: Column, period: Column) -> Column:
    return F.concat(F.when(period == "year", "").otherwise(F.concat(period, F.lit(" "))), F.lit("FY"), year.cast("string"))


def period_phrase(year: Column, period: Column, was_year: Column, was: Column, snapshot: Column) -> Column:
    """The time that a figure is at, or the two that it compares."""
    told = F.concat(named(year, period), F.when(was.isNotNull(), F.concat(F.lit(" over "), named(was_year, was))).otherwise(""))
    return F.when(snapshot, F.concat(F.lit("as at the end of "), told)).otherwise(told)


def now() -> Column:
    """The time in UTC, to the second; not the same in two runs."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
