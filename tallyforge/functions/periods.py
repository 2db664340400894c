"""Fiscal periods (years end in March) and figures over them, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Period, first and last month from April of the year before, quarter, length in months, opening.
PERIODS = (
    ("year", 1, 12, "Q4", 12, None),
    ("Q1", 1, 3, "Q1", 3, None),
    ("Q2", 4, 6, "Q2", 3, "Q1"),
    ("Q3", 7, 9, "Q3", 3, "Q2"),
    ("Q4", 10, 12, "Q4", 3, "Q3"),
    ("H1", 1, 6, "Q2", 6, None),
    ("9M", 1, 9, "Q3", 9, None),
)


def period_table(spark: SparkSession) -> DataFrame:
    """The seven periods; ``opening`` null is Q4 of the year before."""
    return spark.createDataFrame(PERIODS, "period string, first int, last int, quarter string, months int, opening string")


def fiscal_year(day: Column) -> Column:
    return F.year(day) + (F.month(day) > 3).cast("int")


def fiscal_quarter(day: Column) -> Column:
    return F.concat(F.lit("Q"), (F.floor(F.pmod(F.month(day) - 4, F.lit(12)) / 3) + 1).cast("string"))


def span(year: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """First and last day of the months counted from April of ``year - 1``."""
    start = F.make_date(year - 1, F.lit(4), F.lit(1))
    return F.add_months(start, first - 1), F.last_day(F.add_months(start, last - 1))


def months_of(start: Column, end: Column) -> Column:
    """Months of a span by its days, half to even; 0 for an instant."""
    return F.coalesce(F.bround((F.datediff(end, start) + 1) / 30.44).cast("int"), F.lit(0))


def growth(current: Column, previous: Column) -> Column:
    """Null over a base of zero."""
    return F.when(previous != 0, (current - previous) / F.abs(previous))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def average(a: Column, b: Column) -> Column:
    return (a + b) / 2


def tolerance(decimals: Column) -> Column:
    """Half a unit of the last digit for each figure, added up; unbounded precision counts as two digits."""
    return F.aggregate(decimals, F.lit(0.0), lambda s, d: s + 0.5 * F.pow(F.lit(10.0), -F.coalesce(d, F.lit(2))))


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def agrees(a: Column, b: Column, share: float = 0.005) -> Column:
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))
