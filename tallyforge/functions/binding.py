"""Naming a value within a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it. A column used several times is written out
    as often, and chains of such uses grow until they are too large to compile."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def required(why: Column) -> Column:
    """A condition for rows that are fine; a row with a reason against it is an error. As a filter it is never left out,
    whatever columns are read."""
    return F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(F.lit(True))
