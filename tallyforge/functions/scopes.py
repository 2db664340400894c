"""Scopes of definitions: ``*`` for all, or names between commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import scopes_of


def refusal(spec: Column, every: list[str]) -> Column:
    """Why a text can't be a scope; null if it can."""
    named = scopes_of(spec, every)
    unknown = F.size(F.array_except(named, F.array(*map(F.lit, every)))) > 0
    return F.when((F.size(named) == 0) | unknown | (spec.contains("*") & (F.trim(spec) != "*")), "scope is * or a list of known scopes")


def normal(spec: Column, every: list[str]) -> Column:
    """``*`` for all scopes, else their names, sorted, between commas."""
    named = scopes_of(spec, every)
    return F.when(F.size(F.array_except(F.array(*map(F.lit, every)), named)) == 0, "*").otherwise(F.array_join(named, ","))


def covers(spec: Column, scope: Column, every: list[str]) -> Column:
    return F.array_contains(scopes_of(spec, every), scope)
