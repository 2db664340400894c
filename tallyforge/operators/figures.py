"""Figures read from passages: equality, matches, faults and their census, calls behind values, conversations as rows.

A figure: ``struct<metric string, value double, unit string, year int, description string>``."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import printed as N
from tallyforge.functions.citations import first_object
from tallyforge.functions.labels import unit_key
from tallyforge.functions.periods import near
from tallyforge.functions.text import squeeze
from tallyforge.sizes import placed

#: Powers of named scales, the description of a change, patterns that make "other" a metric.
POWERS = (3, 5, 6, 7, 9)
CHANGE = "change"
FIGURE = "struct<metric:string,value:double,unit:string,year:int,description:string>"
EXPRESSION = r"\d\s*\*\*\s*\d"


def same(want: Column, got: Column) -> Column:
    """Whether two figures agree on metric, value, unit and year."""
    return F.coalesce(want["metric"].eqNullSafe(got["metric"]) & near(want["value"], got["value"]) & unit_key(want["unit"]).eqNullSafe(unit_key(got["unit"])) & want["year"].eqNullSafe(got["year"]), F.lit(False))


def described(figure: Column, passage: Column) -> Column:
    """A description that names something in the passage, if the metric is other; else none, or that it is a change."""
    d = figure["description"]
    other = (F.coalesce(d, F.lit("")) != "") & (passage.isNull() | F.contains(squeeze(passage), squeeze(d)))
    return F.when(figure["metric"] != "other", d.isNull() | (d == CHANGE)).otherwise(F.coalesce(other, F.lit(False)))


def undescribed(figures: Column, passage: Column) -> Column:
    return F.filter(figures, lambda f: ~described(f, passage))


def named(labels: Column) -> Column:
    """Whether any label has a metric of its own."""
    return F.exists(labels, lambda x: x["metric"] != "other")


def needs_call(expected: Column, passage: Column, calls: Column | None = None) -> Column:
    """Whether an answer takes a calculation: its label made one, or else some value isn't printed as it is."""
    printed = N.printed_numbers(passage)
    unprinted = F.exists(expected, lambda f: ~F.exists(printed, lambda p: p == F.abs(f["value"])))
    return unprinted if calls is None else F.coalesce(F.size(calls) > 0, unprinted)


def found_as(label: Column, figure: Column) -> Column:
    """Whether a figure is the number that a label asks for, as printed or at a named scale, in its year (any without)."""
    values = F.when(label["call"].isNull(), F.array(*[label["value"] * 10.0**k for k in (0, *POWERS)])).otherwise(F.array(label["value"]))
    fits = F.exists(values, lambda v: near(v, figure["value"]))
    return (label["year"].isNull() | F.coalesce(label["year"] == figure["year"], F.lit(False))) & fits


def missed(labels: Column, figures: Column) -> Column:
    """Labels that no figure is."""
    return F.filter(labels, lambda x: ~F.exists(figures, lambda f: found_as(x, f)))


def scaled(want: Column, got: Column) -> Column:
    """Whether a number is another times a power of ten."""
    power = F.log10(F.abs(F.try_divide(got, want)))
    return F.coalesce((want != 0) & (got != 0) & (F.abs(power - F.bround(power)) < 1e-6), F.lit(False))


def inferred_call(value: Column, passage: Column) -> Column:
    """The call behind a value that its passage doesn't print: a printed number over 100, or else times a named scale; null if
    it is printed or none gives it. Of several numbers the least counts."""
    printed = N.printed_numbers(passage)
    size, sign = F.abs(value), F.when(value < 0, "-").otherwise("")
    text = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    close = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    by_hundred = F.transform(F.filter(printed, lambda n: close(n / 100, size)), lambda n: F.concat(sign, text(n), F.lit(" / 100")))

    def times(k: int) -> Column:
        return F.transform(F.filter(printed, lambda n: close(n * 10.0**k, size)), lambda n: F.concat(sign, text(n), F.lit(f" * 10**{k}")))

    tries = [by_hundred, *map(times, POWERS)]
    return F.when(~F.exists(printed, lambda n: n == size), F.get(F.concat(*tries), F.lit(0)))


def parsed(text: Column) -> Column:
    """Figures of the first JSON object in a reply; null if there is none or it doesn't fit."""
    whole = F.from_json(first_object(text), f"figures array<{FIGURE}>", {"mode": "PERMISSIVE"})
    fits = F.forall(whole["figures"], lambda f: f["metric"].isNotNull() & f["value"].isNotNull())
    return F.when(fits, whole["figures"])


def _close(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def faults_of(want: list[dict], got: list[dict] | None, final: str, called: bool, needed: bool) -> list[str]:
    """Every way in which an answer departs from its case; figures carry ``key`` (of the unit) and ``described``.

    Each wanted figure uses up an equal one, else one of the same value, else a hundredfold, else one off by a power of
    ten."""
    out = ["no call when needed"] * (needed and not called) + ["call when not needed"] * (called and not needed)
    if got is None:
        return [*out, "expression in JSON" if re.search(EXPRESSION, final or "") else "invalid JSON"]
    left = list(got)
    power = lambda a, b: a != 0 and b != 0 and abs(math.log10(abs(b / a)) - round(math.log10(abs(b / a)))) < 1e-6
    rules = (
        lambda w, g: g["described"] and _close(w["value"], g["value"]) and all(w[k] == g[k] for k in ("metric", "key", "year")),
        lambda w, g: _close(w["value"], g["value"]),
        lambda w, g: _close(w["value"] * 100, g["value"]),
        lambda w, g: power(w["value"], g["value"]),
    )
    for w in want:
        kind, hit = next(((i, g) for i, rule in enumerate(rules) for g in left if rule(w, g)), (None, None))
        if kind is None:
            out.append("missed")
            continue
        left.remove(hit)
        if kind == 1:
            out += ["metric"] * (w["metric"] != hit["metric"])
            if w["key"] != hit["key"]:
                out.append("unit" if hit["key"] in (None, "INR", "USD", "AUD", "EUR", "GBP") else "unit not a currency")
            if w["year"] != hit["year"]:
                out.append("year added" if w["year"] is None else "year dropped" if hit["year"] is None else "year wrong")
            out += ["description"] * (not hit["described"])
        elif kind > 1:
            out.append("percentage not converted" if kind == 2 else "wrong scale")
    return out + ["extra"] * len(left)


def answered(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """``id, faults``: kinds of faults of each case's (``id, passage, expected`` and, if there, ``label_calls``) prediction
    (``id, final, calls``), in order; none for a perfect one, and a missing one is one fault."""
    both = rows.join(predictions.withColumn("here", F.lit(True)), "id", "left")
    passage = F.col("passage")
    plain = lambda f: F.struct(f["metric"].alias("metric"), f["value"].alias("value"), unit_key(f["unit"]).alias("key"), f["year"].alias("year"), described(f, passage).alias("described"))
    as_json = lambda figures: F.to_json(F.transform(figures, plain), {"ignoreNullFields": "false"})
    needed = needs_call(F.col("expected"), passage, F.col("label_calls") if "label_calls" in rows.columns else None)
    flat = both.select("id", "here", as_json(F.col("expected")).alias("want"), as_json(parsed(F.col("final"))).alias("got"), F.coalesce("final", F.lit("")).alias("final"), F.coalesce(F.size("calls") > 0, F.lit(False)).alias("called"), needed.alias("needed"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [["no prediction"] if here is not True else faults_of(json.loads(w), json.loads(g) if isinstance(g, str) else None, t, bool(c), bool(n)) for here, w, g, t, c, n in zip(*(f[x] for x in ("here", "want", "got", "final", "called", "needed")), strict=True)]
            yield pd.DataFrame({"id": f["id"], "faults": found})

    return flat.mapInPandas(run, f"id {kind}, faults array<string>")


def census(faulty: DataFrame) -> DataFrame:
    """How often each fault occurs, the commonest first."""
    return faulty.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fault")


def matched(rows: DataFrame) -> DataFrame:
    """``id, found, missed, extra, recall, described`` of cases with ``expected`` and ``got`` figures.

    Each wanted figure uses up one equal one; equality is by class, so classes are counted within the case and nothing is paired
    or shuffled. Values count to ten digits, which parts classes as the tolerance does but at its very edge."""
    kind = lambda f: F.struct(f["metric"].alias("m"), F.format_string("%.9e", f["value"]).alias("v"), unit_key(f["unit"]).alias("u"), f["year"].alias("y"))
    n = lambda side: F.greatest(F.size(side), F.lit(0)).cast("long")
    times = lambda side, c: n(F.filter(side, lambda x: x.eqNullSafe(c)))
    fine = F.size(undescribed(F.col("got"), F.col("passage"))) <= 0
    classed = rows.select("id", fine.alias("described"), F.transform("expected", kind).alias("w"), F.transform("got", kind).alias("g"))
    found = F.aggregate(F.array_distinct("w"), F.lit(0).cast("long"), lambda s, c: s + F.least(times(F.col("w"), c), times(F.col("g"), c)))
    out = classed.select("id", "described", F.coalesce(found, F.lit(0).cast("long")).alias("found"), *[n(c).alias(c) for c in "wg"])
    out = out.select("id", "described", "found", (F.col("w") - F.col("found")).alias("missed"), (F.col("g") - F.col("found")).alias("extra"))
    return out.withColumn("recall", F.when(F.col("found") + F.col("missed") > 0, F.col("found") / (F.col("found") + F.col("missed"))).otherwise(1.0))


def totals(graded: DataFrame) -> DataFrame:
    """One row of an arm's numbers: ``graded`` has what ``matched`` gives, ``parsed``, ``called`` and ``needed``."""
    passed = (F.col("missed") == 0) & (F.col("extra") == 0) & F.col("described")
    return graded.agg(
        F.count("*").alias("cases"),
        F.count_if(passed).alias("passed"),
        F.count_if("parsed").alias("parsed"),
        F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall"),
        F.count_if(F.col("missed") == 0).alias("all_found"),
        F.count_if(F.col("extra") == 0).alias("no_extra"),
        F.count_if("described").alias("described"),
        F.count_if(F.col("needed") & F.col("called")).alias("called_when_needed"),
        F.count_if("needed").alias("needed"),
        F.count_if(~F.col("needed") & F.col("called")).alias("called_when_not"),
        F.count_if(~F.col("needed")).alias("not_needed"),
    )


def conversation_rows(turns: DataFrame, prefix: str = "va") -> DataFrame:
    """``id, conv_id, passage, wanted, prompt, reply``: conversations (``conv_id, turn, role, text``) as rows to evaluate: what the
    first user turn holds as passage and question, and the last assistant turn. Rows are numbered by conversation."""
    order = lambda role, last: F.expr(f"{'max_by' if last else 'min_by'}(CASE WHEN role = '{role}' THEN text END, CASE WHEN role = '{role}' THEN turn END)")
    g = turns.groupBy("conv_id").agg(order("user", False).alias("prompt"), order("assistant", True).alias("reply"))
    inner = lambda tag: F.nullif(F.regexp_extract("prompt", rf"(?s)<{tag}>(.*)</{tag}>", 1), F.lit(""))
    return placed(g, ["conv_id"]).select(F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("id"), "conv_id", F.coalesce(inner("passage"), "prompt").alias("passage"), inner("wanted").alias("wanted"), "prompt", "reply")


def label_calls(messages: Column) -> Column:
    """Expressions of the calculations that a conversation's messages (JSON array) made."""
    kind = "array<struct<tool_calls:array<struct<function:struct<arguments:struct<expression:string>>>>>>"
    calls = F.flatten(F.transform(F.from_json(messages, kind), lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<function:struct<arguments:struct<expression:string>>>>"))))
    return F.transform(calls, lambda c: c["function"]["arguments"]["expression"])
