"""Graders, which cost nothing, as columns, and the runner of cases by variants.

A score is ``struct<passed, detail, value, parts>``; ``expected`` and ``output`` are columns of JSON objects. Each grader is made
by a function of what it looks at and gives a function of both columns. A missing label is the dataset's fault, a missing
field the answer's; the detail says which."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import python as P
from tallyforge.operators import retrieval as R

Grader = Callable[[Column, Column], Column]


def score(passed: Column, detail: Column | None = None, value: Column | None = None, parts: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.coalesce(detail if detail is not None else none.cast("string"), F.lit("")).alias("detail"),
        (value if value is not None else none).cast("double").alias("value"),
        (parts if parts is not None else none).cast("map<string,boolean>").alias("parts"),
    )


def _both(want: Column, got: Column, name: str) -> Column:
    """What is missing of a label and a field; null if nothing."""
    return F.when(want.isNull(), f"dataset has no expected '{name}'").when(got.isNull(), f"output has no '{name}'")


def exact_match(name: str = "answer") -> Grader:
    text = P.field_text(name)

    def grade(expected: Column, output: Column) -> Column:
        want, got = text(expected), text(output)
        return score(want == got, F.coalesce(_both(want, got, name), F.when(want != got, F.concat(F.lit("expected "), want, F.lit(", got "), got))))

    return grade


def contains(name: str = "answer") -> Grader:
    text = P.field_text(name)

    def grade(expected: Column, output: Column) -> Column:
        want, got = text(expected), text(output)
        return score(F.contains(got, want), F.coalesce(_both(want, got, name), F.when(~F.contains(got, want), F.concat(want, F.lit(" not found")))))

    return grade


def _phrases(name: str, label: str, wanted: bool, says: str) -> Grader:
    bad_of = P.phrases(name, label, wanted)

    def grade(expected: Column, output: Column) -> Column:
        bad = bad_of(expected, output)
        return score(F.size(bad) == 0, F.when(bad.isNull(), f"expected '{label}' must be a list").when(F.size(bad) > 0, F.concat(F.lit(says), F.array_join(bad, ", "))))

    return grade


def includes(name: str = "answer") -> Grader:
    """Every phrase of the label ``includes`` is in the field."""
    return _phrases(name, "includes", True, "never says ")


def excludes(name: str = "answer") -> Grader:
    """No phrase of the label ``excludes`` is; nothing said passes."""
    return _phrases(name, "excludes", False, "says ")


def regex(name: str = "answer", pattern: str | None = None) -> Grader:
    """A pattern, the same for all cases or each one's label, is found in the field as it is."""
    text = P.field_text(name, fold=False)

    def grade(expected: Column, output: Column) -> Column:
        rule = F.lit(pattern) if pattern is not None else text(expected)
        got = text(output)
        found = P.found_by(got, rule)
        why = F.when(got.isNull(), f"output has no '{name}'").when(rule.isNull(), f"dataset has no regex in '{name}'").when(found.isNull(), "invalid regex").when(~found, "did not match")
        return score(found, why)

    return grade


def valid(schema: str, required: list[str] | None = None) -> Grader:
    """The output is of a schema (as DDL); required fields, all unless named, are there."""

    def grade(expected: Column, output: Column) -> Column:
        parsed = F.from_json(output, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        names = required if required is not None else [part.split()[0] for part in schema.split(",")]
        missing = F.filter(F.array(*[F.when(parsed[n].isNull(), n) for n in names]), lambda x: x.isNotNull())
        fine = parsed.isNotNull() & parsed["_broken"].isNull()
        return score(fine & (F.size(missing) == 0), F.when(~fine, "does not fit").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))

    return grade


def field_match(names: list[str]) -> Grader:
    """Exact match of every field, each reported as a part."""

    def grade(expected: Column, output: Column) -> Column:
        ok = [(n, F.coalesce(P.field_text(n)(expected) == P.field_text(n)(output), F.lit(False))) for n in names]
        parts = F.create_map(*[x for n, c in ok for x in (F.lit(n), c)])
        all_ = F.lit(True)
        for _, c in ok:
            all_ = all_ & c
        return score(all_, F.concat_ws("; ", *[F.when(~c, n) for n, c in ok]), None, parts)

    return grade


def flag(name: str) -> Grader:
    """A truth value that the task reports about itself, as a rate."""
    text = P.field_text(name, fold=False)

    def grade(expected: Column, output: Column) -> Column:
        got = text(output)
        raised = F.when(got == "true", True).when(got == "false", False)
        return score(raised, F.when(got.isNull(), f"output has no '{name}'").when(raised.isNull(), f"'{name}' is no boolean").when(~raised, f"{name} is false"), raised.cast("double"))

    return grade


def right_tools(called: str = "tools") -> Grader:
    """Every tool that the label ``tools`` needs was called and none that ``forbid`` names; a part for each."""
    found_of = P.tools(called)

    def grade(expected: Column, output: Column) -> Column:
        found = found_of(expected, output)
        why = F.when(found["parts"].isNull(), "no lists of tools").otherwise(F.concat_ws("; ", F.when(F.size(found["missing"]) > 0, F.concat(F.lit("never called "), F.array_join(found["missing"], ", "))), F.when(F.size(found["banned"]) > 0, F.concat(F.lit("called "), F.array_join(found["banned"], ", ")))))
        return score((F.size(found["missing"]) == 0) & (F.size(found["banned"]) == 0), why, None, F.from_json(found["parts"], "map<string,boolean>"))

    return grade


def _ids(column: Column, name: str) -> Column:
    """A list of ids, repeats dropped; null if there is no such list."""
    return F.array_distinct(F.from_json(F.get_json_object(column, f"$.{name}"), "array<string>"))


def resolvable(relevant: str = "relevant") -> Grader:
    """Whether the label has any relevant id: a property of the chunks, and what the other ranking metrics are meaned over."""

    def grade(expected: Column, output: Column) -> Column:
        want = _ids(expected, relevant)
        fine = F.coalesce(F.size(want) > 0, F.lit(False)) & want.isNotNull()
        return score(fine, F.when(~fine, "no relevant id"), fine.cast("double"))

    return grade


def ranking(k: int, metric: str = "recall", retrieved: str = "retrieved", relevant: str = "relevant") -> Grader:
    """recall, hit or rr (reciprocal rank) of the first ``k`` ids; without a label the value is null."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")

    def grade(expected: Column, output: Column) -> Column:
        want, got = _ids(expected, relevant), _ids(output, retrieved)
        can = (F.size(want) > 0) & got.isNotNull()
        value = F.when(can, {"recall": R.recall_at(got, want, k), "hit": R.hit_at(got, want, k), "rr": R.reciprocal_rank(F.slice(got, 1, k), want)}[metric])
        return score(value == 1, F.when(want.isNull() | (F.size(want) == 0), "no relevant id").when(got.isNull(), f"output has no '{retrieved}'").when(value < 1, "not all that is relevant, or not first"), value)

    return grade


def rag_graders(correct: Grader, k: int = 5) -> dict[str, Grader]:
    """What an answer from found passages is judged by: whether the task says that it answered, which tells an abstention from a
    wrong answer; whether a relevant passage is among the first ``k`` that it cites, not among those found; whether it is right."""
    return {"answered": flag("answered"), "cites_relevant": ranking(k, "hit", retrieved="cited"), "correct": correct}


def run(cases: DataFrame, variants: dict[str, Callable[[str], str]], graders: dict[str, Grader], *, limit: float | None = None) -> DataFrame:
    """``variant, case_id, output, error, cost, grader, passed, detail, value, parts`` of every case by every variant.

    A variant is a function of a case's input to an output, both JSON; a field ``_cost`` of the output is its price. A task
    that raises gives a row with the error and no score, and is no failure of the case. With a ``limit``, cases beyond the
    one that crosses it, in the order of their ids, have the error ``budget``. ``cases(case_id, input, expected)``."""
    tasks = list(variants.items())

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for case, given, expected in zip(f["case_id"], f["input"], f["expected"], strict=True):
                for name, task in tasks:
                    try:
                        rows.append((name, case, expected, task(given), None))
                    except Exception as e:  # the task's error is the row's result
                        rows.append((name, case, expected, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["variant", "case_id", "expected", "output", "error"], dtype=object)

    kind = cases.schema["case_id"].dataType.simpleString()
    done = cases.select("case_id", "input", "expected").mapInPandas(work, f"variant string, case_id {kind}, expected string, output string, error string")
    done = done.withColumn("cost", F.coalesce(F.get_json_object("output", "$._cost").try_cast("double"), F.lit(0.0)))
    if limit is not None:
        before = F.coalesce(F.sum("cost").over(Window.partitionBy("variant").orderBy("case_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        done = done.withColumn("error", F.when(before > limit, "budget").otherwise(F.col("error")))
    scores = F.array(*[F.struct(F.lit(n).alias("grader"), g(F.col("expected"), F.col("output")).alias("s")) for n, g in graders.items()])
    ok = done.filter("error IS NULL").withColumn("scores", scores).select("variant", "case_id", "output", "error", "cost", F.explode("scores").alias("x")).select("variant", "case_id", "output", "error", "cost", "x.grader", "x.s.*")
    failed = done.filter("error IS NOT NULL")
    for c, t in (("grader", "string"), ("passed", "boolean"), ("detail", "string"), ("value", "double"), ("parts", "map<string,boolean>")):
        failed = failed.withColumn(c, F.lit(None).cast(t))
    return ok.unionByName(failed.select(*ok.columns))


def failures(scores: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The first failed scores by variant, case and grader, and how many more there are."""
    bad = scores.filter("NOT passed OR error IS NOT NULL")
    return bad.orderBy("variant", "case_id", "grader").limit(most), max(0, bad.count() - most)


def first_seen(rows: DataFrame, value: str, order: str) -> Column:
    """Aggregate: distinct values in the order first seen."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.array_distinct(F.filter(F.transform(listed, lambda x: x[value]), lambda v: v.isNotNull()))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the token classes and of the cost over calls."""
    numbers = [c for c, t in calls.dtypes if c not in by and t in ("int", "bigint", "double")]
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in numbers])


def vetoed(passed: Column) -> Column:
    """Aggregate: whether any reviewer objects."""
    return ~F.bool_and(passed)


def unsupported(verdicts: Column) -> Column:
    """Of a map of verdicts, those that aren't supported."""
    return F.map_filter(verdicts, lambda _, v: v != "supported")
