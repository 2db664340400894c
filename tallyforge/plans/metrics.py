"""Derived metrics: definitions, their plan as exact fetches, and evaluation as one column expression.

A definition has a formula over variables and binds each variable to a concept or another definition at a time: current,
previous or opening. Planning expands it on the driver (definitions are few) to a relation of fetches; evaluation
pivots the fetched values and compiles the formula to a column, so that any number of companies and periods is one plan."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import times
from tallyforge.functions.citations import fact_citation

AT = ("current", "previous", "opening")
#: Formulas by name: variables, whether the result has its inputs' unit or is a pure number, expression.
FORMULAS = {
    "average": (("first", "second"), "same", "(first + second) / 2"),
    "difference": (("minuend", "subtrahend"), "same", "minuend - subtrahend"),
    "growth": (("current", "previous"), "pure", "(current - previous) / abs(previous)"),
    "ratio": (("numerator", "denominator"), "pure", "numerator / denominator"),
    "total": (("first", "second"), "same", "first + second"),
}


@dataclass(frozen=True)
class Metric:
    name: str
    formula: str
    bindings: dict[str, tuple[str, str]]  # variable: (concept or metric, current | previous | opening)
    unit: str = "pure"  # or same: that of its inputs
    label: str = ""
    scope: str = "*"

    @classmethod
    def of(cls, name: str, formula: str, bindings: dict[str, tuple[str, str]], **more) -> Metric:
        """A metric by one of the named formulas."""
        variables, unit, expression = FORMULAS[formula]
        if set(bindings) != set(variables):
            raise ValueError(f"{formula} takes {', '.join(sorted(variables))}, not {', '.join(sorted(bindings))}")
        return cls(name, expression, bindings, unit, **more)


@dataclass(frozen=True)
class Fetch:
    path: str
    concept: str
    at: str


class Metrics:
    def __init__(self, definitions: list[Metric]) -> None:
        self.by_name = {d.name: d for d in definitions}
        if len(self.by_name) < len(definitions):
            raise ValueError("a metric is defined twice")

    def leaves(self, name: str) -> set[str]:
        """The filed concepts that a metric reads, through others."""
        return {f.concept for f in self.plan(name)}

    def compares(self, name: str) -> bool:
        return any(at == "previous" for _, at in self.by_name[name].bindings.values())

    def reads_opening(self, name: str) -> bool:
        return any(at == "opening" or (what in self.by_name and self.reads_opening(what)) for what, at in self.by_name[name].bindings.values())

    def one_time(self, name: str) -> bool:
        """Whether everything is read at the current time."""
        return all(at == "current" and (what not in self.by_name or self.one_time(what)) for what, at in self.by_name[name].bindings.values())

    def kind(self, name: str, instants: set[str]) -> str:
        """snapshot if all that it reads are balances, flow if none is, else mixed, as is what reads an opening."""
        read = self.leaves(name)
        if read <= instants:
            return "mixed" if self.reads_opening(name) else "snapshot"
        return "mixed" if read & instants else "flow"

    def openings(self, available: set[str], instants: set[str]) -> set[str]:
        """What may be read at an opening: filed balances, and metrics of balances that are all read at one time."""
        return {n for n in available if (n not in self.by_name and n in instants) or (n in self.by_name and self.one_time(n) and self.leaves(n) <= instants)}

    def comparing(self) -> set[str]:
        return {n for n in self.by_name if self.compares(n)}

    def refusal(self, metric: Metric, available: set[str], openings: set[str]) -> str | None:
        """Why a metric can't be defined over the concepts of its scope; None if it can."""
        used = list(metric.bindings.values())
        if any(what == metric.name for what, _ in used):
            return f"{metric.name} can't be an input to itself"
        for why, bad in (
            ("no concept {} in this scope", sorted(w for w, _ in used if w not in available)),
            ("at {} is no time", sorted(at for _, at in used if at not in AT)),
            ("{} compares two periods itself", sorted(w for w, _ in used if w in self.comparing())),
            ("{} is not a balance", sorted(w for w, at in used if at == "opening" and w not in openings)),
        ):
            if bad:
                return why.format(", ".join(bad))
        return None

    def seeded(self, rows: list[Metric], available: set[str], instants: set[str]) -> tuple[Metrics, dict[str, str]]:
        """The metrics with those of ``rows`` that can be defined, in passes until one adds nothing, so that one may build on a
        later one; and why the others can't."""
        held, pending = Metrics(list(self.by_name.values())), list(rows)
        while True:
            refused, names = {}, available | set(held.by_name)
            for m in pending:
                why = "it is held already" if m.name in held.by_name else held.refusal(m, names, held.openings(names, instants))
                if why:
                    refused[m.name] = why
                else:
                    held.by_name[m.name] = m
                    names = names | {m.name}
            if len(refused) == len(pending):
                return held, refused
            pending = [m for m in pending if m.name in refused]

    def plan(self, name: str, path: str = "", depth: int = 0) -> list[Fetch]:
        """Fetches of all leaves; a path is the dotted variables down to the leaf."""
        if depth > len(self.by_name):
            raise ValueError(f"{name} is defined by itself")
        out = []
        for variable, (what, at) in self.by_name[name].bindings.items():
            here = f"{path}.{variable}" if path else variable
            if what in self.by_name:
                if at != "current" or any(a == "previous" for _, a in self.by_name[what].bindings.values()):
                    raise ValueError(f"{what} compares two times and can't be an input of {name}")
                out += self.plan(what, here, depth + 1)
            else:
                out.append(Fetch(here, what, at))
        return out

    def column(self, name: str, path: str = "") -> Column:
        """The formula over columns named by path. A zero divisor gives null."""
        metric = self.by_name[name]

        def build(node: ast.AST) -> Column:
            match node:
                case ast.Expression(body=b):
                    return build(b)
                case ast.Constant(value=v) if isinstance(v, int | float):
                    return F.lit(float(v))
                case ast.Name(id=v) if v in metric.bindings:
                    here = f"{path}.{v}" if path else v
                    what = metric.bindings[v][0]
                    return self.column(what, here) if what in self.by_name else F.col(f"`{here}`")
                case ast.UnaryOp(op=ast.USub(), operand=x):
                    return -build(x)
                case ast.Call(func=ast.Name(id="abs"), args=[x]):
                    return F.abs(build(x))
                case ast.BinOp(left=a, op=op, right=b):
                    x, y = build(a), build(b)
                    match op:
                        case ast.Add():
                            return x + y
                        case ast.Sub():
                            return x - y
                        case ast.Mult():
                            return x * y
                        case ast.Div():
                            return F.try_divide(x, y)
            raise ValueError(f"{metric.formula}: only arithmetic over its variables")

        return build(ast.parse(metric.formula, mode="eval"))

    def evaluate(self, name: str, facts: DataFrame, by: list[str], ordinal: str) -> DataFrame:
        """The metric for each group and period of ``facts(by, ordinal, concept, value)``, with consecutive ordinals.

        previous and opening read the period before. One aggregate pivots all concepts; a shifted copy of it, joined on
        the group and ordinal, has the periods before."""
        fetches = self.plan(name)
        concepts = sorted({f.concept for f in fetches})
        wide = facts.filter(F.col("concept").isin(concepts)).groupBy(*by, ordinal).agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(f"now{i}") for i, c in enumerate(concepts)])
        before = wide.select(*by, (F.col(ordinal) + 1).alias(ordinal), *[F.col(f"now{i}").alias(f"was{i}") for i in range(len(concepts))])
        rows = wide.join(before, [*by, ordinal], "left")
        named = rows.select(*by, ordinal, *[F.col(f"{'now' if f.at == 'current' else 'was'}{concepts.index(f.concept)}").alias(f.path) for f in fetches])
        return named.select(*by, ordinal, self.column(name).alias("metric"))

    def asked(self, name: str, questions: DataFrame, balances: set[str]) -> DataFrame:
        """``query_id, ticker, basis, path, concept, year, period, cite_as, refusal``: each fact that each question needs.

        ``questions(query_id, ticker, basis, year, period, was_year, was)``. A balance is read as at the quarter its period ends
        in, an opening one as at the quarter before. A question for a metric that compares needs an earlier time, as long and
        over before; another must have none."""
        earlier = F.col("was").isNotNull()
        if self.compares(name):
            why = F.when(~earlier, "give the previous period too").otherwise(times.interval_refusal(F.col("year"), F.col("period"), F.col("was_year"), F.col("was")))
        else:
            why = F.when(earlier, "it is at one period")
        opening, at = times.opening_of(F.col("year"), F.col("period")), {}
        at["current"] = F.struct(F.col("year").cast("int").alias("year"), F.col("period").alias("period"))
        at["previous"] = F.struct(F.col("was_year").cast("int").alias("year"), F.col("was").alias("period"))
        at["opening"] = F.struct(opening["year"].cast("int").alias("year"), opening["period"].alias("period"))
        rows = []
        for f in self.plan(name):
            if f.at == "opening" and f.concept not in balances:
                raise ValueError(f"{f.concept} is not a balance; only a balance has an opening")
            time = at[f.at]
            period = times.as_time(time["period"])["quarter"] if f.concept in balances else time["period"]
            rows.append(F.struct(F.lit(f.path).alias("path"), F.lit(f.concept).alias("concept"), time["year"].alias("year"), period.alias("period")))
        out = questions.withColumn("refusal", why).withColumn("f", F.explode(F.array(*rows)))
        cite = fact_citation(F.col("ticker"), F.col("f.year"), F.col("basis"), F.col("f.period"), F.col("f.concept"), F.lit(None).cast("string"))
        return out.select("query_id", "ticker", "basis", "f.*", cite.alias("cite_as"), "refusal")

    def computed(self, name: str, found: DataFrame) -> DataFrame:
        """``query_id, value, unit, refusal, inputs`` of ``found(query_id, path, value, unit, multiplier, cite_as, refusal)``.

        Per-share inputs count times their multiplier (null: 1). Refused are questions without all facts, with inputs of
        several units where the metric has its inputs' unit, or with a zero base."""
        paths = [f.path for f in self.plan(name)]
        pick = lambda p: F.max(F.when(F.col("path") == p, F.col("value") * F.coalesce("multiplier", F.lit(1.0))))
        one = F.max(F.struct(F.col("refusal").isNotNull().alias("bad"), "refusal"))["refusal"]
        wide = found.groupBy("query_id").agg(*[pick(p).alias(p) for p in paths], F.collect_set("unit").alias("units"), F.array_sort(F.collect_set("cite_as")).alias("inputs"), one.alias("why"))
        missing = F.lit(False)
        for p in paths:
            missing = missing | F.col(f"`{p}`").isNull()
        value = self.column(name)
        mixed = F.size("units") > 1 if self._same(name) else F.lit(False)
        why = F.coalesce("why", F.when(missing, "a fact is missing").when(mixed, "it needs one unit").when(value.isNull(), "a base is zero"))
        unit = F.get("units", F.lit(0)) if self._same(name) else F.lit("pure")
        return wide.withColumn("refusal", why).select("query_id", F.when(F.col("refusal").isNull(), value).alias("value"), F.when(F.col("refusal").isNull(), unit).alias("unit"), "refusal", "inputs")

    def _same(self, name: str) -> bool:
        """Whether a metric has the unit of its inputs."""
        m = self.by_name[name]
        return m.unit == "same" and all(what not in self.by_name or self._same(what) for what, _ in m.bindings.values())


def derived_rows(computed: DataFrame, inputs: DataFrame, checked: tuple[str, ...], checked_by: Column) -> DataFrame:
    """Computed values as facts to be written: ``tier`` derived with who checked the metric, else derived-ai; ``refusal`` where an
    input (``inputs(query_id, fact_id, tier)``) is missing or unchecked, or there is none."""
    state = inputs.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("tier").isNull()).alias("missing"), F.count_if(~F.col("tier").isin(*checked)).alias("unchecked"), F.array_sort(F.collect_set("fact_id")).alias("links"))
    rows = computed.drop("inputs").join(state, "query_id", "left").withColumn("by", checked_by)
    why = F.coalesce("refusal", F.when(F.coalesce("n", F.lit(0)) == 0, "no input").when(F.col("missing") > 0, "an input is missing").when(F.col("unchecked") > 0, "an input is unchecked"))
    return rows.withColumn("refusal", why).select("query_id", F.when(F.col("refusal").isNull(), F.col("value")).alias("value"), F.when(F.col("refusal").isNull(), F.when(F.col("by").isNotNull(), "derived").otherwise("derived-ai")).alias("tier"), F.when(F.col("refusal").isNull(), F.col("by")).alias("verified_by"), "refusal", F.when(F.col("refusal").isNull(), F.col("links")).alias("links"))


def held_derived(rows: DataFrame, facts: DataFrame, verified: bool = False) -> DataFrame:
    """``query_id, held``: the derived fact that already holds a row, the same company, basis, concept, days, segment and formula
    (null equals null), the one with the least id. With ``verified`` it must be the only verified one of its place."""
    key = ("ticker", "basis", "concept", "period_start", "period_end", "segment")
    f = facts.filter(F.col("tier") == "derived" if verified else F.col("tier").isin("derived", "derived-ai")).select("fact_id", "formula", *[F.col(c).alias(f"f_{c}") for c in key])
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    both = rows.withColumnRenamed("formula", "r_formula").join(f, on)
    same = F.min(F.when(F.col("formula") == F.col("r_formula"), F.col("fact_id")))
    g = both.groupBy("query_id").agg(same.alias("held"), F.count("*").alias("n"))
    return g.select("query_id", F.when((F.col("n") == 1) | F.lit(not verified), F.col("held")).alias("held")).filter("held IS NOT NULL")


def proposals(held: DataFrame, new: DataFrame) -> DataFrame:
    """Formula proposals (``name, expression, ...``): those held, and new ones that aren't held by name and expression."""
    first = new.dropDuplicates(["name", "expression"]).join(held.select("name", "expression"), ["name", "expression"], "left_anti")
    return held.unionByName(first, allowMissingColumns=True)


def promoted(derived: DataFrame, links: DataFrame, facts: DataFrame, definition: Metric, tickers: list[str], person: str, checked: tuple[str, ...]) -> DataFrame:
    """Derived facts after a person has checked a definition: those of its concept and of companies in its scope, all of whose
    inputs are checked, become derived, with the check's stamp; others stay."""
    if not person.strip():
        raise ValueError("say who checked it")
    open_ = links.join(facts.filter(~F.col("tier").isin(*checked)).select(F.col("fact_id").alias("input_id")), "input_id", "left_semi").select("fact_id").distinct().withColumn("open", F.lit(True))
    stamp = f"{definition.name}[{definition.scope}]@{person.strip()}"
    rows = derived.join(open_, "fact_id", "left")
    moves = (F.col("tier") == "derived-ai") & (F.col("concept") == definition.name) & F.col("ticker").isin(tickers) & F.col("open").isNull()
    rows = rows.withColumn("moves", moves)
    return rows.select(*[c for c in derived.columns if c not in ("tier", "verified_by")], F.when(F.col("moves"), "derived").otherwise(F.col("tier")).alias("tier"), F.when(F.col("moves"), stamp).otherwise(F.col("verified_by")).alias("verified_by"))
