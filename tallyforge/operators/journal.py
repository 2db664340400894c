"""Runs of tasks over cases that stop before they spend, and whose outcomes are kept as they come.

Cases go out in waves. Before a wave is called, the sums of the worst that its cases can cost, in the order of the cases, say
how many of them the rest of the budget bears; only those are called. A wave's outcomes are one commit of an append-only
journal. A run that was killed goes on with the cases that the journal lacks, and grading, of a new run or again, reads
the journal: it calls nothing and bills nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sinks.snapshots import Tables
from tallyforge.sizes import placed


class Journal:
    """The outcomes of a run: ``variant, case_id, output, error, cost, wave``. ``identity``: what the run is of (digests of the
    cases and the tasks); a journal of another identity is refused."""

    def __init__(self, spark: SparkSession, folder: str, identity: str, kind: str = "string") -> None:
        self.spark, self.tables, self.kind = spark, Tables(spark, folder), kind
        own = self.tables.manifest().info.get("identity", identity)
        if own != identity:
            raise ValueError(f"the journal is of another run: {own}, not {identity}")
        self.identity = identity

    def outcomes(self) -> DataFrame:
        return self.tables.read("outcomes", f"variant string, case_id {self.kind}, output string, error string, cost double, wave int").drop("part")

    def spent(self) -> float:
        return self.outcomes().agg(F.sum("cost")).first()[0] or 0.0

    def run(self, cases: DataFrame, tasks: dict[str, Callable[[str], tuple[str, float]]], *, worst: Column | float = 0.0, limit: float | None = None, wave: int = 1_000) -> DataFrame:
        """Calls each task (input to output and cost) for each of ``cases(case_id, input)`` that the journal lacks, in the order of case
        and variant, as far as the budget goes. Returns all outcomes, and a row with the error ``budget`` for each pair that was not
        called. A call that fails is an outcome with its error, at the worst cost of the case.

        The first case that the rest of the budget doesn't bear ends a wave; when none goes out, the run ends."""
        price = F.lit(worst) if isinstance(worst, float | int) else worst
        names = F.explode(F.array(*[F.lit(n) for n in sorted(tasks)]))
        asked = cases.select("case_id", "input", price.cast("double").alias("worst")).withColumn("variant", names)
        while True:
            at = self.tables.manifest()
            done = self.outcomes()
            left = asked.join(done.select("variant", "case_id"), ["variant", "case_id"], "left_anti")
            rows = placed(left.select("variant", "case_id", "worst"), ["case_id", "variant"], value="worst").filter(F.col("place") < wave)
            if limit is not None:
                rows = rows.filter(F.col("total") <= limit - self.spent() + 1e-9)
            going = left.join(F.broadcast(rows.select("variant", "case_id")), ["variant", "case_id"], "left_semi")  # a wave
            number = len(at.tables.get("outcomes", [])) + 1
            made = self._called(going, tasks).withColumn("wave", F.lit(number))
            part = self.tables.stage("outcomes", made)
            own = type(at)(tables={"outcomes": [part]})
            if self.tables.read("outcomes", made.schema, own).isEmpty():
                break
            self.tables.commit({"outcomes": [*at.tables.get("outcomes", []), part]}, {"identity": self.identity}, over=at)
        done = self.outcomes()
        refused = left.select("variant", "case_id", F.lit(None).cast("string").alias("output"), F.lit("budget").alias("error"), F.lit(0.0).alias("cost"), F.lit(None).cast("int").alias("wave"))
        return done.unionByName(refused)

    def _called(self, rows: DataFrame, tasks: dict) -> DataFrame:
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for variant, case, given, most in zip(f["variant"], f["case_id"], f["input"], f["worst"], strict=True):
                    try:
                        said, cost = tasks[variant](given)
                        out.append((variant, case, said, None, float(cost)))
                    except Exception as e:  # the task's error is the outcome
                        out.append((variant, case, None, f"{type(e).__name__}: {e}", most))
                yield pd.DataFrame(out, columns=["variant", "case_id", "output", "error", "cost"], dtype=object)

        return rows.select("variant", "case_id", "input", "worst").mapInPandas(work, f"variant string, case_id {self.kind}, output string, error string, cost double")

    def graded(self, expected: DataFrame, graders: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
        """``variant, case_id, grader, passed`` of all outcomes without an error against ``expected(case_id, expected)``. Nothing is called."""
        scores = F.explode(F.array(*[F.struct(F.lit(n).alias("grader"), g(F.col("expected"), F.col("output")).alias("passed")) for n, g in sorted(graders.items())]))
        return self.outcomes().filter("error IS NULL").join(expected, "case_id").select("variant", "case_id", scores.alias("s")).select("variant", "case_id", "s.grader", "s.passed")
