"""What rests on what: staleness that reaches through derived facts, checked write-back.

``links(fact_id, input_id)`` says which facts a derived fact was computed from. Rounds over links go on until nothing new is
reached, so that a chain of any length is followed, and each fact is reached once, in circles too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.facts import CHECKED
from tallyforge.sizes import sized


def dependants(links: DataFrame, changed: DataFrame) -> DataFrame:
    """``fact_id, depth`` of all facts that rest on ``changed(input_id)``, at the least number of steps. Facts that changed themselves
    are absent unless they rest on another changed one."""
    spark = links.sparkSession
    edges = links.select("fact_id", "input_id").distinct().persist()  # lost parts are read again
    front = changed.select("input_id").distinct().checkpoint() if spark.sparkContext.getCheckpointDir() else changed.select("input_id").distinct().persist()
    reached, depth = None, 0
    while True:
        depth += 1
        step = edges.join(sized(front), "input_id", "left_semi").select("fact_id").distinct()
        if reached is not None:
            step = step.join(reached, "fact_id", "left_anti")
        new = step.withColumn("depth", F.lit(depth))
        new = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new.persist()
        if new.isEmpty():
            return reached if reached is not None else new
        reached = new if reached is None else reached.unionByName(new)
        front = new.select(F.col("fact_id").alias("input_id"))


def fresh(derived: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """Derived facts that rest on nothing changed, however far below."""
    return derived.join(dependants(links, changed).select("fact_id"), "fact_id", "left_anti")


def written_back(proposals: DataFrame, plan: DataFrame, facts: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposed derived facts that may be written, their links, and those that may not, each with its reason.

    ``proposals(fact_id, name, ticker, period_end, value)`` with ``cites(array of struct(slot, input_id))``; ``plan(name, slot,
    concept)`` says what each slot must be; ``facts(input_id, concept, ticker, tier)``; ``held(name, ticker, period_end)``. Reasons, the
    first that holds: ``held`` already, a slot without a cite (``missing``), a cite that no slot of the plan asks for (``unplanned``), no
    such fact (``unknown``), a fact of another concept or company (``wrong``), or one that isn't checked (``unchecked``)."""
    cited = proposals.select("fact_id", "name", F.col("ticker").alias("own"), F.explode("cites").alias("c")).select("fact_id", "name", "own", "c.slot", "c.input_id")
    wanted = proposals.select("fact_id", "name").join(sized(plan), "name")
    known = facts.select("input_id", F.col("concept").alias("found"), "ticker", "tier")
    both = wanted.join(cited.drop("name"), ["fact_id", "slot"], "full_outer").join(known, "input_id", "left")
    found = lambda n, why: F.struct(F.lit(n).alias("n"), F.lit(why).alias("why"))
    fault = (
        F.when(F.col("input_id").isNull(), found(2, "missing"))
        .when(F.col("concept").isNull(), found(3, "unplanned"))
        .when(F.col("found").isNull(), found(4, "unknown"))
        .when((F.col("found") != F.col("concept")) | (F.col("ticker") != F.col("own")), found(5, "wrong"))
        .when(~F.col("tier").isin(*CHECKED), found(6, "unchecked"))
    )
    first = both.groupBy("fact_id").agg(F.min(fault).alias("f"))
    here = held.select("name", "ticker", "period_end", F.lit(True).alias("here")).distinct()
    judged = proposals.join(here, ["name", "ticker", "period_end"], "left").join(first, "fact_id", "left")
    none = F.when(F.col("f").isNull() & (F.size("cites") <= 0), F.lit("missing"))  # a name that no plan has
    judged = judged.withColumn("reason", F.when(F.col("here"), "held").otherwise(F.coalesce("f.why", none)))
    columns = proposals.columns
    good = judged.filter("reason IS NULL")
    return good.select(*columns), good.select("fact_id", F.explode("cites.input_id").alias("input_id")).distinct(), judged.filter("reason IS NOT NULL").select(*columns, "reason")
