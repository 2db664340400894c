"""How much of published figures is held and found: sources of figures, the facts that hold them, and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import times
from tallyforge.operators import crosscheck as C
from tallyforge.operators.lookup import in_time
from tallyforge.sources.manifests import outside


def from_fundamentals(table: DataFrame, definitions: dict[str, str], concepts: dict[str, str]) -> DataFrame:
    """Figures of frozen fundamentals (``ticker, year, metric, value``), matched by their concept and asked by definition and by
    word."""
    pick = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return table.select(F.concat_ws("|", "ticker", F.col("year").cast("string"), "metric").alias("figure_id"), F.lit("fundamentals").alias("source"), "ticker", "year", "value", F.lit(0.0).alias("tolerance"), F.try_element_at(pick(definitions), F.col("metric")).alias("asked"), F.col("metric").alias("word"), F.lit("concept").alias("match"), F.try_element_at(pick(concepts), F.col("metric")).alias("concept"), F.lit(None).cast("array<string>").alias("units"))


def from_tables(questions: DataFrame, figures: DataFrame, tickers: list[str], years: list[int]) -> tuple[DataFrame, DataFrame]:
    """Hand-written figures of table questions, and those left out with the reason (their own, or that they are beyond what is
    held). ``questions(id, question)``; ``figures(id, ticker, year, printed, scale, unit, metric, excluded)``. A figure without its
    question is an error."""
    rows = figures.join(questions, "id", "left")
    lost = rows.filter("question IS NULL").select("id").first()
    if lost:
        raise ValueError(f"{lost.id} is not a table question")
    rows = rows.withColumn("reason", F.coalesce("excluded", outside(F.col("ticker"), F.col("year"), tickers, years)))
    places = F.length(F.regexp_extract("printed", r"\.(\d+)$", 1))
    kept = rows.filter("reason IS NULL").select(F.col("id").alias("figure_id"), F.lit("tables").alias("source"), "ticker", "year", (F.col("printed").cast("double") * F.col("scale")).alias("value"), (0.5 * F.pow(F.lit(10.0), -places) * F.col("scale")).alias("tolerance"), F.col("question").alias("asked"), F.col("metric").alias("word"), F.lit("value").alias("match"), F.lit(None).cast("string").alias("concept"), F.array("unit").alias("units"))
    return kept, rows.filter("reason IS NOT NULL").select("id", F.lit("tables").alias("source"), "reason")


def holdings(figures: DataFrame, facts: DataFrame) -> DataFrame:
    """``figure_id, concept, basis, segment, held, decimals, place``: facts of a figure's company and year that hold it.

    Matched by concept it is the consolidated one without a segment, matched by value any of its units that is equal within
    roundings and filed precisely enough to say so. Each concept, basis and segment counts once, from the earliest filing;
    consolidated and unsegmented ones come first."""
    first, last = times.span_of(F.col("year"), F.lit("year"))
    f = figures.withColumns({"first": first, "last": last})
    facts = facts.select(F.col("ticker").alias("f_ticker"), F.col("concept").alias("f_concept"), "basis", "segment", "period_start", "period_end", F.col("value").alias("held"), "unit", "decimals", "filed", "fact_id")
    near = f.join(facts, (F.col("ticker") == F.col("f_ticker")) & (F.col("period_end") == F.col("last"))).filter(in_time(F.col("period_start"), F.col("period_end"), F.col("first"), F.col("last")))
    key = Window.partitionBy("figure_id", "f_concept", "basis", F.coalesce("segment", F.lit(""))).orderBy(F.col("filed").asc_nulls_first(), "fact_id")
    once = near.withColumn("n", F.row_number().over(key)).filter("n = 1")
    by_concept = (F.col("f_concept") == F.col("concept")) & (F.col("basis") == "consolidated") & F.col("segment").isNull()
    by_value = F.array_contains("units", F.col("unit")) & C.telling(F.col("held"), F.col("value"), F.col("tolerance"), F.col("decimals"))
    held = once.filter(F.coalesce(F.when(F.col("match") == "concept", by_concept).otherwise(by_value), F.lit(False)))
    order = Window.partitionBy("figure_id").orderBy((F.col("basis") != "consolidated").cast("int"), F.col("segment").isNotNull().cast("int"), "segment", "f_concept")
    return held.withColumn("place", F.row_number().over(order)).select("figure_id", F.col("f_concept").alias("concept"), "basis", "segment", "held", "decimals", "place")


def scored(figures: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """``figure_id, source, phrasing, held, rank, exact`` of what a look-up found (``figure_id, phrasing, rank, concept, basis, segment, value``)
    for each figure in each phrasing. ``exact`` is measured where a figure is matched by concept."""
    phrased = figures.select("figure_id", "source", "value", "tolerance", "match", F.explode(F.array(F.lit("asked"), F.lit("word"))).alias("phrasing"))
    best = held.groupBy("figure_id").agg(F.count("*").alias("n"))
    h = held.select("figure_id", F.col("concept").alias("h_concept"), F.col("basis").alias("h_basis"), F.col("segment").alias("h_segment"), "decimals")
    hits = found.withColumnRenamed("value", "got").join(h, "figure_id").filter((F.col("concept") == F.col("h_concept")) & (F.col("basis") == F.col("h_basis")) & F.col("segment").eqNullSafe(F.col("h_segment")))
    first = hits.groupBy("figure_id", "phrasing").agg(F.min(F.struct("rank", "got", "decimals")).alias("b"))
    rows = phrased.join(best, "figure_id", "left").join(first, ["figure_id", "phrasing"], "left")
    equal = C.value_equal(F.col("b.got"), F.col("value"), F.col("tolerance"), F.col("b.decimals"), F.lit(False))
    return rows.select("figure_id", "source", "phrasing", (F.coalesce("n", F.lit(0)) > 0).alias("held"), "b.rank", F.when(F.col("match") == "concept", F.coalesce(equal, F.lit(False))).alias("exact"))
