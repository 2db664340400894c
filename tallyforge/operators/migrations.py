"""Older tables of facts and definitions brought to the present form: every row and id is kept, columns are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What offsets of bindings became, and the words in labels that said them.
AT = {"t": "current", "t-1y": "previous", "t-1q": "previous"}
PERIOD_WORDS = r"(?i),? (?:year on year|quarter on quarter|over the quarter before)|^(?:year|quarter)-on-\w+ "


def tier_now(tier: Column, verified_by: Column) -> Column:
    """A tier of an older version: XBRL rows by who checked them, names with ``pdf`` as filed."""
    alone = verified_by.startswith("pdf:") & ~verified_by.contains("+")
    return F.when((tier == "xbrl") & verified_by.isNull(), "xbrl-ai").when(((tier == "xbrl") & alone) | (tier == "xbrl-pdf"), "xbrl-filed").when(tier.startswith("pdf-"), F.concat(F.lit("filed-"), F.substring(tier, 5, 1000))).otherwise(tier)


def stamp_now(verified_by: Column) -> Column:
    """A document's stamp with its origin: PDF copies are the exchange's, HTML ones another filing's."""
    path = F.substring(verified_by, 5, 10_000)
    return F.when(~verified_by.startswith("pdf:"), verified_by).when(verified_by.contains(".pdf"), F.concat(F.lit("nse-pdf:"), path)).when(verified_by.isNotNull(), F.concat(F.lit("sec-6k-html:"), path))


def facts_now(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"tier": tier_now(F.col("tier"), F.col("verified_by")), "verified_by": stamp_now(F.col("verified_by"))})


def with_column(table: DataFrame, name: str, value: Column) -> DataFrame:
    """A table with a column that it may lack; rows that have it keep theirs."""
    return table if name in table.columns else table.withColumn(name, value)


def renamed(old: DataFrame, new: DataFrame, key: list[str], tiers: dict[str, str]) -> DataFrame:
    """Rows of an old table, tiers renamed, beside those of the new one, which come first where keys are equal."""
    names = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair])
    moved = old.withColumn("tier", F.coalesce(F.try_element_at(names, F.col("tier")), "tier")) if tiers else old
    return new.unionByName(moved.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def bindings_now(definitions: DataFrame) -> DataFrame:
    """Definitions (``name, scope, label, formula, bindings, tier``; bindings as JSON) whose offsets are times and whose labels have
    no period words; of those alike in scope, formula and bindings a checked one stays, else the shorter name."""
    old = F.from_json("bindings", "map<string,struct<concept:string,offset:string,at:string>>")
    at = F.create_map(*[F.lit(x) for pair in AT.items() for x in pair])
    entries = F.array_sort(F.transform(F.map_entries(old), lambda e: F.struct(e["key"].alias("key"), F.struct(F.coalesce(e["value"]["at"], F.try_element_at(at, e["value"]["offset"])).alias("at"), e["value"]["concept"].alias("concept")).alias("value"))))
    was = F.col("bindings").contains('"offset"')
    words = F.trim(F.regexp_replace("label", PERIOD_WORDS, ""))
    rows = definitions.withColumn("label", F.when(was, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000))).otherwise(F.col("label"))).withColumn("bindings", F.when(was, F.to_json(F.map_from_entries(entries))).otherwise(F.col("bindings")))
    w = Window.partitionBy("scope", "formula", "bindings").orderBy(F.desc(F.col("tier") == "derived-concept"), F.length("name"), "name")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def check_stamp(name: Column, scope: Column, person: Column) -> Column:
    """What a trusted derived fact names as its check."""
    return F.concat(name, F.lit("["), scope, F.lit("]@"), person)
