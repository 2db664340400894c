"""Headlines made by templates with the labels they should get, company mentions, and labels drawn from texts.

Everything is a column: what fills a template comes from 16-bit parts of the MD5 of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.labels import company_key

#: Metrics by rank, words for them, and what a label says if nothing is named.
RANKED = ("profit", "revenue", "margin", "other")
WORDS = {"revenue": "revenue", "profit": "net profit", "other": "net interest income", "margin": "operating margin"}
UNKNOWN, NONE = "unknown", "none"


def part(seed: int, key: str, i: int) -> Column:
    """The i-th 16-bit number, of eight, that a seed and a key give."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 4 * i + 1, 4), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def preferred(stated: list[str], mentioned: list[str]) -> str:
    """The metric that labels a headline of several: the best-ranked with a percentage, else the best-ranked."""
    return min(stated or mentioned, key=RANKED.index)


def indian(n: Column) -> Column:
    """A number with commas after the last three digits and then after twos."""
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{2})*\d{3}$)", "$1,")


def generated(ids: DataFrame, companies: list[str], seed: int = 7, key: str = "id") -> DataFrame:
    """``id, rule, text, company, metric, quarter, direction, change_pct`` of each id, by sixteen templates in turn."""
    h = [part(seed, key, i) for i in range(8)]
    up = h[0] % 2 == 0
    pct = 1 + h[1] % 40
    quarter, metric, company = _pick(["Q1", "Q2", "Q3", "Q4"], h[2]), _pick(["revenue", "profit"], h[3]), _pick(companies, h[4])
    word = F.when(metric == "revenue", WORDS["revenue"]).otherwise(WORDS["profit"])
    amount = F.concat(F.lit("Rs "), indian(120 + h[5] * 3 % 99_000), F.lit(" crore"))
    low, high = 5 + h[6] % 20, 30 + h[7] % 15
    s, n, either = F.lit, lambda c: c.cast("string"), lambda a, b: F.when(up, a).otherwise(b)
    direction, none = either("up", "down"), s(None).cast("int")
    both = preferred(["profit", "other"], ["profit", "other"])
    rules = [
        ("percent-move", [company, quarter, word, either("rises", "falls"), F.concat(n(pct), s("%"))], metric, quarter, direction, pct),
        ("percent-first", [company, s("reports"), F.concat(n(pct), s("%")), either("rise", "fall"), s("in"), quarter, word], metric, quarter, direction, pct),
        ("margin-level", [company, quarter, s(WORDS["margin"]), either("widens", "narrows"), s("to"), F.concat(n(F.when(up, high).otherwise(low)), s("%")), s("from"), F.concat(n(F.when(up, low).otherwise(high)), s("%"))], s("margin"), quarter, direction, none),
        ("basis-points", [company, quarter, s(WORDS["margin"]), either("improves", "slips"), n(10 + h[5] % 240), s("bps")], s("margin"), quarter, direction, none),
        ("rupee-amount", [company, quarter, word, either("rises", "falls"), s("to"), amount], metric, quarter, direction, none),
        ("flat", [company, quarter, word, s("flat at"), amount], metric, quarter, s("flat"), none),
        ("guidance", [company, either("raises", "cuts"), s("FY26"), word, s("guidance")], s("guidance"), s("FY"), direction, none),
        ("orders", [company, s("wins orders worth"), amount, s("in"), quarter], s("orders"), quarter, s(UNKNOWN), none),
        ("headcount", [company, quarter, s("headcount"), either("rises", "falls"), s("by"), n(300 + h[5] % 8700)], s("headcount"), quarter, direction, none),
        ("growth-rate", [company, quarter, word, s("growth"), either("accelerates", "slows"), s("to"), F.concat(n(F.when(up, high).otherwise(low)), s("%"))], metric, quarter, s("up"), F.when(up, high).otherwise(low)),
        ("two-metrics", [company, quarter, s(WORDS["profit"]), either("up", "down"), F.concat(n(pct), s("%,")), s(WORDS["other"]), s("up"), F.concat(n(low), s("%"))], s(both), quarter, direction, pct),
        ("share-price", [company, s("shares"), either("jump", "slump"), F.concat(n(pct), s("%")), s("in early trade")], s(NONE), s(UNKNOWN), s(UNKNOWN), none),
        ("no-metric", [company, s("appoints new chief executive")], s(NONE), s(UNKNOWN), s(UNKNOWN), none),
        ("no-period", [company, word, either("rises", "falls"), F.concat(n(pct), s("%"))], metric, s(UNKNOWN), direction, pct),
        ("half-or-full-year", [company, _pick(["H1", "H2", "FY25"], h[2]), word, either("rises", "falls"), F.concat(n(pct), s("%"))], metric, F.substring(_pick(["H1", "H2", "FY25"], h[2]), 1, 2), direction, pct),
        ("loss", [company, quarter, s("net loss"), either("narrows", "widens"), s("to"), amount], s("profit"), quarter, direction, none),
    ]
    made = F.array(*[F.struct(s(rule).alias("rule"), F.concat_ws(" ", *words).alias("text"), company.alias("company"), m.alias("metric"), q.alias("quarter"), d.alias("direction"), c.cast("int").alias("change_pct")) for rule, words, m, q, d, c in rules])
    return ids.select(key, F.element_at(made, F.pmod(F.col(key), F.lit(len(rules))).cast("int") + 1).alias("m")).select(key, "m.*")


def directory(companies: DataFrame) -> DataFrame:
    """``key, ticker`` of every spelling of ``companies(ticker, name, aliases, ord)``: the first company to claim it has it."""
    names = companies.select("ticker", "ord", F.explode(F.concat(F.array("ticker", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.select(company_key(F.col("name")).alias("key"), "ticker", "ord").groupBy("key").agg(F.min_by("ticker", "ord").alias("ticker"))


def resolved(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """``mentions(mention, ...)`` with their ticker, null if no company has the spelling."""
    return mentions.withColumn("key", company_key(F.col("mention"))).join(index, "key", "left").drop("key")


def unresolved(mentions: DataFrame) -> DataFrame:
    return mentions.filter("ticker IS NULL").groupBy("mention").agg(F.count("*").alias("n"))


def majority(rows: DataFrame, label: str) -> DataFrame:
    """The commonest label of all other rows (ties: the first in the alphabet), for each row. Two labels decide: a row takes one
    from its own label's count, so that the second can be the commonest for rows of the first alone."""
    best = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(2).collect()
    if not best:
        return rows.withColumn("majority", F.lit(None).cast(rows.schema[label].dataType))
    (first, n), (second, m) = best[0], best[-1]
    less = F.lit(second if len(best) > 1 and (n - 1 < m or (n - 1 == m and second < first)) else first)
    return rows.withColumn("majority", F.when(F.col(label) == first, less).otherwise(F.lit(first)))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The latest value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def draw_mix(rows: DataFrame) -> DataFrame:
    """What a draw of ``rows(named, paired, years)`` holds."""
    single = ~F.col("paired")
    return rows.agg(F.count_if(single & F.col("named")).alias("named"), F.count_if(single & ~F.col("named")).alias("other"), F.count_if("paired").alias("two_companies"), F.count_if(F.col("years") > 1).alias("two_years_or_more"), F.count_if((F.col("years") > 1) & F.col("paired")).alias("paired_years"))


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms that weigh most for each class: ``weights(label, term, weight)``."""
    w = Window.partitionBy("label").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
