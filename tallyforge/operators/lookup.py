"""Looking facts up: by company, basis, segment and period, by words, with a log; shares, labels and what is held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import citations, times
from tallyforge.functions import printed as N
from tallyforge.functions.labels import FILLER, casefold
from tallyforge.functions.text import label_of, name_words
from tallyforge.operators import retrieval as R
from tallyforge.operators.postings import Postings
from tallyforge.operators.facts import CHECKED
from tallyforge.sinks.snapshots import written
from tallyforge.sizes import sized

#: Pairs of questions and metrics that a task holds, about.
PAIRS = 1_000_000

#: Facts that a look-up returns, concepts that it considers, and how far a held figure may be off.
MOST, DEPTH, AGREES = 5, 20, 0.005


def in_time(start: Column, end: Column, first: Column, last: Column) -> Column:
    """A duration's both days are the span's; an instant's day is its last."""
    return F.when(start.isNull(), end == last).otherwise((start == first) & (end == last))


def segment_asked(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """``asked(query_id, ticker, basis, period_end, segment)`` with ``found`` and ``refusal``: the segment that a company files
    by these words in any case, else the only one that holds them, else why not; a blank one is none."""
    held = facts.filter("segment IS NOT NULL").select("ticker", "basis", "period_end", F.col("segment").alias("s")).distinct()
    wanted = casefold(F.trim("segment"))
    rows = asked.join(held, ["ticker", "basis", "period_end"], "left")
    exact = F.min(F.when(casefold(F.col("s")) == wanted, F.col("s")))
    holding = F.collect_set(F.when(F.contains(casefold(F.col("s")), wanted), F.col("s")))
    out = rows.groupBy("query_id", "ticker", "basis", "period_end", "segment").agg(exact.alias("exact"), holding.alias("holding"), F.array_join(F.array_sort(F.collect_set("s")), "; ").alias("files"))
    blank = F.col("segment").isNull() | (F.trim("segment") == "")
    found = F.when(~blank, F.coalesce("exact", F.when(F.size("holding") == 1, F.get("holding", F.lit(0)))))
    why = F.when(~blank & found.isNull(), F.concat(F.lit("no single segment; it files: "), F.when(F.col("files") == "", "none").otherwise(F.col("files"))))
    return out.select("query_id", "ticker", "basis", "period_end", "segment", found.alias("found"), why.alias("refusal"))


def find(facts: DataFrame, filings: DataFrame, asked: DataFrame, run_id: str, k: int = MOST) -> DataFrame:
    """Up to ``k`` facts of each question, one a concept, in the order of the concepts.

    ``asked(query_id, ticker, year, period, basis, segment, concept, place)``; ``facts(fact_id, ticker, basis, concept, label,
    segment, period_start, period_end, value, unit, tier, run_id, filing_id)``; ``filings(filing_id, origin, filed)``. A
    checked fact comes first, then one of this run, then others; among them the earliest filing, none before all."""
    first, last = times.span_of(F.col("year"), F.col("period"))
    q = asked.select("query_id", "place", "year", "period", *[F.col(c).alias(f"q_{c}") for c in ("ticker", "basis", "concept")], F.coalesce("segment", F.lit("")).alias("q_segment"), first.alias("first"), last.alias("last"))
    near = facts.join(q, (F.col("ticker") == F.col("q_ticker")) & (F.col("basis") == F.col("q_basis")) & (F.col("concept") == F.col("q_concept")) & (F.coalesce("segment", F.lit("")) == F.col("q_segment")))
    near = near.filter(in_time(F.col("period_start"), F.col("period_end"), F.col("first"), F.col("last"))).join(filings.select("filing_id", "origin", "filed"), "filing_id", "left")
    trust = F.when(F.col("tier").isin(*CHECKED), 0).when(F.col("run_id") == run_id, 1).otherwise(2)
    best = near.withColumn("o", F.row_number().over(Window.partitionBy("query_id", "concept").orderBy(trust, F.col("filed").asc_nulls_first(), "fact_id"))).filter("o = 1")
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "concept"))).filter(F.col("rank") <= k)
    cite = citations.fact_citation(F.col("ticker"), F.col("year"), F.col("basis"), F.col("period"), F.col("concept"), F.nullif("q_segment", F.lit("")))
    source = F.when(F.col("origin").isNotNull(), F.concat(F.lit("filing of the period ended "), F.col("filed").cast("string"), F.lit(": "), F.col("origin"))).otherwise("written back")
    return top.select("query_id", "rank", cite.alias("cite_as"), "concept", "label", "value", "unit", "period_start", "period_end", "basis", "segment", "tier", source.alias("source"))


def concept_texts(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``concept, text``: a concept's standard label and its other ones."""
    listed = aliases.groupBy("concept").agg(F.array_sort(F.collect_set(F.col("label"))).alias("more"))
    return concepts.join(listed, "concept", "left").select("concept", F.array_join(F.concat(F.array("label"), F.coalesce("more", F.array().cast("array<string>"))), "; ").alias("text"))


def concept_index(texts: DataFrame, folder: str) -> Postings:
    """A stored index of ``texts(concept, text)`` for any number of ``matched``, built where the folder has none."""
    index = Postings(texts.sparkSession, folder, kind="string")
    if not index.tables.manifest().version:
        index.add(texts.select(F.col("concept").alias("doc_id"), "text"))
    return index


def matched(questions: DataFrame, texts: DataFrame, k: int = DEPTH, *, index: Postings | None = None) -> DataFrame:
    """``query_id, concept, place`` of the concepts closest to each question's words by BM25, an exact name first. With an
    ``index`` of the texts none of them is read."""
    asked = questions.select("query_id", F.col("what").alias("text"))
    ranked = index.bm25(asked, k=k) if index else R.bm25(texts.select(F.col("concept").alias("doc_id"), "text"), asked, k=k)
    rows = ranked.select("query_id", F.col("doc_id").alias("concept"), "rank").unionByName(questions.join(texts, F.col("what") == F.col("concept")).select("query_id", "concept", F.lit(0).alias("rank")))
    best = rows.groupBy("query_id", "concept").agg(F.min("rank").alias("rank"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= k).drop("rank")


def filed(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of ``asked(ticker, concept, ...)`` whose company files the concept."""
    return asked.join(facts.select("ticker", "concept").distinct(), ["ticker", "concept"], "left_semi")


def candidates(asked: DataFrame, facts: DataFrame, instants: DataFrame, k: int = MOST) -> DataFrame:
    """The first ``k`` of the matched concepts (``query_id, ticker, concept, place``) that the company files, and whether each is
    a balance (``instants(concept)``)."""
    w = Window.partitionBy("query_id").orderBy("place")
    kept = filed(asked, facts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return kept.join(instants.select("concept", F.lit(True).alias("i")), "concept", "left").select("query_id", "rank", "concept", F.coalesce("i", F.lit(False)).alias("snapshot"))


def logged(questions: DataFrame, found: DataFrame, matches: DataFrame, run_id: str, asked_by: str, at: Column) -> DataFrame:
    """A log row of every question (``query_id, ticker, basis, year, period, what``), whether facts were found or not: the
    concept found first, else that matched first."""
    hit = found.groupBy("query_id").agg(F.min_by("concept", "rank").alias("f"))
    closest = matches.groupBy("query_id").agg(F.min_by("concept", "place").alias("m"))
    rows = questions.join(hit, "query_id", "left").join(closest, "query_id", "left")
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(asked_by).alias("asked_by"), at.alias("asked_at"), "ticker", "basis", F.concat_ws(" ", F.col("year").cast("string"), "period").alias("period"), "what", F.coalesce("f", "m").alias("concept"), F.col("f").isNotNull().alias("found"))


def metrics_ranked(questions: DataFrame, metrics: DataFrame) -> DataFrame:
    """``query_id, name, shared, rank, holds``: metrics (``name, label``) that share a word with the question, the exact name
    first, then by shared words and name. ``holds``: it is the name, or the metric has every word but filler."""
    little = F.array(*map(F.lit, FILLER))
    words = metrics.select("name", F.array_distinct(F.concat(name_words(F.col("name")), name_words(F.col("label")))).alias("own"))
    q = questions.select("query_id", "what", F.array_except(name_words(F.col("what")), little).alias("asked"))
    # the whole name is one more key, so that one join gives both; questions are dealt, their pairs stay where they are made
    key = lambda kind, w: F.struct(F.lit(kind).alias("exact"), w.alias("w"))
    keys = lambda words, whole: F.explode(F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: key(False, w)), F.array(key(True, F.col(whole))))).alias("key")
    held = written(words.select("name", keys(F.col("own"), "name")).select("name", "key.*").filter("w IS NOT NULL"), "names")
    asked = q.select("query_id", F.size("asked").alias("of"), keys(F.col("asked"), "what")).select("query_id", "of", "key.*").filter("w IS NOT NULL")
    pairs = asked.groupBy("exact", "w").count().join(held.groupBy("exact", "w").agg(F.count("*").alias("m")), ["exact", "w"]).agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0
    parts = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    asked = q.repartition(parts, "query_id").select("query_id", F.size("asked").alias("of"), keys(F.col("asked"), "what")).select("query_id", "of", "key.*")
    rows = asked.join(sized(held), ["exact", "w"]).groupBy("query_id", "name").agg(F.count_if(~F.col("exact")).alias("shared"), F.max("exact").alias("exact"), F.max("of").alias("of"))
    holds = F.col("exact") | ((F.col("of") > 0) & (F.col("shared") == F.col("of")))
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("shared"), "name")
    return rows.select("query_id", "name", "shared", F.row_number().over(w).alias("rank"), holds.alias("holds"))


def metric_matched(ranked: DataFrame) -> DataFrame:
    """The metric that each question names: the first that holds all its words; questions with none have no row."""
    return ranked.filter("holds").groupBy("query_id").agg(F.min_by("name", "rank").alias("name"))


def share_counts(facts: DataFrame, paid_up: str = "PaidUpCapital", face_value: str = "FaceValue") -> DataFrame:
    """``ticker, period_end, count``: paid-up capital over face value in one standalone filing at its own day, the largest of
    a day. Only non-zero face values count."""
    own = facts.filter((F.col("basis") == "standalone") & (F.col("period_end") == F.col("filed")))
    wide = own.filter(F.col("concept").isin(paid_up, face_value)).groupBy("ticker", "filing_id", "period_end").agg(F.max(F.when(F.col("concept") == paid_up, F.col("value"))).alias("p"), F.max(F.when(F.col("concept") == face_value, F.col("value"))).alias("v"))
    return wide.filter("p IS NOT NULL AND v <> 0").groupBy("ticker", "period_end").agg(F.max(F.col("p") / F.col("v")).alias("count"))


def event_within(effective: Column, seen_from: Column, seen_to: Column, start: Column, end: Column) -> Column:
    """Whether an event may have taken effect after a day and by another: a dated one by its day, another by its window."""
    return F.when(effective.isNotNull(), (effective > start) & (effective <= end)).otherwise((seen_from < end) & (seen_to > start))


def event_multiplier(before: Column, after: Column) -> Column:
    """What a per-share figure from before an event is multiplied by; 1 if the shares aren't known."""
    return F.when(before.isNull() | after.isNull(), 1.0).otherwise(before / after)


def ratio_parsed(text: Column) -> Column:
    """``struct<after, before, refusal>`` of a ratio of shares after to before, as 2:1."""
    a, b = (F.regexp_extract(text, r"^\s*(\d+)\s*:\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    why = F.when(a.isNull() | b.isNull(), "no ratio of shares after to before").when((a <= 0) | (b <= 0) | (a == b), "changes no share count")
    return F.struct(F.when(why.isNull(), a).alias("after"), F.when(why.isNull(), b).alias("before"), why.alias("refusal"))


def event_text(event: Column) -> Column:
    """An event in words."""
    head = F.concat(event["ticker"], F.lit(" event "), event["id"].cast("string"))
    ratio = F.when(event["after"].isNotNull(), F.concat(F.lit(" "), event["after"].cast("string"), F.lit(":"), event["before"].cast("string"))).otherwise("")
    seen = F.when(event["seen_ratio"].isNotNull(), F.format_string(" (x%.3f)", event["seen_ratio"])).otherwise("")
    unknown = F.concat(head, F.lit(": an unknown share-count change between "), event["seen_from"].cast("string"), F.lit(" and "), event["seen_to"].cast("string"), seen, F.lit(", "), event["tier"])
    known = F.concat(head, F.lit(": "), event["kind"], ratio, F.lit(" effective "), event["effective"].cast("string"), F.lit(", "), F.when(event["tier"] == "share-event", F.concat(F.lit("checked by "), event["verified_by"])).otherwise(event["tier"]))
    return F.when(event["kind"] == "unknown", unknown).otherwise(known)


def held_to(filings: DataFrame) -> DataFrame:
    """``period_end, quarter, tickers``: to which day the latest results of companies are held, the latest first."""
    last = filings.groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    return last.groupBy("period_end").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ", ").alias("tickers")).select("period_end", N.quarter_end(F.col("period_end")).alias("quarter"), "tickers").orderBy(F.desc("period_end"))


def labels_merged(packages: DataFrame) -> DataFrame:
    """``concept, label, aliases`` of ``packages(ord, concept, role, label)``: the standard label of the first package that has
    one, and all other labels."""
    standard = F.min_by(F.when(F.col("role") == "standard", F.col("label")), F.when(F.col("role") == "standard", F.struct("ord", "label")))
    g = packages.groupBy("concept").agg(standard.alias("label"), F.array_sort(F.collect_set("label")).alias("all"))
    return g.select("concept", "label", F.filter("all", lambda x: ~x.eqNullSafe(F.col("label"))).alias("aliases"))


def labels_applied(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts with the standard label of their concept, where there is one; XBRL facts without keep the split element name."""
    rows = facts.join(labels.select("concept", F.col("label").alias("l")), "concept", "left")
    return rows.withColumn("label", F.when(F.col("tier").startswith("xbrl"), F.coalesce("l", label_of(F.col("concept")))).otherwise(F.col("label"))).drop("l")


def held_check(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """``status`` of each published figure (``ticker, concept, basis, year, value``) against the fact of its own March filing
    (``facts(..., period_start, period_end, filed, value)``): equal, differs or not filed. One join, no probes."""
    first, last = times.span_of(F.col("year"), F.lit("year"))
    w = wanted.withColumns({"first": first, "last": last})
    own = facts.filter(F.col("filed") == F.col("period_end")).select("ticker", "concept", "basis", F.col("period_start").alias("s"), F.col("period_end").alias("e"), F.col("value").alias("v"))
    rows = w.join(own, (w["ticker"] == own["ticker"]) & (w["concept"] == own["concept"]) & (w["basis"] == own["basis"]) & (own["e"] == w["last"]) & (own["s"].isNull() | (own["s"] == w["first"])), "left")
    status = F.when(F.col("v").isNull(), "not filed").when(F.abs(F.col("v") - F.col("value")) <= AGREES * F.greatest(F.abs("v"), F.abs("value")), "equal").otherwise("differs")
    return rows.select(w["ticker"], w["concept"], w["basis"], "year", "value", F.col("v").alias("filed_value"), status.alias("status"))


def holdings(figures: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that may hold a figure (``figure_id, ticker, period_end``), one for each concept, basis and segment, the earliest
    filing's first."""
    f = facts.withColumnRenamed("value", "held")
    rows = figures.join(f, ["ticker", "period_end"])
    w = Window.partitionBy("figure_id", "concept", "basis", F.coalesce("segment", F.lit(""))).orderBy(F.col("filed").asc_nulls_first(), "fact_id")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def split_by_trust(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found facts that are shown, and those that are held back because nobody has checked them."""
    fine = F.col("tier").isin(*CHECKED)
    return found.filter(fine), found.filter(~fine)


def first_rank(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """``figure_id, rank``: the first place (from 1) at which a look-up found what holds the figure; null if it didn't."""
    best = hits.join(wanted, ["figure_id", "concept"], "left_semi").groupBy("figure_id").agg(F.min("rank").alias("rank"))
    return wanted.select("figure_id").distinct().join(best, "figure_id", "left")
