"""Facts against printed figures, what is done about it, and the review of where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import printed as N
from tallyforge.functions.binding import let
from tallyforge.functions.labels import label_share, per_share_row, table_cell
from tallyforge.functions.periods import months_of
from tallyforge.sinks.snapshots import written
from tallyforge.sizes import placed, small

#: Least label share, digits that make a figure distinctive, facts that a person ticks of a group.
LABEL_SHARE, DISTINCT_DIGITS, SPOTS = 0.6, 5, 3
#: Kinds of copies, and rows that a trace shows above and below.
KINDS = ("born-digital PDF", "filed OCR layer", "RapidOCR reading", "SEC copy")
TRACE_ROWS = 8
#: The most pairs of different labels whose shares are worked out ahead.
LABEL_PAIRS = 200_000


def distinctive(printed: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(printed, r"\D", ""), "^0+", "")) >= DISTINCT_DIGITS


def documents_for(facts: DataFrame) -> DataFrame:
    """Facts (``ticker, period_start, period_end, filed``) with each ``document`` that prints them and its ``ord``: for a
    year's figure or a balance in a filing of its own March the annual report, then the quarter's results."""
    results = F.concat_ws("-", "ticker", F.col("filed").cast("string"))
    annual = F.concat(F.col("ticker"), F.lit("-FY"), F.date_format("filed", "yy"))
    yearly = (F.month("filed") == 3) & (F.col("period_end") == F.col("filed")) & months_of(F.col("period_start"), F.col("period_end")).isin(0, 12)
    return facts.select("*", F.posexplode(F.when(yearly, F.array(annual, results)).otherwise(F.array(results))).alias("ord", "document"))


def in_period(start: Column, end: Column, column_end: Column, months: Column, alone: Column) -> Column:
    """A column without a length counts only if it is alone on its day."""
    fits = F.when(start.isNull(), True).when(months.isNotNull(), months == months_of(start, end)).otherwise(alone)
    return F.coalesce((column_end == end) & fits, F.lit(False))


def with_share(near: DataFrame, facts: DataFrame, cells: DataFrame) -> tuple[DataFrame, Column]:
    """Pairs of facts and cells (``c``) with their labels' ``share``, and whether the row prints a figure a share. Facts and rows have few
    labels that differ: where these make few pairs, each is worked out once and looked up, else it is worked out where it is met."""
    share = lambda row: label_share(F.col("labels"), F.col("segment"), row)
    per = lambda heading, row: per_share_row(F.col("labels"), F.concat_ws(" ", heading, row))
    own, own_per = share(F.col("c.label")), per("c.heading", "c.label")
    kinds, rows = written(facts.select("labels", "segment").distinct(), "kinds"), written(cells.select("heading", "label").distinct(), "labels")
    if kinds.count() * rows.count() > LABEL_PAIRS:
        return near.withColumn("share", own), own_per
    pairs = written(kinds.crossJoin(rows).select(*[F.col(x).alias(f"s_{x}") for x in ("labels", "segment", "heading", "label")], share(F.col("label")).alias("s"), per("heading", "label").alias("s_per")), "shares")
    if not small(pairs):
        return near.withColumn("share", own), own_per
    met = F.lit(True)
    for x in ("labels", "segment", "c.heading", "c.label"):
        met = met & F.col(x).eqNullSafe(F.col(f"s_{x.removeprefix('c.')}"))
    return near.join(F.broadcast(pairs), met, "left").withColumn("share", F.coalesce("s", own)), F.coalesce("s_per", own_per)


def checked(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """Each fact against each document that prints it: ``fact_id, document, outcome, rule, share, sheet, row, column, page,
    printed, row_label, heading``.

    ``facts``: fact_id, document, basis, period_start, period_end, value, unit, labels, segment. ``cells``: as ``sheets``
    gives them. In reading order the first equal figure with a rule agrees: by its row's label, else as a distinctive
    figure, else as a per-share row. Otherwise the best label of ``LABEL_SHARE`` or more differs, the first of equal
    ones; else the fact is unmatched. Document and day are the keys of the join, and one aggregate keeps first and best,
    so that no pairs are written."""
    c = cells.filter("period_end IS NOT NULL").select("document", F.col("period_end").alias("c_end"), F.struct(*[x for x in cells.columns if x not in ("document", "period_end")]).alias("c"))
    near = facts.join(c, (facts["document"] == c["document"]) & (F.col("period_end") == F.col("c_end"))).drop(c["document"])
    near = near.filter(F.col("c.basis").isNull() | (F.col("c.basis") == F.col("basis"))).filter(in_period(F.col("period_start"), F.col("period_end"), F.col("c_end"), F.col("c.months"), F.col("c.alone")))
    near, per = with_share(near, facts, cells.filter("period_end IS NOT NULL"))
    same = N.figure_agrees(F.col("value"), F.col("unit"), F.col("c"), F.col("c.scale"))
    per_share = F.col("unit").endswith("PerShare") & per
    rule = F.when(F.col("share") >= LABEL_SHARE, "label").when(distinctive(F.col("c.printed")), "distinct").when(per_share, "per-share")
    place = [F.col(f"c.{x}").alias(x) for x in ("sheet", "row", "column")]
    rest = [F.col("c.page").alias("page"), F.col("c.printed").alias("printed"), F.col("c.label").alias("row_label"), F.col("c.heading").alias("heading")]
    rated = near.withColumn("rule", F.when(same, rule))
    agree = F.min(F.when(F.col("rule").isNotNull(), F.struct(*place, F.col("rule"), F.col("share"), *rest)))
    differ = F.min(F.when(F.col("share") >= LABEL_SHARE, F.struct((-F.col("share")).alias("worst"), *place, F.lit(None).cast("string").alias("rule"), F.col("share"), *rest)))
    best = rated.groupBy("fact_id", "document").agg(agree.alias("agree"), differ.alias("differ"))
    all_ = facts.select("fact_id", "document").join(best, ["fact_id", "document"], "left")
    outcome = F.when(F.col("agree").isNotNull(), "agree").when(F.col("differ").isNotNull(), "differ").otherwise("unmatched")
    pick = lambda x: F.coalesce(F.col(f"agree.{x}"), F.when(F.col("agree").isNull(), F.col(f"differ.{x}")))
    return all_.select("fact_id", "document", outcome.alias("outcome"), F.col("agree.rule").alias("rule"), F.round(pick("share"), 3).alias("share"), *[pick(x).alias(x) for x in ("sheet", "row", "column", "page", "printed", "row_label", "heading")])


def best_outcome(outcomes: DataFrame) -> DataFrame:
    """One outcome a fact over its documents (``ord``): agree before differ before unmatched, then the order."""
    rank = F.when(F.col("outcome") == "agree", 0).when(F.col("outcome") == "differ", 1).otherwise(2)
    w = Window.partitionBy("fact_id").orderBy(rank, "ord", "document")
    return outcomes.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def applied(facts: DataFrame, outcomes: DataFrame, origins: DataFrame, at: Column) -> DataFrame:
    """Facts (``fact_id, tier, verified_by, verified_at, printed, page``) once agreements are written: an unchecked XBRL fact
    that agrees becomes filed, verified by its document with its origin; all others are left alone. An agreement whose
    document has no origin is an error."""
    agreed = outcomes.filter("outcome = 'agree'").select("fact_id", "document", F.col("printed").alias("a_printed"), F.col("page").alias("a_page")).join(origins, "document", "left")
    stamp = F.when(F.col("origin").isNull(), F.raise_error(F.concat(F.lit("no origin of "), "document"))).otherwise(F.concat_ws(":", "origin", "document"))
    rows = facts.join(agreed.withColumn("stamp", stamp), "fact_id", "left")
    moves = (F.col("tier") == "xbrl-ai") & F.col("stamp").isNotNull()
    new = lambda a, b: F.when(moves, a).otherwise(F.col(b)).alias(b)
    return rows.withColumn("moves", moves).select(*[c for c in facts.columns if c not in ("tier", "verified_by", "verified_at", "printed", "page")], F.when(F.col("moves"), "xbrl-filed").otherwise(F.col("tier")).alias("tier"), new(F.col("stamp"), "verified_by"), new(at, "verified_at"), new(F.col("a_printed"), "printed"), new(F.col("a_page"), "page"))


def issue_of(value: Column, outcome: Column, printed: Column) -> Column:
    """Why a fact didn't agree: it is filed as zero, it isn't printed, it is printed times 100, or it differs."""

    def hundred(p: Column) -> Column:
        return F.coalesce(F.abs(p["value"] - value * 100) <= 0.5 * F.pow(F.lit(10.0), -p["places"]) + 1e-9, F.lit(False))

    return F.when(value == 0, "xbrl zero").when(outcome != "differ", "not printed").when(let(N.number(printed), hundred), "printed x100").otherwise("differs")


def numbered(groups_: DataFrame, size: str, by: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 by falling ``size``, then ``by``; no task needs all rows, nor all of a size."""
    return placed(groups_, [F.desc(size), *by]).withColumn(name, (F.col("place") + 1).cast("int")).drop("place")


def groups(outcomes: DataFrame) -> DataFrame:
    """``number, ticker, concept, segment, issue, n, ids`` of the facts that didn't agree (``fact_id, ticker, concept, segment,
    value, outcome, printed``), the largest group first; segments count in any case."""
    rows = outcomes.filter("outcome <> 'agree'").withColumn("issue", issue_of(F.col("value"), F.col("outcome"), F.col("printed")))
    g = rows.groupBy("ticker", "concept", F.lower(F.coalesce("segment", F.lit(""))).alias("key"), "issue").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("fact_id")).alias("ids"), F.min_by("segment", "fact_id").alias("segment"))
    return numbered(g, "n", ["ticker", "concept", "key", "issue"])


def spot_sample(group: Column, ids: Column, size: int = SPOTS, seed: int = 7) -> Column:
    """The ids that a person ticks before a check covers all: the first by a seeded hash, in order."""
    drawn = F.array_sort(F.transform(ids, lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), group, i.cast("string"))).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(drawn, 1, size), lambda x: x["i"]))


def agreement_sample(outcomes: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """A sample of the agreements, drawn by a seeded hash, by id."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("fact_id").cast("string")))
    return outcomes.filter("outcome = 'agree'").orderBy(order, "fact_id").limit(size).orderBy("fact_id")


def ruled(groups_: DataFrame, decisions: DataFrame, held: DataFrame) -> DataFrame:
    """Decisions against groups: ``group_id, verdict, status, confirmed, new``.

    ``groups_(group_id, any_id, ids)``; ``any_id`` is the group's id with ``*`` for its company. ``decisions(group_id, verdict,
    decided_by, checks array<struct<group, facts array<struct<id, value>>, ticked array<bigint>>>)``. ``held(fact_id, value)``.
    A group's own decision comes before one for any company. Without a person it is proposed. ``right`` needs, in each
    check of the group, exactly the spot sample ticked, else it is refused; facts whose value is still the checked one
    are confirmed: all of them, it is applied, else it extends to the rest, which is new. Other verdicts are applied."""
    d = decisions.select(F.col("group_id").alias("d_id"), F.struct("verdict", "decided_by", "checks").alias("d"))
    own = groups_.join(d, F.col("group_id") == F.col("d_id"), "left").drop("d_id").withColumnRenamed("d", "mine")
    rows = own.join(d, F.col("any_id") == F.col("d_id"), "left").withColumn("d", F.coalesce("mine", "d")).filter("d IS NOT NULL")
    rows = rows.select("group_id", "ids", "d.verdict", F.col("d.decided_by").alias("by"), F.filter(F.coalesce("d.checks", F.array().cast(dict(decisions.dtypes)["checks"])), lambda c: c["group"] == F.col("group_id")).alias("checks"))
    fits = lambda c: (F.size(F.array_except(spot_sample(F.col("group_id"), F.transform(c["facts"], lambda f: f["id"])), c["ticked"])) == 0) & (F.size(F.array_except(c["ticked"], F.transform(c["facts"], lambda f: f["id"]))) == 0)
    rows = rows.withColumn("fine", F.forall("checks", fits))
    pairs = rows.filter("verdict = 'right' AND fine").select("group_id", "ids", F.explode("checks").alias("c")).select("group_id", "ids", F.explode("c.facts").alias("f"))
    same = pairs.join(held, F.col("f.id") == held["fact_id"]).filter((F.col("f.value") == F.col("value")) & F.array_contains("ids", F.col("f.id")))
    sure = same.groupBy("group_id").agg(F.array_sort(F.collect_set("f.id")).alias("confirmed"))
    rows = rows.join(sure, "group_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.array().cast("array<bigint>")))
    left = F.array_except("ids", "confirmed")
    status = F.when(F.col("by").isNull(), "proposed").when(F.col("verdict") != "right", "applied").when(~F.col("fine"), "refused").when(F.size(left) == 0, "applied").otherwise("extend")
    known = status.isin("applied", "extend") & (F.col("verdict") == "right")
    return rows.select("group_id", "verdict", status.alias("status"), F.when(known, F.col("confirmed")).alias("confirmed"), F.when(status == "extend", left).alias("new"))


def confirmed_facts(facts: DataFrame, rulings: DataFrame, decided_by: str, at: Column) -> DataFrame:
    """Unchecked XBRL facts that a ``right`` decision confirms become checked, by the person who decided; others stay."""
    sure = rulings.filter("verdict = 'right' AND status IN ('applied', 'extend')").select(F.explode("confirmed").alias("fact_id"), F.lit(True).alias("sure")).distinct()
    moves = F.col("sure") & (F.col("tier") == "xbrl-ai")
    rows = facts.join(sure, "fact_id", "left").withColumn("moves", F.coalesce(moves, F.lit(False)))
    keep = [c for c in facts.columns if c not in ("tier", "verified_by", "verified_at")]
    return rows.select(*keep, F.when(F.col("moves"), "xbrl").otherwise(F.col("tier")).alias("tier"), F.when(F.col("moves"), decided_by).otherwise(F.col("verified_by")).alias("verified_by"), F.when(F.col("moves"), at).otherwise(F.col("verified_at")).alias("verified_at"))


def orphans(groups_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions for no group of this run."""
    known = groups_.select("group_id").union(groups_.select("any_id")).distinct()
    return decisions.join(known, "group_id", "left_anti")


def counts(outcomes: DataFrame) -> DataFrame:
    """Facts by company and basis, a column for each outcome."""
    return outcomes.groupBy("ticker", "basis").pivot("outcome", ["agree", "differ", "unmatched"]).count().na.fill(0)


def traced(outcomes: DataFrame, rows: DataFrame, window: int = TRACE_ROWS) -> DataFrame:
    """The printed rows around each checked figure: ``fact_id, r, cells, role``, of ``rows(document, sheet, r, cells, header)``.

    Header rows come along. A figure that isn't printed there any more, or has no place, is one row with the reason."""
    mine = outcomes.select("fact_id", "document", "sheet", "row", "column", "printed")
    near = mine.join(rows, ["document", "sheet"]).filter((F.col("header")) | (F.abs(F.col("r") - F.col("row")) <= window))
    here = near.filter((F.col("r") == F.col("row")) & (F.trim(F.get("cells", F.col("column"))) == F.col("printed"))).select("fact_id").distinct()
    shown = near.join(here, "fact_id", "left_semi").select("fact_id", "r", "cells", F.when(F.col("r") == F.col("row"), "figure").when(F.col("header"), "header").otherwise("around").alias("role"))
    lost = mine.join(here, "fact_id", "left_anti").select("fact_id", F.lit(None).cast("int").alias("r"), F.lit(None).cast("array<string>").alias("cells"), F.when(F.col("row").isNull(), "no figure").otherwise("not printed there now").alias("role"))
    return shown.unionByName(lost)


def markdown_counts(counted: DataFrame) -> DataFrame:
    """``line`` of each row of ``counts``, as a table's row."""
    return counted.select(F.concat(F.lit("| "), F.concat_ws(" | ", table_cell(F.col("ticker")), "basis", *[F.col(c).cast("string") for c in ("agree", "differ", "unmatched")]), F.lit(" |")).alias("line"))


def copy_kind(document: Column, origin: Column) -> Column:
    return F.when(document.endswith("#rapidocr"), KINDS[2]).when(origin == "sec-6k-html", KINDS[3]).when(origin == "nse-pdf-ocr", KINDS[1]).otherwise(KINDS[0])


def coverage(scored: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """By source and phrasing: figures, held, found among the first k, exact (null where it wasn't measured)."""
    return scored.groupBy("source", "phrasing").agg(F.count("*").alias("figures"), F.count_if("held").alias("held"), *[F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"found_{k}") for k in ks], F.when(F.count("exact") > 0, F.count_if(F.coalesce("exact", F.lit(False)))).alias("exact"))


def value_equal(found: Column, value: Column, allowed: Column, decimals: Column, by_value: Column) -> Column:
    """Equal within both roundings; matched by value, the sign is ignored."""
    room = allowed + 0.5 * F.pow(F.lit(10.0), -F.coalesce(decimals, F.lit(2)))
    return F.when(by_value, F.abs(F.abs(found) - F.abs(value)) <= room).otherwise(F.abs(found - value) <= room)


def telling(found: Column, value: Column, allowed: Column, decimals: Column, most: float = 0.01) -> Column:
    """Equal by value, and filed so precisely that this says something."""
    rounding = 0.5 * F.pow(F.lit(10.0), -F.coalesce(decimals, F.lit(2)))
    return (rounding <= most * F.abs(value)) & value_equal(found, value, allowed, decimals, F.lit(True))
