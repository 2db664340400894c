"""Reports as Markdown, made of aggregates that have a row a variant, source or group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.labels import examples, table_cell
from tallyforge.operators import crosscheck, grading
from tallyforge.operators.evaluation import per_field, report
from tallyforge.sinks.files import free_name, write_rows, write_text


def table(header: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(header) + " |", "|---" * len(header) + "|", *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


def rate(part: int, whole: int) -> str:
    return "—" if not whole else f"{part}/{whole} ({100 * part / whole:.0f}%)"


def evaluation(scores: DataFrame, title: str, header: dict[str, str], most: int = 20) -> str:
    """Pass rates by variant and grader (errors apart, and in no denominator), means of the cases that could be scored, pass
    rates by field, and the first failures."""
    rows = report(scores).orderBy("variant", "grader").collect()
    variants = sorted({r["variant"] for r in scores.select("variant").distinct().collect()})
    graders = sorted({r["grader"] for r in rows})
    by = {(r["variant"], r["grader"]): r for r in rows}
    errors = {r["variant"]: r["n"] for r in scores.filter("error IS NOT NULL").groupBy("variant").agg(F.count_distinct("case_id").alias("n")).collect()}
    shown = lambda v, g: rate(by[v, g]["passed"], by[v, g]["cases"]) if (v, g) in by else "—"
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in header.items()), "", "## Results", ""]
    lines += table(["variant", *graders, "errors"], [[v, *(shown(v, g) for g in graders), errors.get(v, 0)] for v in variants])
    means = [g for g in graders if any((v, g) in by and by[v, g]["mean_value"] is not None for v in variants)]
    if means:
        value = lambda v, g: f"{by[v, g]['mean_value']:.3f}" if (v, g) in by and by[v, g]["mean_value"] is not None else "—"
        lines += ["", "## Metrics (mean per case)", "", *table(["metric", *variants], [[g, *(value(v, g) for v in variants)] for g in means])]
    if "parts" in scores.columns:
        fields = {(r["field"], r["variant"]): rate(r["passed"], r["cases"]) for r in per_field(scores.filter("error IS NULL AND parts IS NOT NULL")).collect()}
        if fields:
            lines += ["", "## Per field", "", *table(["field", *variants], [[f, *(fields.get((f, v), "—") for v in variants)] for f in sorted({f for f, _ in fields})])]
    bad, more = grading.failures(scores, most)
    found = [f"- `{r['case_id']}` [{r['variant']}] — " + (f"error: {r['error']}" if r["error"] is not None else f"**{r['grader']}**: {r['detail'] or 'failed'}") for r in bad.collect()]
    if found:
        lines += ["", "## Failures", "", *found, *([f"- …and more; {more} not shown"] if more else [])]
    return "\n".join(lines) + "\n"


def coverage(scored: DataFrame, left: DataFrame, header: dict[str, str]) -> str:
    """What is held and found of each source, and why figures were left out. ``scored``: as for ``crosscheck.coverage``;
    ``left(source, reason)``."""
    rows = crosscheck.coverage(scored).orderBy("source", "phrasing").collect()
    body = [[r["source"], r["phrasing"], r["figures"], rate(r["held"], r["figures"]), rate(r["found_1"], r["held"]), rate(r["found_5"], r["held"]), "—" if r["exact"] is None else rate(r["exact"], r["held"])] for r in rows]
    lines = ["# coverage", "", *(f"- {k}: {v}" for k, v in header.items()), "", *table(["source", "asked by", "figures", "held", "found@1", "found@5", "exact"], body)]
    reasons = left.groupBy("source", "reason").count().orderBy("source", "reason").collect()
    if reasons:
        lines += ["", "## Left out", "", *table(["source", "why", "figures"], [list(r) for r in reasons])]
    return "\n".join(lines) + "\n"


def crosschecked(outcomes: DataFrame, header: dict[str, str]) -> str:
    """Outcomes by company and basis, and the groups to review with examples of what is filed and printed."""
    counted = crosscheck.counts(outcomes).orderBy("ticker", "basis").collect()
    lines = ["# cross-check", "", *(f"- {k}: {v}" for k, v in header.items()), "", *table(["company", "basis", "agree", "differ", "unmatched"], [list(r) for r in counted])]
    groups = crosscheck.groups(outcomes)
    facts = outcomes.select("fact_id", F.regexp_replace(F.col("value").cast("string"), r"\.0$", "").alias("filed"), "printed", "period_end")
    detail = groups.select("number", "ticker", "concept", "segment", "issue", "n", F.explode("ids").alias("fact_id")).join(facts, "fact_id").groupBy("number", "ticker", "concept", "segment", "issue", "n").agg(F.min("period_end").alias("first"), F.max("period_end").alias("last"), examples(F.array_sort(F.collect_list("filed"))).alias("filed"), examples(F.array_sort(F.collect_list("printed"))).alias("printed"))
    rows = detail.select("number", "n", "ticker", table_cell(F.col("concept")).alias("concept"), F.coalesce("segment", F.lit("")).alias("segment"), "issue", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"))).alias("periods"), "filed", table_cell(F.col("printed")).alias("printed")).orderBy("number").collect()
    return "\n".join([*lines, "", "## To review", "", *table(["number", "facts", "company", "concept", "segment", "issue", "periods", "filed", "printed"], [list(r) for r in rows])]) + "\n"


def saved(rows: DataFrame, text: str, folder: str, base: str, order: list[str]) -> str:
    """Writes a report under a name of its own and its rows beside it; returns the report's path."""
    spark = rows.sparkSession
    path = free_name(spark, folder, base, ".md")
    write_rows(rows, path.removesuffix(".md") + ".rows.jsonl", order)
    return write_text(spark, path, text, replace=False)
