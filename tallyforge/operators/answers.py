"""What saved runs and answers hold: usage, tools called, evidence of citations, figures that passages back, re-grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import citations
from tallyforge.functions import printed as N
from tallyforge.functions.labels import canonical_call
from tallyforge.functions.text import squeeze
from tallyforge.operators.figures import inferred_call

#: Blocks that call a tool, metrics that descriptions of "other" figures name, bases that need no segment.
CALLS = ("tool_use", "server_tool_use")
RELABELLED = (("tax", r"(?i)tax expense|current tax|effective (income )?tax rate"), ("receivables", r"(?i)receivable"), ("equity", r"(?i)total equity|other equity|shareholders'? (equity|funds)|net worth|share capital|^equity$"), ("assets", r"(?i)\bassets\b"))
BASES = ("consolidated", "standalone")


def usage_of_blocks(usage: Column) -> Column:
    """``struct<input, output, written, written_hour, read, searches>`` of a usage that counts cached tokens apart (JSON)."""
    whole = F.from_json(usage, "input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, cache_creation struct<ephemeral_1h_input_tokens:bigint>, server_tool_use struct<web_search_requests:bigint>")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return F.struct(n(whole["input_tokens"]).alias("input"), n(whole["output_tokens"]).alias("output"), n(whole["cache_creation_input_tokens"]).alias("written"), n(whole["cache_creation"]["ephemeral_1h_input_tokens"]).alias("written_hour"), n(whole["cache_read_input_tokens"]).alias("read"), n(whole["server_tool_use"]["web_search_requests"]).alias("searches"))


def usage_of_completion(usage: Column) -> Column:
    """The same of a usage whose prompt tokens include cached ones; none at all counts nothing."""
    whole = F.from_json(usage, "prompt_tokens bigint, completion_tokens bigint, prompt_tokens_details struct<cached_tokens:bigint>")
    cached = F.coalesce(whole["prompt_tokens_details"]["cached_tokens"], F.lit(0)).cast("bigint")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return F.struct((n(whole["prompt_tokens"]) - cached).alias("input"), n(whole["completion_tokens"]).alias("output"), zero.alias("written"), zero.alias("written_hour"), cached.alias("read"), zero.alias("searches"))


def tools_called(blocks: Column) -> Column:
    """Names of the tools that a turn's blocks (JSON array) ask for, in order."""
    parsed = F.from_json(blocks, "array<struct<type:string,name:string>>")
    return F.transform(F.filter(parsed, lambda b: b["type"].isin(*CALLS)), lambda b: b["name"])


def pages_returned(blocks: Column) -> Column:
    """Distinct addresses that a turn's searches returned, in order."""
    parsed = F.from_json(blocks, "array<struct<type:string,content:array<struct<url:string>>>>")
    urls = F.flatten(F.transform(F.filter(parsed, lambda b: (b["type"] == "web_search_tool_result") & b["content"].isNotNull()), lambda b: F.transform(b["content"], lambda c: c["url"])))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def held_back(calls: DataFrame, tool: str) -> Column:
    """Aggregate over ``calls(tool, result)``: unverified entries that a tool's results held back."""
    return F.coalesce(F.sum(F.when(F.col("tool") == tool, F.get_json_object("result", "$.unverified_held").try_cast("bigint"))), F.lit(0))


def evidence(cited: DataFrame, facts: DataFrame) -> DataFrame:
    """Cited ids (``answer_id, pos, id``) with their fact's text (``facts(id, text)``), or the bare id as JSON if it was never seen."""
    return cited.join(facts.select("id", "text"), "id", "left").withColumn("fact", F.coalesce("text", F.to_json(F.struct(F.col("id").alias("cite_as"))))).drop("text")


def guarded(answer: Column, retrieved: Column) -> Column:
    """``struct<passed, detail>`` of the guard run again on a saved answer; no answer passes, a withheld one doesn't."""
    broken = citations.violations(answer, F.coalesce(retrieved, F.array().cast("array<string>")))
    why = F.when(answer.isNull(), "no answer to check").when(answer == citations.WITHHELD, "withheld: it carried a credential").otherwise(F.array_join(broken, "; "))
    return F.struct((answer.isNull() | ((answer != citations.WITHHELD) & (F.size(broken) == 0))).alias("passed"), why.alias("detail"))


def relabelled(label: Column) -> Column:
    """A label (``metric, unit, description``) whose "other" names a metric by its description: money only, but for a tax rate."""
    rate = F.contains(F.lower(label["description"]), F.lit("rate"))
    metric = F.lit(None).cast("string")
    for name, pattern in reversed(RELABELLED):
        money = label["unit"].isNotNull() | (rate if name == "tax" else F.lit(False))
        metric = F.when(label["description"].rlike(pattern) & money, name).otherwise(metric)
    named = F.when((label["metric"] == "other") & (F.coalesce(label["description"], F.lit("")) != ""), metric)
    return F.struct(F.coalesce(named, label["metric"]).alias("metric"), label["unit"].alias("unit"), F.when(named.isNull(), label["description"]).alias("description"))


def backed(value: Column, passage: Column) -> Column:
    """Whether a passage prints a value, as it is or at a named scale."""
    return F.exists(N.printed_numbers(passage), lambda n: n == F.abs(value)) | inferred_call(value, passage).isNotNull()


def called_value(call: Column, passage: Column, value: Column) -> Column:
    """Whether a scaling call gives a value of a number that the passage prints."""
    shape = r"^(-?\d+(?:\.\d+)?) (?:\* 10\*\*(\d+)|/ (100))$"
    one = canonical_call(F.replace(call, F.lit(","), F.lit("")))
    n = F.regexp_extract(one, shape, 1).try_cast("double")
    times = F.when(F.regexp_extract(one, shape, 3) == "100", 0.01).otherwise(F.pow(F.lit(10.0), F.regexp_extract(one, shape, 2).try_cast("double")))
    fits = F.abs(n * times - value) <= 1e-9 * F.greatest(F.abs(n * times), F.abs(value))
    return F.coalesce(one.rlike(shape) & F.exists(N.printed_numbers(passage), lambda p: p == F.abs(n)) & fits, F.lit(False))


def figures_refused(figures: DataFrame, passages: DataFrame) -> DataFrame:
    """``answer_id, refusal`` of replies' figures (``answer_id, pos, chunk_id, value, basis, calls``): all or nothing. Each must come from a
    passage that was read (``passages(answer_id, chunk_id, text)``), whose segment it names is printed there, and have a value
    that it prints, as it is or through one of the reply's calls."""
    rows = figures.join(passages.select("answer_id", "chunk_id", "text"), ["answer_id", "chunk_id"], "left")
    by_call = F.exists(F.coalesce("calls", F.array().cast("array<string>")), lambda c: called_value(c, F.col("text"), F.col("value")))
    printed = F.exists(N.printed_numbers(F.col("text")), lambda n: n == F.abs(F.col("value")))
    why = (
        F.when(F.col("text").isNull(), F.concat(F.col("chunk_id"), F.lit(" is not a passage its searches returned")))
        .when(F.col("basis").isNotNull() & ~F.col("basis").isin(*BASES) & ~F.contains(squeeze(F.col("text")), squeeze(F.col("basis"))), F.concat(F.col("chunk_id"), F.lit(" does not name the segment")))
        .when(~(printed | by_call), F.concat(F.col("chunk_id"), F.lit(" does not back a value")))
    )
    return rows.withColumn("why", why).groupBy("answer_id").agg(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("pos"))).alias("refusal"))


def only_listed(drawn: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """The drawn rows that a list names; one that it names and that wasn't drawn is an error."""
    lost = listed.select(*keys).distinct().join(drawn, keys, "left_anti").first()
    if lost:
        raise ValueError(f"listed but not drawn: {lost}")
    return drawn.join(listed.select(*keys).distinct(), keys, "left_semi")


def judged(rows: DataFrame, judge, key: str = "case_id") -> DataFrame:
    """``key, passed, detail`` by a judge: a function of a list of (question, answer, reference) to (passed, detail), called once a batch.
    Rows with an error aren't judged; a judge that raises fails its batch's rows with the reason."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            given = list(zip(f["question"], f["answer"], f["reference"], strict=True))
            try:
                found = list(judge(given))
            except Exception as e:  # the judge's error is the rows' result
                found = [(False, f"{type(e).__name__}: {e}")] * len(given)
            yield pd.DataFrame([(k, bool(p), d) for k, (p, d) in zip(f[key], found, strict=True)], columns=[key, "passed", "detail"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.filter("error IS NULL").select(key, "question", "answer", "reference").mapInPandas(run, f"{key} {kind}, passed boolean, detail string")
