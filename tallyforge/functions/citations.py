"""Citations, guards of answers, and records within texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import CREDENTIAL

#: What a passage's id looks like, the longest answer, and what stands for a withheld one.
PASSAGE_ID = r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*#\d{4}\b"
MOST_LETTERS = 8000
WITHHELD = "[answer withheld: it contained something shaped like a credential]"
LEAK = "credential-shaped"


def fact_citation(ticker: Column, year: Column, basis: Column, period: Column, concept: Column, segment: Column) -> Column:
    """``FACT:ticker:year:basis:period:concept``, and the segment if there is one."""
    return F.concat_ws(":", F.lit("FACT"), ticker, year.cast("string"), basis, period, concept, segment)


def chunk_citation(document: Column, page: Column, heading: Column) -> Column:
    return F.concat_ws(" · ", document, F.concat(F.lit("p."), page.cast("string")), F.nullif(heading, F.lit("")))


def fact_json(fact: Column) -> Column:
    """A fact as JSON; a balance has the day that it is as at, another the days from and to."""
    period = F.when(fact["period_start"].isNull(), F.create_map(F.lit("as_at"), fact["period_end"].cast("string"))).otherwise(F.create_map(F.lit("from"), fact["period_start"].cast("string"), F.lit("to"), fact["period_end"].cast("string")))
    return F.to_json(F.struct(*[fact[c].alias(c) for c in ("cite_as", "label", "value", "unit")], period.alias("period"), *[fact[c].alias(c) for c in ("basis", "segment", "tier", "source")]), {"ignoreNullFields": "false"})


def context_block(chunks: Column) -> Column:
    """Chunks (structs of id, citation and text, in order) as one text, blank lines between them."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["id"], F.lit("] "), c["citation"], F.lit("\n"), c["text"])), "\n\n")


def passages_in(block: Column) -> Column:
    """``array<struct<id, citation, text>>``: what ``context_block`` has put together."""
    shape = r"(?s)\[([^\]\n]+#\d{4})\] ([^\n]*)\n(.*?)(?=\n\n\[[^\]\n]+#\d{4}\] |\z)"
    return F.arrays_zip(*[F.regexp_extract_all(block, F.lit(shape), i).alias(n) for i, n in enumerate(("id", "citation", "text"), 1)])


def cited(text: Column) -> Column:
    """Ids of passages that stand in square brackets, in order, repeats kept."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), 1)
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(PASSAGE_ID), 0)))


def violations(text: Column, found: Column) -> Column:
    """Every rule that an answer breaks: it is empty or too long, cites what wasn't found, or has a credential."""
    invented = F.array_sort(F.array_except(cited(text), found))
    leaks = F.regexp_count(text, F.lit(CREDENTIAL))
    rules = F.array(
        F.when(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "", "the answer is empty").when(F.length(text) > MOST_LETTERS, "the answer is too long"),
        F.when(F.size(invented) > 0, F.concat(F.lit("cites passages it never retrieved: "), F.array_join(invented, ", "))),
        F.when(leaks > 0, F.concat(F.lit("contains "), leaks.cast("string"), F.lit(f" {LEAK} string(s)"))),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def shown(text: Column, broken: Column) -> Column:
    """An answer as it is read: withheld if it has a credential."""
    return F.when(F.exists(broken, lambda r: r.contains("credential")), WITHHELD).otherwise(text)


def masked(text: Column, mark: str = "[redacted]") -> Column:
    return F.regexp_replace(text, CREDENTIAL, mark)


def withheld_credentials(text: Column) -> Column:
    return text.rlike(CREDENTIAL)


def first_object(text: Column) -> Column:
    """What stands from the first opening to the last closing brace; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def records(text: Column, schema: str, field: str) -> Column:
    """The records of ``field`` in the first JSON object of a text; null if there is none or it isn't of that kind.

    ``schema``: of the whole object, as DDL."""
    whole = F.from_json(first_object(text), schema, {"mode": "PERMISSIVE"})
    return whole[field]


def facts_as_evidence(result: Column) -> Column:
    """``array<struct<id, source, text>>`` of the facts of a JSON answer that have a citation; empty for other texts."""
    facts = F.from_json(F.get_json_object(result, "$.facts"), "array<string>")
    one = lambda f: F.struct(F.get_json_object(f, "$.cite_as").alias("id"), F.coalesce(F.get_json_object(f, "$.source"), F.lit("")).alias("source"), f.alias("text"))
    return F.coalesce(F.filter(F.transform(facts, one), lambda p: p["id"].isNotNull()), F.array().cast("array<struct<id:string,source:string,text:string>>"))


BINDINGS = "map<string,struct<concept:string,at:string>>"


def bindings(text: Column) -> Column:
    """Stored bindings of a metric's variables."""
    return F.from_json(text, BINDINGS)


def bindings_json(value: Column) -> Column:
    """Bindings as stored: variables in order, each its time and concept."""
    entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"]["at"].alias("at"), e["value"]["concept"].alias("concept")).alias("value"))))
    return F.to_json(F.map_from_entries(entries))


def pairs(rows: Column, key: str, value: str) -> Column:
    """``struct<map, refusal>`` of a list of named pairs; a name that is given twice is refused."""
    names = F.transform(rows, lambda r: r[key])
    twice = F.size(F.array_distinct(names)) < F.size(names)
    return F.struct(F.when(~twice, F.map_from_entries(F.transform(rows, lambda r: F.struct(r[key], r[value])))).alias("map"), F.when(twice, "a name is given twice").alias("refusal"))


def merged(held: Column, new: Column) -> Column:
    """Two maps as one, the later value of a key counting."""
    return F.map_concat(F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


LEAKED_CALL = r'(?s)<tool_call>\s*\{\s*"name"\s*:\s*"([^"]+)"\s*,\s*"arguments"\s*:\s*(\{.*?\})\s*\}\s*</tool_call>'


def leaked_calls(text: Column, offered: list[str]) -> Column:
    """``struct<text, calls array<struct<name, arguments>>>``: whole calls of offered tools that a reply printed as markup,
    and the text without them."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(LEAKED_CALL), 1).alias("name"), F.regexp_extract_all(text, F.lit(LEAKED_CALL), 2).alias("arguments"), F.regexp_extract_all(text, F.lit(LEAKED_CALL), 0).alias("whole"))
    good = F.filter(found, lambda c: c["name"].isin(*offered) & F.try_parse_json(c["arguments"]).isNotNull())
    left = F.aggregate(good, text, lambda t, c: F.replace(t, c["whole"], F.lit("")))
    return F.struct(F.when(F.size(good) > 0, F.trim(left)).otherwise(text).alias("text"), F.transform(good, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))).alias("calls"))
