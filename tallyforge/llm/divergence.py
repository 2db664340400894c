"""Audit of how sources differ: distances between the word distributions of groups, exactly.

A group is a source of a language. Its distance to another is a sum over all kept terms of f(count here, count there), and
f sees nothing of a term but its two counts. So for each pair of groups it is tallied how many terms have each combination
of counts: a joint histogram, far smaller than the vocabulary, as most counts are small. Terms that neither has are one
more cell, known from the size of the vocabulary. f is evaluated once for each combination and multiplied.

Terms are counted in the tasks that read the texts, and meet by term, a row for each group that has the term: whatever a
group's share of all documents, its rows are spread by term. The table of terms and their counts by group is written
once and tallied in blocks of terms, whose histograms are added up by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import shared

#: Documents of a language that a kept term is in at least, what is added to each count, and the unit of p.
LEAST_DOCUMENTS, ADDED, UNIT = 30, 5, 1_000_000_000
#: Entries that a task counts before it hands them on, and cells (terms by sources) that it tallies as one block.
ENTRIES, CELLS = 200_000, 1 << 21
#: A-Z become a-z; other ASCII parts terms. All bytes of other characters belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task's rows, in several parts if there are many."""
    n, docs, held = {}, {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            size, own = len(found), docs[lang, source]
            for at in range(0, size, 50_000):
                keys = list(found)[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array(keys, pa.binary()).cast(pa.string()), pa.array([found[k] for k in keys], pa.int64()), pa.array([own[k] for k in keys], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (lang, source) not in n:
                n[lang, source], docs[lang, source] = Counter(), Counter()
            own = n[lang, source]
            held -= len(own)
            own.update(words := terms(text))
            docs[lang, source].update(set(words))
            held += len(own)
            if held >= ENTRIES:
                yield from out()
                n, docs, held = {}, {}, 0
    yield from out()
    shared.settle()


def counted(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, total, at`` of every kept term; ``at`` has (source, n) of each source of the language that has it."""
    rows = shared.spread(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # dealt by term once; both sums are made where a term's rows have met
    by_source = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("at")).filter(F.col("docs") >= least).drop("docs")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, x, y, terms): of each pair of a language's sources, a < b, how many terms of a block have which counts,
    both above nought."""
    held: dict[str, list[dict[str, int]]] = {}
    sources: dict[str, set[str]] = {}

    def out(lang: str) -> Iterator[pa.RecordBatch]:
        names, found = sorted(sources.pop(lang)), held.pop(lang)
        place = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(names), len(found)), np.int64)
        for i, of in enumerate(found):
            counts[[place[s] for s in of], i] = list(of.values())
        there = (counts > 0).astype(np.float32)
        meet = np.triu(there @ there.T, 1) > 0
        values = [np.unique(row, return_inverse=True) for row in counts]
        for i, j in zip(*np.nonzero(meet), strict=True):
            (xs, x), (ys, y) = values[i], values[j]
            cells, many = np.unique(x.astype(np.int64) * len(ys) + y, return_counts=True)
            x_, y_ = xs[cells // len(ys)], ys[cells % len(ys)]
            some = (x_ > 0) & (y_ > 0)
            k = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array([v] * k) for v in (lang, names[i], names[j])] + [pa.array(v[some], pa.int64()) for v in (x_, y_, many)], ["lang", "a", "b", "x", "y", "terms"])

    for batch in batches:
        for lang, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append({f["source"]: f["n"] for f in found})
            names = sources.setdefault(lang, set())
            names.update(f["source"] for f in found)
            if len(names) * len(held[lang]) >= CELLS:
                yield from out(lang)
    for lang in list(held):
        yield from out(lang)


def share(count: str, total: str, v: str) -> Column:
    """p = 1 + floor(UNIT * (count + ADDED) / (total + ADDED * v)), in two exact steps of whole numbers: they hold up to 9e13
    occurrences, and beyond it an overflow is an error, not a wrong result."""
    high, low = 100_000, UNIT // 100_000
    c, d = f"({count} + {ADDED})", f"({total} + {ADDED} * {v})"
    return F.expr(f"1 + ({c} * {high} div {d}) * {low} + (({c} * {high} % {d}) * {low} div {d})")


def divergence(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group (language and source).

    Part ``pair`` has the distance to each other source of the language, part ``term`` the terms whose share in the group is
    furthest above that in the language. Null texts, languages and sources are empty strings. A language without kept terms
    has distances of 0 and no terms; a language of one source has no pairs; an empty table gives no rows."""
    docs = shared.cased(docs, lang, source, text).toDF("lang", "source", "text").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shared.small_batches(docs.sparkSession)
    kept = shared.materialised(counted(docs, least), "terms")
    each = kept.select("lang", "term", "total", F.inline("at"))
    marginal = shared.materialised(each.groupBy("lang", "source", F.col("n").alias("x")).agg(F.count("*").alias("terms")), "marginal")

    sums = marginal.groupBy("lang", "source").agg(F.sum(F.col("x") * F.col("terms")).alias("size"), F.sum("terms").alias("held"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "held", "v", "all")])
    groups = shared.materialised(groups, "groups")

    one = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("na"), F.col("held").alias("ha"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("nb"), F.col("held").alias("hb"))
    pairs = one.join(two, "lang").filter("a < b")  # a row for each pair of the result
    pa_, pb = (lambda x: share(x, "na", "v")), (lambda y: share(y, "nb", "v"))
    f = lambda x, y: F.abs(pa_(x) - pb(y))
    # cells that both have; each also takes its terms away from the cells where one has none
    block = kept.select("lang", "at").mapInArrow(_tallied, "lang string, a string, b string, x long, y long, terms long")
    joint = block.groupBy("lang", "a", "b", "x", "y").agg(F.sum("terms").alias("terms")).join(shared.sized(pairs), ["lang", "a", "b"])
    parts = [joint.select("lang", "a", "b", (F.col("terms") * (f("x", "y") - f("x", "0L") - f("0L", "y") + f("0L", "0L"))).alias("value"))]
    # cells where one has none, as if no term were shared
    for side, own in (("a", lambda: f("x", "0L")), ("b", lambda: f("0L", "x"))):
        cells = marginal.withColumnRenamed("source", side).join(shared.sized(pairs), ["lang", side])
        parts.append(cells.select("lang", "a", "b", (F.col("terms") * own()).alias("value")))
    # and where neither has any
    nought = (F.col("v") - F.col("ha") - F.col("hb")) * F.when(F.col("v") > 0, f("0L", "0L")).otherwise(0)
    parts.append(pairs.select("lang", "a", "b", nought.alias("value")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    value = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    value = value.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")).select("lang", "s.source", "s.item", "value")

    above = each.join(shared.sized(groups), ["lang", "source"]).withColumn("value", share("n", "size", "v") - share("total", "all", "v")).filter("value > 0")
    above = above.select("lang", "source", F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.withColumns({"part": F.lit(part), "rank": F.row_number().over(order)})
    out = ranked(value, "pair").unionByName(ranked(above, "term").filter(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
