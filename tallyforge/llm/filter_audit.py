"""Audit of how filters interact: what each removes, repeats or removes alone, under every order of them.

Every document has a mask of the filters that it fails. Four of them look at the text alone; the fifth, equality with a
document of a smaller id, is found by sorting: rows are dealt to ranges of (fingerprint, id, a number of their own) and
sorted by fingerprint, full text and id, and each row is compared with its predecessor, batch after batch. A
fingerprint's rows can lie in several ranges, so each range also gives the texts of its first and its last fingerprint
with their least ids, one row each; the least over all ranges decides. A group of copies of any size is thus dealt over
as many ranges as its rows need.

Masks are counted by part and label, and all that the audit tells is a sum over masks: of a mask, an order and a step it is
known whether the step's filter removes, would have removed, or alone fails the document. No text is read for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared

#: The last of the filters is equality with an earlier text; the others are columns of the text.
NAMES = "ABCDE"
#: What parts words, as a character class.
GAPS = r"[\x20\x09-\x0D]+"


def text_filters(text: Column, *, least_words: int = 100, distinct: int = 80, upper: int = 10, symbols: str = "[#$%&*|]") -> list[Column]:
    """Failure of A to D: few words, few distinct words (percent), many of A-Z (percent of code points), a symbol."""
    words = F.array_remove(F.split(text, GAPS), "")
    n, capitals = F.size(words), F.regexp_count(text, F.lit("[A-Z]"))
    return [n < least_words, 100 * F.size(F.array_distinct(words)) < distinct * n, 100 * capitals > upper * F.length(text), text.rlike(symbols)]


_FIELDS = [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("p", pa.int32()), ("fp", pa.int64()), ("nth", pa.int32()), ("least", pa.int64()), ("text", pa.string())]
_SCHEMA = "doc_id long, part string, mask int, p int, fp long, nth int, least long, text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range without texts, with the number of their text within their fingerprint and the least id of the
    text here; and a row with the text for each text of the first and last fingerprint (its mask is null)."""
    p, first = TaskContext.get().partitionId(), None
    fp = text = least = None  # of the row before
    nth, edge = 0, []  # the number of its text, and (number, text, least id) of the texts of its fingerprint
    schema = pa.schema(_FIELDS)

    def edges(of: int, found: list) -> pa.RecordBatch:
        n = len(found)
        none = lambda kind: pa.nulls(n, kind)
        return pa.RecordBatch.from_arrays(
            [none(pa.int64()), none(pa.string()), none(pa.int32()), pa.array([p] * n, pa.int32()), pa.array([of] * n, pa.int64()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())],
            schema=schema,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column
        fps, texts, ids = column(0).to_numpy(), column(1), column(2)
        starts = np.ones(len(fps), bool)  # rows whose text isn't the one before
        same = np.flatnonzero(fps[1:] == fps[:-1]) + 1
        if len(same):
            starts[same] = ~pc.equal(texts.take(pa.array(same)), texts.take(pa.array(same - 1))).to_numpy(zero_copy_only=False)
        starts[0] = fp is None or fps[0] != fp or texts[0].as_py() != text
        at = np.flatnonzero(starts)
        numbers, leasts = np.empty(len(fps), np.int32), np.empty(len(fps), object)
        numbers[: at[0] if len(at) else len(fps)] = nth
        leasts[: at[0] if len(at) else len(fps)] = least
        ends = [*at[1:].tolist(), len(fps)] if len(at) else []  # a batch may hold nothing but the text before
        for a, z in zip(at.tolist(), ends, strict=True):
            now, least = int(fps[a]), ids[a].as_py()
            if now != fp:
                if first is None and fp is not None:
                    first = fp
                    yield edges(fp, edge)
                fp, nth, edge = now, 0, []
            else:
                nth += 1
            edge.append((nth, texts[a].as_py(), least))
            numbers[a:z], leasts[a:z] = nth, least
        text = edge[-1][1]
        n = len(fps)
        yield pa.RecordBatch.from_arrays([ids, column(3), column(4), pa.array(np.full(n, p, np.int32)), column(0), pa.array(numbers), pa.array(leasts.tolist(), pa.int64()), pa.nulls(n, pa.string())], schema=schema)
    if fp is not None:
        yield edges(fp, edge)


def masks(docs: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "lang", **limits) -> DataFrame:
    """``doc_id, part, mask`` of every row; bit i of the mask is set if the i-th filter fails.

    A null text is empty, a null part is an empty string. Rows with the least id of their text pass the last filter, all of
    them if the id is repeated; a null id is neither smaller nor larger than any, so its rows pass. An empty table gives no rows.
    Other columns are not read."""
    rows = shared.cased(docs, key, text, part).toDF("doc_id", "text", "part").withColumns({"text": F.coalesce("text", F.lit("")), "part": F.coalesce("part", F.lit(""))})
    rows = rows.select(F.xxhash64("text").alias("fp"), "text", F.col("doc_id").cast("long").alias("doc_id"), "part", F.monotonically_increasing_id().alias("own"))
    dealt = rows.repartitionByRange("fp", "doc_id", "own").sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_filters(F.col("text"), **limits))), F.lit(0)).cast("int")
    shared.small_batches(docs.sparkSession)
    # the masks come after the shuffle, as the pass that finds the ranges would work them out too
    ranges = shared.materialised(dealt.select("fp", "text", "doc_id", "part", bits.alias("mask")).mapInArrow(_runs, _SCHEMA), "ranges")
    edges = ranges.filter("mask IS NULL")
    over = edges.groupBy("fp", "text").agg(F.min("least").alias("over")).withColumnRenamed("fp", "f")
    edges = edges.join(over, (edges.fp == over.f) & (edges.text == over.text)).select("p", "fp", "nth", "over")
    found = ranges.filter("mask IS NOT NULL").join(shared.sized(shared.materialised(edges, "edges")), ["p", "fp", "nth"], "left")
    repeated = F.coalesce(F.col("doc_id") > F.coalesce("over", "least"), F.lit(False))
    return found.select("doc_id", "part", (F.col("mask") + F.when(repeated, 1 << len(NAMES) - 1).otherwise(0)).alias("mask"))


def rules(names: str = NAMES) -> list[tuple]:
    """Of every order, step and mask: (filter_order, step, mask, kept, removed, redundant, alone, share of all orders that the
    step's filter removes in). The share's sum over orders is the number of orders divided by the filters failed, a whole number."""
    bit = {x: 1 << i for i, x in enumerate(names)}
    out = []
    for order in permutations(names):
        before = 0
        for step, x in enumerate(order, 1):
            for mask in range(1 << len(names)):
                fails = bool(mask & bit[x])
                gone = bool(mask & before)
                out.append(("".join(order), step, mask, not gone and not fails, not gone and fails, gone and fails, mask == bit[x], factorial(len(names)) // mask.bit_count() if fails else 0))
            before |= bit[x]
    return out


def audited(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """``part, filter_order, step`` and counts of documents: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for each part, order and step. A document is good or toxic if any of its label rows says so; null ids have no labels.
    Without documents there are no parts and no rows."""
    spark = docs.sparkSession
    marks = shared.cased(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "bad"))])
    found = masks(docs, **names).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # so that a repeated id is one row in the join
    there = found.filter("doc_id IS NOT NULL").join(shared.sized(shared.materialised(marks.filter("good + bad > 0"), "marks")), "doc_id", "left")
    counts = there.select("part", "mask", "n", "good", "bad").unionByName(found.filter("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("bad")))
    counts = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "bad")])
    table = spark.createDataFrame(rules(), "filter_order string, step int, mask int, kept boolean, removed boolean, redundant boolean, alone boolean, share int")
    total = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)).cast("long")
    return (
        counts.join(F.broadcast(table), "mask")  # a row for each order, step and mask: fixed
        .groupBy("part", "filter_order", "step")
        .agg(
            total("kept").alias("kept"),
            total("removed").alias("removed"),
            total("redundant").alias("redundant"),
            total("alone").alias("unique_fails"),
            total("removed", "good").alias("good_lost"),
            total("removed", "bad").alias("toxic_lost"),
            F.sum(F.col("n") * F.col("share")).cast("long").alias("shapley"),
        )
    )
