"""Line dedup by a deletion-neighbourhood join, within one edit.

Two lines are within one edit (a letter replaced, inserted or left out) exactly if they are equal, one equals the
other less one letter, or both are equal less the letter at the same place. So each line's variants, itself less
one letter at each place, are emitted as hashed keys; equal keys meet, and the earliest line that a line meets is
verified by edit distance. Every line that has an earlier one within the bound goes.

Equal lines are joined first, by 128 bits of hash, however short they are. Of distinct lines of ``MIN_CHARS``, only those can have a neighbour that share
with another one the first or the second half of the shorter of the two, at its length: four keys a line. Variants
are emitted for these alone. A key's group is bounded without a cap: distinct lines that give one variant at one
place differ in that letter alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.shingles import mixed

#: Shorter lines, trimmed, have no neighbours: one edit makes another word of them. Equal ones are dropped from ``shortest`` on.
MIN_CHARS = 20
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))


def variants(line: str) -> tuple[int, np.ndarray]:
    """Hash of a line, and those of the line less the letter at each place, from prefix sums."""
    c = mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 3)
    step = np.full(len(c), _BASE, np.uint64)
    step[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * np.multiply.accumulate(step), dtype=np.uint64)])
    less = sums[:-1] + (sums[-1] - sums[1:]) * _UNBASE
    whole = mixed(sums[-1:] + np.uint64(len(c) * _BASE & 0xFFFFFFFFFFFFFFFF))
    return int(whole.view(np.int64)[0]), mixed(less + np.uint64((len(c) - 1) * _BASE & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def halves(line: Column, n: Column, shift: int) -> list[Column]:
    """Keys of the first and second half of a line, as if its length were ``n``; the second is taken from the end."""
    half = F.floor(n / 2).cast("int")
    return [F.xxhash64(n, F.lit(0), line.substr(F.lit(1), half)), F.xxhash64(n, F.lit(1), line.substr(half + 1 + shift, n))]


def exploded(docs: DataFrame, text: str, key: str, shortest: int) -> DataFrame:
    """``k, t, at, line, h, g`` of each line that isn't blank and has ``shortest`` letters: document, its text's hash,
    place, trimmed line, hashes."""
    rows = shared.spread(shared.cased(docs, key, text)).filter(F.col(text).isNotNull())
    lines = rows.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter((F.length("line") >= shortest) & F.col("line").rlike(r"\S"))
    return lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), F.col("line")))


def near_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """``h, g`` of the distinct lines that have an earlier line within one edit but not equal.

    ``found``: distinct lines with keys of halves (null if too short) and their first occurrence ``first``; ``lines``: as of ``exploded``."""
    spark = found.sparkSession
    keys = found.select("h", "g", F.explode(F.array_distinct("halves")).alias("half"))
    alike = keys.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("half")
    wanted = shared.materialised(keys.join(alike, "half", "left_semi").select("h", "g").distinct().join(found.select("h", "g", "first"), ["h", "g"]), "open-lines")
    texts = lines.join(shared.sized(wanted), ["h", "g"]).filter(F.struct("k", "t", "at").eqNullSafe(F.col("first"))).select("h", "g", "first", "line").dropDuplicates(["h", "g"])
    texts = shared.materialised(texts, "open-texts")
    shared.small_batches(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [], []
            for line in batch.column(2).to_pylist():
                whole, less = variants(line)
                # of equal letters in a row one place is enough, as both lines' first unequal place is the same
                keys.append(np.concatenate([[whole], less]))
                places.append(np.arange(-1, len(less), dtype=np.int32))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((keys, pa.int64()), (places, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["h", "g", "key", "place"])

    emitted = texts.select("h", "g", "line").repartition("h").mapInArrow(emit, "h long, g long, key array<long>, place array<int>")
    rows = emitted.select("h", "g", F.explode(F.arrays_zip("key", "place")).alias("v")).select("h", "g", "v.key", "v.place")
    met = rows.groupBy("key").agg(F.collect_list(F.struct("place", "h", "g")).alias("own")).filter(F.size("own") > 1)
    met = met.select("key", F.explode("own").alias("o")).select("key", "o.*").join(texts.select("h", "g", "first"), ["h", "g"])
    met = shared.materialised(met, "met")
    one = F.struct("first", "h", "g")
    by_key = met.groupBy("key").agg(F.min(F.when(F.col("place") < 0, one)).alias("whole"), F.min(F.when(F.col("place") >= 0, one)).alias("less"))
    by_place = met.groupBy("key", "place").agg(F.min(one).alias("same"))
    best = met.join(by_key, "key").join(by_place, ["key", "place"])
    other = F.when(F.col("place") < 0, F.col("less")).otherwise(F.least("whole", "same"))
    pairs = best.select("h", "g", "first", other.alias("o")).filter("o.first < first").select("h", "g", F.col("o.h").alias("oh"), F.col("o.g").alias("og")).distinct()
    earlier = texts.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("line").alias("other"))
    return pairs.join(texts.select("h", "g", "line"), ["h", "g"]).join(earlier, ["oh", "og"]).filter(F.levenshtein("line", "other", 1) >= 0).select("h", "g").distinct()


def dropped_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shortest: int = MIN_CHARS) -> DataFrame:
    """``k, t, drop``: of each document (key and hash of its text) that loses lines, their places from 0."""
    lines = exploded(docs, text, key, shortest)
    n, line = F.length("line"), F.col("line")
    keyed = lines.select("k", "t", "at", "h", "g", F.when(n >= MIN_CHARS, F.array(*halves(line, n, 0), *halves(line, n - 1, 1))).alias("halves"))
    narrow = shared.materialised(keyed, "lines")
    found = narrow.groupBy("h", "g").agg(F.min(F.struct("k", "t", "at")).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    found = shared.materialised(found, "distinct-lines")
    near = near_lines(found, lines).withColumn("near", F.lit(True))
    # only lines that repeat or have an earlier neighbour take part from here
    known = found.join(near, ["h", "g"], "left").filter("n > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"), "n")
    known = shared.materialised(known, "repeated-lines")
    gone = shared.joined_by_size(narrow.select("k", "t", "at", "h", "g"), known, ["h", "g"], "n").filter(F.col("near") | ~F.struct("k", "t", "at").eqNullSafe(F.col("first")))
    return shared.materialised(gone.groupBy("k", "t").agg(F.collect_set("at").alias("drop")), "dropped")


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shortest: int = MIN_CHARS) -> DataFrame:
    """The rows with all their columns, their text without dropped lines, and ``n_lines``, ``n_dropped``.

    Lines end at a line feed and are compared trimmed; order is by key (null first), hash of the text, place. A line of
    at least ``MIN_CHARS`` letters that has an earlier one within one edit goes, be that one kept or not; so does one of
    at least ``shortest`` letters that has an equal earlier one, unless it is blank. A null text
    stays null, with no lines; an empty text has one, empty, line. Rows with equal key and text are one document and
    give equal rows. Long texts are whole; other columns pass as they are."""
    gone = dropped_lines(docs, text=text, key=key, shortest=shortest)
    # columns go by place, so that no name of the input can clash with one of these
    names = list(docs.columns)
    mine = docs.toDF(*[f"c{i}" for i in range(len(names))])
    whole, own = F.col(f"c{names.index(text)}"), F.col(f"c{names.index(key)}")
    joined = mine.withColumn("hash", F.xxhash64(whole)).join(shared.sized(gone), own.eqNullSafe(F.col("k")) & (F.col("hash") == F.col("t")), "left")
    lines = F.split(whole, "\n")
    left = F.when(F.col("drop").isNull(), whole).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("drop", i)), "\n"))
    kept = [left if c == text else F.col(f"c{i}") for i, c in enumerate(names)]
    out = joined.select(*kept, F.coalesce(F.when(whole.isNotNull(), F.size(lines)), F.lit(0)), F.coalesce(F.size("drop"), F.lit(0)))
    return out.toDF(*names, "n_lines", "n_dropped")
