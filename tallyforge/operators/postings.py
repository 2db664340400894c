"""A stored index of texts by their words, searched by BM25 without reading a text.

Documents are indexed in segments. A segment deals its documents to ranges of up to ``RANGE``; of each range a word has
one block: the documents that hold it as gaps, how often each does, the largest frequency and the shortest of these
documents. A range also has a row of its own with ids and lengths. Blocks are Parquet, in folders by a hash of the word and
sorted by word, so that a search reads the folders and row groups of its words alone. Texts are cut and counted in one pass
without a shuffle; what is dealt by word afterwards are blocks, and a common word has as many of them as there are ranges.

A search has two passes. The first reads the heads of blocks: the largest frequency and the shortest document bound what a
range can score for a query, whatever the lengths of documents added later. The ranges with the largest bounds are
scored, and the k-th best score so far is a threshold; of the others only ranges that can reach it are read and scored.

New documents are a new segment and one commit; ``merged`` makes one segment of all, from blocks, and leaves documents out."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import tokens
from tallyforge.operators.retrieval import refuse, top
from tallyforge.sinks.snapshots import Manifest, Tables
from tallyforge.sizes import placed, sized, spread

#: Documents of a range, folders by word, and ranges that a query's threshold is taken from.
RANGE, BUCKETS, FIRST = 512, 8, 8
#: Arrow batches hold this many bytes of words at most.
BATCH_BYTES = 16 << 20
#: Words of queries that are searched for at a time.
QUERY_WORDS = 200_000
#: Products that are added up at a time.
CELLS = 1 << 21


def _schema(kind: str) -> str:
    """Rows of blocks (``term``) and of ranges (no term, ``ids`` and ``lengths``)."""
    return f"range long, term string, n int, most int, shortest int, gaps array<int>, counts array<int>, ids array<{kind}>, lengths array<int>, bucket int"


def _bucket(term: Column, buckets: int) -> Column:
    """The folder of a word; rows of ranges have one of their own."""
    return F.when(term.isNull(), -1).otherwise(F.crc32(term) % buckets).cast("int")


def _lists(flat: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(flat, pa.int32()))


def _blocked(ids: pa.Array, docs: np.ndarray, words: pa.Array, counts: np.ndarray, lengths: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
    """The row of a range and its blocks, from (document, word, count) in any order."""
    names = ["range", "term", "n", "most", "shortest", "gaps", "counts", "ids", "lengths"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(ids.type), pa.list_(pa.int32())]
    own = [pa.array([number]), None, None, None, None, None, None, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _lists(lengths, np.array([0, len(lengths)]))]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, t) if c is None else c for c, t in zip(own, kinds, strict=True)], names)
    if not len(docs):
        return
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((docs, codes))
    codes, docs, counts = codes[order], docs[order], counts[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    borders = np.append(starts, len(codes))
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = docs[starts]
    n = len(starts)
    columns = [np.full(n, number), coded.dictionary.take(pa.array(codes[starts])), np.diff(borders), np.maximum.reduceat(counts, starts), np.minimum.reduceat(lengths[docs], starts), _lists(gaps, borders), _lists(counts, borders), None, None]
    yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents given with their words."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, RANGE):
            ids, words = batch.column(0).slice(at, RANGE), batch.column(1).slice(at, RANGE)
            lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            pairs, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
            yield from _blocked(ids, pairs // size, coded.dictionary.take(pa.array(pairs % size)), counts, lengths, number)
            number += 1


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) of every place of runs that begin and are as long as told."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each with its range's first new number (``base``) and which documents are left (32 in each of ``bits``), as pieces
    of blocks of the new ranges, of which an old one meets two at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.list_value_length(batch.column("gaps")).to_numpy().astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        gaps, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("gaps", "counts"))
        docs = np.cumsum(gaps)
        docs -= np.repeat(docs[begins] - gaps[begins], sizes)  # each block begins anew
        row = np.repeat(np.arange(len(sizes)), sizes)
        bits = batch.column("bits").flatten().to_numpy().astype(np.int64).reshape(len(sizes), -1)
        whole, ones = docs // 32, np.bitwise_count(bits).astype(np.int64)
        word = bits[row, whole]
        rank = (np.cumsum(ones, 1) - ones)[row, whole] + np.bitwise_count(word & ((np.int64(1) << (docs % 32)) - 1))
        here = (word >> (docs % 32)) & 1 == 1
        number, row, counts = (batch.column("base").to_numpy()[row] + rank)[here], row[here], counts[here]
        new = number // RANGE
        starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(new, prepend=-1) != 0))
        borders = np.append(starts, len(row))
        yield pa.RecordBatch.from_arrays([pa.array(new[starts]), *(batch.column(c).take(pa.array(row[starts])) for c in ("term", "shortest")), _lists(number % RANGE, borders), _lists(counts, borders)], ["range", "term", "shortest", "docs", "counts"])


def _scored(asked: tuple, mean: float, k: int, k1: float, b: float):
    """Of a range, given by its row (with the queries that it is scored for) and blocks, each query's first k documents, and those
    with the score of the last."""
    terms, first, queries, weights = asked

    def run(table: pa.Table) -> pa.Table:
        kind = table.schema.field("ids").type.value_type
        alone = pc.is_null(table["term"])
        left, right = table.filter(pc.invert(alone)).sort_by("term"), table.filter(alone)
        if not left.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "doc_id": pa.array([], kind), "score": pa.array([], pa.float64())})
        ids, lengths = right["ids"].combine_chunks().flatten(), right["lengths"].combine_chunks().flatten().to_numpy()
        wanted = np.unique(right["queries"].combine_chunks().flatten().to_numpy())
        short = k1 * (1 - b + b * lengths / mean)
        scores = np.zeros(len(wanted) * len(lengths))
        sizes = pc.list_value_length(left["gaps"]).to_numpy().astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        gaps, tf = left["gaps"].combine_chunks().flatten().to_numpy().astype(np.int64), left["counts"].combine_chunks().flatten().to_numpy().astype(float)
        docs = np.cumsum(gaps)
        docs -= np.repeat(docs[begins] - gaps[begins], sizes)  # each block begins anew
        part = tf * (k1 + 1) / (tf + short[docs])
        # every block meets the queries that ask for its word
        at = np.searchsorted(terms, left["term"].to_numpy(zero_copy_only=False))
        block, entry = _ragged(first[at], first[at + 1] - first[at])
        row = np.minimum(np.searchsorted(wanted, queries[entry]), len(wanted) - 1)
        here = wanted[row] == queries[entry]
        block, entry, row = block[here], entry[here], row[here]
        step = max(1, CELLS // max(int(sizes.max(initial=1)), 1))
        for i in range(0, len(block), step):
            pair, posting = _ragged(begins[block[i : i + step]], sizes[block[i : i + step]])
            scores += np.bincount(row[i : i + step][pair] * len(lengths) + docs[posting], weights[entry[i : i + step]][pair] * part[posting], len(scores))
        scores = scores.reshape(len(wanted), -1)
        scores = np.round(scores, 9)
        n = min(k, scores.shape[1])
        least = np.maximum(np.partition(scores, scores.shape[1] - n, 1)[:, scores.shape[1] - n], 1e-300)  # ties are decided by id later
        i, j = np.nonzero(scores >= least[:, None])
        return pa.table({"q": pa.array(wanted[i], pa.int64()), "doc_id": ids.take(pa.array(j)), "score": scores[i, j]})

    return run


class Postings:
    """The index of a folder. ``kind``: the SQL type of document ids, for a new one."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long", buckets: int = BUCKETS) -> None:
        self.spark, self.tables = spark, Tables(spark, folder)
        self.info = {"kind": kind, "buckets": buckets, "n": 0, "words": 0} | self.tables.manifest().info

    def _rows(self, at: Manifest) -> DataFrame:
        return self.tables.read("postings", _schema(self.info["kind"]), at)

    def _segment(self, blocks: DataFrame) -> tuple[str, int, int]:
        """Writes a segment: (its part, documents, words)."""
        # files of a good size, however common a folder's words are
        dealt = blocks.withColumn("bucket", _bucket(F.col("term"), self.info["buckets"])).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
        part = self.tables.stage("postings", dealt, ["bucket"])
        own = self._rows(Manifest(tables={"postings": [part]})).filter("bucket = -1")
        n, words = own.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("words")).agg(F.sum("n"), F.sum("words")).first()
        return part, n or 0, words or 0

    def add(self, docs: DataFrame) -> Manifest:
        """Indexes ``docs(doc_id, text)`` as a new segment. Ids must be new; a null text has no words."""
        at = self.tables.manifest()
        if at.tables.get("postings"):
            held = self._rows(at).filter("bucket = -1").select(F.explode("ids").alias("doc_id"))
            if not held.join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
                raise ValueError("some of the documents are in the index already")
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        kind = self.info["kind"]
        cut = spread(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")).select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
        part, n, words = self._segment(cut.mapInArrow(_cut, _schema(kind).rpartition(",")[0]))
        now = {"n": at.info.get("n", 0) + n, "words": at.info.get("words", 0) + words}
        return self._committed({"postings": [*at.tables.get("postings", []), part]}, now, at)

    def merged(self, without: DataFrame | None = None) -> Manifest:
        """One segment of all, without the documents of ``without(doc_id)``. Reads blocks, and no text."""
        at = self.tables.manifest()
        rows, kind = self._rows(at), self.info["kind"]
        whole = rows.filter("bucket = -1").select("part", "range", F.explode(F.arrays_zip("ids", "lengths", F.sequence(F.lit(0), F.size("ids") - 1).alias("doc"))).alias("x")).select("part", "range", "x.doc", F.col("x.ids").alias("doc_id"), F.col("x.lengths").alias("length"))
        if without is not None:
            whole = whole.join(sized(without.select(F.col("doc_id").cast(kind).alias("doc_id")).distinct()), "doc_id", "left_anti")
        # ranges keep their order and close up: of each, where its first document comes and which are left
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        listed = whole.groupBy(F.col("part").alias("segment"), "range").agg(F.array_sort(F.collect_list(F.struct("doc", "doc_id", "length"))).alias("x"))
        kinds = f"segment string, range long, x array<struct<doc: int, doc_id: {kind}, length: int>>"
        listed = self.tables.read("left", kinds, Manifest(tables={"left": [self.tables.stage("left", listed)]})).drop("part")
        first = placed(listed.select("segment", "range", F.size("x").alias("n")), ["segment", "range"], value="n").select("segment", "range", (F.col("total") - F.col("n")).cast("long").alias("base"))
        numbers = listed.join(sized(first), ["segment", "range"])
        bits = F.transform(F.sequence(F.lit(0), F.lit(RANGE // 32 - 1)), lambda w: F.aggregate(F.filter("x.doc", lambda d: F.floor(d / 32) == w), F.lit(0).cast("long"), lambda b, d: b + F.pow(F.lit(2.0), d % 32).cast("long")))
        masks = numbers.select("segment", "range", "base", bits.alias("bits"))
        blocks = rows.filter("bucket >= 0").select(F.col("part").alias("segment"), "range", "term", "shortest", "gaps", "counts").join(sized(masks), ["segment", "range"])
        pieces = blocks.select("term", "shortest", "gaps", "counts", "base", "bits").mapInArrow(_moved, "range long, term string, shortest int, docs array<int>, counts array<int>")
        # pieces of a block follow one another; the shortest document bounds what is left of it
        met = pieces.groupBy("range", "term").agg(F.min("shortest").alias("shortest"), F.array_sort(F.collect_list(F.struct("docs", "counts"))).alias("x"))
        met = met.select("range", "term", "shortest", F.flatten("x.docs").alias("docs"), F.flatten("x.counts").alias("counts"))
        before = F.zip_with("docs", F.concat(F.array(F.lit(0)), "docs"), lambda v, last: v - last)
        none = [F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<int>").alias("lengths")]
        blocks = met.select("range", "term", F.size("docs").alias("n"), F.array_max("counts").alias("most"), "shortest", F.slice(before, F.lit(1), F.size("docs")).alias("gaps"), "counts", *none)
        each = numbers.select("base", F.posexplode("x").alias("i", "d")).select((F.col("base") + F.col("i")).alias("number"), "d")
        own = each.groupBy(F.floor(F.col("number") / RANGE).alias("range")).agg(F.array_sort(F.collect_list(F.struct("number", "d"))).alias("x"))
        gone = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("n", "int"), ("most", "int"), ("shortest", "int"), ("gaps", "array<int>"), ("counts", "array<int>"))]
        ranges = own.select("range", *gone, F.transform("x", lambda v: v["d"]["doc_id"]).alias("ids"), F.transform("x", lambda v: v["d"]["length"]).alias("lengths"))
        part, n, words = self._segment(blocks.unionByName(ranges))
        return self._committed({"postings": [part]}, {"n": n, "words": words}, at)

    def _committed(self, tables: dict, now: dict, at: Manifest) -> Manifest:
        done = self.tables.commit(tables, self.info | now, over=at)
        self.info = done.info
        return done

    def bm25(self, queries: DataFrame, *, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """``query_id, doc_id, score, rank`` for ``queries(query_id, text)``, as ``retrieval.bm25`` gives them for the documents of the
        index. Queries are a stated set; up to ``QUERY_WORDS`` of their words are searched for at a time."""
        refuse(k)
        at = self.tables.manifest()
        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        turns, out, rows = 1, None, asked.limit(QUERY_WORDS + 1).collect()  # a bound
        if len(rows) > QUERY_WORDS:
            turns = math.ceil(2 * asked.count() / QUERY_WORDS)
        for turn in range(turns):
            if turns > 1:  # half of the bound on average
                rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).collect()
            found = self._search(at, rows, kind, k, k1, b)
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], f"query_id {kind}, doc_id {self.info['kind']}, score double, rank int")
        return top(out, "query_id", "doc_id", k)

    def _search(self, at: Manifest, asked: list, kind: str, k: int, k1: float, b: float) -> DataFrame:
        spark, info = self.spark, at.info
        mean = info["words"] / info["n"] if info.get("n") and info.get("words") else 1.0
        names = sorted({r.query_id for r in asked})
        place = {name: i for i, name in enumerate(names)}
        terms = sorted({r.term for r in asked})
        none = spark.createDataFrame([], f"query_id {kind}, doc_id {info.get('kind', 'long')}, score double")
        if not terms or not info.get("n"):
            return none
        buckets = info["buckets"]
        words = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
        folders = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
        rows = self._rows(at)
        blocks = rows.filter(F.col("bucket").isin(folders)).join(words, "term", "left_semi")
        heads = blocks.select("part", "range", "term", "n", "most", "shortest").persist()
        df = dict(heads.groupBy("term").agg(F.sum("n")).collect())  # a row a word that is asked for
        idf = {t: math.log(1 + (info["n"] - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        entries = sorted((r.term, place[r.query_id], idf[r.term] * r.times) for r in asked if r.term in idf)
        if not entries:
            return none
        terms = np.array(sorted(idf), object)
        first = np.searchsorted(np.array([e[0] for e in entries], object), terms)
        sent = (terms, np.append(first, len(entries)), np.array([e[1] for e in entries]), np.array([e[2] for e in entries]))
        weights = F.broadcast(spark.createDataFrame(entries, "term string, q long, weight double"))
        bound = F.col("weight") * F.col("most") * (k1 + 1) / (F.col("most") + k1 * (1 - b + b * F.col("shortest") / mean))
        bounds = heads.join(weights, "term").groupBy("q", "part", "range").agg(F.sum(bound).alias("bound")).persist()

        def scored(chosen: DataFrame) -> DataFrame:
            """Scores of ``q, part, range``: ranges' rows and blocks meet by range."""
            by_range = chosen.groupBy("part", "range").agg(F.collect_list("q").alias("queries"))
            own = rows.filter("bucket = -1").unionByName(rows.filter(F.col("bucket").isin(folders)).join(words, "term", "left_semi").select(*rows.columns))
            met = own.select("part", "range", "term", "gaps", "counts", "ids", "lengths").join(by_range, ["part", "range"])
            met = met.withColumn("queries", F.when(F.col("term").isNull(), F.col("queries")))
            return met.groupBy("part", "range").applyInArrow(_scored(sent, mean, k, k1, b), f"q long, doc_id {info['kind']}, score double")

        ranked = top(bounds.withColumnRenamed("bound", "score").withColumn("key", F.struct("part", "range")), "q", "key", FIRST)
        seeds = ranked.select("q", "part", "range").collect()  # FIRST rows a query
        seeds = F.broadcast(spark.createDataFrame(seeds, "q long, part string, range long"))
        early = scored(seeds).persist()
        least = top(early, "q", "doc_id", k).groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("least")).collect()  # a row a query
        least = F.broadcast(spark.createDataFrame(least, "q long, least double"))
        rest = bounds.join(seeds, ["q", "part", "range"], "left_anti").join(least, "q", "left")
        late = scored(rest.filter(F.col("bound") + 1e-8 >= F.coalesce("least", F.lit(0.0))).select("q", "part", "range"))
        named = spark.createDataFrame(list(enumerate(names)), f"q long, query_id {kind}")
        return early.unionByName(late).join(F.broadcast(named), "q").select("query_id", "doc_id", "score")

    def ranker(self):
        """A ranker of the documents of the index: a function of (documents, queries, k), which reads no documents."""
        return lambda docs, queries, k: self.bm25(queries, k=k)
