"""Choice of a classifier's penalty by folds, all fits at once, and leave-one-out without fitting anew.

For labelled sets that one task can hold (``ROWS`` rows, ``ENTRIES`` counts; more is refused, ``classifier.out_of_fold`` takes any
number). Spark counts words and pairs of words; the grid of penalties and folds is a table, each row of which is fitted by a
task of its own. A fit is logistic regression by Newton's steps in the space of the rows, one class against the others; its
curvature also tells what each row's score would be without the row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.classifier import FOLDS, folded
from tallyforge.sinks.snapshots import written
from tallyforge.sizes import sized

ROWS, ENTRIES = 4_000, 2_000_000
#: Strengths that are tried, as the weight of the rows against the penalty.
GRID = (0.1, 1.0, 10.0, 100.0)
#: Terms that are multiplied at a time.
BLOCK = 2_048
#: Arrow batches hold this many bytes of words at most.
BATCH_BYTES = 16 << 20


def word_terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def term_counts(rows: DataFrame, *kept: str) -> DataFrame:
    """``key, term, n`` of rows (``key, text``), and the columns ``kept``, which go by the key. A row's words are counted where it
    is read, without a shuffle; only rows whose key is there more than once are dealt by it and counted together."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", *kept))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy().astype(np.int64)
            coded = batch.column(0).flatten().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            pairs, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
            row = pa.array(pairs // size)
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns[1:]), coded.dictionary.take(pa.array(pairs % size)), pa.array(n, pa.int64())], names=["key", *kept, "term", "n"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    terms = word_terms(F.col("text")).alias("terms")
    own = lambda rows: rows.select(terms, "key", *kept).mapInArrow(count, f"{kinds}, term string, n long").select("key", "term", "n", *kept)
    twice = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).filter("c > 1").select("k")
    if twice.isEmpty():
        return own(rows)
    twice = written(twice, "twice")
    met = rows["key"].eqNullSafe(twice["k"])
    again = rows.join(sized(twice), met, "left_semi").select(F.explode(terms).alias("term"), "key", *kept).groupBy("key", "term", *kept).agg(F.count("*").alias("n"))
    return own(rows.join(sized(twice), met, "left_anti")).unionByName(again)


@dataclass
class Gathered:
    """A labelled set as counts: row, term and count of each entry, and each row's key, class and fold."""

    keys: list
    classes: list
    label: np.ndarray
    fold: np.ndarray
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray

    def vectors(self, fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, value) of damped counts by the inverse frequency among the rows ``fitted``, each row of length 1."""
        terms = int(self.term.max(initial=-1)) + 1
        df = np.bincount(self.term[fitted[self.row]], minlength=terms)
        idf = np.log((1 + fitted.sum()) / (1 + df)) + 1
        known = df[self.term] > 0
        row, term = self.row[known], self.term[known]
        value = (1 + np.log(self.count[known])) * idf[term]
        length = np.sqrt(np.bincount(row, value**2, len(self.keys)))
        return row, term, value / length[row]

    def products(self, fitted: np.ndarray) -> np.ndarray:
        """Inner products of all rows, and 1 for the constant."""
        row, term, value = self.vectors(fitted)
        order = np.argsort(term, kind="stable")
        row, term, value = row[order], term[order], value[order]
        out = np.ones((len(self.keys), len(self.keys)))
        for at in range(0, int(term.max(initial=-1)) + 1, BLOCK):
            a, z = np.searchsorted(term, [at, at + BLOCK])
            part = np.zeros((len(self.keys), BLOCK))
            part[row[a:z], term[a:z] - at] = value[a:z]
            out += part @ part.T
        return out


def gathered(rows: DataFrame, folds: int = FOLDS) -> Gathered:
    """Rows (``key, text, label``) whose label isn't null, by key; a null text has no words."""
    own = folded(rows.filter("label IS NOT NULL AND key IS NOT NULL").select("key", "text", "label"), folds)
    named = own.select("key", "label", "fold").orderBy("key").limit(ROWS + 1).collect()
    if len(named) > ROWS:
        raise ValueError(f"over {ROWS} rows; classifier.out_of_fold takes any number")
    keys = [r["key"] for r in named]
    if len(set(keys)) < len(keys):
        raise ValueError("a key is there twice")
    counted = term_counts(own).limit(ENTRIES + 1).collect()
    if len(counted) > ENTRIES:
        raise ValueError(f"over {ENTRIES} words; classifier.out_of_fold takes any number")
    classes = sorted({r["label"] for r in named})
    row, term = {k: i for i, k in enumerate(keys)}, {t: i for i, t in enumerate(sorted({r["term"] for r in counted}))}
    array = lambda values: np.array(list(values), np.int64)
    return Gathered(keys, classes, array(classes.index(r["label"]) for r in named), array(r["fold"] for r in named), array(row[r["key"]] for r in counted), array(term[r["term"]] for r in counted), array(r["n"] for r in counted))


def fit(products: np.ndarray, y: np.ndarray, strength: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the rows, scores without each row) of one class. The score of any row is its products with the weights."""
    k = strength * products
    scores = np.zeros(len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-scores))
        w = np.maximum(p * (1 - p), 1e-10)
        root = np.sqrt(w)
        b = w * scores + y - p
        inner = np.eye(len(y)) + root[:, None] * k * root
        weights = b - root * np.linalg.solve(inner, root * (k @ b))
        new = k @ weights
        moved = np.abs(new - scores).max(initial=0.0)
        scores = new
        if moved < 1e-9:
            break
    p = 1 / (1 + np.exp(-scores))
    w = np.maximum(p * (1 - p), 1e-10)
    root = np.sqrt(w)
    spread = np.diag(k) - np.einsum("ij,ji->i", k * root, np.linalg.solve(np.eye(len(y)) + root[:, None] * k * root, root[:, None] * k))
    return strength * weights, scores - spread * (y - p) / (1 - spread * w)


def predicted(data: Gathered, products: np.ndarray, train: np.ndarray, test: np.ndarray, strength: float) -> np.ndarray:
    """The class of each test row by one fit a class over the training rows; equal scores go to the first."""
    scores = [products[np.ix_(test, train)] @ fit(products[np.ix_(train, train)], (data.label[train] == c).astype(float), strength)[0] for c in range(len(data.classes))]
    return np.argmax(scores, axis=0)


def grid_scores(rows: DataFrame, grid: tuple[float, ...] = GRID, folds: int = FOLDS) -> DataFrame:
    """``strength, fold, key, label, prediction``: every row by every strength, judged by a fit on the folds that it isn't in, whose
    statistics of words are of these folds too."""
    spark, data = rows.sparkSession, gathered(rows, folds)
    sent = spark.sparkContext.broadcast(data)  # ROWS and ENTRIES at most
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "label")}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, products = sent.value, None, None
        for f in frames:
            for strength, fold in zip(f["strength"], f["fold"], strict=True):
                held = own.fold == fold
                train, test = np.flatnonzero(~held), np.flatnonzero(held)
                if not len(test) or not len(train):
                    continue
                if fold != last:
                    products, last = own.products(~held), fold
                got = predicted(own, products, train, test, strength)
                yield pd.DataFrame({"strength": strength, "fold": fold, "key": [own.keys[i] for i in test], "label": [own.classes[own.label[i]] for i in test], "prediction": [own.classes[c] for c in got]})

    asked = spark.createDataFrame([(c, fold) for fold in range(folds) for c in grid], "strength double, fold int").repartition(len(grid) * folds, "strength", "fold")
    return asked.mapInPandas(work, f"strength double, fold int, key {kinds['key']}, label {kinds['label']}, prediction {kinds['label']}")


def strongest(scores: DataFrame) -> float:
    """The strength with the most right, of equal ones the smallest."""
    return scores.groupBy("strength").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("right")).orderBy(F.desc("right"), "strength").first()["strength"]


def leave_one_out(rows: DataFrame, strength: float) -> DataFrame:
    """``key, label, prediction``: each row by what the fit over all rows says of it without it. Frequencies of words are of all
    rows. One fit a class, by the tasks; no row's fit is made anew."""
    spark, data = rows.sparkSession, gathered(rows)
    sent = spark.sparkContext.broadcast(data)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        products = None
        for f in frames:
            for c in f["c"]:
                products = own.products(np.ones(len(own.keys), bool)) if products is None else products
                without = fit(products, (own.label == c).astype(float), strength)[1]
                yield pd.DataFrame({"i": np.arange(len(own.keys)), "c": int(c), "score": without})

    one = spark.createDataFrame([(c,) for c in range(len(data.classes))], "c int").repartition(max(len(data.classes), 1), "c")
    best = one.mapInPandas(work, "i long, c int, score double").groupBy("i").agg(F.min_by("c", F.struct(-F.col("score"), "c")).alias("c"))
    names = spark.createDataFrame(list(enumerate(data.classes)), f"c int, prediction {rows.schema['label'].dataType.simpleString()}")
    keys = spark.createDataFrame([(i, k, data.classes[data.label[i]]) for i, k in enumerate(data.keys)], f"i long, key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "c").join(F.broadcast(keys), "i").select("key", "label", "prediction")  # ROWS at most
