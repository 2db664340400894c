"""Toxicity by a classifier with a counterfactual penalty.

A sparse logistic model over words and their beginnings, over the distinct words of a text. In training, every
identity term in a labelled text is swapped for the others of its list, and the squared change of the text's
score is penalised, as is the change between sentences that differ in nothing but the term, or its absence. A
group's mention then can't carry weight of its own, which spares neutral mentions.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows (whole texts, half of them for either
label if there are enough) with at most ``SAMPLE_BYTES`` of hashed features, drawn by a hash. Scoring covers all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.chunk_scores import ChunkScores

#: The most labelled rows that are fitted, the most bytes of their features, and the features that are kept after
#: screening.
SAMPLE, SAMPLE_BYTES, KEPT = 8000, 48 << 20, 3000
#: Calibration is held to margins as they are by as much as so many rows weigh.
PULL = 0.1
BUCKETS = 1 << 18
#: Beginnings of a word that are features beside the word: stems with changing ends.
BEGINNINGS = (4, 5, 6)
#: Identity terms. Within a list, terms stand for one another in swapped sentences.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
NOT_WORD = regex.compile(r"[^\p{L}\p{M}]+")


def bucket(feature: str) -> int:
    """A stable hash of a feature."""
    return zlib.crc32(feature.encode()) * 0x9E3779B1 % (1 << 32) >> 14


def words_of(text: str) -> list[str]:
    return [w for w in NOT_WORD.split(text.lower()) if w]


def features_of(word: str) -> list[int]:
    return [bucket(word), *(bucket(f"{word[:n]}*") for n in BEGINNINGS if len(word) > n)]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text, ascending, and in how many of its distinct pieces between white space each stands."""
    return np.unique(np.array([f for piece in set(text.split()) for w in words_of(piece) for f in features_of(w)], np.int32), return_counts=True)


def swaps(text: str) -> Iterator[np.ndarray]:
    """Of each identity term in the text and each other term of its list, the change of features as (plus, minus)."""
    present = {w for w in set(words_of(text))}
    for group in IDENTITY:
        for term in present & set(group):
            for other in group:
                if other != term:
                    yield features_of(other), features_of(term)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by bucket
    bias: float

    def rows(self, pieces: list[str]) -> np.ndarray:
        w = self.weights
        return np.array([[sum(w[f] for word in words_of(p) for f in features_of(word))] for p in pieces], np.float32).reshape(len(pieces), 1)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] + self.bias, -500, 500)))


@dataclass
class Rows:
    """Labelled texts as a sparse matrix: of each text the features and their counts, one behind the other."""

    size: np.ndarray  # of each text, how many features it has
    feature: np.ndarray
    times: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Rows:
        join = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs]).astype(kind)
        return cls(np.array([len(f) for f, _ in texts], np.int64), join([f for f, _ in texts], np.int32), join([t for _, t in texts], np.float32), np.asarray(label, bool))

    def only(self, chosen: np.ndarray) -> Rows:
        inner = np.repeat(chosen, self.size)
        return Rows(self.size[chosen], self.feature[inner], self.times[inner], self.label[chosen])

    def margins(self, model: ToxicityModel) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        return np.bincount(owner, model.weights[self.feature] * self.times, len(self.size)) + model.bias


def screened(rows: Rows) -> np.ndarray:
    """The ``KEPT`` features that tell the labels apart best (by the deviation of their counts from what the labels'
    shares predict) among those of two texts at least, and all of the identity terms."""
    share = float(rows.label.mean())
    toxic = np.bincount(rows.feature[np.repeat(rows.label, rows.size)], minlength=BUCKETS)
    total = np.bincount(rows.feature, minlength=BUCKETS)
    z = np.abs(toxic - share * total) / np.sqrt(total * share * (1 - share) + 1)
    groups = [f for g in IDENTITY for t in g for f in features_of(t)]
    kept = np.unique(np.concatenate([np.argsort(-z, kind="stable")[:KEPT], np.array(groups)]))
    return kept[(total[kept] >= 2) | np.isin(kept, groups)]


def fit(rows: Rows, changes: list[tuple[list[int], list[int], int]], *, counterfactual: float = 20.0, sparsity: float = 1e-3, rounds: int = 500) -> ToxicityModel:
    """Accelerated proximal gradient steps on the logistic loss, the counterfactual penalty and a sparsity term.

    ``changes``: swaps as (plus, minus, how many). All products go over the entries that are there, never over a
    dense matrix: memory is a few times that of ``rows``."""
    n, share = len(rows.size), float(rows.label.mean()) if len(rows.size) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -20.0 if share < 0.5 else 20.0)
    kept = screened(rows)
    index = np.full(BUCKETS, -1, np.int32)
    index[kept] = np.arange(len(kept), dtype=np.int32)
    inner = index[rows.feature] >= 0
    column, times = index[rows.feature[inner]], rows.times[inner].astype(float)
    owner = np.repeat(np.arange(n, dtype=np.int32), rows.size)[inner]
    # features are scaled towards a mean square of one, so that rare words move nearly as fast as common ones
    scale = 1 / np.sqrt(np.maximum(np.bincount(column, times**2, len(kept)) / n, 0.01))
    times *= scale[column]
    # sentences that differ in a term alone, and those that have one or none
    pairs = changes + [(features_of(b), features_of(a), 1) for g in IDENTITY for a, b in zip(g, g[1:], strict=False)] + [([], features_of(t), 1) for g in IDENTITY for t in g]
    many = sum(count for _, _, count in pairs)
    parts = [(i, index[f], sign * count**0.5) for i, (plus, minus, count) in enumerate(pairs) for sign, side in ((1, plus), (-1, minus)) for f in side if index[f] >= 0]
    swap, at, moved = (np.array([x[j] for x in parts], kind) for j, kind in enumerate((np.int32, np.int32, float)))
    moved *= scale[at]
    y = rows.label.astype(float)
    forward = lambda v: np.bincount(owner, v[column] * times, n)
    backward = lambda r: np.bincount(column, r[owner] * times, len(kept))
    pulled = lambda v: 2 * counterfactual / many * np.bincount(at, np.bincount(swap, v[at] * moved, len(pairs))[swap] * moved, len(kept))
    curve, v = 1.0, np.random.default_rng(3).normal(size=len(kept))
    for _ in range(12):  # the largest curvature, which sets the step
        v = 0.25 * backward(forward(v)) / n + pulled(v)
        curve = float(np.linalg.norm(v))
        v /= max(curve, 1e-12)
    step = 1 / (1.2 * curve + 0.25)
    w, seen, bias = np.zeros(len(kept)), np.zeros(len(kept)), float(np.log(share / (1 - share)))
    for i in range(rounds):
        look = w + i / (i + 3) * (w - seen)
        pull = (1 / (1 + np.exp(-np.clip(forward(look) + bias, -500, 500))) - y) / n
        seen, w = w, look - step * (backward(pull) + pulled(look))
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0)
        bias -= step * pull.sum()
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w * scale
    return ToxicityModel(weights, float(bias))


def calibrated(rows: Rows, changes: list[tuple[list[int], list[int], int]]) -> ToxicityModel:
    """``fit``, with its margins stretched and shifted as suits rows that a fit hasn't seen: either half of the rows
    gets its margins from a fit of the other half. Both labels weigh the same. A pull towards margins as they are,
    as strong as ``PULL`` rows of the rarer label, lets few rows change little; it is the same law at any size."""
    model = fit(rows, changes)
    share = rows.label.mean() if len(rows.size) else 0
    if not 0 < share < 1:
        return model
    place = np.zeros(len(rows.size), int)  # rows of each label go to the halves in turn
    for side in (rows.label, ~rows.label):
        place[side] = np.arange(side.sum())
    half = place % 2 == 0
    margin = np.zeros(len(half))
    for back in (half, ~half):
        margin[back] = rows.only(back).margins(fit(rows.only(~back), changes))
    y = rows.label.astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    ridge = PULL / min(y.sum(), (1 - y).sum())
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -500, 500)))
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(g * margin).sum() + ridge * (a - 1), g.sum() + ridge * c])
        hess = np.array([[(h * margin**2).sum() + ridge, (h * margin).sum()], [(h * margin).sum(), h.sum() + ridge]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, c = max(a - move[0], 0.1), c - move[1]
    return ToxicityModel((model.weights * a).astype(np.float32), float(model.bias * a + c))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fits on at most ``sample`` rows of ``labels`` that aren't null and have a text, and on at most ``sample_bytes`` of
    their features, taken in the order of the keys' hash within the label, so that both labels keep their parts; the first row
    always counts. Of several labels of a key the
    highest counts, and of several texts that with the least hash. Equal swaps of the drawn rows are one with their
    number, so that all count. Without labels the model calls nothing toxic."""
    shared.small_batches(docs.sparkSession)
    rows = shared.cased(labels, key, label).filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).alias("y"))
    held = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    half = sample // 2
    room = {y: max(half, sample - held.get(not y, 0)) for y in held}
    # draws in units of the label's share, so that a cut takes as much of either label
    parts = shared.chosen_map({True: 1.0, False: 1.0} | {y: min(1.0, room[y] / n) for y, n in held.items()})
    rows = rows.withColumn("draw", shared.draw(key) / float(1 << 62) / parts[F.col("y")])
    chosen = rows.filter("draw < 1").orderBy("draw", key).limit(sample)
    found = shared.cased(docs, key, text).filter(F.col(text).isNotNull()).join(F.broadcast(chosen), key)  # ``sample`` rows at most
    whole = found.groupBy(key, "y", "draw").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text")).select("y", "draw", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [text_features(t) for t in texts]
            data = [np.concatenate([f, n]).astype("<i4").tobytes() for f, n in found]
            changed = [[[*p, -1, *m] for p, m in swaps(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(changed, pa.list_(pa.list_(pa.int64())))], names=["y", "draw", "features", "changes"])

    drawn = shared.materialised(whole.mapInArrow(run, "y boolean, draw double, features binary, changes array<array<bigint>>"), "toxicity-sample")
    sizes = sorted(tuple(r) for r in drawn.select("draw", F.length("features")).collect())
    last, total = None, 0
    for at, size in sizes:
        total += size
        if last is not None and total > sample_bytes:
            break
        last = at
    drawn = drawn.filter(F.col("draw") <= F.lit(last).cast("double")) if sizes else drawn
    got = sorted(drawn.select("draw", "y", "features").collect(), key=lambda r: (r["draw"], r["features"]))
    swapped = drawn.select(F.explode("changes").alias("c")).groupBy("c").count().orderBy("c").collect()  # pairs of terms
    changes = [(r["c"][: r["c"].index(-1)], r["c"][r["c"].index(-1) + 1 :], r["count"]) for r in swapped]
    texts = [np.frombuffer(r["features"], "<i4") for r in got]
    model = calibrated(Rows.of([(t[: len(t) // 2], t[len(t) // 2 :]) for t in texts], np.array([r["y"] for r in got], bool)), changes)
    del got, texts
    shared.settle()
    return model


def scored(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """``key, score, predicted`` of every row, from the whole text alone. A null text counts as empty and gets the
    score of a text without words. Repeated rows stay. Only key and text are read."""
    shared.small_batches(docs.sparkSession)
    rows = shared.spread(shared.cased(docs, key, text))
    kind = rows.schema[key].dataType.simpleString()
    used = np.flatnonzero(model.weights)
    values, bias = model.weights[used], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = values
        own = ToxicityModel(weights, bias)
        sums = ChunkScores(own.rows, 1)
        for batch in batches:
            score = own.scores(sums.sums(batch.column(1).to_pylist(), distinct=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"])
        del sums
        shared.settle()

    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
