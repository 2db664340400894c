"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary logistic classifier over hashed byte n-grams of
letters says on which side a text lies. Decoding adds, for each language, the logistic losses of the
classifiers' margins against its codeword, weighted by how reliable each classifier is on rows held back in
training; the language with the least loss wins. If the runner-up is near, the text is flagged as ambiguous.

The classifiers are fitted on the driver from at most ``SAMPLE`` labelled texts (whole and different), drawn evenly
over languages by a hash; a row is its hashed counts by then. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.chunk_scores import ChunkScores, grams

ORDERS, BUCKETS = (1, 2, 3), 4096
#: The most labelled texts that are fitted.
SAMPLE = 2400
#: Languages that are learned at most, the commonest first: a row each goes to the driver.
LANGUAGES = 256
#: A text is ambiguous if the runner-up's loss is at most this share of all weight above the winner's.
MARGIN = 0.25
#: An ambiguous text with at least this score is still kept.
SURE = 0.6
LETTERS = regex.compile(r"[^\p{L}]+")
UNKNOWN = "und"


def words_of(chunk: str) -> str:
    return LETTERS.sub(" ", chunk.lower()).strip()


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class: all different splits for up to five classes, else the random code
    of 15 bits a doubling that keeps rows furthest apart."""
    if classes <= 5:
        bits = np.arange(1, 2 ** max(classes - 1, 1))
        table = np.vstack([np.zeros(len(bits), int), *[(bits >> i) & 1 for i in range(classes - 1)]])[:classes]
        return np.where(table > 0, 1, -1)
    rng, best, width = np.random.default_rng(7), None, 15 * int(np.ceil(np.log2(classes)))
    for _ in range(50):
        code = rng.choice([-1, 1], (classes, width))
        code = code[:, (code != code[0]).any(0)]
        apart = ((code[:, None] != code[None]).sum(-1) + width * np.eye(classes, dtype=int)).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language, bit
    weights: np.ndarray  # bucket, bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit, adding up to 1

    def rows(self, chunks: list[str]) -> np.ndarray:
        """Of each piece: the bits' sums, and the number of n-grams."""
        owner, bucket = grams([words_of(c) for c in chunks], ORDERS, BUCKETS)
        out = np.empty((len(chunks), len(self.bias) + 1), np.float32)
        for k in range(len(self.bias)):
            out[:, k] = np.bincount(owner, self.weights[bucket, k], len(chunks))
        out[:, -1] = np.bincount(owner, minlength=len(chunks))
        return out

    def decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language number or -1, score, whether it is ambiguous."""
        n = sums[:, -1]
        margins = sums[:, :-1] / np.maximum(n, 1)[:, None] + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(1) for word in self.code], 1)
        order = np.argsort(loss, 1, kind="stable")
        best = order[:, 0]
        least = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        next_ = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] if loss.shape[1] > 1 else least + np.inf
        score = 1 / np.exp(np.minimum(len(self.bias) * (least[:, None] - loss), 0)).sum(1)
        none = n == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), ~none & (next_ - least < MARGIN)


def fit(x: np.ndarray, label: np.ndarray, languages: list[str], rounds: int = 150) -> LanguageModel:
    """Logistic classifiers of all bits at once, by accelerated gradient steps on scaled frequencies.

    ``x``: counts as 32-bit floats, a row for each text; it is scaled in place, and nothing of its size is made."""
    code = codewords(len(languages))
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    scale = 1 / np.sqrt(x.mean(0) + np.float32(1e-5))
    x *= scale
    y = code[label].astype(np.float32)
    back = np.arange(len(x)) % 5 == 4
    steep = float(np.einsum("ij,ij->i", x, x).max(initial=0.0))

    def solve(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        seen, step = w.copy(), np.float32(4.0 / max(steep + 1, 1))
        share = (part / max(part.sum(), 1)).astype(np.float32)[:, None]
        for i in range(rounds):
            look = w + np.float32(i / (i + 3)) * (w - seen)
            pull = y / (1 + np.exp(y * (x @ look + bias))) * share
            seen, w = w, look + step * (x.T @ pull - np.float32(1e-4) * look)
            bias = bias + step * pull.sum(0)
        return w, bias

    w, bias = solve(~back)
    right = np.ones(code.shape[1])
    if back.any():
        right = (((x @ w + bias) * y)[back] > 0).mean(0)
        w, bias = solve(np.ones(len(x), bool))
    trust = np.maximum(2 * right - 1, 0.05)
    return LanguageModel(languages, code, (w * scale[:, None]).astype(np.float32), bias, trust / trust.sum())


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = LANGUAGES) -> LanguageModel | None:
    """Fits on at most ``sample`` different texts with a label, of the ``most`` commonest languages; None if there are none. A
    hash of the text draws them, about as many of each language, and their order in units of the language's share, so that
    a cut takes as much of each; of several labels of a text the first in the alphabet counts."""
    shared.small_batches(labelled.sparkSession)
    rows = shared.cased(labelled, text, lang).toDF("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not held:
        return None
    each = max(sample // len(held), 1)
    parts = shared.chosen_map({name: min(1.0, each / n) for name, n in held.items()})
    drawn = rows.withColumn("draw", shared.draw("text") / float(1 << 62) / F.try_element_at(parts, F.col("lang"))).filter("draw < 1")
    some = drawn.groupBy(shared.draw("text").alias("hash")).agg(F.min(F.struct("lang", "draw")).alias("l"), F.first("text").alias("text")).select("l.draw", "l.lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for t in batch.column(2).to_pylist():
                _, bucket = grams([words_of(t)], ORDERS, BUCKETS)
                counts = np.bincount(bucket, minlength=BUCKETS)
                there = np.flatnonzero(counts)
                data.append(there.astype("<u4").tobytes() + counts[there].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["draw", "lang", "counts"])

    drawn = some.mapInArrow(run, "draw double, lang string, counts binary").orderBy("draw", "lang").limit(sample).collect()
    if not drawn:
        return None
    drawn = [drawn[i] for i in np.random.default_rng(1).permutation(len(drawn))]
    languages = sorted({r["lang"] for r in drawn})
    label = np.array([languages.index(r["lang"]) for r in drawn])
    x = np.zeros((len(drawn), BUCKETS), np.float32)
    for i in range(len(drawn)):
        there, counts = np.frombuffer(drawn[i]["counts"], "<u4").reshape(2, -1)
        x[i, there] = counts
        drawn[i] = None
    model = fit(x, label, languages)
    del x, drawn
    shared.settle()
    return model


def identified(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score, ambiguous`` of every row, from the whole text alone.

    A text that is null or has no letter, and any text without a model, is ``und`` with score 0 and not
    ambiguous. Repeated rows stay. Equal losses go to the language first in the alphabet. Only key and text are
    read."""
    shared.small_batches(docs.sparkSession)
    rows = shared.spread(shared.cased(docs, key, text))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = ChunkScores(model.rows, len(model.bias) + 1) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model:
                best, score, near = model.decide(scores.sums(texts))
            else:
                best, score, near = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [model.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(near)], names=[key, "lang_pred", "score", "ambiguous"])
        del scores
        shared.settle()

    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, ambiguous boolean")


def in_known_language(docs: DataFrame, model: LanguageModel | None, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text has letters and one language that clearly wins.

    Rejected are ``und`` texts, and ambiguous ones with a score under ``SURE``: about even mixtures of languages, or
    neither; without a model nothing can be told apart and only texts without
    letters go."""
    shared.small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = ChunkScores(model.rows, len(model.bias) + 1) if model else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if model:
                best, score, near = model.decide(scores.sums(texts))
                yield batch.filter(pa.array((best >= 0) & ~(near & (score < SURE))))
            else:
                yield batch.filter(pa.array([bool(words_of(t or "")) for t in texts], pa.bool_()))
        del scores
        shared.settle()

    return shared.filtered(docs, run)
