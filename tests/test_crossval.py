"""Fits by folds and without each row against plain refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import crossval as C
from tallyforge.operators.classifier import folded


def rows(n=80, seed=0):
    rng = np.random.default_rng(seed)
    words = {"up": "rises gains more high", "down": "falls loses less low", "flat": "same still holds even"}
    out = []
    for i in range(n):
        label = ("up", "down", "flat")[i % 3]
        own = rng.choice(words[label].split(), 3).tolist() + rng.choice("the profit of a firm in year".split(), 4).tolist()
        if i % 11 == 0:
            own = rng.choice(sum((w.split() for w in words.values()), []), 6).tolist()
        out.append((f"k{i:03}", " ".join(rng.permutation(own)), label))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "key string, text string, label string")


def descent(x, y, strength, steps=20_000):
    """Weights by plain descent on the rows' losses and half the squared weights."""
    w, rate = np.zeros(x.shape[1]), 1 / (1 + strength * np.linalg.norm(x, 2) ** 2 / 4)
    for _ in range(steps):
        w -= rate * (w + strength * x.T @ (1 / (1 + np.exp(-x @ w)) - y))
    return w


def test_fit_equals_descent(df):
    data = C.gathered(df)
    every = np.ones(len(data.keys), bool)
    row, term, value = data.vectors(every)
    x = np.ones((len(data.keys), term.max() + 2))
    x[:, :-1] = 0
    x[row, term] = value
    assert np.allclose(data.products(every), x @ x.T)
    y = (data.label == 1).astype(float)
    for strength in (0.3, 5.0):
        weights, without = C.fit(x @ x.T, y, strength)
        assert np.allclose(x.T @ weights, descent(x, y, strength), atol=1e-4)
        for i in range(0, len(y), 9):  # leaving a row out
            rest = np.arange(len(y)) != i
            own = x[i] @ x[rest].T @ C.fit(x[rest] @ x[rest].T, y[rest], strength)[0]
            assert abs(own - without[i]) < 0.15 * max(1.0, abs(own))


def test_grid_judges_every_row_once_a_strength(df):
    got = C.grid_scores(df, (0.01, 10.0), 4).collect()
    assert len(got) == 160 and len({(r.strength, r.key) for r in got}) == 160
    folds = {r.key: r.fold for r in folded(df, 4).collect()}
    assert all(folds[r.key] == r.fold for r in got)
    best = C.strongest(C.grid_scores(df, (0.01, 10.0), 4))
    right = {c: sum(r.label == r.prediction for r in got if r.strength == c) for c in (0.01, 10.0)}
    assert right[best] == max(right.values()) >= 60
    # one fit of the grid by hand
    data = C.gathered(df, 4)
    train, test = np.flatnonzero(data.fold != 2), np.flatnonzero(data.fold == 2)
    mine = C.predicted(data, data.products(data.fold != 2), train, test, 10.0)
    assert {(data.keys[i], data.classes[c]) for i, c in zip(test, mine, strict=True)} == {(r.key, r.prediction) for r in got if r.fold == 2 and r.strength == 10.0}


def test_leave_one_out_equals_refits(df):
    got = {r.key: r.prediction for r in C.leave_one_out(df, 10.0).collect()}
    data = C.gathered(df)
    products = data.products(np.ones(len(data.keys), bool))
    same = 0
    for i in range(len(data.keys)):
        rest = np.flatnonzero(np.arange(len(data.keys)) != i)
        same += data.classes[C.predicted(data, products, rest, np.array([i]), 10.0)[0]] == got[data.keys[i]]
    assert len(got) == 80 and same >= 79


def test_odd_sets(spark, monkeypatch):
    schema = "key string, text string, label string"
    odd = spark.createDataFrame([("a", None, "x"), ("b", "", "y"), ("c", "word", None), (None, "word", "x"), ("d", "one two", "x"), ("e", "two", "y")], schema)
    data = C.gathered(odd)
    assert data.keys == ["a", "b", "d", "e"] and len(data.term) == 4  # one, two, one two, two
    assert C.leave_one_out(odd, 1.0).count() == 4
    assert C.grid_scores(odd.limit(0)).count() == 0 and C.leave_one_out(odd.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError, match="twice"):
        C.gathered(odd.filter("key = 'a'").unionByName(odd.filter("key = 'a'")))
    monkeypatch.setattr(C, "ROWS", 3)
    with pytest.raises(ValueError, match="over 3 rows"):
        C.gathered(odd.withColumn("n", F.lit(1)))
