import hashlib

import numpy as np
import pyarrow as pa
import pytest
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyforge.llm import ann, warc


def pages(spark):
    big = "<p>" + "shared " * 300 + "</p>"
    rows = [(1, "http://www.Example.com/a?x=1", big), (2, "https://example.com:443/b", big), (9, "http://a.example.com", big), (3, "http://example.com/a", "small"), (4, "http://example.com/a", "small"), (5, None, None), (6, "no url", ""), (None, "http://example.com/n", big), (7, "http://x.org:8080/é", "é" * 600), (1, "http://www.Example.com/a?x=1", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark):
    p = pages(spark)
    got = warc.read_archive(spark, warc.write_archive(p)).collect()
    want = []
    for r in p.collect():
        body = (r.html or "").encode()
        revisit = len(body) >= 1000 and (r.html or "").startswith("<p>shared") and r.page_id != 9
        want.append((str(r.page_id), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    key = lambda x: (x[0], x[1], x[2], x[3], x[4] or 0)
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert warc.read_archive(spark, warc.write_archive(p.limit(0))).count() == 0


def test_lookup_by_two_levels(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 2)
    p = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p{i % 5}", f"body {i}") for i in range(60)], "page_id long, url string, html string")
    manifest = warc.write_archive(p)
    for i in (0, 3, 34):
        found = warc.lookup(spark, manifest, f"http://h{i % 7}.example.com/p{i % 5}")
        assert sorted(int(f["X-Page-Id"]) for f, _, _ in found) == [j for j in range(60) if j % 35 == i % 35]
    assert warc.lookup(spark, manifest, "http://nobody.example.com/") == []


def test_url_keys(spark):
    rows = [("http://user@WWW.b.org:80/x y#f", "org,b,www)/x%20y#f"), ("https://b.org:8443", "org,b:8443)/"), (None, ""), ("mailto:a", "mailto:a")]
    got = spark.createDataFrame(rows, "url string, want string").select(warc.url_key(F.col("url")).alias("k"), "want").collect()
    assert all(r.k == r.want for r in got)


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    return {q: sorted(((-float(ok[q] @ x), i) for i, x in ok.items() if i != q))[:k] for q in ok if q % 20 == 0}


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.6
    x[100:400] = 2 * x[100]  # a large group of copies, which are one another's nearest
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [None] * 16), (5060, [float("nan")] * 16), (None, [1.0] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    rows = [(i, None if v is None or None in v else np.float32(v).astype(float).tolist()) for i, v in rows]
    want = brute(rows, 20)
    by = {q: list(zip(g["rank"], g["vec_id"], g["score"], strict=True)) for q, g in got.sort_values(["query_id", "rank"]).groupby("query_id")}
    assert set(by) == set(want) and all([r for r, _, _ in v] == list(range(1, 21)) for v in by.values())
    hits = sum(len({i for _, i, _ in by[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    values = dict(rows)
    assert all(abs(s - np.dot(values[q], values[i])) < 1e-9 for q, v in by.items() for _, i, s in v)
    assert all(v == sorted(v, key=lambda r: (-r[2], r[1])) for v in by.values())
    assert [i for _, i, _ in by[120]] == [i for i in range(100, 122) if i != 120][:20]


@pytest.mark.parametrize("exhaustive", [0, 1000])
def test_walks_find_what_all_centroids_give(exhaustive):
    """The graph is walked, or all centroids are compared: what a query searches is about the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] * 4 + rng.normal(size=(3000, 8))
    book = ann.centroids(x, 200)
    book.exhaustive = exhaustive
    bundle, sizes = np.arange(200) // 2, np.full(100, 30)
    q, ratio = x[:300] + 0.1, 2.0
    got = set(zip(*map(np.ndarray.tolist, ann.reached(book, q, bundle, sizes, ratio, 0.0, 90, 16)), strict=True))
    want = set()
    for i, v in enumerate(q):
        d = np.sort([((book.points[2 * b : 2 * b + 2] - v) ** 2).sum(1).min() for b in range(100)])
        order = np.argsort([((book.points[2 * b : 2 * b + 2] - v) ** 2).sum(1).min() for b in range(100)], kind="stable")
        want |= {(i, int(b)) for at, b in enumerate(order) if d[at] <= ratio * d[0] or at < 3}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    if exhaustive:
        assert got == want


def test_nearest_by_walks_alone(spark):
    """Queries and postings go by the graph; clashing columns and equal products across lists."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, size=(3000, 6)).astype(float)  # many equal products of different vectors
    x[(x == 0).all(1)] = 1
    df = spark.createDataFrame([(i, v.tolist(), "a", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, Embedding string, h int")
    got = ann.nearest(df, queries=100, exhaustive=0, recall=1.0).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        best = sorted(range(len(x)), key=lambda i: (-score[i], i))[:20]
        own = g.sort_values("rank")
        assert list(own["score"]) == [score[i] for i in own["vec_id"]]
        assert [(-s, i) for s, i in zip(own["score"], own["vec_id"], strict=True)] == sorted((-s, i) for s, i in zip(own["score"], own["vec_id"], strict=True))
        hits += len(set(best) & set(own["vec_id"]))
    assert hits >= 0.97 * 20 * 30


def test_lists_of_two_levels(spark):
    """Many lists are fitted in two levels; results are as good."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50, 16))[rng.integers(0, 50, 6000)] * 2 + rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, queries=200, flat=10, exhaustive=0).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q, own in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(own & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 30 and hits >= 0.95 * 20 * 30


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_recall_holds_without_structure(spark, tmp_path):
    """Vectors without clusters have their neighbours in many lists, more with every row."""
    x = np.random.default_rng(9).normal(size=(40_000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))}), f"{tmp_path}/x.parquet", row_group_size=5_000)
    got = ann.nearest(spark.read.parquet(f"{tmp_path}/x.parquet"), queries=200).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q in range(0, len(x), 200):
        score = x @ x[q]
        score[q] = -2
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 200 and hits / (20 * 200) >= 0.97


def test_queries_beside_a_centroid_find_their_neighbours(spark, tmp_path):
    """Rows without structure, some of them in loose groups: a query that a centroid lies on searches no less than others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 64))
    x[rng.random(len(x)) < 0.5] += 4 * rng.normal(size=(40, 64))[rng.integers(0, 40)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), f"{tmp_path}/x.parquet")
    got = ann.nearest(spark.read.parquet(f"{tmp_path}/x.parquet")).toPandas().groupby("query_id")["vec_id"].apply(set)
    shares = []
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -2
        shares.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert len(shares) == len(got) and np.mean(shares) >= 0.98
    assert np.mean(np.array(shares) < 0.9) <= 0.01 and min(shares) >= 0.5
