"""Approximate nearest neighbours by balanced posting lists.

Largest inner products become smallest distances by one more coordinate, which fills every vector up to the largest
norm. Balanced k-means on a bounded sample gives centroids; their number grows with the rows up to ``MAX_LISTS``, and an
in-memory graph over them is searched with a beam. Every vector goes to its nearest centroid's posting list and, near a
boundary, to further ones within a ratio of distances, unless one chosen before is closer to that centroid than the
vector is. Lists that lie near one another share a bundle of up to ``BLOCK`` vectors. A query walks the graph and searches
the bundles whose nearest centroid is within a ratio of its ``BEAM``-th nearest one, as the nearest may be the query
itself. The ratio has no bound of its own: it is the least by which queries drawn from the table find the wanted share of
their neighbours, together and nearly each of them alone, which one exact pass gives, and a walk is widened until it has
passed that ratio. Where drawn queries would read more than ``HALF`` of all postings, lists spare too little, and every
query searches all bundles.

Equal vectors are indexed once, with their smallest ids, as many as a result can hold. Long lists and many queries of
a list are split into blocks, so that a task's share is bounded whatever the groups; every row is indexed and no
candidate of a searched list is left out. Scores are inner products of the original vectors in double precision, added
up in the order of the coordinates, so that a pair's score is the same wherever it is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import shared

#: Bounds of what is fitted on the driver and sent to workers: rows that centroids are fitted on, lists that are fitted there
#: at once, and lists in all. Beyond ``FLAT`` lists, coarse ones are fitted on the driver and each is parted by a task of its
#: own, on ``EACH`` rows for each of its lists.
SAMPLE, FLAT, MAX_LISTS, EACH = 20_000, 8_192, 65_536, 32
#: Vectors and queries that one task compares at a time.
BLOCK, QUERY_BLOCK = 4_096, 1_024
DEGREE = 24
#: Centroids that a walk begins with, and for each that is asked for how many may all be compared in place of a walk, which can
#: end far from the nearest: up to ``FLAT`` lists are never walked.
BEAM, EXHAUSTIVE = 16, 512
#: Queries that the ratio is fitted on, and queries that a worker ranks at a time.
TRIED, CHUNK = 400, 256
#: The share of drawn queries that find ``ALONE`` of their neighbours each, and the share of postings beyond which all are read.
SURE, ALONE, HALF = 0.99, 0.95, 0.5


@dataclass
class Centroids:
    """Centroids and a graph of their neighbours."""

    points: np.ndarray
    links: np.ndarray
    exhaustive: int = EXHAUSTIVE

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of about the nearest ``beam`` centroids of each query, nearest first. All
        queries walk at once: each expands its nearest centroid that isn't expanded yet, until it has none."""
        n, k = len(q), len(self.points)
        beam = min(beam, k)
        norms = (self.points**2).sum(1)
        far = lambda rows, ids: np.maximum((q[rows] ** 2).sum(1)[:, None] + norms[ids] - 2 * np.einsum("qd,qcd->qc", q[rows], self.points[ids]), 0)
        if k <= self.exhaustive * beam or beam == k:
            ids, near = np.empty((n, beam), np.int64), np.empty((n, beam))
            step = max(1, (4 << 20) // k)  # a few million distances at a time
            for at in range(0, n, step):
                part = q[at : at + step]
                d = np.maximum((part**2).sum(1)[:, None] + norms - 2 * part @ self.points.T, 0)
                ids[at : at + step] = mine = np.argsort(d, 1, kind="stable") if beam == k else nearest_columns(d, beam)
                near[at : at + step] = np.take_along_axis(d, mine, 1)
            return ids, near
        starts = np.linspace(0, k - 1, beam).astype(np.int64)
        ids = np.tile(starts, (n, 1))
        d = far(np.arange(n), ids)
        order = np.argsort(d, 1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        done = np.zeros((n, beam), bool)
        seen = np.zeros((n, k), bool)
        seen[:, starts] = True
        live = np.arange(n)
        while len(live):
            rest = np.where(done[live], np.inf, d[live])
            at = rest.argmin(1)
            more = np.isfinite(rest[np.arange(len(live)), at])
            live, at = live[more], at[more]
            if not len(live):
                break
            done[live, at] = True
            near = self.links[ids[live, at]]
            new = far(live, near)
            new[seen[live[:, None], near]] = np.inf
            seen[live[:, None], near] = True
            both_d = np.concatenate([d[live], new], 1)
            order = np.argsort(both_d, 1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~np.isfinite(new)], 1), order, 1)
            d[live] = np.take_along_axis(both_d, order, 1)
        return ids, d


def assigned(x: np.ndarray, points: np.ndarray, penalty: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest point, penalties added, and the squared distance to it. A few million distances
    are held at a time."""
    own, least = np.empty(len(x), np.int64), np.empty(len(x))
    base, step = (points**2).sum(1), max(1, (4 << 20) // max(len(points), 1))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = base - 2 * part @ points.T
        own[at : at + step] = mine = (d + penalty).argmin(1)
        least[at : at + step] = np.take_along_axis(d, mine[:, None], 1)[:, 0] + (part**2).sum(1)
    return own, least


def balanced(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means whose distances grow with a cluster's share of the rows."""
    rng = np.random.default_rng(5)
    points = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        own, least = assigned(x, points, penalty)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = counts > 0
        sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[full], axis=0)
        points[full] = sums / counts[full, None]
        points[~full] = x[rng.choice(len(x), int((~full).sum()))]
        penalty = 0.3 * max(float(least.mean()), 1e-12) * (counts * k / len(x) - 1)
    return points


def linked(points: np.ndarray, exhaustive: int = EXHAUSTIVE) -> Centroids:
    """Centroids with their graph."""
    k = len(points)
    links = np.empty((k, min(DEGREE, k)), np.int64)
    rng = np.random.default_rng(6)
    step = max(1, min(1024, (8 << 20) // k))  # a few million distances at a time
    for at in range(0, k, step):
        d = (points**2).sum(1) - 2 * points[at : at + step] @ points.T
        links[at : at + step] = np.argsort(d, 1, kind="stable")[:, : links.shape[1]] if k <= 1024 else nearest_columns(d, links.shape[1])
    if k > 64:
        links[:, -4:] = rng.integers(0, k, (k, 4))  # far links keep the graph in one piece
    return Centroids(points, links, exhaustive)


def nearest_columns(d: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` columns of the least values of each row, in their order."""
    some = np.argpartition(d, m - 1, 1)[:, :m]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), 1, kind="stable"), 1)


def centroids(sample: np.ndarray, lists: int) -> Centroids:
    return linked(balanced(sample, min(lists, len(sample))))


def parted(classes: DataFrame, lifted, coarse: np.ndarray, lists: int, total: int) -> np.ndarray:
    """About ``lists`` centroids: each coarse one's vectors are parted by a task, on a drawn part of the table."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(coarse)  # FLAT centroids at most
    drawn = classes.filter(shared.draw("h") < shared.share(EACH * lists / total))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = sent.value
        for batch in batches:
            x = lifted(matrix(batch.column("v")))
            if len(x):
                near = assigned(x, points)[0]
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(list(x), pa.list_(pa.float64()))], names=["coarse", "x"])

    def split(group: pa.Table) -> pa.Table:
        x = matrix(group.column("x").combine_chunks() if group.num_rows else pa.array([], pa.list_(pa.float64())))
        points = balanced(x, max(1, min(len(x), round(len(x) / EACH)))) if len(x) else x
        return pa.table({"x": pa.array(list(points), pa.list_(pa.float64()))})

    found = drawn.select("v").mapInArrow(own, "coarse long, x array<double>").groupBy("coarse").applyInArrow(split, "x array<double>")
    points = np.array([r["x"] for r in found.collect()])  # MAX_LISTS rows or so
    return points[np.lexsort(points.T)]  # tasks end in any order


def bundles(points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bundle of each list: lists with near centroids together, up to ``BLOCK`` vectors or a single list."""
    groups = balanced(points, max(1, len(points) // 16))
    out, bundle, size = np.zeros(len(points), np.int64), 0, 0
    for i in np.argsort(assigned(points, groups)[0], kind="stable"):
        if size and size + counts[i] > BLOCK:
            bundle, size = bundle + 1, 0
        out[i] = bundle
        size += counts[i]
    return out


def distances(q: np.ndarray, points: np.ndarray, bundle: np.ndarray) -> np.ndarray:
    """Squared distance of each query to the nearest centroid of each bundle."""
    by = np.argsort(bundle, kind="stable")
    d = np.maximum((q**2).sum(1)[:, None] + (points**2).sum(1) - 2 * q @ points.T, 0)[:, by]
    return np.minimum.reduceat(d, np.searchsorted(bundle[by], np.arange(bundle.max() + 1)), axis=1)


def scale(d: np.ndarray, place: int = BEAM - 1) -> np.ndarray:
    """What a query's ratio refers to: its distance to a centroid near it, by its place in distances in order."""
    return d[:, min(place, d.shape[1] - 1)]


def reached(book: Centroids, q: np.ndarray, bundle: np.ndarray, sizes: np.ndarray, ratio: float, soft: float, enough: int, beam: int, place: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(query, bundle) pairs to search: bundles with a centroid within the ratio of the nearest (or that at a place), and the nearest ones until
    they hold ``enough`` vectors. ``soft`` is added to both sides of the ratio. Walks keep ``beam``
    centroids; those that end before they have all of that go again four times as wide, and then over all centroids."""
    if not np.isfinite(ratio):
        every = len(sizes)
        return np.repeat(np.arange(len(q)), every), np.tile(np.arange(every), len(q))
    out: list[np.ndarray] = []
    left, k, narrow = np.arange(len(q)), len(book.points), beam
    while len(left):
        ids, d = book.search(q[left], beam)
        own = bundle[ids]
        # the first place of each bundle in a row is its nearest centroid
        order = np.argsort(own, 1, kind="stable")
        ranked = np.take_along_axis(own, order, 1)
        first = np.zeros(own.shape, bool)
        np.put_along_axis(first, order, np.concatenate([np.ones((len(own), 1), bool), ranked[:, 1:] != ranked[:, :-1]], 1), 1)
        held = np.cumsum(np.where(first, sizes[own], 0), 1)
        before = held - np.where(first, sizes[own], 0)
        near = d + soft <= ratio * (scale(d, place)[:, None] + soft)
        ended = np.full(len(left), beam >= k) | (~near[:, -1] & (held[:, -1] >= enough))
        i, j = np.nonzero(first & (near | (before < enough)) & ended[:, None])
        out.append(np.stack([left[i], own[i, j]]))
        left, beam = left[~ended], min(4 * beam, k) if beam == narrow else k
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *out], 1)
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the coordinates."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def widest(posted: DataFrame, tried: list, far: np.ndarray, base: np.ndarray, soft: float, bundle: np.ndarray, k: int, copies: int, recall: float) -> float:
    """The least ratio by which the drawn queries find a share of ``recall`` of their ``k`` neighbours, and a share of ``SURE`` of
    them ``ALONE`` of their own each, exactly.

    ``far``: as of ``distances``; ``base``: as of ``scale``. Of every vector's postings only the nearest to a query counts, and a result needs
    ``copies * (k + 1)`` postings at most."""
    room = copies * (k + 1)
    asked = posted.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in tried], float))  # TRIED vectors

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kept = asked.value, None
        for batch in batches:
            ids = batch.column("ids")
            first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            plain = [x.to_numpy(zero_copy_only=False) for x in (batch.column("list"), ids.value_lengths())]
            new = [q @ matrix(batch.column("v")).T, *(np.tile(x, (len(q), 1)) for x in (plain[0], first, plain[1]))]
            kept = new if kept is None else [np.concatenate(x, 1) for x in zip(kept, new, strict=True)]
            if kept[0].shape[1] > room:
                at = np.argpartition(-kept[0], room - 1, 1)[:, :room]
                kept = [np.take_along_axis(x, at, 1) for x in kept]
        if kept is not None:
            t = np.repeat(np.arange(len(q)), kept[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(t), *(pa.array(x.ravel()) for x in (kept[0], *(x.astype(np.int64) for x in kept[1:])))], names=["t", "score", "list", "first", "n"])

    found = posted.select("list", "ids", "v").mapInArrow(best, "t long, score double, list long, first long, n long")
    order = Window.partitionBy("t").orderBy(F.desc("score"), "first", "list")
    rows = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= room).orderBy("t", "r").collect()
    lists: list[dict[int, list]] = [{} for _ in tried]
    for r in rows:  # classes come by score
        lists[r["t"]].setdefault(r["first"], [r["n"], []])[1].append(r["list"])
    needs, alone = [], []
    for i, classes in enumerate(lists):
        left, mine = k, []
        for first, (n, own) in classes.items():
            n = min(n - (first == tried[i]["ids"][0]), left)  # the query itself is no neighbour
            mine += [(far[i, bundle[own]].min() + soft) / (base[i] + soft)] * n
            left -= n
        needs += mine
        if mine:
            alone.append(least_of(mine, ALONE))
    return max(least_of(needs, recall), least_of(alone, SURE)) if needs else 0.0


def least_of(values: list[float], part: float) -> float:
    """The least of the values that this part of them doesn't exceed."""
    return float(np.sort(values)[min(len(values) - 1, int(np.ceil(part * len(values))) - 1)])


def vectors(table: DataFrame, vector: str, key: str) -> DataFrame:
    """``id, v, h, g`` of the rows that take part: no null id, vector of the commonest length, finite, not zero."""
    rows = shared.cased(table, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return rows.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(table: DataFrame, *, k: int = 20, queries: int = 20, vector: str = "embedding", key: str = "vec_id", recall: float = 0.98, closure: float = 0.15, copies: int = 3, least: int = 20, exhaustive: int = EXHAUSTIVE, flat: int = FLAT) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` largest inner products found for every row whose id is divisible by
    ``queries``, among all other rows; equal scores go by the smaller id.

    ``closure``, ``copies``: by how much further a list may be than the nearest to hold a copy of a vector, and in how
    many lists at most. ``recall``: the share of neighbours that is found of queries drawn from the table, which sets how
    far queries search, beside what nearly each of them must find. ``least``: lists are searched until they hold so many times the vectors that a result needs.
    ``exhaustive``: up to so many centroids for each that is asked for, all are compared in place of a walk. ``flat``: up to
    so many lists are fitted at once, more in two levels.
    Vectors that are null, zero or hold a null or non-finite number, or are of another length than most, and null ids take no part. Equal rows count once. An empty table gives no rows."""
    spark = table.sparkSession
    shared.small_batches(spark)
    rows = vectors(table, vector, key)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = few.groupBy("h", "g").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    classes = shared.materialised(classes, "vectors")
    asked = rows.filter(F.col("id") % queries == 0).select("id", "h", "g").distinct()
    total, largest = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    result = f"query_id long, rank int, `{key}` long, score double"
    if not total:
        return spark.createDataFrame([], result)
    share = shared.draw("h") < shared.share(SAMPLE / total)
    sample = np.array([r["v"] for r in classes.filter(share).orderBy("h").select("v").limit(SAMPLE).collect()] or [r["v"] for r in classes.orderBy("h").select("v").limit(100).collect()])
    lifted = lambda x: np.concatenate([x, np.sqrt(np.maximum(largest - (x**2).sum(1), 0))[:, None]], 1)
    lists = int(min(MAX_LISTS, max(1, 2 * total**0.5)))
    if lists <= flat:
        points = balanced(lifted(sample), min(lists, len(sample)))
    else:  # as many coarse ones as each has parts
        points = parted(classes, lifted, balanced(lifted(sample), min(int(lists**0.5), len(sample))), lists, total)
    book = linked(points, exhaustive)
    model = spark.sparkContext.broadcast(book)  # MAX_LISTS centroids at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            x = lifted(matrix(batch.column("v")))
            ids, d = own.search(x, BEAM)
            d = np.sqrt(d)
            keep = np.zeros(ids.shape, bool)
            keep[:, 0] = True
            for j in range(1, ids.shape[1]):
                apart = np.sqrt(((own.points[ids[:, j]][:, None] - own.points[ids[:, :j]]) ** 2).sum(2))
                hidden = (keep[:, :j] & (apart < d[:, j : j + 1] * 0.8)).any(1)
                keep[:, j] = (d[:, j] <= (1 + closure) * d[:, 0]) & ~hidden & (keep.sum(1) < copies)
            at, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at, j]), *(batch.column(c).take(pa.array(at)) for c in ("h", "ids", "v"))], names=["list", "h", "ids", "v"])

    def norm(x: np.ndarray) -> np.ndarray:
        """Queries at the length of the lifted vectors; the order of inner products doesn't depend on a query's length."""
        x = x / np.abs(x).max(1, keepdims=True)
        return np.concatenate([x * np.sqrt(largest / (x**2).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                batch = whole.slice(at, CHUNK)
                i, j = reached(own, norm(matrix(batch.column("v"))), bundle, sizes, wide, soft, enough, beam, BEAM - 1)
                yield pa.RecordBatch.from_arrays([pa.array(j), *(batch.column(c).take(pa.array(i)) for c in ("h", "g", "v"))], names=["bundle", "h", "g", "v"])

    posted = shared.materialised(classes.mapInArrow(post, "list long, h long, ids array<long>, v array<double>"), "postings")
    held = np.zeros(len(book.points), np.int64)
    for r in posted.groupBy("list").count().collect():  # a row for each list
        held[r["list"]] = r["count"]
    enough = least * copies * (k + 1)
    bundle = bundles(book.points, held)
    sizes = np.bincount(bundle, held).astype(np.int64)
    asking = shared.materialised(classes.join(asked.select("h", "g").distinct(), ["h", "g"], "left_semi"), "asking")
    tried = asking.orderBy(F.xxhash64("h"), "g").limit(TRIED).collect()
    wide, soft, beam = 1.0, 0.0, BEAM
    if tried:
        x = norm(np.array([r["v"] for r in tried]))
        far = distances(x, book.points, bundle)
        d = np.sort(distances(x, book.points, np.arange(len(book.points))), 1)
        base, soft = scale(d), 1e-12 * largest  # a query that lies on so many centroids has a finite ratio
        wide = widest(posted, tried, far, base, soft, bundle, k, copies, recall) * (1 + 1e-9)
        if ((far + soft <= wide * (base[:, None] + soft)) @ sizes).mean() > HALF * sizes.sum():
            wide = np.inf
        need = int(np.quantile((d + soft <= wide * (base[:, None] + soft)).sum(1), 0.9))  # centroids that most queries walk to
        beam = BEAM if 2 * need <= BEAM else min(2 * need, len(book.points))
    wanted = shared.materialised(asking.mapInArrow(ask, "bundle long, h long, g long, v array<double>"), "queries")
    nq = {r["bundle"]: -(-r["count"] // QUERY_BLOCK) for r in wanted.groupBy("bundle").count().collect()}  # a row for each bundle
    rows_of = [(i, int(b), -(-int(sizes[b]) // BLOCK), nq[b]) for i, b in enumerate(bundle.tolist()) if b in nq]
    blocks = F.broadcast(spark.createDataFrame(rows_of, "list long, bundle long, nb long, nq long"))  # MAX_LISTS rows at most
    lay = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = posted.join(blocks, "list").select("bundle", F.pmod("h", "nb").alias("b"), F.explode(lay("nq")).alias("q"), "ids", "v")
    right = wanted.join(F.broadcast(blocks.select("bundle", "nb", "nq").distinct()), "bundle").select("bundle", F.explode(lay("nb")).alias("b"), F.pmod("h", "nq").alias("q"), "h", "g", "v")

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not held.num_rows or not asked.num_rows:
            return kinds.empty_table()
        held, asked = held.combine_chunks(), asked.combine_chunks()
        one = lambda t, c: t.column(c).chunk(0)
        ids = one(held, "ids")
        first, at = np.unique(ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()], return_index=True)  # once, whatever its lists
        x, ids, parts = matrix(one(held, "v"))[at], ids.take(pa.array(at)), []
        for lo in range(0, asked.num_rows, CHUNK):
            y = matrix(one(asked, "v").slice(lo, CHUNK))
            rough = y @ x.T
            # a product's last bits depend on the block; what may be among the first is added up anew
            last = np.partition(rough, -min(k + 1, len(x)), 1)[:, -min(k + 1, len(x))] - 1e-12 * np.sqrt((y**2).sum(1) * largest)
            q, c = np.nonzero(rough >= last[:, None])
            scores = products(y[q], x[c])
            order = np.lexsort((c, -scores, q))  # c goes by id
            q, c, scores = q[order], c[order], scores[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) <= k
            q, c, scores = q[top], c[top], scores[top]
            parts.append(pa.table([one(asked, "h").take(pa.array(q + lo)), one(asked, "g").take(pa.array(q + lo)), pa.array(scores), ids.take(pa.array(c))], schema=kinds))
        return pa.concat_tables(parts)

    found = left.groupBy("bundle", "b", "q").cogroup(right.groupBy("bundle", "b", "q")).applyInArrow(compare, "h long, g long, score double, ids array<long>")
    # a vector found in several lists counts once
    single = found.select("h", "g", "score", F.explode("ids").alias("id")).groupBy("h", "g", "id").agg(F.max("score").alias("score"))
    by_class = Window.partitionBy("h", "g").orderBy(F.desc("score"), "id")
    top = single.withColumn("n", F.row_number().over(by_class)).filter(F.col("n") <= k + 1)
    lists = top.groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("top"))
    each = asked.join(lists, ["h", "g"]).select(F.col("id").alias("query_id"), F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, k).alias("top"))
    return each.select("query_id", F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.id").alias(key), F.col("t.score").alias("score"))
