"""Exact pairs of embeddings within a threshold, by a dual traversal of a cover tree.

Cosines of a threshold or more are distances of ``t`` or less between unit vectors. Of each label a tree is built: a node
has a centre and a covering radius (the largest distance of its vectors to the centre, as measured), and its children are
a net of centres, each further from the others than the level's radius, which halves from level to level. The upper
levels are made by Spark, a round a level: the nodes with too many vectors choose centres among a sample of theirs, and
their vectors are dealt to the nearest, in parts of bounded size, whatever the node's share of the table. Nodes that are
small enough become leaves, packed into one row with the lower levels of their own tree, down to single vectors.

The traversal begins with each root against itself. A pair of nodes whose centres are further apart than ``t`` and both
covering radii holds no link and is dropped; one whose centres are so near that all its pairs must be links is counted as a
whole; others go down to pairs of their children. Spark walks the upper levels (a join of pairs with children a round); a
task walks the lower ones for a pair of leaves. So pairs are never rows: a task gives the number of links of each of its
vectors and a forest that links what is linked, a row a vector.

Equal vectors of a label are one class with their number. Every link is found: centres and samples decide only how much is
pruned. In many dimensions without structure little is, and leaves of a label are then all compared, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import shared
from tallyforge.llm.components import components

#: Classes of a leaf; children of a node of the upper levels at most, and classes that they are chosen among; levels.
LEAF, FAN, SAMPLE, LEVELS = 2_048, 64, 1_024, 16
#: Vectors of a lower node that are children of the node above as they are.
FEW = 16
#: What rounding can do to a distance.
SLACK = 1e-7


def units(data: bytes | memoryview, n: int, kind: str) -> np.ndarray:
    """Vectors of length 1, in double precision, from the packed originals."""
    x = np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of two, of any length up to 1."""
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T, 0))


def net(x: np.ndarray, radius: float, most: int | None = None) -> np.ndarray:
    """Rows, each further than the radius from those before it, so that every row is within the radius of one; or the first
    ``most`` of them."""
    chosen: list[int] = []
    left = np.arange(len(x))
    while len(left) and (most is None or len(chosen) < most):
        near = distances(x[left[:64]], x[left[:64]]) <= radius
        mine: list[int] = []
        for i in range(len(near)):
            if not near[i, mine].any():
                mine.append(i)
        mine = mine[: None if most is None else most - len(chosen)]
        centres = left[mine]
        chosen.extend(centres.tolist())
        left = left[(distances(x[left], x[centres]) > radius).all(1)]
    return np.array(chosen, np.int64)


@dataclass
class Tree:
    """Lower levels over the vectors of a leaf. Nodes are numbered so that a node's children and its vectors are ranges; the
    vectors stand in the order of the nodes."""

    order: np.ndarray
    first: np.ndarray  # a node's vectors
    last: np.ndarray
    centre: np.ndarray  # a place in that order
    radius: np.ndarray
    child: np.ndarray  # its children; none if it is a single vector
    end: np.ndarray

    @classmethod
    def over(cls, x: np.ndarray, radius: float = 1.0) -> Tree:
        order = np.arange(len(x))
        nodes = [[0, len(x), 0, 2.0, 0, 0]]
        queue, at = [(0, radius)], 0
        while at < len(queue):
            (i, r), at = queue[at], at + 1
            a, z = nodes[i][:2]
            if z - a == 1:
                continue
            own = order[a:z].copy()
            centres = np.arange(0)
            while z - a > FEW and r > 1e-6 and len(centres) < 2:  # levels of one child are passed over
                centres, r = net(x[own], r), r / 2
            if len(centres) < 2:  # few, or all in one place
                parts, radii = [own[k : k + 1] for k in range(z - a)], [0.0] * (z - a)
            else:
                d = distances(x[own], x[own[centres]])
                nearest = d.argmin(1)
                nearest[centres] = np.arange(len(centres))  # a centre is its own, also beside an equal one
                far = d[np.arange(len(own)), nearest]
                places = np.argsort(nearest, kind="stable")
                bounds = np.searchsorted(nearest[places], np.arange(len(centres) + 1))
                parts, radii = [], []
                for k, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    part = places[s:e]
                    if e - s <= FEW:
                        parts.extend(own[m : m + 1] for m in part.tolist())
                        radii.extend([0.0] * (e - s))
                    else:
                        parts.append(own[np.concatenate([centres[k : k + 1], part[part != centres[k]]])])
                        radii.append(float(far[part].max()))
            begun = len(nodes)
            for k, part in enumerate(parts):
                order[a : a + len(part)] = part
                nodes.append([a, a + len(part), a, radii[k], 0, 0])
                queue.append((begun + k, r))
                a += len(part)
            nodes[i][4:] = begun, len(nodes)
        own = np.array(nodes, object)
        return cls(order, *[own[:, c].astype(np.float64 if c == 3 else np.int64) for c in range(6)])

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.first)], np.int64)
        return b"".join(np.ascontiguousarray(v).tobytes() for v in (head, self.order, self.first, self.last, self.centre, self.radius, self.child, self.end))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        n, m = np.frombuffer(data, np.int64, 2)
        sizes, out, at = [(n, np.int64), (m, np.int64), (m, np.int64), (m, np.int64), (m, np.float64), (m, np.int64), (m, np.int64)], [], 16
        for size, kind in sizes:
            out.append(np.frombuffer(data, kind, size, at))
            at += 8 * int(size)
        return cls(*out)


def united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins what ``a[i]`` and ``b[i]`` name, in place: a label is the least place of its component."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        for of in (a, b, x, y):
            np.minimum.at(labels, of, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def traversed(a: Tree, xa: np.ndarray, wa: np.ndarray, b: Tree, xb: np.ndarray, wb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of all vectors of both trees (of one, if they are the same) the sum of the weights that each is linked to, and the least
    place of what it is linked with in these trees. Vectors and weights stand in the trees' order."""
    t = float(np.sqrt(max(2 - 2 * threshold, 0)))
    shift = 0 if same else len(xa)
    links, labels = np.zeros(shift + len(xb), np.int64), np.arange(shift + len(xb))
    below = lambda tree, i: np.arange(tree.child[i], tree.end[i]) if tree.end[i] > tree.child[i] else np.array([i])
    stack = [(below(a, 0), below(b, 0), same)]
    while stack:  # some nodes of one tree against some of the other, or nodes against themselves
        ca, cb, own = stack.pop()
        pa_, pb = a.centre[ca], b.centre[cb]
        dots = xa[pa_] @ xb[pb].T
        lone_a, lone_b = a.last[ca] - a.first[ca] == 1, b.last[cb] - b.first[cb] == 1
        one = lone_a[:, None] & lone_b
        hits = one & (dots >= threshold)
        if own:
            np.fill_diagonal(hits, False)
        if hits.any():
            links[pa_] += hits @ wb[pb]
            if not own:
                links[shift + pb] += hits.T @ wa[pa_]
            r, c = np.nonzero(np.triu(hits) if own else hits)
            united(labels, pa_[r], shift + pb[c])
        if one.all():
            continue
        d, radii = np.sqrt(np.maximum(2 - 2 * dots, 0)), a.radius[ca][:, None] + b.radius[cb]
        whole = ~one & (d + radii <= t - SLACK)
        down = ~one & ~whole & (d <= t + radii + SLACK)
        if own:
            whole, down = np.triu(whole, 1), np.triu(down, 1)
            stack.extend((below(a, i), below(a, i), True) for i in ca[~lone_a].tolist())
        for r, c in zip(*np.nonzero(whole), strict=True):
            u, v = np.arange(a.first[ca[r]], a.last[ca[r]]), np.arange(b.first[cb[c]], b.last[cb[c]])
            links[u] += wb[v].sum()
            links[shift + v] += wa[u].sum()
            united(labels, np.concatenate([u, shift + v]), np.full(len(u) + len(v), u[0]))
        for r in np.flatnonzero(~lone_a & down.any(1)).tolist():
            stack.append((below(a, ca[r]), cb[down[r]], False))
        lone = down & lone_a[:, None]
        for c in np.flatnonzero(lone.any(0)).tolist():
            stack.append((ca[lone[:, c]], below(b, cb[c]), False))
    return links, labels


def _bytes(column: pa.ChunkedArray | pa.Array) -> list:
    return [v.as_buffer() for v in column]


def _joined(column) -> bytes:
    return b"".join(memoryview(v) for v in _bytes(column))


def _choose(kind: str, leaf: int, fan: int):
    """Of a sample of a node its children: as many as its vectors ask for, further apart than the level's radius."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        node, n, radius = table["node"][0].as_py(), table["n"][0].as_py(), table["r"][0].as_py()
        x = units(_joined(table["x"]), table.num_rows, kind)
        order = np.random.default_rng(11).permutation(len(x))
        x = x[order]
        chosen = x[net(x, radius, min(fan, max(2, -(-3 * n // leaf))))]
        return pa.table({"node": [f"{node}.{i}" for i in range(len(chosen))], "parent": [node] * len(chosen), "centre": pa.array(chosen.tolist(), pa.list_(pa.float64()))})

    return run


def _deal(kind: str):
    """Vectors of a part of a node to the nearest of its children."""

    def run(rows: pa.Table, children: pa.Table) -> pa.Table:
        names = children["node"].to_pylist()
        x = units(_joined(rows["x"]), rows.num_rows, kind)
        d = distances(x, np.array(children["centre"].to_pylist(), float))
        own = d.argmin(1)
        return pa.table({"cls": rows["cls"], "w": rows["w"], "x": rows["x"], "node": pa.array([names[i] for i in own.tolist()], pa.string()), "d": d[np.arange(len(own)), own]})

    return run


def _pack(kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        raw = np.frombuffer(_joined(table["x"]), kind).reshape(table.num_rows, -1)
        tree = Tree.over(units(raw.tobytes(), len(raw), kind))
        column = lambda name: table[name].to_numpy()[tree.order].astype(np.int64).tobytes()
        return pa.table({"node": [table["node"][0].as_py()], "block": pa.array([table["block"][0].as_py()], pa.int32()), "cls": [column("cls")], "w": [column("w")], "x": [raw[tree.order].tobytes()], "tree": [tree.packed()]})

    return run


def _compare(kind: str, threshold: float):
    """Links of the vectors of pairs of leaves. A null second leaf is the first again."""

    def read(row: dict | None):
        if row is None:
            return None
        ids = np.frombuffer(row["cls"], np.int64)
        return Tree.unpacked(row["tree"]), units(row["x"], len(ids), kind), np.frombuffer(row["w"], np.int64), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                one, two = read(a.as_py()), read(b.as_py())
                ids = one[3] if two is None else np.concatenate([one[3], two[3]])
                links, labels = traversed(*one[:3], *(two or one)[:3], threshold, two is None)
                some = np.flatnonzero(links > 0)
                if len(some):
                    to = pa.array(ids[labels[some]], mask=labels[some] == some)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), to], ["cls", "links", "to"])

    return run


def leaves(points: DataFrame, kind: str, *, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, DataFrame, int]:
    """Upper levels over ``points`` (cls, node, w, x; node is the root's name): (leaves' rows with their node, all nodes as
    ``node, parent, centre, radius``, number of levels below the roots)."""
    live, done, nodes, level = points, [], None, 0
    tight = None
    while True:
        sizes = shared.materialised(live.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf), "sizes")
        if tight is not None:
            sizes = sizes.join(tight, "node", "left_anti")
        if level == LEVELS or sizes.isEmpty():
            break
        big = shared.sized(sizes)
        done.append(live.join(F.broadcast(sizes) if shared.small(sizes) else sizes, "node", "left_anti"))
        rows = live.join(big, "node").withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / (2 * leaf))).cast("int"))
        sample = rows.filter(shared.draw("cls") < (F.lit(float(SAMPLE)) / F.col("n") * F.lit(float(1 << 62)))).withColumn("r", F.lit(2.0**-level))
        chosen = shared.materialised(sample.groupBy("node").applyInArrow(_choose(kind, leaf, fan), "node string, parent string, centre array<double>"), "centres")
        parts = sizes.select(F.col("node").alias("parent"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / (2 * leaf)) - 1).cast("int"))).alias("part"))
        to = chosen.join(parts, "parent")
        dealt = rows.groupBy("node", "part").cogroup(to.groupBy(F.col("parent").alias("node"), "part")).applyInArrow(_deal(kind), "cls long, w long, x binary, node string, d double")
        live = shared.materialised(dealt, "level")
        below = chosen.join(live.groupBy("node").agg(F.max("d").alias("radius")), "node")
        below = shared.materialised(below, "nodes")
        nodes = below if nodes is None else nodes.unionByName(below)
        # what is as tight as that is cut into blocks, as a split would prune nothing
        tight = below.filter(F.col("radius") <= 1e-6).select("node")
        live, level = live.drop("d"), level + 1
    for rows in done:
        live = live.unionByName(rows.select(*live.columns))
    return live, nodes, level


def leaf_pairs(roots: DataFrame, nodes: DataFrame | None, level: int, t: float) -> DataFrame:
    """``a, b`` of all pairs of leaves that can hold a link, a leaf with itself among them; of two, one order alone."""
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if nodes is None:
        return pairs
    ends = nodes.select("node", "centre", "radius").join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    none = F.array().cast("array<double>")
    alone = roots.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node", none.alias("centre"), F.lit(1.0).alias("radius"))
    stay = ends.unionByName(alone).select(F.col("node").alias("parent"), "node", "centre", "radius")
    steps = shared.materialised(nodes.select("parent", "node", "centre", "radius").unionByName(stay), "steps")
    side = lambda s: shared.sized(steps.select(F.col("parent").alias(f"p{s}"), F.col("node").alias(f"n{s}"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}")))
    apart = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = (F.col("n1") == F.col("n2")) | (apart <= F.col("r1") + F.col("r2") + (t + SLACK))
    for _ in range(level):
        both = pairs.join(side(1), F.col("a") == F.col("p1")).join(side(2), F.col("b") == F.col("p2"))
        pairs = both.filter(((F.col("a") != F.col("b")) | (F.col("n1") <= F.col("n2"))) & near).select(F.col("n1").alias("a"), F.col("n2").alias("b"))
        pairs = shared.materialised(pairs, "pairs")
    return pairs


def linked(vectors: DataFrame, *, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Rows are linked if their labels are equal and not null, their vectors are of equal length and the cosine is the threshold
    or more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; equal vectors of a
    label link. Rows of a repeated key count by themselves; null keys link like others, but name no component unless all of
    its keys are null. ``kept``: the key is its component's. An empty table gives no rows; other columns are not read."""
    spark = vectors.sparkSession
    shared.small_batches(spark)
    rows = shared.cased(vectors, key, vector, label).toDF("vec_id", "v", "label")
    if not (isinstance(rows.schema["v"].dataType, T.ArrayType) and isinstance(rows.schema["v"].dataType.elementType, T.FloatType)):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = rows.filter(usable).groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = shared.materialised(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(3)
                values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                x = [values[a:z].astype(kind).tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x, pa.binary())], ["cls", "node", "w", "x"])

    root = F.concat_ws("/", F.col("label").cast("string"), F.size("v"))
    points = classes.select("cls", root.alias("node"), F.col("n").alias("w"), "v").mapInArrow(packed, "cls long, node string, w long, x binary")
    points = shared.materialised(points, "points")
    ends, nodes, level = leaves(points, kind, leaf=leaf, fan=fan)

    ends = shared.materialised(ends, "leaves") if level else ends
    blocks = shared.materialised(ends.groupBy("node").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / leaf).cast("int")), "blocks")
    cut = ends.join(shared.sized(blocks.select("node", "blocks")), "node").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    packs = cut.groupBy("node", "block").applyInArrow(_pack(kind), "node string, block int, cls binary, w binary, x binary, tree binary")
    packs = shared.materialised(packs, "packs")

    pairs = leaf_pairs(points.select("node").distinct(), nodes, level, float(np.sqrt(max(2 - 2 * threshold, 0))))
    there = packs.select("node", "block")
    pairs = pairs.join(there.toDF("a", "i"), "a").join(there.toDF("b", "j"), "b").filter((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")))
    pack = F.struct("cls", "w", "x", "tree")
    one, two = packs.select(F.col("node").alias("a"), F.col("block").alias("i"), pack.alias("one")), packs.select(F.col("node").alias("b"), F.col("block").alias("j"), pack.alias("two"))
    crossed = pairs.join(one, ["a", "i"]).join(two, ["b", "j"])
    alone = one.withColumns({"b": F.col("a"), "j": F.col("i")}).withColumn("two", F.lit(None).cast(two.schema["two"].dataType))
    tasks = crossed.select("a", "i", "b", "j", "one", "two").unionByName(alone.select("a", "i", "b", "j", "one", "two"))
    tasks = tasks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "i", "b", "j").select("one", "two")
    found = shared.materialised(tasks.mapInArrow(_compare(kind, threshold), "cls long, links long, to long"), "links")

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.filter("to IS NOT NULL").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    known = classes.join(links, "cls", "left").join(roots.withColumnsRenamed({"id": "cls"}), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    known = shared.materialised(known, "known")
    firsts = shared.materialised(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "firsts")
    known = shared.joined_by_size(known, firsts, ["root"], "members").select("label", "v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = shared.materialised(known, "components")
    linked_rows = shared.joined_by_size(rows.filter(usable), known.withColumn("weight", F.col("n")).drop("n"), ["label", "v"], "weight").select("vec_id", "n_links", "component_id")
    other = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_rows.unionByName(other).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("vec_id", key)
