"""Links of embeddings against all pairs."""

import numpy as np
import pytest

from tallyforge.llm.cover_tree import Tree, linked, traversed, units

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, groups, dims, spread, seed=0):
    """Vectors without structure, but for groups around one of them."""
    rng = np.random.default_rng(seed)
    x, at = rng.normal(size=(n, dims)), 0
    for size in groups:
        x[at : at + size] = x[at] + rng.normal(size=(size, dims)) * spread
        at += size
    return x[rng.permutation(n)].astype(np.float32)


@pytest.mark.parametrize(("n", "groups", "spread"), [(1, [], 0.1), (30, [12], 0.06), (700, [300, 40, 2, 2], 0.06), (700, [600], 0.001), (300, [300], 0.0)])
def test_traversal_equals_all_pairs(n, groups, spread):
    raw = vectors(n, groups, 16, spread)
    x, w = units(raw.tobytes(), n, "<f4"), np.arange(n) % 5 + 1
    tree = Tree.unpacked(Tree.over(x).packed())
    assert sorted(tree.order) == list(range(n))
    for i in range(len(tree.first)):  # every node's vectors are within its radius
        own = x[tree.order][tree.first[i] : tree.last[i]]
        assert np.linalg.norm(own - x[tree.order][tree.centre[i]], axis=1).max() <= tree.radius[i] + 1e-6
    x, w = x[tree.order], w[tree.order]
    links, labels = traversed(tree, x, w, tree, x, w, 0.98, True)
    hits = x @ x.T >= 0.98
    np.fill_diagonal(hits, False)
    assert (links == hits @ w).all()
    reach = hits | np.eye(n, dtype=bool)
    for _ in range(10):
        reach = reach.astype(np.float32) @ reach > 0
    assert (labels == reach.argmax(1)).all()


def plain(rows):
    """(key, links, component, kept) of every row by comparing all pairs."""
    good = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, above = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for at, a in enumerate(good):
        for b in good[at + 1 :]:
            u, v = np.array(rows[a][1]), np.array(rows[b][1])
            if rows[a][2] == rows[b][2] and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                above[y] = x
    keys = {}
    for k, (i, _, _) in enumerate(rows):
        keys.setdefault(root(k), []).append(i)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in keys.items()}
    return sorted(str((i, links[k], least[root(k)], i == least[root(k)])) for k, (i, _, _) in enumerate(rows))


@pytest.fixture(scope="module")
def table():
    """Two labels and none, a group, a third of the rows equal, and odd rows: repeated and null keys, scaled copies, other
    lengths, zero, null and non-finite vectors."""
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors(300, [120, 40, 3], 16, 0.06))]
    rows += [(1000 + i, v.tolist(), 2) for i, v in enumerate(vectors(60, [10], 16, 0.06, 1))]
    rows += [(2000 + i, v.tolist(), None) for i, v in enumerate(vectors(5, [5], 16, 0.01, 2))]
    one = rows[0][1]
    rows += [(3000 + i, one, 1) for i in range(200)]
    odd = [[2 * c for c in one], None, [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8, [2.0] * 8, [], [None] * 16, [1e-30] * 16, [3e38] * 16]
    return rows + [(4000 + i, v, 1) for i, v in enumerate(odd)] + [(None, one, 1), (7, one, 1), (None, [1.0] * 5, 3), (7, one, 1)]


@pytest.mark.parametrize(("leaf", "fan"), [(2048, 64), (40, 4)])  # one leaf a label, and several levels
def test_links_equal_all_pairs(spark, table, leaf, fan):
    df = spark.createDataFrame([(*r, 0, 1) for r in table], SCHEMA + ", root int, cls int").withColumnRenamed("cls", "Label")
    got = linked(df, leaf=leaf, fan=fan)
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got.collect()) == plain(table)


def test_no_rows(spark):
    assert linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_key_holds_most_rows(spark):
    """Nearly all rows are one vector: they are one class, and no task of the last join has them all."""
    x = vectors(40, [], 16, 0.0)
    rows = [(i, x[0].tolist(), 1) for i in range(2000)] + [(5000 + i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_links == 2000 and got[5000].component_id == 0 and got[0].kept and not got[1999].kept and got[5001].kept
