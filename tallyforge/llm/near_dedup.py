"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets form a class, and the classes are joined:

1. Each class gets 64 minwise tokens and a sketch of two bits of each. The roots of independent trees branch by
   tokens that a hash of the path selects: classes with the same token at the chosen place share a node.
2. In each node, classes are held against three leaders of the node (the first in three orders). That gives at
   most three candidates a class and node, however large a group of near copies is. Candidates whose sketches
   agree are confirmed on the full sets and merged into components.
3. Nodes whose classes now lie in one component need nothing more. Of the rest, small ones are compared
   exhaustively, sketch against sketch, for pairs in different components, which are confirmed on the full sets.
   Large ones branch again by further chosen tokens, level by level; but where many classes look like a leader,
   branching would not part them, and those outside the node's largest component are compared on full sets with all
   of the node, in blocks. So is what is still large at the last level: no case is dropped.

A pair at the threshold is missed by a tree with a probability of about 0.06 at any depth, hence by all with less
than 1e-6 at five trees. Confirmed links are exact. Only leaders' and undecided candidates' texts are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.bpe import in_parts
from tallyforge.llm.components import components
from tallyforge.llm.shingles import digest, mixed, shingle_sets

TOKENS = 64
TREES, BRANCHES = 5, 2
#: Nodes up to this size are compared exhaustively.
SMALL = 64
#: A larger node in which this share of the classes looks like a leader is compared on full sets, by blocks of this
#: many; others branch.
CROWDED, BLOCK = 0.3, 512
#: The most bytes of sets in a block, but for a single larger one.
BLOCK_BYTES = 8 << 20
LEVELS = 6
PART = 1_000_000
_ODD = np.random.default_rng(99).integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = "n_shingles long, vid long, s1 long, s2 long, tokens array<int>"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """64 minwise tokens of 32 bits of each set; of empty sets zeros."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for t in range(TOKENS):
            out[full, t] = np.minimum.reduceat(flat * _ODD[t], starts) >> np.uint64(32)
    return out


def sketches(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each token, as two signed numbers."""
    two = (mixed(tokens.astype(np.uint64), 5) & np.uint64(3)).reshape(len(tokens), 2, 32)
    packed = (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64).view(np.int64)
    return packed[:, 0], packed[:, 1]


def class_id(s: np.ndarray) -> int:
    """A number that names a set."""
    a, b = digest(s)
    return int(mixed(np.array([(a * 3 + b) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def features(docs: DataFrame, *, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and, of its shingle set, size, class, sketch and tokens."""
    shared.small_batches(docs.sparkSession)
    rows = shared.spread(shared.cased(docs, key, text))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_parts(batch.column(1).to_pylist(), lambda t: len(t or ""), PART):
                sets = shingle_sets([t or "" for t in texts], n)
                tokens = signatures(sets)
                s1, s2 = sketches(tokens)
                columns = [[len(s) for s in sets], [class_id(s) for s in sets], s1, s2]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * TOKENS, pa.int32()), pa.array(tokens.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, pa.int64()) for c in columns), listed], names=[key, "n_shingles", "vid", "s1", "s2", "tokens"])
                at += len(texts)
        shared.settle()

    return rows.mapInArrow(run, f"`{key}` {kind}, {FEATURES}")


def unlike(a: str, b: str) -> Column:
    """In how many of the 64 tokens the sketches differ."""
    fold = lambda x: F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return fold(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + fold(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))


def plausible(a: str, b: str, percent: int) -> Column:
    """Sizes allow the similarity, and sketches don't differ by six deviations more than they would at it."""
    p = 0.75 * (1 - percent / 100)
    most = int(TOKENS * p + 6 * (TOKENS * p * (1 - p)) ** 0.5) + 1
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (unlike(a, b) <= most)


def child_nodes(rows: DataFrame, branches: int) -> DataFrame:
    """Rows (``node``, ``tokens``, ...) to rows of the nodes below: the path's hash selects the tokens."""
    place = lambda j: F.pmod(F.xxhash64("node", j), F.lit(TOKENS)).cast("int")
    below = F.array(*[F.xxhash64("node", F.lit(j), F.get("tokens", place(F.lit(j)))) for j in range(branches)])
    return rows.withColumn("node", F.explode(F.array_distinct(below)))


def sets_of(vids: DataFrame, docs: DataFrame, vertices: DataFrame, *, n: int, text: str, key: str) -> DataFrame:
    """``vid, shingles`` of the given classes: their texts are read again, their sets written."""
    ends = vids.distinct().join(vertices.select("vid", "rep"), "vid")
    whole = shared.cased(docs, key, text).join(ends, F.col(key).eqNullSafe(F.col("rep"))).select("vid", text)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in in_parts(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), lambda r: len(r[1] or ""), PART):
                found = [(v, s) for (v, _), s in zip(rows, shingle_sets([t or "" for _, t in rows], n), strict=True) if class_id(s) == v]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["vid", "shingles"])

    return shared.materialised(whole.mapInArrow(sets, "vid long, shingles binary").dropDuplicates(["vid"]), "sets")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b`` of classes) whose full sets are similar enough."""
    a, b = (held.select(F.col("vid").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                common = int((p[at] == q).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(alike, "a long, b long")


def crowded_links(crowded: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links of crowded nodes (``node, vid, comp, size, mass``: shingles in all) on full sets: classes outside the node's largest component
    against all of the node, block by block. A task gives at most one link for each merge of components, never
    all pairs."""
    counts = crowded.groupBy("node", "comp").agg(F.count("*").alias("n"))
    giant = counts.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("g"), F.sum("n").alias("weight")).select("node", F.col("g.comp").alias("giant"), "weight")
    rows = shared.joined_by_size(crowded, shared.materialised(giant, "giants"), ["node"], "weight").join(held, "vid").withColumn("nb", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("mass") * 8 / BLOCK_BYTES))).withColumn("own", F.pmod(F.xxhash64("vid", "node"), "nb"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    columns = ("vid", "comp", "shingles")
    left = rows.filter("comp <> giant").select("node", F.col("own").alias("bl"), every.alias("br"), *columns)
    right = rows.select(F.col("node").alias("node_r"), every.alias("bl_r"), F.col("own").alias("br_r"), *[F.col(c).alias(f"{c}_r") for c in columns])

    def compare(some: pa.Table, all_: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if some.num_rows and all_.num_rows:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in all_.column("shingles_r")]
            sizes = np.array(list(map(len, sets)))
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            vids, comps = all_.column("vid_r").to_pylist(), all_.column("comp_r").to_pylist()
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := above.get(x, x)) != x:
                    x = y
                return x

            for vid, comp, x in zip(some.column("vid").to_pylist(), some.column("comp").to_pylist(), some.column("shingles"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                length = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                for i in np.flatnonzero(100 * common >= percent * (sizes + len(x) - common)).tolist():
                    p, q = root(comp), root(comps[i])
                    if p != q:
                        above[max(p, q)] = min(p, q)
                        out.append((vid, vids[i]))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return left.groupBy("node", "bl", "br").cogroup(right.groupBy("node_r", "bl_r", "br_r")).applyInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, *, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of distinct n-word shingles;
    words lie between spaces and the controls 9 to 13, and A-Z counts as a-z. With fewer than n words the whole
    sequence is the one shingle. A text that is null or without words has an empty set and no link. component_id
    is the smallest key reachable, itself included; ``kept`` says that it is the row's own. Rows with equal keys
    and texts get equal results; equal keys with different texts are documents of their own, linked only if their sets
    are alike. A null key is never the smallest beside others and never kept. An empty table gives no rows. Only key and text are read."""
    base = shared.materialised(features(docs, n=n, text=text, key=key), "features")
    filled = base.filter("n_shingles > 0")
    vertices = shared.materialised(filled.groupBy("vid").agg(F.min(key).alias("rep"), F.first(F.struct("n_shingles", "s1", "s2", "tokens")).alias("f")).select("vid", "rep", "f.*"), "vertices")
    columns = ["node", "vid", "n_shingles", "s1", "s2"]
    me = F.struct("vid", "n_shingles", "s1", "s2")
    read = {"n": n, "text": text, "key": key}

    def members_of(rows: DataFrame) -> DataFrame:
        """``node, m, size, l0, l1, l2`` of nodes with several classes; the last three are leaders."""
        orders = [F.min(F.struct(F.xxhash64("vid", F.lit(i)).alias("o"), *[F.col(c) for c in columns[1:]])).alias(f"l{i}") for i in range(3)]
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), *orders).filter("size > 1")
        nodes = shared.materialised(nodes.withColumn("weight", F.col("size")), "nodes")
        # nodes with many classes are joined apart from the others
        return shared.materialised(shared.joined_by_size(rows, nodes, ["node"], "weight").select("node", me.alias("m"), "size", "l0", "l1", "l2"), "members")

    roots = vertices.withColumn("node", F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])))
    members = members_of(child_nodes(roots, BRANCHES).select(columns))
    stars = None
    for i in range(3):
        part = members.filter((F.col("m.vid") != F.col(f"l{i}.vid")) & plausible("m", f"l{i}", percent)).select(F.col("m.vid").alias("a"), F.col(f"l{i}.vid").alias("b"))
        stars = part if stars is None else stars.union(part)
    tied = shared.materialised(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    ends = lambda pairs: pairs.select(F.col("a").alias("vid")).union(pairs.select("b"))
    links = shared.materialised(confirmed(tied, sets_of(ends(tied), docs, vertices, **read), percent), "links")
    merged = components(links)

    pairs, crowded = None, None
    near = plausible("m", "l0", percent) | plausible("m", "l1", percent) | plausible("m", "l2", percent)
    for level in range(LEVELS):
        last = level == LEVELS - 1
        placed = members.select("node", "m", near.alias("near")).join(merged.withColumnRenamed("id", "vid"), F.col("m.vid") == F.col("vid"), "left").select("node", "m", "near", F.coalesce("root", "m.vid").alias("comp"))
        kinds = placed.groupBy("node").agg(F.count("*").alias("size"), F.count_if("near").alias("close"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("m.n_shingles").alias("mass")).filter("low <> high")
        kind = F.when(F.col("size") <= SMALL, "small").when(F.lit(last) | (F.col("close") >= CROWDED * F.col("size")), "crowded").otherwise("open")
        kinds = shared.materialised(kinds.select("node", "size", "mass", kind.alias("kind"), F.col("size").alias("weight")), "kinds")
        live = shared.materialised(shared.joined_by_size(placed.drop("near"), kinds, ["node"], "weight"), "open")
        small = live.filter("kind = 'small'")
        p, q = small.select("node", F.col("m").alias("p"), F.col("comp").alias("c")), small.select(F.col("node").alias("node2"), F.col("m").alias("q"), F.col("comp").alias("d"))
        close = p.join(q, (F.col("node") == F.col("node2")) & (F.col("c") < F.col("d")) & plausible("p", "q", percent)).select(F.least("p.vid", "q.vid").alias("a"), F.greatest("p.vid", "q.vid").alias("b"))
        pairs = close if pairs is None else pairs.union(close)
        full = live.filter("kind = 'crowded'").select("node", F.col("m.vid").alias("vid"), "comp", "size", "mass")
        crowded = full if crowded is None else crowded.union(full)
        large = live.filter("kind = 'open'").select("node", F.col("m.vid").alias("vid"))
        if last or large.isEmpty():
            break
        members = members_of(child_nodes(large.join(vertices, "vid"), BRANCHES).select(columns))
    pairs = shared.materialised(pairs.distinct().join(tied, ["a", "b"], "left_anti"), "pairs")
    held = sets_of(ends(pairs).union(crowded.select("vid")), docs, vertices, **read)
    more = shared.materialised(confirmed(pairs, held, percent).union(crowded_links(crowded, held, percent)), "more-links")
    if not more.isEmpty():
        merged = components(links.union(more))

    named = vertices.select("vid", "rep").join(merged.withColumnRenamed("id", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "root").select("vid", "component_id")
    out = base.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("vid")).alias("vid")).join(of_class, "vid", "left")
    return out.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
