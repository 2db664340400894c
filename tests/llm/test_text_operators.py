import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, language, sharding, toxicity


def least_distance(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_matcher_equals_brute_force():
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(n))) for i, n in enumerate((60, 110, 29, 12))]
    matcher = decontamination.Matcher(items)
    for _ in range(150):
        t = list(decontamination.folded(rng.choice(items[:3])[1]))
        for _ in range(rng.randint(0, 10)):
            p, o = rng.randrange(len(t)), rng.randrange(3)
            if o == 0:
                t[p] = "z"
            elif o == 1 and len(t) > 1:
                del t[p]
            else:
                t.insert(p, "q")
        doc = decontamination.folded("in front " + "".join(t) + " behind")
        want = [(i, d) for i, x in items[:3] if (d := least_distance(f := decontamination.folded(x), doc)) <= decontamination.budget(f)]
        assert [(i, d) for i, d, _ in matcher.find(doc) if i < 3] == want


def test_short_items_end_at_word_borders():
    matcher = decontamination.Matcher([(1, "short one"), (2, "(x)"), (3, "cafe"), (4, "a")])
    find = lambda t: [(i, e) for i, _, e in matcher.find(t)]
    assert find("A Short  one.") == [(1, 11), (4, 1)]
    assert [find(t) for t in ('("short one")', "short one", "see short one, then", "«short one»")] == [[(1, 11)], [(1, 9)], [(1, 13)], [(1, 10)]]
    assert find("shorty one, short ones, 1short one, short one2") == []
    assert find("ashort one short one") == [(1, 20)]
    assert find("f (x) cafe\u0301") == [(2, 5)]


def test_leaks_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "the FIRST text,  long enough to be a line."), (2, None), (3, ""), (None, "x"), (4, "short"), (1, "the FIRST text,  long enough to be a line.")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.leaks(odd, bench).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (7, 4, 0)]
    assert decontamination.leaks(odd, bench.limit(0)).count() == 0
    assert decontamination.leaks(odd.limit(0), bench).count() == 0
    clean = decontamination.decontaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    bench = spark.createDataFrame([(i, f"item number {i} with a text of its own kind {i * i}") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before. item number {i} with a text of its own kind {i * i}. after") for i in range(20)], "doc_id long, text string")
    assert sum(1 for r in decontamination.leaks(docs, bench).collect() if r.doc_id == r.item_id) == 20


def test_language(spark, odd):
    texts = {"en": "the cat and the dog were with this that which", "de": "der hund und die katze nicht ein schön über", "fr": "le chien et la été que pour avec où"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(texts[k].split(), k=20)), k) for i in range(300) for k in [rng.choice(list(texts))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = language.identified(docs, model).join(docs, "doc_id")
    assert got.filter("lang = lang_pred").count() / 300 > 0.97
    seen = {r.doc_id: r for r in language.identified(odd, model).collect()}
    assert len(seen) == 8 and all(seen[i].lang_pred == "und" and seen[i].score == 0 for i in (2, 3, 4))
    assert all(0 <= r.score <= 1 for r in seen.values())
    assert language.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}
    assert language.in_known_language(odd, model).columns == odd.columns


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len(code) == n and len({tuple(r) for r in code.tolist()}) == n


def test_toxicity(spark, odd):
    rng = random.Random(6)
    words = [f"w{i}" + rng.choice("abc") for i in range(200)]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = rng.choices([w.strip("0123456789") + w for w in words], k=40) + (["vile", rng.choice(["women", "muslims"])] if bad else [])
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.98
    neutral = spark.createDataFrame([(0, "we met women here"), (1, "we met men here")], "doc_id long, text string")
    scores = [r.score for r in toxicity.scored(neutral, model).orderBy("doc_id").collect()]
    assert max(scores) < 0.5 and abs(scores[0] - scores[1]) < 0.05
    out = toxicity.scored(odd, model)
    assert out.count() == odd.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.scored(odd, toxicity.train(odd, labels.limit(0))).agg(F.max("predicted")).first()[0] == 0


def test_toxicity_counts_every_swap(spark, monkeypatch):
    texts = [f"text {i} of {a} and {b}" for i in range(20) for a, b in [("women", "gay"), ("black", "jews")]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "KEPT", 5)
    passed = []
    monkeypatch.setattr(toxicity, "calibrated", lambda rows, changes: passed.extend(changes))
    toxicity.train(docs, labels)
    got = Counter()
    for plus, minus, *n in passed:
        got[tuple(plus), tuple(minus)] += n[0] if n else 1
    assert got == Counter((tuple(plus), tuple(minus)) for t in texts for plus, minus in toxicity.swaps(t))


def test_sparse_fit_equals_a_dense_one():
    """The model is where a dense problem's loss, penalty and sparsity term, stated plainly, have their minimum."""
    rng = np.random.default_rng(4)
    texts = [" ".join([*rng.choice([f"word{i}" for i in range(12)], 6), "vile" if i % 3 == 0 else "kind", rng.choice(["women", "men"])]) for i in range(90)]
    rows = toxicity.Rows.of([toxicity.text_features(t) for t in texts], np.arange(90) % 3 == 0)
    changes = [(toxicity.features_of("women"), toxicity.features_of("men"), 40)]
    model = toxicity.fit(rows, changes, rounds=6000)
    kept = toxicity.screened(rows)
    place = {int(f): i for i, f in enumerate(kept)}
    x = np.zeros((90, len(kept)))
    for i, t in enumerate(texts):
        for f, n in zip(*toxicity.text_features(t), strict=True):
            if int(f) in place:
                x[i, place[int(f)]] = n
    scale = 1 / np.sqrt(np.maximum((x**2).mean(0), 0.01))
    x *= scale
    pairs = changes + [(toxicity.features_of(b), toxicity.features_of(a), 1) for g in toxicity.IDENTITY for a, b in zip(g, g[1:], strict=False)] + [([], toxicity.features_of(t), 1) for g in toxicity.IDENTITY for t in g]
    delta = np.zeros((len(pairs), len(kept)))
    for i, (plus, minus, n) in enumerate(pairs):
        for side, sign in ((plus, 1), (minus, -1)):
            for f in side:
                delta[i, place[f]] += sign * n**0.5 * scale[place[f]]
    w, y = model.weights[kept] / scale, rows.label
    many = sum(n for _, _, n in pairs)

    def loss(w, bias):
        m = x @ w + bias
        return np.mean(np.logaddexp(0, m) - y * m) + 20.0 * np.sum((delta @ w) ** 2) / many + 1e-3 * np.abs(w).sum()

    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    grad = x.T @ (p - y) / 90 + 40.0 * delta.T @ (delta @ w) / many
    on = np.abs(w) > 1e-6
    assert on.any() and np.allclose(grad[on], -1e-3 * np.sign(w[on]), atol=2e-4) and (np.abs(grad[~on]) <= 1.2e-3).all() and abs((p - y).mean()) < 2e-4
    least = loss(w, model.bias)
    assert all(loss(w + rng.normal(size=len(w)) * 0.01, model.bias) > least for _ in range(20))


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{'xy'[j // 26]}" for j in range(50))) for i in range(40)] + [(0, "another text of the same id")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "calibrated", lambda rows, changes: seen.append(rows))
    for most in (1 << 20, 5000, 1):
        toxicity.train(docs, labels, sample_bytes=most)
    assert [len(r.size) for r in seen] == [40, seen[1].size.size, 1]
    assert 1 < len(seen[1].size) < 40 and seen[1].feature.size * 8 <= 5000


def test_swaps_weigh_by_their_number():
    rng = np.random.default_rng(1)
    texts = [toxicity.text_features(f"w{rng.integers(9)} {'vile women' if i % 2 else 'fine men'}") for i in range(60)]
    rows = toxicity.Rows.of(texts, np.arange(60) % 2 == 1)
    a, b = ((toxicity.features_of(x), toxicity.features_of(y)) for x, y in (("women", "men"), ("jews", "hindus")))
    one, all_ = toxicity.fit(rows, [(*a, 30), (*b, 2)]), toxicity.fit(rows, [(*a, 1)] * 30 + [(*b, 1)] * 2)
    assert np.allclose(one.weights, all_.weights, atol=1e-5) and abs(one.bias - all_.bias) < 1e-5


def test_sharding_equals_brute_force(spark, odd):
    docs = spark.createDataFrame([(i, "é" * (i * 37 % 1000)) for i in range(3000)] + [(None, "n"), (5, "again"), (5, "again")], "doc_id long, text string")
    out = sharding.sharded(docs, shards=8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= out.groupby("vslot")["size"].sum().max()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    slot_of = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % sharding.SLOTS
    rows = [(i, len(t.encode()) + 1, zlib.crc32(t.encode()), slot_of(i)) for i, t in ((r.doc_id, r.text) for r in docs.collect())]
    # slots by falling bytes, each to the emptiest shard; places by slot, then key (null first), checksum and size
    by_slot = Counter()
    for _, size, _, slot in rows:
        by_slot[slot] += size
    loads, shard_of = [0] * 8, {}
    for slot in sorted(by_slot, key=lambda s: (-by_slot[s], s)):
        shard_of[slot] = loads.index(min(loads))
        loads[shard_of[slot]] += by_slot[slot]
    want, place = [], Counter()
    for i, size, crc, slot in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2], r[1])):
        shard = shard_of[slot]
        want.append((i, size, crc, "bytes", shard, place[shard], None))
        place[shard] += 1
    key = lambda r: (r[4], r[5])
    got = [tuple(r)[:7] for r in sharding.sharded(docs, shards=8).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    got = sharding.sharded(odd).collect()
    assert sorted(r.size for r in got if r.doc_id in (2, 3)) == [1, 1]
    assert {r.text_crc32 for r in got if r.doc_id == 3} == {0}
    assert sharding.sharded(odd.limit(0)).count() == 0


def test_rebalancing_moves_few_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    folder = f"file://{tmp_path}/map"
    one = {r.doc_id: r for r in sharding.sharded(docs, shards=4, folder=folder).collect()}
    two = {r.doc_id: r for r in sharding.sharded(docs, shards=5, folder=folder, version=2).collect()}
    moved = [i for i in one if one[i].shard != two[i].shard]
    total, share = sum(r.size for r in one.values()), sum(one[i].size for i in moved)
    assert all(two[i].shard == 4 for i in moved)  # the new shard alone receives
    assert abs(share - total / 5) <= 0.011 * total / 5
    assert sharding.load_map(spark, folder, 1) != sharding.load_map(spark, folder, 2)


def test_budgets_are_parameters(spark):
    """One edit in five letters, from ten letters on."""
    docs = spark.createDataFrame([(1, "we saw the quack brawn fix run"), (2, "a quick brown fox"), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    assert {(r.doc_id, r.distance) for r in decontamination.leaks(docs, items, per=5, short=10).collect()} == {(1, 3), (2, 0)}
    assert [r.doc_id for r in decontamination.leaks(docs, items).collect()] == [2]
    assert {r.doc_id for r in decontamination.decontaminated(docs, items, per=5, short=10).collect()} == {3}
    with pytest.raises(ValueError):
        decontamination.Matcher([(1, "x")], per=1)


def test_cuts_keep_both_labels(spark, monkeypatch):
    """A tenth of the rows are toxic; whatever the bounds cut, they take about as much of either label as of all drawn."""
    text = "some words that say nothing " * 20
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in range(2000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "calibrated", lambda rows, changes: seen.append(rows.label))
    toxicity.train(docs, labels, sample=400)
    size = len(seen[0])
    assert 0.4 < seen[0].mean() < 0.6 and 330 < size <= 400
    per_row = 8 * len(toxicity.text_features(f"{text} 1")[0])
    toxicity.train(docs, labels, sample=400, sample_bytes=per_row * size // 4)
    assert 0.35 < seen[1].mean() < 0.65 and 0.2 * size < len(seen[1]) < 0.3 * size


def test_language_sample_keeps_rare_languages(spark, monkeypatch):
    rows = [(f"word number {'a' * (i % 7)} of text {i}", "aa" if i % 20 else "bb") for i in range(2000)] + [("one odd text", "cc")]
    df = spark.createDataFrame(rows, "text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, label, languages: seen.append((label, languages)))
    language.train(df, sample=150)
    language.train(df, sample=150, most=2)
    (label, languages), (_, two) = seen
    assert languages == ["aa", "bb", "cc"] and two == ["aa", "bb"] and len(label) <= 150
    assert 30 <= (label == 0).sum() <= 75 and 30 <= (label == 1).sum() <= 75
