"""Every registered query over whole tables of the smallest size, against a plain Python version or its SQL."""

import glob
import hashlib
import os
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tallyforge.llm import decontamination, language, registry, toxicity  # noqa: E402
from tallyforge.llm import shared as S  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang) for r in S.documents(spark, SMALL).select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows(spark, name):
    return registry.QUERIES[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    want = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_op1(spark, docs, library):
    want = {}
    for i, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op1_bpe")} == want


def plain_language(model, text):
    """Language and score by counting every n-gram of letters, word by word, and adding the losses of each codeword."""
    mask, total, n = 0xFFFFFFFF, np.zeros(len(model.bias)), 0
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        data = f" {word} ".encode()
        for size in language.ORDERS:
            for at in range(len(data) - size + 1):
                gram = data[at : at + size]
                if gram == b" ":
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x01000193 & mask) ^ (c * 0x9E3779B1 & mask)
                bucket = ((h ^ (h >> 15)) * 0x85EBCA6B & mask) >> 8
                total += model.weights[bucket % language.BUCKETS]
                n += 1
    if not n:
        return "und", 0.0
    margins = total / n + model.bias
    losses = [sum(np.log1p(np.exp(-m * c)) * t for m, c, t in zip(margins, word, model.trust, strict=True)) for word in model.code]
    best = int(np.argmin(losses))
    return model.languages[best], 1 / sum(np.exp(len(model.bias) * (losses[best] - x)) for x in losses)


def test_op2(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op2_language")}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    learned = S.documents(spark, SMALL).filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = language.train(learned)
    for i, t, _ in docs:
        name, score = plain_language(model, t)
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-3
    held = [(lang, got[i].lang_pred) for i, t, lang in docs if got[i].held_out and lang and got[i].lang_pred != "und"]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_op3(spark, docs, library):
    got = sorted(rows(spark, "op3_token_files"), key=lambda r: r.start)
    start = 0
    for r, (i, t, _) in zip(got, sorted(docs), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op5_toxicity")}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7) for i, _, _ in docs)
    all_docs = S.documents(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.train(all_docs, labels)
    for i, t, _ in docs:
        margin = model.bias + sum(float(model.weights[f]) for piece in set((t or "").split()) for w in toxicity.words_of(piece) for f in toxicity.features_of(w))
        assert abs(got[i].score - 1 / (1 + np.exp(-margin))) < 1e-4


def least_distance(item, text):
    """Least edit distance of an item to any part of a text, a row of the table at a time."""
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    before, place = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), np.uint32), 1):
        now = np.empty_like(before)
        now[0] = i
        now[1:] = np.minimum(before[1:] + 1, before[:-1] + (t != c))
        before = np.minimum.accumulate(now - place) + place
    return int(before.min())


def leaks(docs, items):
    out = set()
    for i, t, *_ in docs:
        text = decontamination.folded(t)
        for j, item in items:
            f = decontamination.folded(item)
            if not f or not text or len(f) < decontamination.SHORT:
                continue
            k, tokens = decontamination.budget(f), {f[a : a + 5] for a in range(0, len(f) - 4)}
            if not any(x in text for x in tokens):  # an item in so few errors shares five letters in a row
                continue
            if (d := least_distance(f, text)) <= k:
                out.add((i, j, d))
    return out


def test_op6(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    chosen = {i for i, t, _ in docs if len(t or "") < 4000}
    got = {(r.doc_id, r.item_id, r.distance) for r in rows(spark, "op6_decontamination")}
    assert {x for x in got if x[0] in chosen} == leaks([d for d in docs if d[0] in chosen], items) and got


def test_op9(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op9_sharding")}
    sizes = Counter()
    for i, t, _ in docs:
        data = (t or "").encode()
        r = got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 8
        sizes[r.shard] += len(data) + 1
    for shard in sizes:
        assert sorted(r.slot for r in got.values() if r.shard == shard) == list(range(sum(r.shard == shard for r in got.values())))
    slots = Counter()
    for r in got.values():
        slots[r.vslot] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(slots.values())


def test_op10(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    x = {i: np.array(v, float) for i, v in table if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    got: dict[int, list] = {}
    for r in sorted(rows(spark, "op10_neighbours"), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r)
    asked = [i for i in x if i % 20 == 0]
    hits = 0
    for q in asked:
        best = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        assert [r["rank"] for r in got[q]] == list(range(1, len(best) + 1))
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-9 for r in got[q])
        hits += len(set(best) & {r.vec_id for r in got[q]})
    assert set(got) == set(asked) and hits >= 0.9 * 20 * len(asked)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_line_dedup(docs):
    """Documents without repeated lines and without lines that have an earlier one within an edit."""
    first, out = {}, []
    for i, t in sorted(docs):
        for at, raw in enumerate(t.split("\n")):
            if (line := raw.strip(" ")).strip():
                first.setdefault(line, (i, at))
    by_size: dict[int, list[str]] = {}
    for line in first:
        if len(line) >= 20:
            by_size.setdefault(len(line), []).append(line)
    near = set()
    for n, lines in by_size.items():
        others = [*lines, *by_size.get(n + 1, [])]
        heads: dict[str, list[str]] = {}
        for x in others:  # within an edit, two lines share their first or their last ten letters
            heads.setdefault("a" + x[:10], []).append(x)
            heads.setdefault("b" + x[-10:], []).append(x)
        for group in heads.values():
            for a, b in combinations(group, 2):
                if a != b and within_one(a, b):
                    near.add(max(a, b, key=first.get))
    for i, t in docs:
        kept = [raw for at, raw in enumerate(t.split("\n")) if not (line := raw.strip(" ")).strip() or (line not in near and first[line] == (i, at))]
        out.append((i, "\n".join(kept), len(kept) < len(t.split("\n"))))
    return out


def shingles(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def plain_near_dedup(docs):
    """Documents that are the first of their group of near-duplicates."""
    above = {i: i for i, _ in docs}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    sets = {i: s for i, t in docs if (s := shingles(t))}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a]) * 100 >= 80 * len(sets[b]) >= 64 * len(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            above[y] = x
    return [(i, t) for i, t in docs if root(i) == i]


def test_pipeline(spark, docs, library):
    """Each stage's work done plainly on what its predecessor kept."""
    model = language.train(S.documents(spark, SMALL))
    verdict = {r.doc_id: r for r in language.identified(S.documents(spark, SMALL), model).collect()}
    left = [(i, t) for i, t, _ in docs if verdict[i].lang_pred != "und" and not (verdict[i].ambiguous and verdict[i].score < language.SURE)]
    left = [(i, t) for i, t, dropped in plain_line_dedup(left) if not dropped or t.strip(" \n")]
    left = plain_near_dedup(left)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {i for i, _, _ in leaks(left, items)}
    want = {}
    for i, t in left:
        if i not in dirty:
            ids = library.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and 0 < len(got) < len(docs)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, stage):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names; and an empty table."""
    out = stage(spark, odd, SMALL)
    assert out.columns == (["doc_id", "n_tokens", "ids", "decoded"] if stage is corpus_pipeline.bpe else list(corpus_pipeline.COLUMNS))
    got = out.collect()
    ids = [r.doc_id for r in got]
    if stage is corpus_pipeline.language_id:
        assert not {2, 3, 4} & set(ids)  # without letters
    elif stage is corpus_pipeline.line_dedup:
        assert ids.count(1) == 2 and 5 in ids and 2 in ids and 3 in ids
    elif stage is corpus_pipeline.near_dedup:
        assert ids.count(1) == 1 and {2, 3, 4, 5} <= set(ids)
    else:
        assert Counter(ids) == Counter(r.doc_id for r in odd.collect())
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_near_dedup_loses_no_text_of_a_repeated_id(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, text), (5, text + " more"), (5, "a text of its own that nothing else is like at all"), (None, text), (5, text + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())
    assert got == sorted([text, "a text of its own that nothing else is like at all"])
