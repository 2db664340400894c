"""Audits of filters and sources against plain counting."""

import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import divergence as D
from tallyforge.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string"


def failures(rows):
    """The letters that each (doc_id, text) fails."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first.get(t, i)]
        out.append("".join(x for x, f in zip("ABCDE", fails, strict=True) if f))
    return out


def plain_audit(docs, labels):
    """Every order run as a pipeline."""
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = failures([(i, t) for i, t, *_ in docs])
    parts, out = {}, {}
    for (i, _, part, *_), f in zip(docs, fails, strict=True):
        parts.setdefault(part or "", []).append((i, f))
    for part, rows in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                sums[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == x for _, f in rows), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(sums[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def docs():
    long = " ".join(f"w{i}" for i in range(150))
    texts = [long, long, long + " #", "SHOUTED TEXT", "", None, "a a a a a", " ".join(["one two"] * 80), "é 😀\x1cx", long * 400, "\t \n", long + " TAIL"]
    rows = [(k, t, ("en", "fr", None, "")[k % 4], ("s", "t", None)[k % 3]) for k, t in enumerate(texts * 6)]
    return rows + [(None, long, "en", "s"), (None, "alone", "en", "s"), (3, "repeated id", "fr", "s"), (3, "repeated id", "fr", "s"), (4, "repeated id", "fr", "s"), (None, None, None, None)]


LABELS = [(0, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (12, 1, 1), (12, 0, 0), (None, 1, 1), (999, 1, 1)]


def test_audit_equals_every_pipeline(spark, docs):
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], DOCS + ", mask int, p int").withColumnRenamed("p", "Text")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in A.audited(df, labels).collect()}
    assert got == plain_audit(docs, LABELS)


def test_copies_over_many_ranges(spark):
    """One text of most rows and one fingerprint of two texts, over more ranges than there are texts."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "copy" if i % 10 else f"own {i}") for i in range(400)] + [(5, "copy"), (1, "copy"), (1, "copy"), (None, "copy")]
        found = A.masks(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")).collect()
        want = Counter((i, "E" in f) for (i, _), f in zip(rows, failures(rows), strict=True))
        assert Counter((r.doc_id, bool(r["mask"] & 16)) for r in found) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_documents(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert A.audited(empty, labels).count() == 0 and D.divergence(empty).count() == 0


def plain_divergence(docs, least, top=50):
    words = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t, g, s in docs]
    out = []
    for lang in {g for g, _, _ in words}:
        seen = Counter(w for g, _, ws in words if g == lang for w in set(ws))
        kept = {w for w, n in seen.items() if n >= least}
        counts = {s: Counter() for g, s, _ in words if g == lang}
        for g, s, ws in words:
            if g == lang:
                counts[s].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023, E731
        for s, c in counts.items():
            pairs = [(sum(abs(share(c, w) - share(o, w)) for w in kept), x) for x, o in counts.items() if x != s]
            terms = [(share(c, w) - share(whole, w), w) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 1000])
def test_divergence_equals_plain_sums(spark, docs, least):
    extra = [(500 + i, f"Straße é{'x' * (i % 3)} A-B a_b 你好 {'word ' * i}", "en", f"src{i % 5}") for i in range(20)]
    rows = docs + extra + [(600, "", "xx", "only"), (601, "", "yy", "one"), (602, "a b", "yy", "two")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", term int, n int").withColumnRenamed("n", "Lang")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in D.divergence(df, least=least).collect())
    assert got == plain_divergence(rows, least)


def test_counts_and_histograms_in_many_parts(monkeypatch):
    """What a task hands on early adds up to the same."""
    texts = [("en", f"s{i % 3}", f"a b c{i % 7} Ü") for i in range(50)] + [("fr", "t", "z")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], ["lang", "source", "text"])

    def sums():
        counts, cells = Counter(), Counter()
        for out in D._counted(iter([batch.slice(k, 3) for k in range(0, 51, 3)])):
            for r in out.to_pylist():
                counts[r["lang"], r["source"], r["term"]] += r["n"]
                assert r["docs"] == r["n"]
        by_term = {}
        for (lang, s, term), n in counts.items():
            by_term.setdefault((lang, term), []).append({"source": s, "n": n})
        rows = pa.RecordBatch.from_arrays([pa.array([g for g, _ in by_term]), pa.array(list(by_term.values()))], ["lang", "at"])
        for out in D._tallied(iter([rows.slice(k, 2) for k in range(0, len(by_term), 2)])):
            for r in out.to_pylist():
                cells[r["lang"], r["a"], r["b"], r["x"], r["y"]] += r["terms"]
        return counts, cells

    whole = sums()
    monkeypatch.setattr(D, "ENTRIES", 5)
    monkeypatch.setattr(D, "CELLS", 6)
    assert sums() == whole and whole[0]["en", "s0", "ü".upper()] == 17 and whole[1]["en", "s0", "s1", 17, 17] == 4
