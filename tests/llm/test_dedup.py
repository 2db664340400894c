import hashlib
import random

import pytest

import corpus_pipeline
from tallyforge.llm import components, line_dedup, near_dedup
from tallyforge.llm.queries_line_dedup import op4_line_dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde  ") for _ in range(rng.randint(18, 60))).strip() for _ in range(40)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(4):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                p, o = rng.randrange(len(x)), rng.randrange(3)
                x = x[:p] + ("zé"[o % 2] + x[p + 1 :] if o == 0 else x[p + 1 :] if o == 1 else "a" + x[p:])
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = []
    for d, text in rows:
        kept = []
        for raw in text.split("\n"):
            x = raw.strip(" ")
            if len(x) < line_dedup.MIN_CHARS or not any(within_one(x, y) for y in seen):
                kept.append(raw)
            if len(x) >= line_dedup.MIN_CHARS:
                seen.append(x)
        assert got[d].text == "\n".join(kept)
        assert got[d].n_dropped == len(text.split("\n")) - len(kept)


def test_line_dedup_of_odd_rows(spark, odd):
    out = line_dedup.deduplicated(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert out.count() == odd.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].text is None and by[3].n_lines == 0
    assert by[2].text == "" and by[2].n_lines == 1
    assert line_dedup.deduplicated(odd.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The query and the pipeline's stage drop equal lines of any length, and near ones from ``MIN_CHARS`` on alone."""
    long = "A line that has a neighbour."
    rows = [(0, f"Les.\n\n{long}\n \t\nLea.\n7"), (1, f"Les.\n\nkept\n{long[:-1]}\n \t\n7 "), (2, " Les. \nLea."), (3, "\n")]
    want = {0: (rows[0][1], 0), 1: ("\nkept\n \t", 3), 2: ("", 2), 3: ("\n", 0)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text_sha256, r.n_dropped) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {i: t for i, (t, _) in want.items() if i != 2}


def groups(rows, n, percent):
    sets, find = {}, {}
    for k, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        find[k] = k
    keys = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i in keys:
            for j in keys:
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b) and find[j] > find[i]:
                    find[j], changed = find[i], True
    return {k: (len(sets[k]), find[k], find[k] == k) for k in keys}


@pytest.mark.parametrize(("small", "crowded"), [(64, 0.3), (2, 0.3), (2, 2.0)])
def test_near_groups_equal_brute_force(spark, monkeypatch, small, crowded):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    monkeypatch.setattr(near_dedup, "LEVELS", 3)
    rng = random.Random(8)
    rows = []
    for _ in range(6):
        base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30)) for _ in range(60)]
        for _ in range(15):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                words[rng.randrange(60)] = f"new{rng.randrange(999)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, "One"), (901, "one"), (902, None), (903, ""), (904, " \t\n"), (905, "one two"), (906, "ONE\ttwo")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == groups(rows, 2, 80)


def test_near_groups_of_odd_rows(spark, odd):
    got = near_dedup.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert [r.kept for r in got if r.doc_id == 1] == [True, True]
    assert not any(r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_groups(odd.limit(0)).count() == 0


def test_near_dedup_stage_keeps_one_row_a_group(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("a")), (2, words("a") + " end"), (3, words("b")), (3, words("a")), (None, words("c")), (None, words("c")), (None, words("b")), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == [(1, words("a")), (3, words("b")), (4, None), (5, ""), (None, words("c"))]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (501, 501)], "a long, b long")
    roots = {r.id: r.root for r in components.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(101)) and roots[501] == 500
