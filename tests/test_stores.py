"""What is kept between runs: snapshots, indexes, derived rows, the build, journals; and joins by order, sessions as state."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import identity, lineage, lookup, ranges, retrieval
from tallyforge.operators import postings as P
from tallyforge.operators.journal import Journal
from tallyforge.plans import build
from tallyforge.sinks import derived, snapshots
from tallyforge.streaming import events

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def test_commits_are_whole(spark, folder):
    tables = snapshots.Tables(spark, folder)
    assert tables.manifest().version == 0 and tables.read("a", "x long").count() == 0
    first = tables.commit({"a": [tables.stage("a", spark.range(3).toDF("x"))], "b": []}, {"n": 3}, over=tables.manifest())
    lost = tables.stage("a", spark.range(100).toDF("x"))  # never named
    second = tables.commit({"b": [tables.stage("b", spark.range(2).toDF("y"))]}, over=first)
    assert (second.version, second.info, tables.read("a", "x long").count(), tables.read("b", "y long").count()) == (2, {"n": 3}, 3, 2)
    with pytest.raises(snapshots.Conflict):
        tables.commit({"a": []}, over=first)
    assert tables.read("b", "y long", tables.manifest(1)).count() == 0
    assert tables.swept() == [f"a/part={lost}"] and tables.read("a", "x long").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.manifest(1)


TEXTS = ["red green blue", "red red red", "green, Green 1,234.5", "", None, "blue " * 700 + "end", "red green blue", "an odd wörd ß", "red"]
ASKED = [(1, "red green"), (2, "blue end"), (3, "nothing here is known"), (4, ""), (5, "1,234.5 SS red red"), (6, None)]


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def test_index_equals_direct_search(spark, folder, monkeypatch):
    """Several segments, more ranges than a threshold is taken from, ties over segments, merging, and other parameters."""
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(3000)], "doc_id long, text string").filter("text IS NOT NULL")
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    index = P.Postings(spark, folder, buckets=3)
    assert index.bm25(queries).count() == 0
    monkeypatch.setattr(P, "FIRST", 2)
    for part in range(3):
        index.add(docs.filter(F.col("doc_id") % 3 == part))
    for k, more in ((1, {}), (4, {}), (5000, {"k1": 0.9, "b": 0.2})):
        assert ranked(index.bm25(queries, k=k, **more)) == ranked(retrieval.bm25(docs, queries, k=k, **more))
    with pytest.raises(ValueError):
        index.add(docs.limit(1))
    index.merged(docs.filter("doc_id % 5 = 0").select("doc_id"))
    rest = docs.filter("doc_id % 5 <> 0")
    again = P.Postings(spark, folder)  # parameters are those that it was built with
    assert len(again.tables.manifest().tables["postings"]) == 1 and again.info["n"] == rest.count()
    monkeypatch.setattr(P, "QUERY_WORDS", 3)  # queries in turns
    assert ranked(again.bm25(queries, k=4)) == ranked(retrieval.bm25(rest, queries, k=4))
    with pytest.raises(ValueError):
        again.bm25(queries, k=0)


def test_a_search_reads_no_text(spark, folder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    index = P.Postings(spark, folder)
    index.add(docs)
    asked = spark.createDataFrame([(1, "the first words"), (2, "und die")], "query_id long, text string")
    found = index.bm25(asked)
    files = {f.split("/store/")[1].split("/")[0] for f in found.inputFiles() if "/store/" in f}
    assert not any("documents" in f for f in found.inputFiles()) and files <= {"postings"}
    assert "documents.parquet" not in found._jdf.queryExecution().toString()


def test_concepts_are_matched_by_the_index(spark, folder):
    texts = spark.createDataFrame([("Sales", "Sales; Revenue from operations"), ("Tax", "Tax expense"), ("Profit", "Profit before tax")], "concept string, text string")
    asked = spark.createDataFrame([("a", "tax"), ("b", "Sales"), ("c", "revenue")], "query_id string, what string")
    index = lookup.concept_index(texts, folder)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lookup.matched(asked, texts, index=index)) == rows(lookup.matched(asked, texts))
    assert lookup.concept_index(texts, folder).tables.manifest().version == 1  # built once


def halves(rows):
    return rows.select("content_key", F.explode(F.split("content", ",")).alias("piece"))


def test_contents_are_derived_once(spark, folder):
    made = []

    def counting(rows):
        made.append(rows.count())
        if len(made) == 3:
            raise RuntimeError("killed")
        return halves(rows).filter("piece <> ''")

    store = derived.Derived(spark, folder, counting, "content_key string, piece string", code="v1")
    rows = spark.createDataFrame([(1, "a,b"), (2, "a,b"), (3, None), (4, ""), (5, "c")], "id long, content string")
    assert store.update(rows, "content") == 3 and made == [3]  # one content of two rows, none of a null
    assert sorted((r.id, r.piece) for r in store.read(rows, "content").collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (5, "c")]
    more = rows.unionByName(spark.createDataFrame([(i, f"new {i}") for i in range(10, 40)], rows.schema))
    with pytest.raises(RuntimeError):
        store.update(more, "content", batch_bytes=60)  # the second batch of several is killed
    held = store.seen().count()
    assert held == 3 + made[1] and store.tables.manifest().version == 2
    assert store.update(more, "content", batch_bytes=60) == 30 - made[1] and store.seen().count() == 33
    assert sum(made[:2]) + sum(made[3:]) == 33  # nothing derived twice but for the batch that was killed
    assert store.update(more, "content") == 0
    other = derived.Derived(spark, folder, halves, store.schema)
    assert other.code == derived.code_of(halves) and other.update(rows, "content") == 3
    assert other.forget_other_code() and store.seen().count() == 0 and other.read(rows, "content").count() == 6


def fact(filing, concept, value, end="2024-03-31"):
    return (filing, concept, None, dt.date.fromisoformat(end), None, "INR", value, 0)


PARSED = "filing_id string, concept string, period_start date, period_end date, segment string, unit string, value double, decimals int"


def test_build_is_one_commit(spark, folder):
    store = build.Store(spark, folder, buckets=4)
    listed = lambda *names: spark.createDataFrame([(n, f"sha-{n}", dt.datetime(2026, 1, 1), None) for n in names], build.FILINGS)
    parsed = lambda rows: spark.createDataFrame(rows, PARSED)
    first = [fact(f"f{i}", c, float(i)) for i in range(8) for c in ("Sales", "Tax")]
    key = lambda f, c: f"{f}|{c}||2024-03-31||INR"
    links = spark.createDataFrame([("d1", key("f1", "Sales")), ("d2", "d1"), ("d3", key("f2", "Tax"))], build.LINKS)
    assert store.apply(listed(*[f"f{i}" for i in range(8)]), parsed(first), links) == {"commits": 1, "added": 16}
    parts = store.tables.manifest().tables["facts"]
    state = lambda: sorted((r.filing_id, r.concept, r.value) for r in store.facts().collect())
    assert state() == sorted((r[0], r[1], r[6]) for r in first) and store.links().count() == 3
    assert store.apply(listed("f1"), parsed(first[2:4])) == {"commits": 0, "kept": 2}  # the same again
    second = [fact("f1", "Sales", 9.0), fact("f1", "Profit", 5.0)]
    for step in ("facts", "filings", "commit"):
        with pytest.raises(RuntimeError):
            store.apply(listed("f1"), parsed(second), fail=step)
        assert store.tables.manifest().version == 1 and len(state()) == 16
    assert store.apply(listed("f1"), parsed(second)) == {"commits": 1, "added": 1, "changed": 1, "removed": 1}
    assert ("f1", "Sales", 9.0) in state() and ("f1", "Tax", 1.0) not in state() and len(state()) == 16
    assert len(set(parts) & set(store.tables.manifest().tables["facts"])) == len(parts) - 1  # one bucket is written anew
    assert [r.fact_id for r in store.links().collect()] == ["d3"]  # what rests on a changed fact is gone, at any depth
    assert {(r.filing_id, r.change, r.n, r.round) for r in store.log().collect() if r.round == 2} == {("f1", c, 1, 2) for c in ("added", "changed", "removed")}
    assert store.apply(listed("f1"), parsed(second))["commits"] == 0 and store.apply(listed("f9"), parsed([]))["commits"] == 1
    assert store.filings().count() == 9


def test_nothing_is_called_past_the_limit(spark, folder, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def task(given):
        (calls / given).touch()
        if given == "b":
            raise ValueError("no")
        return given.upper(), 1.0  # half of the worst

    cases = spark.createDataFrame([(c, c) for c in "abcdefgh"], "case_id string, input string")
    journal = Journal(spark, folder, "run-1")
    rows = {r.case_id: r for r in journal.run(cases, {"t": task}, worst=2.0, limit=7.0, wave=3).collect()}
    # waves: abc (worst 6 of 7) spends 4; d (2 of 3) spends 1; e (2 of 2) spends 1; f would need 2 of 1
    assert sorted(os.listdir(calls)) == list("abcde") and journal.spent() == 6.0
    assert {c for c, r in rows.items() if r.error == "budget"} == set("fgh") and rows["b"].error == "ValueError: no" and rows["e"].wave == 3
    shutil.rmtree(calls)
    calls.mkdir()
    more = journal.run(cases, {"t": task}, worst=2.0, limit=9.5, wave=3).collect()  # goes on where the journal ends
    assert sorted(os.listdir(calls)) == ["f", "g"] and sum(r.error == "budget" for r in more) == 1
    graded = journal.graded(cases.withColumn("expected", F.when(F.col("case_id") == "a", "A").otherwise("x")), {"equal": lambda e, o: e == o})
    assert sorted((r.case_id, r.passed) for r in graded.collect()) == [(c, c == "a") for c in "acdefg"]
    assert sorted(os.listdir(calls)) == ["f", "g"] and journal.spent() == 8.0
    with pytest.raises(ValueError):
        Journal(spark, folder, "run-2")


def test_staleness_reaches_any_depth(spark):
    links = spark.createDataFrame([(f"f{i + 1}", f"f{i}") for i in range(6)] + [("x", "y"), ("f2", "f5"), ("f1", "f1")], "fact_id string, input_id string")
    got = {r.fact_id: r.depth for r in lineage.dependants(links, spark.createDataFrame([("f1",)], "input_id string")).collect()}
    assert got == {"f1": 1, "f2": 1, "f3": 2, "f4": 3, "f5": 4, "f6": 5}  # also in a circle
    facts = spark.createDataFrame([("f6",), ("x",)], "fact_id string")
    assert [r.fact_id for r in lineage.fresh(facts, links, spark.createDataFrame([("f0",)], "input_id string")).collect()] == ["x"]


@pytest.mark.parametrize("partitions", [1, 13])
def test_asof_with_one_key_of_most_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = [(i, "hot" if i % 10 else f"k{i % 7}", (i * 37) % 500) for i in range(900)] + [(1000, None, 3), (1001, "hot", None), (1002, "hot", -5)]
        right = [("hot", 5, "a"), ("hot", 5, "b"), ("hot", 250, None), ("k0", 0, "c"), (None, 1, "d"), ("k3", None, "e"), ("k4", 499, "f")]
        got = ranges.asof(spark.createDataFrame(left, "id long, key string, at long"), spark.createDataFrame(right, "key string, at long, v string"), ["key"], "at", ["v"], within=F.col("at") - F.col("found_at") <= 200)

        def want(key, at):
            found = [(a, v or "", v) for k, a, v in right if k is not None and k == key and a is not None and at is not None and a <= at]
            a, _, v = max(found, default=(None, None, None))
            return (None, None) if a is None or at - a > 200 else (a, v)

        assert sorted((r.id, r.found_at, r.v) for r in got.collect()) == [(i, *want(k, a)) for i, k, a in left]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_points_within_windows(spark):
    points = [(i, "a" if i % 9 else "b", (i * 53) % 1000 - 300) for i in range(300)] + [(900, None, 5), (901, "a", None)]
    windows = [(i, "a" if i % 4 else "b", (i * 71) % 900 - 300, (i * 71) % 900 - 300 + (0, 1, 7, 300, 5000, -2)[i % 6]) for i in range(60)] + [(99, "a", -(10**12), 10**12), (98, None, 0, 9), (97, "a", None, 9)]
    got = ranges.within(spark.createDataFrame(points, "id long, key string, at long"), spark.createDataFrame(windows, "w long, key string, low long, high long"), ["key"], "at", "low", "high")
    want = sorted((i, w) for i, k, a in points for w, q, lo, hi in windows if k is not None and k == q and a is not None and lo is not None and lo <= a <= hi)
    assert sorted((r.id, r.w) for r in got.collect()) == want
    assert ranges.within(got.select("id", "key", "at").limit(0), got.select("w", "key", "low", "high").limit(0), ["key"], "at", "low", "high").count() == 0


def test_sessions_as_state(spark, tmp_path):
    """Rows late and out of order over several batches: every session that the watermark has passed comes once, as in a batch, and
    the state holds the others alone."""
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    shuffled = e.withColumn("o", F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86_400_000_000))).orderBy("o").drop("o").collect()
    (tmp_path / "in").mkdir()
    for i in range(4):
        spark.createDataFrame(shuffled[i * 250 : (i + 1) * 250], e.schema).coalesce(1).write.parquet(f"{tmp_path}/t{i}")
        shutil.move(glob.glob(f"{tmp_path}/t{i}/*.parquet")[0], f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1e9 + i * 1000, 1e9 + i * 1000))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = events.session_state(events.event_stream(spark, str(tmp_path / "in"), e.schema, files_per_trigger=1), late="2 days")
        run = stream.writeStream.outputMode("append").format("memory").queryName("session_state").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(key)
    key = lambda r: (r.user_id, r.start, r.n, round(r.total, 6))
    got = [key(r) for r in spark.table("session_state").collect()]
    whole = {key(r) for r in events.sessions(e.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    newest = max(r.ts for r in shuffled)
    over = {s for s in whole if s[1] < newest - dt.timedelta(days=3)}
    assert len(got) == len(set(got)) and set(got) <= whole and over <= set(got)
    assert sum(p.numInputRows for p in run.recentProgress) == 1000


def test_digests_of_rows(spark):
    """Order doesn't count; numbers of equal rows, nulls and the borders of columns do."""
    rows = [(i, f"text {i}", None) for i in range(300)] + [(1, "a", "b")] * 50
    df = spark.createDataFrame(rows, "id long, a string, b string")
    d = lambda x: identity.digest(spark.createDataFrame(x, df.schema), ["id", "a", "b"])
    whole = d(rows)
    assert d(rows[::-1]) == whole and len(whole) == 64
    others = [rows[:-1], [*rows, rows[0]], [(1, "ab", "")], [(1, "a", "b")], [(1, "", "ab")], [(1, None, "b")], [(1, "n", "b")], []]
    assert len({whole, *map(d, others)}) == len(others) + 1
    by = {r.a: (r.rows, r.digest) for r in identity.digests(df.filter("id < 5"), ["id", "b"], ["a"]).collect()}
    assert by["a"][0] == 50 and len(by) == 6 and len({x for _, x in by.values()}) == 6
    assert identity.joined([("x", "1")]) == ("x", "1") and identity.joined([("x", "1"), ("y", "2")])[0] == "x+y"
    assert identity.joined([("x", "1"), ("y", "2")])[1] != identity.joined([("y", "2"), ("x", "1")])[1]


def test_runs_are_united_if_they_are_of_the_same(spark):
    rows = lambda v: spark.createDataFrame([(v, 1, True), (v, 2, False)], "variant string, case_id int, passed boolean")
    run = lambda v, cases="d1", began="2026-01-01", **graders: identity.Run(rows(v), cases, {"exact": "1"} | graders, began)
    assert identity.united([run("a"), run("b"), run("c")]).count() == 6
    for other, why in ((run("b", "d2"), "cases"), (run("b", exact="2"), "exact"), (run("b", more="1"), "more"), (run("a"), "several runs: a")):
        with pytest.raises(ValueError, match=why):
            identity.united([run("a"), other])
    assert identity.newest([run("a"), run("b", began="2026-02-01"), run("c", began="2026-02-01")]).rows.first().variant == "c"
    log = spark.createDataFrame([("r1", 1, "x", 1), ("r2", 2, "x", 2), ("r2", 2, "x", 3), ("r1", 1, None, 4)], "run string, at int, g string, n int")
    assert sorted(r.n for r in identity.newest_rows(log, "run", "at").collect()) == [2, 3]
    assert sorted(r.n for r in identity.newest_rows(log, "run", "at", ["g"]).collect()) == [2, 3, 4]


def test_merged_ranges_keep_their_order(spark, folder):
    """Merging moves blocks, not single postings: an old range's documents stay together, whatever their ids."""
    docs = spark.createDataFrame([(i, f"all w{i % 7}") for i in range(1400)], "doc_id long, text string")
    index = P.Postings(spark, folder)
    for part in (0, 1):
        index.add(docs.filter(F.col("doc_id") % 2 == part).coalesce(1))
    index.merged(docs.filter("doc_id % 10 = 3").select("doc_id"))
    rows = index._rows(index.tables.manifest())
    ranges = [r.ids for r in rows.filter("bucket = -1").orderBy("range").collect()]
    assert [len(x) for x in ranges] == [512, 512, 236] and sum(len({i % 2 for i in x}) == 1 for x in ranges) == 2
    assert rows.filter("term = 'all'").agg(F.sum("n"), F.max(F.size("gaps"))).first()[:] == (1260, 512)
    asked = spark.createDataFrame([(1, "w3 all")], "query_id long, text string")
    assert ranked(index.bm25(asked, k=300)) == ranked(retrieval.bm25(docs.filter("doc_id % 10 <> 3"), asked, k=300))
