"""Cases of the third round's findings: each failed before."""

import glob
import math
import os
import re

import duckdb
from pyspark.sql import functions as F

from tallyforge import catalogue
from tallyforge.functions import costs, python
from tallyforge.sinks.derived import Derived

SMALL = "/root/testdata/sf0.001"


def folder(tmp_path, **tables):
    """The smallest tables as links, but for those given as SQL over them."""
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)
        if name[: -len(".parquet")] in tables:
            duckdb.execute(f"COPY ({tables[name[: -len('.parquet')]].format(old=path)}) TO '{tmp_path}/{name}' (FORMAT parquet)")
        else:
            os.symlink(path, tmp_path / name)
    return str(tmp_path)


def same_as_sql(spark, name, path):
    got = catalogue.QUERIES[name](spark, path)
    db = duckdb.connect()
    for file in glob.glob(f"{path}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[: -len('.parquet')]} AS SELECT * FROM '{file}'")
    found = db.execute(catalogue.ORACLE_SQL[name])
    order = [c[0] for c in found.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, found.fetchall()))


def test_document_entries_of_more_than_two_thousand_companies(spark, tmp_path):
    same_as_sql(spark, "document_entries", folder(tmp_path, supplier="SELECT * REPLACE (s_suppkey + 2500 + 10 * i AS s_suppkey) FROM '{old}', range(6) t(i)"))


def test_affordable_output_where_the_last_bits_decide(spark):
    price = F.struct(F.lit(5.0).alias("input"), F.lit(25.0).alias("output"), F.lit(None).cast("double").alias("cached_input"))
    many = spark.range(0, 10_000, 5)  # what is left is a whole number of tokens
    got = many.select("id", costs.affordable_output(price, F.col("id"), F.lit(0.05)).alias("n"))
    wrong = [r.id for r in got.collect() if r.n != max(0, math.floor((0.05 - 1e-6 * r.id * 5.0) / (25.0 * 1e-6)) - 1)]
    assert not wrong


def test_questions_are_verified_with_marks_as_they_are(spark, tmp_path):
    """A document that holds an item but for a curly mark, a space before a comma or one that isn't ASCII holds it not."""
    item = "SELECT item_id + 3 - item_id % 5 AS item_id, 'one two, three \"four\" five six seven eight' AS text FROM '{old}' LIMIT 1"
    texts = ["x one two, three “four” five six seven eight y", "x one two , three \"four\" five six seven eight y", "x one two, three \"four\" five six seven eight y", "x One  two,\nthree \"four\" five six seven eight y"]
    rows = " UNION ALL ".join(f"SELECT {2 * i} AS doc_id, '{t}' AS text, 'en' AS lang, 's' AS source, 1 AS n_chars" for i, t in enumerate(texts, 1))
    same_as_sql(spark, "questions_verified", folder(tmp_path, benchmark=item, documents=rows))


def test_equal_calls_of_graders_run_once(spark):
    """A grader names its fields several times; each is read once a row, and the rows are dealt over the cores."""
    plan = catalogue.QUERIES["graders"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    calls = [len(set(re.findall(r"pythonUDF\d+#\d+", line))) for line in re.findall(r"ArrowEvalPython (.*)", plan)]
    assert 0 < sum(calls) <= 20 and "REPARTITION_BY_NUM" in plan


def test_expressions_are_worked_out_once():
    assert python.valued("(3 * 4 + 2) / 2") == 7.0 and python.valued("3 * 10 ** 3", True) == 3000.0
    assert python.valued("3 + 1", True) is None and python.valued("x") is None and python.valued("1" + " + 1" * 99) == 100.0
    before = python._valued.cache_info().hits
    assert python.valued("(3 * 4 + 2) / 2") == 7.0 and python._valued.cache_info().hits == before + 1


def test_lines_are_dealt_where_work_is_long(spark):
    for name in ("usage_read", "arithmetic_texts"):
        assert "REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_batches_read_the_table_once(spark, tmp_path):
    """However many batches there are, the rows are read to find what is new and to lay it out, and not once a batch."""
    rows = spark.range(40).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    asked = rows.mapInPandas(counted, rows.schema)
    store = Derived(spark, f"file://{tmp_path}/store", lambda own: own.select("content_key", F.length("content").alias("n")), "content_key string, n int", code="1")
    assert store.update(asked, "content", batch_bytes=40) == 40 and store.tables.manifest().version > 5
    assert reads.value <= 2 * 40
    assert store.read(rows, "content").count() == 40 and store.update(rows, "content", batch_bytes=40) == 0
    assert not list(tmp_path.glob("store/new-*"))


def test_batches_of_nothing_but_one_text_are_audited(spark):
    from tallyforge.llm.filter_audit import masks

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 999, F.concat(F.lit("own "), F.col("id").cast("string"))).otherwise("the same").alias("text"), F.lit("en").alias("lang"))
    got = {r["mask"]: r["count"] for r in masks(docs).groupBy("mask").count().collect()}
    assert got == {1: 1 + 20, 1 + 16: 20_000 - 21}


def test_queries_that_share_common_words_meet_documents_by_profile(spark):
    from tallyforge.operators import retrieval as R

    n = F.col("id").cast("string")
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("results of supplier "), n, F.when(F.col("id") % 3 == 0, " of sales").otherwise("")).alias("text"))
    asked = spark.range(700).select(F.col("id").alias("query_id"), F.concat(F.lit("results of "), n, F.when(F.col("id") % 2 == 0, " sales").when(F.col("id") % 5 == 0, " sales sales").otherwise("")).alias("text"))
    terms = R.Terms(docs, asked)
    got, whole = terms.best(7, 1.5, 0.75), R.top(terms.scored(1.5, 0.75), "query_id", "doc_id", 7)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())
    assert rows(got) == rows(whole) and len(rows(got)) == 4900
    # what passes on between the documents and the queries isn't a row a pair
    written = [p.inputFiles() for p in [got]][0]
    assert 0 < spark.read.parquet(*written).count() < 30_000


def test_rankings_of_many_queries_go_in_blocks(spark, monkeypatch):
    from tallyforge.operators import retrieval as R

    docs, asked = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    terms = R.Terms(docs, asked)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", F.round("score", 6)).collect())
    whole = rows(R.top(terms.scored(1.5, 0.75), "query_id", "doc_id", 5))
    monkeypatch.setattr(R, "ENTRIES", 300)
    monkeypatch.setattr(R, "PROFILES", 16)
    assert rows(terms.best(5, 1.5, 0.75)) == whole


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_counted_where_rows_are_read(spark, tmp_path):
    from tallyforge.operators import crossval

    same_as_sql(spark, "fold_terms", folder(tmp_path, documents="SELECT * REPLACE (CASE WHEN doc_id % 90 = 1 THEN 1 ELSE doc_id END AS doc_id) FROM '{old}'"))
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "key long, text string")
    counts = crossval.term_counts(rows)
    assert {(r["key"], r["term"]): r["n"] for r in counts.collect()} == {(1, "a"): 2, (1, "b"): 1, (1, "a b"): 1, (1, "b a"): 1}
    assert not shuffles(counts)


def test_figures_are_matched_within_their_case(spark):
    from tallyforge.operators import figures

    f = "array<struct<metric:string,value:double,unit:string,year:int,description:string>>"
    one, other, none = ("profit", 1.5, "INR", None, None), ("profit", 1.5, "Rs. crore", None, None), (None, None, None, None, None)
    rows = spark.createDataFrame([(1, [one, one, other, none], [other, one, none, none], "p"), (2, None, [one], "p"), (3, [one], None, "p"), (4, [], [], "p")], f"id long, expected {f}, got {f}, passage string")
    found = figures.matched(rows)
    assert {r["id"]: (r["found"], r["missed"], r["extra"]) for r in found.collect()} == {1: (3, 1, 1), 2: (0, 0, 1), 3: (0, 1, 0), 4: (0, 0, 0)}
    assert not shuffles(found)


def test_questions_are_dealt_by_the_pairs_that_they_make(spark, monkeypatch):
    from tallyforge.operators import lookup

    metrics = spark.createDataFrame([("NetProfit", "the net profit"), ("NetSales", "net sales"), ("Margin", None)], "name string, label string")
    asked = spark.createDataFrame([(i, "NetProfit" if i % 2 else "what was net sales") for i in range(200)] + [(900, "Margin"), (901, None)], "query_id long, what string")
    monkeypatch.setattr(lookup, "PAIRS", 20)
    ranked = lookup.metrics_ranked(asked, metrics)
    assert shuffles(ranked) == 1 and ranked.rdd.getNumPartitions() == 41
    rows = {(r["query_id"], r["rank"]): (r["name"], r["shared"], r["holds"]) for r in ranked.collect()}
    assert len(rows) == 401 and rows[1, 1] == ("NetProfit", 3, True) and rows[1, 2] == ("NetSales", 1, False) and rows[0, 1] == ("NetSales", 2, True) and rows[900, 1] == ("Margin", 0, True)


def test_rankings_without_a_common_word(spark):
    from tallyforge.operators import retrieval as R

    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, ""), (4, "four")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "two"), ("b", "four nine"), ("c", "nine"), ("d", "")], "query_id string, text string")
    assert [tuple(r) for r in R.bm25(docs, asked, k=3).select("query_id", "rank", "doc_id").orderBy("query_id", "rank").collect()] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 4)]
    assert R.bm25(docs, asked.filter("query_id = 'c'"), k=3).isEmpty()
    assert R.bm25(docs.filter("doc_id > 9"), asked, k=3).isEmpty()


def test_words_are_damped_in_columns_and_weighed_once_a_fold(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from tallyforge.operators import classifier as C

    rows = spark.createDataFrame([(i, ("up up rises " if i % 3 else "down falls ") + f"word{i % 7} up", float(i % 3 > 0 or i % 11 == 0)) for i in range(60)], "key long, text string, label double")
    vectors = C.features(C.folded(rows, 2))
    assert "Python" not in vectors._jdf.queryExecution().executedPlan().toString()
    row = vectors.filter("key = 1").first()  # up three times, once as a pair with itself
    assert row["tf"].size == C.BUCKETS and sorted(round(x, 12) for x in row["tf"].values) == [1.0] * 6 + [round(1 + math.log(3), 12)]
    fits = []

    class Counted(C.IDF):
        def fit(self, *args):
            fits.append(1)
            return super().fit(*args)

    monkeypatch.setattr(C, "IDF", Counted)
    monkeypatch.setattr(C, "ROUNDS", 4)
    got, accuracy = C.out_of_fold(rows, (0.5, 0.01), 2)
    assert len(fits) == 2
    plain = {}
    for c in accuracy:
        for fold in range(2):
            model = Pipeline(stages=[C.IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=C.ROUNDS, regParam=c)]).fit(vectors.filter(F.col("fold") != fold))
            plain |= {(c, r["key"]): (int(r["label"]), int(r["prediction"])) for r in model.transform(vectors.filter(F.col("fold") == fold)).collect()}
    right = {c: sum(a == b for (d, _), (a, b) in plain.items() if d == c) / 60 for c in accuracy}
    best = max(accuracy, key=lambda c: (right[c], -list(accuracy).index(c)))
    assert accuracy == right and {(best, r["key"]): (r["label"], r["prediction"]) for r in got.collect()} == {k: v for k, v in plain.items() if k[0] == best}


def test_facts_of_a_round_are_dealt_once(spark, tmp_path, monkeypatch):
    from tallyforge.operators import facts
    from tallyforge.plans import build

    kinds = "filing_id string, concept string, period_start date, period_end date, segment string, unit string, value double, decimals int"
    parsed = lambda names, add: spark.createDataFrame([(n, c, None, None, None, "INR", i + add, 0) for n in names for i, c in enumerate("abc")], kinds)
    listed = lambda names: spark.createDataFrame([(n, n, None, None) for n in names], build.FILINGS)
    plans, stage = {}, build.Tables.stage

    def staged(self, name, rows, by=None):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString().count("Exchange")
        return stage(self, name, rows, by)

    monkeypatch.setattr(build.Tables, "stage", staged)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store, names = build.Store(spark, f"file://{tmp_path}/store", buckets=2), [f"f{i}" for i in range(20)]
        assert store.apply(listed(names), parsed(names, 0.0)) == {"commits": 1, "added": 60}
        # of the facts, of the parse, and of the filings that were parsed; nothing again for the buckets
        assert store.apply(listed(names[:5]), parsed(names[:5], 1.0)) == {"commits": 1, "changed": 15} and plans["changes"] == 3 and plans["facts"] == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert {(r["filing_id"], r["concept"]): r["value"] for r in store.facts().collect()} == {(n, c): i + (n in names[:5]) for n in names for i, c in enumerate("abc")}
    held = parsed(["x", "y"], 0.0).selectExpr("*", "'xbrl' AS tier", "'p' AS verified_by")
    got = {rest: sorted((r["filing_id"], r["change"], r["tier"]) for r in facts.sync(held, parsed(["x"], 0.0), rest=rest).collect()) for rest in (False, True)}
    assert got[False] == [("x", "kept", "xbrl")] * 3 and got[True] == got[False] + [("y", "other", "xbrl")] * 3
    double = held.unionByName(held.limit(1))  # as a join, and not as a set
    assert facts.sync(double, parsed(["x"], 0.0)).count() == 4


def test_shares_of_labels_are_looked_up(spark, monkeypatch):
    import datetime as dt

    from tallyforge.operators import crosscheck as C

    day, names = dt.date(2024, 3, 31), [["Net profit"], ["Basic EPS"], None, ["Tax", "Income tax"]]
    facts = spark.createDataFrame([(f"f{i}", "d", "standalone", None, day, 5.0, "INRPerShare" if i % 4 == 1 else "INR", names[i % 4], None if i % 2 else "Retail") for i in range(8)], "fact_id string, document string, basis string, period_start date, period_end date, value double, unit string, labels array<string>, segment string")
    rows = [(i, label, heading) for i, (label, heading) in enumerate([("Net profit retail", None), (None, "EPS"), ("Basic", "Earnings per share"), ("Income tax", ""), ("Net profit retail", "EPS")])]
    cells = spark.createDataFrame([("d", 0, i, 1, 1, heading, label, day, 12, True, None, 1.0, "5", 5.0 if i % 2 == 0 else 4.0, 0, False) for i, label, heading in rows], "document string, sheet int, row int, column int, page int, heading string, label string, period_end date, months int, alone boolean, basis string, scale double, printed string, value double, places int, percent boolean")
    seen, broadcast = [], C.F.broadcast
    monkeypatch.setattr(C.F, "broadcast", lambda df: seen.append(df.count()) or broadcast(df))
    got = [sorted(map(repr, C.checked(facts, cells).collect()))]
    assert seen == [4 * 5]  # kinds of facts and rows
    monkeypatch.setattr(C, "LABEL_PAIRS", 3)
    got.append(sorted(map(repr, C.checked(facts, cells).collect())))
    assert len(seen) == 1 and got[0] == got[1] and len(got[0]) == 8 and "per-share" in str(got[0]) and "rule='label'" in str(got[0])
