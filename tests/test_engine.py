import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyforge import catalogue
from tallyforge.functions import periods, text
from tallyforge.functions import printed as N
from tallyforge.operators import documents, evaluation, facts, retrieval
from tallyforge.plans.metrics import Metric, Metrics
from tallyforge.sources import jsonl, xbrl
from tallyforge.streaming import events

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("printed", "want"), [("1,234.50", (1234.5, 2, False)), ("(12.3)", (-12.3, 1, False)), ("—", (0.0, 0, False)), ("4.5 %", (4.5, 1, True)), ("12/03/2024", None), ("n.a.", None), ("-7", (-7.0, 0, False))])
def test_printed_numbers(spark, printed, want):
    got = one(spark, N.number(F.lit(printed)))
    assert (got and tuple(got)) == want


def test_text_functions(spark):
    assert one(spark, text.squeeze(F.lit(" “A”  b ,\n c’s "))) == "\"a\" b, c's"
    assert one(spark, text.tokens(F.lit("FY24 up 1,234.5, x"))) == ["fy24", "up", "1,234.5", "x"]
    assert one(spark, text.name_words(F.lit("ProfitBeforeTax"))) == ["profit", "before", "tax", "profitbeforetax"]
    assert one(spark, text.indian_grouping(F.lit(12345678))) == "1,23,45,678"
    assert one(spark, text.guard_reason(F.lit(" "))) == "empty" and one(spark, text.guard_reason(F.lit("fine"))) is None
    assert one(spark, text.is_heading(F.lit("2.1 Revenue from operations"))) and not one(spark, text.is_heading(F.lit("revenue went up by a lot this year.")))


def test_periods(spark):
    assert one(spark, periods.fiscal_year(F.lit(dt.date(2024, 3, 31)))) == 2024 and one(spark, periods.fiscal_year(F.lit(dt.date(2024, 4, 1)))) == 2025
    assert one(spark, periods.fiscal_quarter(F.lit(dt.date(2024, 1, 5)))) == "Q4"
    start, end = periods.span(F.lit(2024), F.lit(10), F.lit(12))
    assert (one(spark, start), one(spark, end)) == (dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    assert one(spark, periods.months_of(F.lit(dt.date(2023, 4, 1)), F.lit(dt.date(2024, 3, 31)))) == 12


def test_fusion_ties_go_to_the_first_list(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2)], "query_id int, id string, rank int")
    assert [r.id for r in retrieval.fuse([a, b], k=3).orderBy("rank").collect()] == ["x", "z", "y"]


def test_sentences_tile_and_pack():
    t = "Dr. A. Smith came. He left at 5. " * 20 + "x" * 300
    spans = documents.sentences(t)
    assert "".join(t[a:b] for a, b in spans) == t and t[slice(*spans[0])] == "Dr. A. Smith came. " and len(spans) == 21
    assert all(len(p) <= 120 for _, p in documents.packed(t, 120))


def test_sync(spark):
    key = {"filing_id": 1, "period_start": None, "period_end": "2024-03-31", "segment": None, "unit": "INR", "decimals": 0}
    schema = "filing_id int, concept string, period_start date, period_end string, segment string, unit string, value double, decimals int, tier string, verified_by string"
    row = lambda c, v, tier=None, who=None, segment=None: (1, c, None, "2024-03-31", segment, "INR", v, 0, tier, who)
    held = spark.createDataFrame([row("a", 1.0, "xbrl", "p"), row("b", 2.0, "xbrl", "p"), row("c", 3.0, "xbrl-ai")], schema)
    new = spark.createDataFrame([row("a", 1.0, segment=""), row("b", 5.0), row("d", 4.0)], schema)
    got = {r.concept: (r.change, r.value, r.tier, r.verified_by) for r in facts.sync(held, new).collect()}
    assert got == {"a": ("kept", 1.0, "xbrl", "p"), "b": ("changed", 5.0, "xbrl-ai", None), "c": ("removed", 3.0, "xbrl-ai", None), "d": ("added", 4.0, "xbrl-ai", None)}
    assert key["filing_id"] == 1


def test_metrics_refuse_what_they_cant_plan():
    m = Metrics([Metric("g", "(a - b) / abs(b)", {"a": ("x", "current"), "b": ("x", "previous")}), Metric("h", "g + 1", {"g": ("g", "current")}), Metric("loop", "l", {"l": ("loop", "current")}), Metric("odd", "a ** 2", {"a": ("x", "current")})])
    assert [(f.path, f.at) for f in m.plan("g")] == [("a", "current"), ("b", "previous")]
    for name in ("h", "loop"):
        with pytest.raises(ValueError):
            m.plan(name)
    with pytest.raises(ValueError):
        m.column("odd")


def test_multiset_match(spark):
    want = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "case_id int, v string")
    got = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c")], "case_id int, v string")
    assert tuple(evaluation.multiset_match(want, got, ["v"]).first()) == (1, 1, 2, 2)


def test_strict_datasets(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('// note\n{"id": "a", "input": "x", "expected": "y", "tags": ["t"]}\n\n')
    assert [r.id for r in jsonl.cases(spark, [str(good)]).collect()] == ["a"]
    for broken in ("{", '{"id": ""}', '{"id": "a", "other": 1}', '{"id": "a"}\n{"id": "a"}', "// none"):
        (tmp_path / "bad.jsonl").write_text(broken)
        with pytest.raises(ValueError):
            jsonl.cases(spark, [str(tmp_path / "bad.jsonl")])
    assert len(jsonl.digest(spark, str(good))) == 12


def instance(body: str, stated: bool = True, dated: tuple[str, str] = ("2024-04-01", "2024-06-30")) -> str:
    context = lambda i, period, member="": f'<context id="{i}"><entity><segment>{member}</segment></entity><period>{period}</period></context>'
    span = lambda a, b: f"<startDate>{a}</startDate><endDate>{b}</endDate>"
    said = '<DateOfStartOfReportingPeriod contextRef="OneD">2024-04-01</DateOfStartOfReportingPeriod><DateOfEndOfReportingPeriod contextRef="OneD">2024-06-30</DateOfEndOfReportingPeriod>'
    member = '<explicitMember dimension="d">x:HotelsMember</explicitMember>'
    return f"""<xbrl>{context("OneD", span(*dated))}{context("OneI", "<instant>2024-06-30</instant>")}{context("OneSegD", span(*dated), member)}{context("Other", span("2023-04-01", "2024-03-31"))}{context("OneRelatedPartyTransactionD", span(*dated))}{said if stated else ""}{body}</xbrl>"""


def test_xbrl(spark, tmp_path):
    body = """<Revenue contextRef="OneD" unitRef="INR" decimals="-5">100</Revenue><Revenue contextRef="OneD" unitRef="INR">100</Revenue><Assets contextRef="OneI" unitRef="INR" decimals="INF">7</Assets><DescriptionOfSegment contextRef="OneSegD"> Hotels </DescriptionOfSegment>
      <Revenue contextRef="OneSegD" unitRef="INR">40</Revenue><Profit contextRef="OneD" unitRef="INR">many</Profit><CashAndCashEquivalentsCashFlowStatement contextRef="OneD" unitRef="INR">1</CashAndCashEquivalentsCashFlowStatement><CashAndCashEquivalentsCashFlowStatement contextRef="OneD" unitRef="INR">2</CashAndCashEquivalentsCashFlowStatement>
      <Tax contextRef="Nowhere" unitRef="INR">1</Tax><Loan contextRef="OneRelatedPartyTransactionD" unitRef="INR">9</Loan><Old contextRef="Other" unitRef="INR">5</Old><Revenue contextRef="OneD" unitRef="INR">101</Revenue>"""
    files = {"a": instance(body), "b": "<broken", "c": instance(body, dated=("2024-01-01", "2024-06-30")), "d": instance(body, stated=False)}
    for name, text in files.items():
        (tmp_path / f"{name}.xml").write_text(text)
    rows = xbrl.facts(spark.read.format("binaryFile").load(str(tmp_path / "*.xml"))).collect()
    fine = lambda f: {(r.concept, r.segment, str(r.period_start), str(r.period_end)): r.value for r in rows if r.issue is None and r.origin.endswith(f"{f}.xml")}
    issues = lambda f: sorted((r.issue or "").split(":")[0] for r in rows if r.issue and r.origin.endswith(f"{f}.xml"))
    q = ("2024-04-01", "2024-06-30")
    common = {("Revenue", None, *q): 100.0, ("Assets", None, "None", "2024-06-30"): 7.0, ("Revenue", "Hotels", *q): 40.0, ("CashAndCashEquivalentsCashFlowStatement", None, "None", "2024-03-31"): 1.0, ("CashAndCashEquivalentsCashFlowStatement", None, "None", "2024-06-30"): 2.0}
    assert fine("a") == common | {("Old", None, "2023-04-01", "2024-03-31"): 5.0}
    assert issues("a") == ["Profit in OneD", "Revenue 2024-04-01 to 2024-06-30", "Tax"]
    # dates that aren't the stated ones are believed nowhere; the stated period is used
    assert fine("c") == common and issues("c") == ["Old in Other", "Profit in OneD", "Revenue 2024-04-01 to 2024-06-30", "Tax"]
    assert fine("d") == {("Assets", None, "None", "2024-06-30"): 7.0} and any(i.startswith("the filing states no") for i in issues("d"))
    assert issues("b") == ["it can't be parsed"]


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), e.schema)
    seen = []
    q = events.to_batches(events.once(stream), lambda df, n: seen.append(df.count()), str(tmp_path / "at"))
    q.awaitTermination()
    assert sum(seen) == e.count()


@pytest.mark.parametrize(("make", "keys"), [(events.windowed, ("start", "event_type")), (events.sessions, ("user_id", "start"))], ids=["windows", "sessions"])
def test_windows_of_a_stream_are_those_of_its_rows(spark, tmp_path, make, keys):
    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    # files come in any order, so rows may be late by as much as they span
    stream = make(events.event_stream(spark, str(tmp_path / "in"), e.schema, files_per_trigger=1), late="60 days")
    name = f"stream_{make.__name__}"
    stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted((str([r[k] for k in keys]), r["n"], round(r["total"], 6)) for r in df.collect())
    assert rows(spark.table(name)) == rows(make(e))


def test_revisions_and_logs(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "ticker string, sent int, url string")
    folder, table, log = (f"{tmp_path}/{n}" for n in ("in", "table", "log"))
    schema = rows(("a", 1, "u")).schema
    for batch in (rows(("a", 2, "new"), ("b", 1, "x")), rows(("a", 1, "late"), ("b", 3, "y")), rows(("c", 1, "z"))):
        batch.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        events.revisions(stream, table, ["ticker"], "sent", f"{tmp_path}/at").awaitTermination()
        events.appended(spark.readStream.schema(schema).parquet(folder), log, f"{tmp_path}/at2").awaitTermination()
    assert sorted(tuple(r) for r in events.current(spark, table).collect()) == [("a", 2, "new"), ("b", 3, "y"), ("c", 1, "z")]
    assert spark.read.parquet(log).count() == 5 and events.current(spark, f"{tmp_path}/none") is None


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_equal_their_sql(spark, name):
    import glob
    import os

    import duckdb

    df = catalogue.QUERIES[name](spark, SMALL)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([clean(r[c]) for c in columns]) for r in got) == sorted(str([clean(r[i]) for i in at]) for r in want.fetchall())
    assert json.dumps(columns)
