import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import chunks, crosscheck, documents, figures, grading, headlines, lookup, migrations, retrieval, sampling
from tallyforge.operators.sheets import column_periods, sheets
from tallyforge.plans import coverage, metrics, searching
from tallyforge.plans.metrics import Metric, Metrics
from tallyforge.sinks import files, reports
from tallyforge.sources import manifests, taxonomy

D = dt.date


def texts_of(found):
    return [text for _, _, text in found]


def test_sentences_and_packing():
    t = 'He paid Rs. 5 to Mr. X. "Fine!" she said? Yes.'
    assert [t[a:b] for a, b in documents.sentences(t)] == ['He paid Rs. 5 to Mr. X. "Fine!" ', "she said? ", "Yes."]
    assert [p for _, p in documents.packed("Aa bb. Cc dd. Ee ff.", 14, 1)] == ["Aa bb. Cc dd.", "Cc dd. Ee ff."]
    assert [p for _, p in documents.packed("x" * 25 + ". Yy zz.", 10, 0)] == ["x" * 10, "x" * 10, "xxxxx.", "Yy zz."]
    lines = "first line\nsecond line\nthird"
    assert [p for _, p in documents.packed(lines, 12, 0, lines=True)] == ["first line", "second line", "third"]
    assert "".join(lines[a:b] for a, b in documents.cut_lines(lines, 0, len(lines), 12)) == lines


def test_heading_chunks():
    body = "It is a sentence that goes on for a while, as reports do. " * 3
    doc = {"doc_id": "d", "text": f"Front matter that is long enough to stay, in all its eighty letters or somewhat more.\n1. Revenue from operations\n{body}\nShort One\nno.\n2 Costs\n{body * 4}"}
    got = list(chunks.by_heading(doc, 400))
    assert [h for _, h, _ in got] == [None, "1. Revenue from operations", "2 Costs", "2 Costs"]
    assert got[1][2].startswith("1. Revenue from operations\nIt is") and all(doc["text"][a:].startswith(t[:20]) for a, _, t in got)
    assert texts_of(chunks.by_heading({"doc_id": "d", "text": "no heading here. none at all."}, 400)) == ["no heading here. none at all."]


def test_section_paths():
    paths = chunks.outline(["5 Investments", "(h) Quoted", "i. Shares"])  # i is the letter after h
    assert paths == [["5 Investments"], ["5 Investments", "(h) Quoted"], ["5 Investments", "i. Shares"]]
    paths = chunks.outline(["5 Investments", "a) Debt", "i. Bonds", "ii. Notes", "b) Equity", "Directors", "a) Debt", "6. Loans", "(IV) Term"])
    assert paths[2:] == [
        ["5 Investments", "a) Debt", "i. Bonds"],
        ["5 Investments", "a) Debt", "ii. Notes"],
        ["5 Investments", "b) Equity"],
        ["Directors"],
        ["a) Debt"],
        ["6. Loans"],
        ["6. Loans", "(IV) Term"],
    ]


def table_doc():
    rows = [["Particulars", "March 2025", "March 2024"], ["Assets", "", ""], *[[f"Item {'abcdefgh'[i - 1]}", str(i * 11), str(i * 7)] for i in range(1, 9)], ["Debts", "", ""], *[[f"Loan {'abcd'[i - 1]}", str(i), str(i)] for i in range(1, 5)]]
    printed = "\n".join(" ".join(c for c in r if c) for r in rows)
    head = "5 Balance Sheet\n(₹ in crore)\n"
    text = head + printed + "\nThe company paid 5 to its staff. All was well."
    table = {"begin": len(head), "end": len(head) + len(printed), "rows": rows, "header_rows": 1, "sections": [1, 10]}
    return {"doc_id": "X-FY25", "text": text, "page_starts": [0], "running": ["Standalone accounts"], "tables": [table], "headings": [{"begin": 0, "end": len("5 Balance Sheet")}]}


def test_element_chunks():
    doc = table_doc()
    got = list(chunks.by_element(doc, 230, 200))
    tables = [t for t in texts_of(got) if t.startswith("[Table")]
    label = "[Table · X-FY25 p.1 · 5 Balance Sheet · standalone · (₹ in crore) = ×10000000 · columns: 2025 | 2024]"
    assert len(tables) > 1 and all(t.startswith(f"{label}\nParticulars March 2025 March 2024\n") and len(t) <= 230 for t in tables)
    rows = [x for t in tables for x in t.split("\n")[2:] if x not in ("Assets", "Debts")]
    assert rows == [f"Item {'abcdefgh'[i - 1]} {i * 11} {i * 7}" for i in range(1, 9)] + [f"Loan {'abcd'[i - 1]} {i} {i}" for i in range(1, 5)]
    assert any(t.split("\n")[2] == "Assets" for t in tables[1:])  # a piece repeats the section that it is under
    closing = texts_of(got)[-1]
    assert closing.startswith("[X-FY25 p.1 · 5 Balance Sheet · standalone · (₹ in crore) = ×10000000]\n") and closing.endswith("All was well.")
    whole = list(chunks.by_element(doc, 5000, 200))
    assert sum(t.startswith("[Table") for t in texts_of(whole)) == 1


def test_search_keys(spark):
    doc = table_doc()
    df = spark.createDataFrame([tuple(doc[k] for k in ("doc_id", "text", "page_starts", "running", "tables", "headings"))], chunks.STRUCTURE)
    found = chunks.element_chunks(df, 230, 200)
    keys = chunks.search_keys(df, found).orderBy("key_id").collect()
    assert [r.key_id for r in keys] == [f"X-FY25#k{i:06d}" for i in range(len(keys))]
    by_id = {r.id: r.text for r in found.collect()}
    own = [r for r in keys if r.kind == "row"]
    assert len(own) == 14 and all(r.text.endswith(" · 2025, 2024") for r in own)
    assert all(r.text.split(" · ")[-2] in by_id[r.parent] for r in own)
    hits = spark.createDataFrame([(1, keys[0].key_id, 2, 0.5), (1, keys[-1].key_id, 1, 0.9), (1, keys[-2].key_id, 3, 0.1)], "query_id int, key_id string, rank int, score double")
    assert [(r.id, r["rank"]) for r in chunks.parents(hits, chunks.search_keys(df, found), 2).orderBy("rank").collect()] == [(keys[-1].parent, 1), (keys[0].parent, 2)]
    twice = found.unionByName(found)
    with pytest.raises(Exception, match="chunk id twice"):
        chunks.inventory(twice).collect()


def test_column_periods(spark):
    def periods(*rows):
        cells = [("d", 0, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)]
        got = column_periods(spark.createDataFrame(cells, "document string, sheet int, r int, c int, text string")).collect()
        return {r.c: (r.period_end, r.months) for r in got}

    assert periods(["", "Quarter ended", "", "Year ended"], ["Rs", "30.06.2024", "30.06.2023", "31.03.2024"]) == {1: (D(2024, 6, 30), 3), 2: (D(2023, 6, 30), 3), 3: (D(2024, 3, 31), 12)}
    assert periods(["", "FY 2025", "2023-24"]) == {1: (D(2025, 3, 31), 12), 2: (D(2024, 3, 31), 12)}
    assert periods(["Year ended", "31 March 2025", "2024"]) == {1: (D(2025, 3, 31), None), 2: (D(2024, 3, 31), None)}
    assert periods(["", "As at", "Q1-2026"], ["", "31.03.2025", "30.06.2025"], ["Title below", "", ""]) == {1: (D(2025, 3, 31), 0), 2: (D(2025, 6, 30), 3)}
    assert periods(["", "a", "b"]) == {}


def test_sheets_carry_over(spark):
    one = [["", "Quarter ended"], ["", "30.06.2024"], ["Sales", "10", "x"], ["1", "Tax", "5"]]
    tables = [("d", 0, 30, 40, 1, [["", "30.06.2024", "30.06.2023"], ["Sales", "10", "11"], ["", "1", "2"], ["", "3", "4"]]), ("d", 1, 60, 70, 2, [["Tax", "5", "6"], ["Other heads", "", ""], ["A. Net", "7", "8"]]), ("d", 2, 80, 90, 5, [["Far", "5", "6"]]), ("d", 3, 95, 99, 5, [["words", "only"]])]
    df = spark.createDataFrame(tables, "document string, sheet int, begin int, end int, page int, rows array<array<string>>")
    text = "Consolidated accounts in lakhs".ljust(45) + "standalone now".ljust(200)
    got = {(r.sheet, r.row, r.column): r for r in sheets(df, spark.createDataFrame([("d", text)], "document string, text string")).collect()}
    assert set(got) == {(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2), (0, 3, 1), (0, 3, 2), (1, 0, 1), (1, 0, 2), (1, 2, 1), (1, 2, 2), (2, 0, 1), (2, 0, 2)}
    assert [got[0, r, 1].label for r in (1, 2, 3)] == ["Sales", "30.06.2024 30.06.2023", ""]
    assert (got[0, 1, 1].basis, got[0, 1, 1].scale, got[1, 0, 1].basis, got[2, 0, 1].basis) == ("consolidated", 1e5, "standalone", "standalone")
    assert got[1, 0, 2].period_end == D(2023, 6, 30) and got[2, 0, 1].period_end is None  # three pages on it is another table
    assert got[1, 2, 1].label == "A. Net" and got[1, 2, 1].heading == "A. Net" and one


def test_checks_by_each_rule(spark):
    cell = lambda row, label, printed, value, places=0, percent=False, heading="", end=D(2024, 6, 30), months=3, basis=None, alone=False: ("d", 0, basis, 1e7, 1, row, 1, label, heading, printed, value, places, percent, end, months, alone)
    cells = spark.createDataFrame(
        [cell(1, "Revenue from operations", "100", 100.0), cell(2, "Something", "12,345", 12345.0), cell(3, "(1) Basic", "4.50", 4.5, 2, heading="Earnings per share"), cell(4, "Margin", "12.5", 12.5, 1, True), cell(5, "Profit for the period", "9", 9.0), cell(6, "Gross profit", "77", 77.0), cell(7, "Old", "5", 5.0, months=None, alone=True), cell(8, "Cash", "3", 3.0, basis="standalone")],
        "document string, sheet int, basis string, scale double, page int, row int, column int, label string, heading string, printed string, value double, places int, percent boolean, period_end date, months int, alone boolean",
    )
    fact = lambda name, value, labels, unit="INR": (name, "d", "consolidated", D(2024, 4, 1), D(2024, 6, 30), value, unit, labels, None)
    facts = spark.createDataFrame(
        [fact("label", 100e7, ["Revenue from operations"]), fact("distinct", 12345e7, ["Nothing alike"]), fact("share", 4.5, ["Basic earnings per share"], "INRPerShare"), fact("pure", 0.125, ["Margin"], "pure"), fact("differ", 8e7, ["Profit for the period"]), fact("unmatched", 3e7, ["Cash"]), fact("net", 77e7, ["Net profit"]), fact("alone", 5e7, ["Old"])],
        "fact_id string, document string, basis string, period_start date, period_end date, value double, unit string, labels array<string>, segment string",
    )
    got = {r.fact_id: (r.outcome, r.rule) for r in crosscheck.checked(facts, cells).collect()}
    assert got == {"label": ("agree", "label"), "distinct": ("agree", "distinct"), "share": ("agree", "per-share"), "pure": ("agree", "label"), "differ": ("differ", None), "unmatched": ("unmatched", None), "net": ("unmatched", None), "alone": ("agree", "label")}


def test_rulings(spark):
    groups = spark.createDataFrame([("T|C", "*|C", [1, 2, 3, 4]), ("U|C", "*|C", [7]), ("V|D", "*|D", [8]), ("W|E", "*|E", [9])], "group_id string, any_id string, ids array<bigint>")
    sample = spark.range(1).select(crosscheck.spot_sample(F.lit("T|C"), F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3, 4)])).alias("s")).first().s
    assert len(sample) == 3
    check = lambda ticks: [("T|C", [(i, float(i)) for i in (1, 2, 3, 4)], ticks)]
    kind = "group_id string, verdict string, decided_by string, checks array<struct<group:string,facts:array<struct<id:bigint,value:double>>,ticked:array<bigint>>>"
    held = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 99.0)], "fact_id bigint, value double")
    rule = lambda *rows: {r.group_id: (r.status, r.confirmed, r.new) for r in crosscheck.ruled(groups, spark.createDataFrame(list(rows), kind), held).collect()}
    assert rule(("T|C", "right", "anna", check(sample)))["T|C"] == ("extend", [1, 2, 3], [4])
    assert rule(("T|C", "right", "anna", check(sample[:2])))["T|C"][0] == "refused"
    assert rule(("*|C", "wrong", "anna", []), ("T|C", "elsewhere", None, [])) == {"T|C": ("proposed", None, None), "U|C": ("applied", None, None)}
    lost = crosscheck.orphans(groups, spark.createDataFrame([("X|Z", "wrong", "a", [])], kind))
    assert [r.group_id for r in lost.collect()] == ["X|Z"]
    rulings = crosscheck.ruled(groups, spark.createDataFrame([("T|C", "right", "anna", check(sample))], kind), held)
    facts = spark.createDataFrame([(1, "xbrl-ai", None, None), (2, "xbrl-filed", "x", "t"), (4, "xbrl-ai", None, None)], "fact_id bigint, tier string, verified_by string, verified_at string")
    assert sorted((r.fact_id, r.tier, r.verified_by) for r in crosscheck.confirmed_facts(facts, rulings, "anna", F.lit("now")).collect()) == [(1, "xbrl", "anna"), (2, "xbrl-filed", "x"), (4, "xbrl-ai", None)]


def test_traces(spark):
    rows = [("d", 0, r, [f"label {r}", str(r)], r == 0) for r in range(30)]
    printed = spark.createDataFrame(rows, "document string, sheet int, r int, cells array<string>, header boolean")
    outcomes = spark.createDataFrame([("a", "d", 0, 15, 1, "15"), ("b", "d", 0, 15, 1, "16"), ("c", "d", None, None, None, None)], "fact_id string, document string, sheet int, row int, column int, printed string")
    got = crosscheck.traced(outcomes, printed).collect()
    assert sorted(r.r for r in got if r.fact_id == "a") == [0, *range(7, 24)] and {r.role for r in got if r.fact_id == "a"} == {"header", "around", "figure"}
    assert sorted((r.fact_id, r.role) for r in got if r.fact_id != "a") == [("b", "not printed there now"), ("c", "no figure")]


def test_metric_engine(spark):
    lib = Metrics([Metric.of("Growth", "growth", {"current": ("revenue", "current"), "previous": ("revenue", "previous")}), Metric.of("Average", "average", {"first": ("assets", "current"), "second": ("assets", "opening")}), Metric.of("Margin", "ratio", {"numerator": ("profit", "current"), "denominator": ("revenue", "current")})])
    with pytest.raises(ValueError):
        Metric.of("Bad", "ratio", {"a": ("x", "current")})
    available = {"revenue", "profit", "assets", *lib.by_name}
    refuse = lambda name, formula, **b: lib.refusal(Metric.of(name, formula, b), available, lib.openings(available, {"assets"}))
    assert refuse("Loop", "total", first=("Loop", "current"), second=("revenue", "current")).endswith("an input to itself")
    assert refuse("New", "total", first=("cash", "current"), second=("revenue", "current")) == "no concept cash in this scope"
    assert refuse("New", "total", first=("Growth", "current"), second=("revenue", "current")) == "Growth compares two periods itself"
    assert refuse("New", "total", first=("revenue", "opening"), second=("revenue", "current")) == "revenue is not a balance"
    assert refuse("New", "total", first=("revenue", "then"), second=("revenue", "current")) == "at then is no time"
    assert refuse("New", "total", first=("Margin", "current"), second=("revenue", "current")) is None
    held, refused = lib.seeded([Metric.of("B", "total", {"first": ("A", "current"), "second": ("revenue", "current")}), Metric.of("A", "total", {"first": ("profit", "current"), "second": ("revenue", "current")}), Metric.of("C", "total", {"first": ("none", "current"), "second": ("revenue", "current")})], available, {"assets"})
    assert {"A", "B"} <= set(held.by_name) and list(refused) == ["C"]
    q = spark.createDataFrame([(1, "T", "standalone", 2025, "Q2", None, None), (2, "T", "standalone", 2025, "Q2", 2025, "Q1")], "query_id int, ticker string, basis string, year int, period string, was_year int, was string")
    asked = {(r.query_id, r.path): (r.concept, r.year, r.period, r.refusal) for r in lib.asked("Growth", q, {"assets"}).collect()}
    assert asked[2, "previous"] == ("revenue", 2025, "Q1", None) and asked[1, "current"][3] == "give the previous period too"
    opening = {r.path: (r.year, r.period, r.refusal) for r in lib.asked("Average", q.filter("query_id = 1"), {"assets"}).collect()}
    assert opening == {"first": (2025, "Q2", None), "second": (2025, "Q1", None)}
    with pytest.raises(ValueError):
        lib.asked("Average", q, set())
    found = spark.createDataFrame([(1, "numerator", 5.0, "INR", None, "a", None), (1, "denominator", 0.0, "INR", None, "b", None), (2, "numerator", 5.0, "INR", 0.5, "a", None), (2, "denominator", 10.0, "INR", None, "b", None), (3, "numerator", 5.0, "INR", None, "a", None)], "query_id int, path string, value double, unit string, multiplier double, cite_as string, refusal string")
    got = {r.query_id: (r.value, r.unit, r.refusal) for r in lib.computed("Margin", found).collect()}
    assert got == {1: (None, None, "a base is zero"), 2: (0.25, "pure", None), 3: (None, None, "a fact is missing")}


def test_derived_facts(spark):
    key = "ticker string, basis string, concept string, period_start date, period_end date, segment string"
    rows = spark.createDataFrame([(1, "T", "s", "M", None, D(2024, 3, 31), None, "f"), (2, "T", "s", "N", None, D(2024, 3, 31), None, "g")], f"query_id int, {key}, formula string")
    facts = spark.createDataFrame([(10, "derived", "f", "T", "s", "M", None, D(2024, 3, 31), None), (11, "derived-ai", "f", "T", "s", "M", None, D(2024, 3, 31), None), (12, "derived", "g", "T", "s", "N", None, D(2024, 3, 31), None), (13, "derived", "h", "T", "s", "N", None, D(2024, 3, 31), None)], f"fact_id int, tier string, formula string, {key}")
    assert {r.query_id: r.held for r in metrics.held_derived(rows, facts).collect()} == {1: 10, 2: 12}
    assert {r.query_id: r.held for r in metrics.held_derived(rows, facts, verified=True).collect()} == {1: 10}
    derived = spark.createDataFrame([(1, "M", "T", "derived-ai", None), (2, "M", "T", "derived-ai", None), (3, "M", "U", "derived-ai", None)], "fact_id int, concept string, ticker string, tier string, verified_by string")
    links = spark.createDataFrame([(1, 100), (2, 101), (3, 100)], "fact_id int, input_id int")
    inputs = spark.createDataFrame([(100, "xbrl"), (101, "xbrl-ai")], "fact_id int, tier string")
    got = metrics.promoted(derived, links, inputs, Metric.of("M", "total", {"first": ("a", "current"), "second": ("b", "current")}), ["T"], " anna ", ("xbrl",)).collect()
    assert sorted((r.fact_id, r.tier, r.verified_by) for r in got) == [(1, "derived", "M[*]@anna"), (2, "derived-ai", None), (3, "derived-ai", None)]
    with pytest.raises(ValueError):
        metrics.promoted(derived, links, inputs, Metric.of("M", "total", {"first": ("a", "current"), "second": ("b", "current")}), ["T"], " ", ("xbrl",))
    old = spark.createDataFrame([("f", "a+b", "x")], "name string, expression string, tier string")
    new = spark.createDataFrame([("f", "a+b"), ("f", "a-b"), ("f", "a-b")], "name string, expression string")
    assert metrics.proposals(old, new).count() == 2


def test_look_up_log(spark):
    q = spark.createDataFrame([(1, "T", "s", 2025, "Q1", "sales"), (2, "T", "s", 2025, "year", "cash")], "query_id int, ticker string, basis string, year int, period string, what string")
    found = spark.createDataFrame([(1, "Revenue", 1), (1, "Other", 2)], "query_id int, concept string, rank int")
    matches = spark.createDataFrame([(1, "X", 1), (2, "Cash", 1), (2, "Bank", 2)], "query_id int, concept string, place int")
    got = lookup.logged(q, found, matches, "run", "me", F.lit("now")).orderBy("what").collect()
    assert [(r.what, r.period, r.concept, r.found) for r in got] == [("cash", "2025 year", "Cash", False), ("sales", "2025 Q1", "Revenue", True)]
    event = F.struct(F.lit("T").alias("ticker"), F.lit(3).alias("id"), F.lit("bonus").alias("kind"), F.lit(2).alias("after"), F.lit(1).alias("before"), F.lit(None).cast("double").alias("seen_ratio"), F.lit(None).cast("date").alias("seen_from"), F.lit(None).cast("date").alias("seen_to"), F.lit(D(2024, 5, 1)).alias("effective"), F.lit("share-event").alias("tier"), F.lit("anna").alias("verified_by"))
    assert spark.range(1).select(lookup.event_text(event).alias("t")).first().t == "T event 3: bonus 2:1 effective 2024-05-01, checked by anna"


def test_taxonomy_labels(spark):
    link = lambda body: f'<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><labelLink>{body}</labelLink></linkbase>'
    loc = '<loc xlink:label="l1" xlink:href="core.xsd#in-gaap_Revenue"/><labelArc xlink:from="l1" xlink:to="r1"/>'
    label = lambda role, text: f'<label xlink:label="r1" xlink:role="http://www.xbrl.org/2003/role/{role}">{text}</label>'

    def package(*labels):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("x/core-lab-en.xml", link(loc + "".join(labels)))
            z.writestr("x/core.xml", "<not read>")
        return data.getvalue()

    files = spark.createDataFrame([("a", package(label("label", "Revenue  from\n operations"), label("terseLabel", "Sales"))), ("b", package(label("label", "Turnover")))], "package string, content binary")
    got = taxonomy.merged(files, ["a", "b"]).collect()
    assert [(r.concept, r.label, sorted(r.aliases)) for r in got] == [("Revenue", "Revenue from operations", ["Sales", "Turnover"])]
    manifest = files.select(F.col("package").alias("name"), F.sha2("content", 256).alias("sha256"))
    assert taxonomy.checked(files, manifest, ["a"]).filter("length(content) > 0").count() == 1
    with pytest.raises(Exception, match="not cached"):
        taxonomy.checked(files, manifest, ["z"]).filter("length(content) > 0").collect()


def test_seeds_and_manifests(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"documents": {"annual/ITC-FY25.pdf": {"ticker": "ITC", "company": "ITC Limited", "pages": 4}}}))
    m = manifests.read(spark, str(path), "documents")
    assert [(r.name, r.company, r.pages) for r in m.collect()] == [("annual/ITC-FY25.pdf", "ITC Limited", 4)]
    assert json.loads(manifests.as_json(m).first().value) == {"annual/ITC-FY25.pdf": {"ticker": "ITC", "company": "ITC Limited", "pages": 4}}
    good = tmp_path / "d.jsonl"
    good.write_text('// note\n{"id": "T|C", "verdict": "right", "note": "n", "decided_by": "a", "checks": [{"group": "T|C", "facts": [[1, 2.5]], "spot_checked": [1]}]}\n\n')
    got = manifests.decisions(spark, str(good)).collect()
    assert [(r.group_id, r.verdict, r.checks[0].facts[0].value, r.checks[0].ticked) for r in got] == [("T|C", "right", 2.5, [1])]
    for bad in ('{"id": "x", "verdict": "maybe"}', '{"id": "x", "verdict": "right", "odd": 1}', "[1]", "{"):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="line 1"):
            manifests.decisions(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "e.jsonl").write_text('{"ticker": "T", "kind": "bonus", "effective": "2024-05-01", "shares_after": 2, "shares_before": 1}\n{"ticker": "U", "kind": "split", "effective": "2024-06-01"}')
    held = spark.createDataFrame([("T", D(2024, 5, 1))], "ticker string, effective date")
    assert [r.ticker for r in manifests.share_events(spark, str(tmp_path / "e.jsonl"), held).collect()] == ["U"]
    (tmp_path / "f.json").write_text(json.dumps({"fundamentals": {"T": {"2025": {"eps": {"value": 5, "unit": "INR", "printed": "5", "doc_id": "d", "page": 2, "note": None}}}}}))
    assert [(r.ticker, r.year, r.metric, r.value) for r in manifests.fundamentals(spark, str(tmp_path / "f.json")).collect()] == [("T", 2025, "eps", 5.0)]
    (tmp_path / "t.json").write_text(json.dumps({"companies": {"TCS": {"name": "Tata Consultancy", "aliases": ["TCS Ltd"]}, "ITC": {"name": "ITC", "aliases": []}}}))
    index = headlines.directory(manifests.directory(spark, str(tmp_path / "t.json")))
    assert {r.key: r.ticker for r in index.collect()} == {"tcs": "TCS", "tataconsultancy": "TCS", "itc": "ITC"}


def test_migrations(spark):
    rows = [("Growth", "*", "growth year on year", "growth", '{"b": {"concept": "B", "offset": "t-1y"}, "a": {"concept": "A", "offset": "t"}}', "derived-concept-ai"), ("GrowthToo", "*", "Growth", "growth", '{"b": {"concept": "B", "offset": "t-1q"}, "a": {"concept": "A", "offset": "t"}}', "derived-concept"), ("New", "*", "New", "total", '{"a":{"at":"current","concept":"A"}}', "derived-concept-ai")]
    got = {r.name: (r.label, r.bindings) for r in migrations.bindings_now(spark.createDataFrame(rows, "name string, scope string, label string, formula string, bindings string, tier string")).collect()}
    assert set(got) == {"GrowthToo", "New"} and got["GrowthToo"][1] == '{"a":{"at":"current","concept":"A"},"b":{"at":"previous","concept":"B"}}'
    old = spark.createDataFrame([("f", "formula"), ("g", "formula")], "name string, tier string")
    new = spark.createDataFrame([("f", "formula-ai", 1)], "name string, tier string, n int")
    assert sorted((r.name, r.tier) for r in migrations.renamed(old, new, ["name"], {"formula": "formula-ai"}).collect()) == [("f", "formula-ai"), ("g", "formula-ai")]
    assert migrations.with_column(old, "scope", F.lit("*")).columns == ["name", "tier", "scope"]


def test_draws(spark):
    assert sampling.shares(7, {"a": 1, "b": 9, "c": 9}, ["a", "b", "c"]) == {"a": 1, "b": 3, "c": 3}
    assert sampling.shares(9, {"a": 2}, ["a", "b"]) == {"a": 2, "b": 0}
    rows = spark.createDataFrame([(i, "big" if i < 12 else f"c{i % 4}", i % 3 == 0) for i in range(40)], "id int, company string, named boolean")
    pairs = sampling.paired(rows, "id", "company", 10).collect()
    company = {r.id: r.company for r in rows.collect()}
    used = [x for r in pairs for x in (r.first, r.second)]
    assert len(pairs) == 10 and len(set(used)) == 20 and all(company[r.first] != company[r.second] for r in pairs)
    drawn = sampling.split_by(rows, "named", "company", "id", 20, 0.9).collect()
    assert len(drawn) == 20 and sum(r.named for r in drawn) == 14  # all that are named, and others in their place
    banned = spark.createDataFrame([("one two three four five",)], "t string")
    texts = spark.createDataFrame([("ONE two three four!",), ("one two three",), ("fine words are here now",), ("Fine words are here now",)], "text string")
    assert sorted(r.text.lower() for r in sampling.unquoted(texts, "text", banned, "t").collect()) == ["fine words are here now", "one two three"]


def test_rankers(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "gamma delta"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(9, "beta")], "query_id int, text string")
    letters = lambda t: F.array(F.when(t.contains("beta"), 1.0).otherwise(0.0), F.when(t.contains("gamma"), 1.0).otherwise(0.0))
    for name, rank in retrieval.rankers(letters).items():
        assert [r.doc_id for r in rank(docs, asked, 1).collect()] in ([1], [2]), name
    with pytest.raises(ValueError):
        retrieval.bm25(docs, asked, k=0)
    with pytest.raises(Exception, match="unit length"):
        retrieval.dense(spark.createDataFrame([(1, [3.0, 4.0])], "vec_id int, v array<double>"), spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, v array<double>"), unit=True).collect()
    store = spark.createDataFrame([("x", [1.0, 0.0])], "text_key string, v array<double>")
    made = retrieval.embedded(docs.filter("text IS NOT NULL"), store, lambda texts: [[0.0, 1.0]] * len(texts)).collect()
    assert len(made) == 3 and all(list(r.v) == [0.0, 1.0] for r in made)
    quotes = spark.createDataFrame([(1, "pha bet"), (2, "a"), (3, "zeta eta theta"), (4, "he quick brown fox jump")], "quote_id int, quote string")
    texts = spark.createDataFrame([(1, "Alpha  Beta"), (2, "the quick “brown” fox jumps"), (3, "The quick brown fox jumps over"), (4, "")], "doc_id int, text string")
    assert sorted(tuple(r) for r in retrieval.resolve_quotes(quotes, texts).collect()) == [(1, 1), (2, 1), (4, 3)]


def test_report_helpers(spark):
    rows = spark.createDataFrame([("v", 1, "g", False, None), ("v", 2, "g", True, None), ("v", 3, "g", None, "boom"), ("w", 1, "g", False, None)], "variant string, case_id int, grader string, passed boolean, error string")
    shown, more = grading.failures(rows, 2)
    assert [r.case_id for r in shown.collect()] == [1, 3] and more == 1
    models = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "seq int, model string")
    assert models.agg(grading.first_seen(models, "model", "seq").alias("m")).first().m == ["b", "a"]
    assert rows.groupBy("variant").agg(grading.vetoed(F.coalesce("passed", F.lit(True))).alias("v")).orderBy("variant").collect()[0].v is True
    assert spark.range(1).select(grading.unsupported(F.create_map(F.lit("a"), F.lit("supported"), F.lit("b"), F.lit("weak"))).alias("m")).first().m == {"b": "weak"}
    assert grading.usage_totals(spark.createDataFrame([("m", 1, 2.0), ("m", 3, 4.0)], "model string, tokens int, cost double"), ["model"]).first()[1:] == (2, 4, 6.0)


def test_fault_order():
    f = lambda **k: {"metric": "profit", "value": 5.0, "key": "INR", "year": 2025, "described": True} | k
    assert figures.faults_of([f()], [f()], "", False, False) == []
    assert figures.faults_of([f(value=0.18)], [f(value=18.0)], "", True, False) == ["call when not needed", "percentage not converted"]
    assert figures.faults_of([f(), f(value=7.0)], [f(value=7.0, year=None), f(value=5e3)], "", False, True) == ["no call when needed", "wrong scale", "year dropped"]
    assert figures.faults_of([f()], [f(value=9.0)], "", False, False) == ["missed", "extra"]
    assert figures.faults_of([f()], [f(key="tonnes", metric="tax", described=False)], "", False, False) == ["metric", "unit not a currency", "description"]


def test_statements():
    rows = [["Profit and loss", ""], ["Particulars", "30.06.2024", "30.06.2023"], ["Sales", "5", "6"], ["", "", ""], ["Balance sheet", ""], ["As at", "31 March 2024", "31 March 2023"], ["Cash", "7", "8"]]
    assert chunks.statement_starts(rows) == [0, 4]
    parts = chunks.statements({"rows": rows, "header_rows": 2, "sections": [4, 6]})
    assert [(len(p["rows"]), p["header_rows"], p["sections"]) for p in parts] == [(4, 2, []), (3, 0, [0, 2])]


def test_assembly_strips_what_pages_repeat(spark):
    rows = []
    for page in range(1, 11):
        own = f"Own text of page {'abcdefghij'[page - 1]}."
        rows += [("d", page, 0, "running", "Annual  report", None, None, None), ("d", page, 1, "heading", f"Heading {page}", None, None, None), ("d", page, 2, "text", f"Page {page}\n{own}\nAll rights", None, None, None)]
    rows.append(("d", 3, 3, "table", "a 1\nb 2", [["a", "1"], ["b", "2"]], 1, [1]))
    doc = chunks.assembled(spark.createDataFrame(rows, chunks.ELEMENTS)).first()
    assert "All rights" not in doc.text and "Page 3" not in doc.text and "Own text of page c." in doc.text
    assert doc.running[2] == "Annual report · Page 3 · All rights" and len(doc.page_starts) == 10
    assert [doc.text[h.begin : h.end] for h in doc.headings] == [f"Heading {i}" for i in range(1, 11)]
    assert doc.text[doc.tables[0].begin : doc.tables[0].end] == "a 1\nb 2" and doc.tables[0].sections == [1]
    assert all(doc.text[a:].startswith(f"Heading {i}") for i, a in enumerate(doc.page_starts, 1))


def test_reports_and_files(spark, tmp_path):
    folder = f"file://{tmp_path}"
    scores = spark.createDataFrame([("v", 1, "g", True, None, "", 1.0, {"a": True}), ("v", 2, "g", False, None, "why", 0.0, {"a": False}), ("v", 3, None, None, "boom", None, None, None), ("w", 1, "g", True, None, "", None, None)], "variant string, case_id int, grader string, passed boolean, error string, detail string, value double, parts map<string,boolean>")
    text = reports.evaluation(scores, "set", {"cost": "$0"}, most=1)
    assert "| v | 1/2 (50%) | 1 |" in text and "| g | 0.500 | — |" in text and "| a | 1/2 (50%) | — |" in text and "- …and more; 1 not shown" in text and "**g**: why" in text
    rows = scores.select("variant", "case_id")
    first, second = (reports.saved(rows, text, folder, "set-20260101", ["variant", "case_id"]) for _ in range(2))
    assert first.endswith("set-20260101.md") and second.endswith("set-20260101-2.md")
    with pytest.raises(FileExistsError):
        files.write_text(spark, first, "x", replace=False)
    assert files.write_text(spark, first, "new") == first and (tmp_path / "set-20260101.md").read_text() == "new"
    lines = [json.loads(r.value) for r in spark.read.text(f"{folder}/set-20260101.rows.jsonl").collect()]
    assert sorted((x["variant"], x["case_id"]) for x in lines) == [("v", 1), ("v", 2), ("v", 3), ("w", 1)]
    vectors = spark.createDataFrame([("k", [1.0, 0.0])], "text_key string, v array<double>")
    for version in ("a", "b", "c"):
        files.write_vectors(vectors, f"{folder}/store", version, keep=1)
    assert files.read_vectors(spark, f"{folder}/store", "c").count() == 1 and files.read_vectors(spark, f"{folder}/store", "a").count() == 0 and files.read_vectors(spark, f"{folder}/store", "z").count() == 0
    files.append_log(rows, f"{folder}/log")
    files.append_log(rows, f"{folder}/log")
    assert spark.read.parquet(f"{folder}/log").count() == 8
    scored = spark.createDataFrame([("s", "asked", True, 1, True), ("s", "asked", False, None, False)], "source string, phrasing string, held boolean, rank int, exact boolean")
    left = spark.createDataFrame([("s", "why"), ("s", "why")], "source string, reason string")
    text = reports.coverage(scored, left, {})
    assert "| s | asked | 2 | 1/2 (50%) | 1/1 (100%) | 1/1 (100%) | 1/1 (100%) |" in text and "| s | why | 2 |" in text
    outcomes = spark.createDataFrame([(1, "T", "standalone", "Sales|Net", None, 5.0, "agree", "5", D(2024, 6, 30)), (2, "T", "standalone", "Sales|Net", None, 0.12, "differ", "12", D(2024, 6, 30)), (3, "T", "standalone", "Sales|Net", None, 0.13, "differ", "13", D(2024, 9, 30))], "fact_id int, ticker string, basis string, concept string, segment string, value double, outcome string, printed string, period_end date")
    text = reports.crosschecked(outcomes, {})
    assert "| T | standalone | 1 | 2 | 0 |" in text and "| 1 | 2 | T | Sales\\|Net |  | printed x100 | 2024-06-30 to 2024-09-30 | 0.12; 0.13 | 12; 13 |" in text


def test_searches(spark):
    r = spark.createDataFrame([("ITC-FY24", "ITC"), ("ITC-FY25", "ITC"), ("TCS-FY25", "TCS")], "doc_id string, ticker string")
    ids = lambda *a: sorted(x.doc_id for x in searching.report_scope(r, *a).collect())
    assert ids() == ["ITC-FY24", "ITC-FY25", "TCS-FY25"] and ids("ITC") == ["ITC-FY24", "ITC-FY25"] and ids("all", "2025") == ["ITC-FY25", "TCS-FY25"] and ids("ITC", "2025") == ["ITC-FY25"]
    for bad in (("X", "all"), ("all", "1999"), ("all", "soon")):
        with pytest.raises(ValueError):
            ids(*bad)
    tags = lambda *t: spark.range(1).select(searching.single_report(F.array(*map(F.lit, t)), ["ITC-FY25", "TCS-FY25"]).alias("x")).first().x
    assert tags("a", "ITC-FY25") == "ITC-FY25" and tags("ITC-FY25", "TCS-FY25") is None and tags("a") is None
    old = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "pos int, key string, answer string")
    new = spark.createDataFrame([("b", "z")], "key string, answer string")
    assert [x.answer for x in searching.merged_answers(old, new).orderBy("pos").collect()] == ["x", "z"]
    q = spark.createDataFrame([("q", "m", 10.0, "2.50", 1e7, "INR", None, "T", 2025), ("r", "m", 1.0, "1", 1.0, "INR", "twice", "T", 2025), ("s", "m", 1.0, "1", 1.0, "INR", None, "U", 2025)], "id string, metric string, x double, printed string, scale double, unit string, excluded string, ticker string, year int")
    kept, left = coverage.from_tables(spark.createDataFrame([("q", "?"), ("r", "?"), ("s", "?")], "id string, question string"), q, ["T"], [2025])
    got = kept.first()
    assert (got.figure_id, got.value, got.tolerance) == ("q", 2.5e7, 0.5 * 0.01 * 1e7) and {(x.id, x.reason) for x in left.collect()} == {("r", "twice"), ("s", "not a company that is held")}
    with pytest.raises(ValueError):
        coverage.from_tables(spark.createDataFrame([("q", "?")], "id string, question string"), q, ["T"], [2025])


def test_html_keeps_all_text(spark):
    html = "<title>T</title>lone<div>in a div <b>bold</b></div><pre>pre</pre><p>open<p>next<ul><li>a<li>b</ul><script>x</script><table><tr><th>h<td>1<td>%<tr><td>c</table>tail &amp; end"
    got = [(r.kind, r.text) for r in documents.html_elements(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id", "pos").collect()]
    assert got == [("title", "T"), ("text", "lone"), ("text", "in a div bold"), ("text", "pre"), ("text", "open"), ("text", "next"), ("text", "a"), ("text", "b"), ("row", "h | 1%"), ("row", "c"), ("text", "tail & end")]
