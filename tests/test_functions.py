import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import citations, costs, labels, printed, python, scopes, text, times

D = dt.date


def values(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row)


def test_numbers(spark):
    cases = {"1,234.50": (1234.5, 2, False), "(12.3)": (-12.3, 1, False), "—": (0.0, 0, False), "..": (0.0, 0, False), "4.5 %": (4.5, 1, True), "12/03/2024": None, "March 31, 2024": None, "n.a.": None, "−7": (-7.0, 0, False), ". . 45": (45.0, 0, False), "1,23": (1.23, 2, False), "12. 50": (12.5, 2, False), "1.234.5": (1234.5, 1, False), "12 34": None, "(7": (-7.0, 0, False), "": None, "1,234": (1234.0, 0, False)}
    got = values(spark, *[printed.number(F.lit(k)) for k in cases])
    assert [g and tuple(g) for g in got] == list(cases.values())
    assert values(spark, printed.number(F.lit(None).cast("string"))) == [None]


def test_dates_and_lengths(spark):
    dates = {"as at 31.03.2024": D(2024, 3, 31), "Quarter ended June 30, 2024": D(2024, 6, 30), "30th September 2023": D(2023, 9, 30), "30 Jun'24": D(2024, 6, 30), "3o Sen'25": D(2025, 9, 30), "31 jux'25": None, "31.02.2024": None, "nothing": None, "31.03.2024 and 30.06.2024": D(2024, 6, 30), "30/06/2024, 31 March 2023": D(2023, 3, 31)}
    assert values(spark, *[printed.date_in(F.lit(k)) for k in dates]) == list(dates.values())
    ends = {"2024-25": D(2025, 3, 31), "FY25": D(2025, 3, 31), "FY 2026": D(2026, 3, 31), "2024-28": None}
    assert values(spark, *[printed.fiscal_end_in(F.lit(k)) for k in ends]) == list(ends.values())
    lengths = {"Nine months ended": 9, "Half year": 6, "Quarter ended": 3, "Q1-2026": 3, "Year ended": 12, "FY25": 12, "As at": 0, "asat": 0, "x": None}
    assert values(spark, *[printed.months_in(F.lit(k)) for k in lengths]) == list(lengths.values())
    assert values(spark, printed.scale_in(F.lit("in crore, in Lakhs")), printed.most_stated_scale(F.lit("in lakh in crore in crores")), printed.basis_in(F.lit("standalone and consolidated")), printed.scale_in(F.lit("none"))) == [1e5, 1e7, "consolidated", None]
    assert values(spark, printed.quarter_end(F.lit(D(2026, 3, 31))), printed.period_text(F.lit(D(2024, 6, 30)), F.lit(3)), printed.period_text(F.lit(D(2024, 3, 31)), F.lit(0)), printed.is_serial(F.lit(0), F.lit("12")), printed.is_serial(F.lit(1), F.lit("12"))) == ["Q4 FY2026 (31 March 2026)", "3 months to 2024-06-30", "at 2024-03-31", True, False]


def test_printed_helpers(spark):
    cells = lambda *x: F.array(*map(F.lit, x))
    assert values(spark, printed.row_label(cells("1", "", "Total  income", "5")), printed.row_label(cells("-", "5")), printed.years_in(cells("FY25 2024", "2024-25 2024"))) == ["Total income", None, ["FY25", "2024", "2024-25"]]
    assert values(spark, printed.printed_numbers(F.lit("Two of 1,250.5 and 3"))) == [[2.0, 3.0, 1250.5]]
    assert values(spark, printed.printed_as(F.lit("INR"), F.lit("1.5"), F.lit(1e7)), printed.printed_as(F.lit("pure"), F.lit("12%"), F.lit(1e7)), printed.printed_as(F.lit("INRPerShare"), F.lit("(2)"), F.lit(1e7))) == [1.5e7, 0.12, -2.0]
    assert values(spark, labels.percent_joined(cells("Margin", "12.5", "", "%", "x", "%"))) == [["Margin", "12.5%", "", "", "x", "%"]]


def test_labels(spark):
    lit = F.lit
    share = lambda a, row, seg=None: labels.label_share(F.array(*map(lit, a)), lit(seg).cast("string"), lit(row))
    assert values(spark, share(["Profit before tax"], "Profit / (loss) before tax"), share(["Basic EPS"], "Diluted earnings per share"), share(["Revenue"], "Revenue from discontinued operations"), share(["Revenue"], "Hotels revenue", "Hotels"), share(["the"], "the")) == [1.0, 0.0, 0.0, 1.0, 0.0]
    per = lambda a, t: labels.per_share_row(F.array(*map(lit, a)), lit(t))
    assert values(spark, per(["Basic earnings per share"], "Eamings per share Basic"), per(["Basic earnings per share"], "Earnings per share Diluted"), per(["Basic earnings per share"], "1) Basik earning per shares")) == [True, False, True]
    assert values(spark, labels.scale_phrase(lit("Statement (₹ in crore, except EPS) x")), labels.multiplier_of(lit("in lakh crores")), labels.multiplier_of(lit("Rs in Million")), labels.multiplier_of(lit("x"))) == ["(₹ in crore, except EPS)", 10**12, 10**6, None]
    assert values(spark, labels.company_key(lit("Tata Motors Ltd.")), labels.company_key(lit("M&M Limited")), labels.unit_key(lit("Rs. crore")), labels.unit_key(lit("usd mn")), labels.unit_key(lit("tonnes")), labels.unit_key(lit(" "))) == ["tatamotors", "m&m", "INR", "USD", "tonnes", None]
    assert values(spark, *[labels.canonical_call(lit(x)) for x in ("1250 * 10000000", "(2.5*1e5)", "3 * 10 ** 7", "7 / 100")]) == ["1250 * 10**7", "2.5 * 10**5", "3 * 10**7", "7 / 100"]
    assert values(spark, *[labels.metric_name_refusal(lit(x)) for x in ("NetIncome", "net income", "IncomeFY25", "ProfitQ1", "MarginQ12")]) == [None, "no CamelCase name", "names a period", "names a period", None]
    assert values(spark, labels.slug(lit("How? Are  you!")), labels.table_cell(lit("a|b\nc")), labels.examples(F.array(*map(lit, "aabcd"))), labels.examples(F.array(lit("a")))) == ["how-are-you", "a\\|b c", "a; b; c; …", "a"]
    assert values(spark, labels.body(lit("[X p.1]\nNote\nBody"), lit("A › Note")), labels.body(lit("Body"), lit(None).cast("string"))) == ["Body", "Body"]
    assert values(spark, labels.ticker_of(lit("results/BAJAJ-AUTO-2025-09-30.pdf")), labels.ticker_of(lit("annual/ITC-FY25.pdf")), labels.ticker_of(lit("x.pdf")), labels.cache_name(lit("annual/ITC-FY25.pdf")), labels.cache_name(lit("annual/ITC-FY25.pdf#rapidocr")), labels.fiscal_year_of(lit("ITC-FY25"))) == ["BAJAJ-AUTO", "ITC", None, "verify-annual-ITC-FY25", "verify-annual-ITC-FY25-rapidocr", 2025]
    assert values(spark, labels.normalised_page(lit("ﬁrst\tline  \x0cnext hyphen-\nated\n\n\n\nend ​ "))) == ["first line\nnext hyphenated\n\nend"]
    assert values(spark, text.label_of(lit("RevenueFromOperations")), text.label_of(lit("EPSBasic")), text.squeeze(lit("Straße “A” ‑ b ."))) == ["Revenue from operations", "EPS basic", 'strasse "a" - b.']


def test_table_context_keeps_path_and_basis(spark):
    label = "[Table · X-FY25 p.3 · Note 5 · consolidated · (₹ in crore) = ×10000000 · columns: 2025]"
    assert values(spark, labels.table_context(F.lit(label)))[0].endswith("Note 5 · consolidated")


def test_times(spark):
    lit = F.lit
    as_p = lambda q, length, snap: times.as_period(lit(q), lit(length).cast("string"), lit(snap))
    got = values(spark, as_p("Q4", "12M", False), as_p("Q2", None, True), as_p("Q1", "12M", False), as_p("Q1", None, False), as_p("Q1", "3M", True))
    assert [tuple(g) for g in got] == [("year", None), ("Q2", None), (None, "no filing holds such a span"), (None, "a flow needs a length"), (None, "a snapshot has no length")]
    assert [tuple(x) for x in values(spark, times.opening_of(lit(2025), lit("Q1")), times.opening_of(lit(2025), lit("Q3")), times.opening_of(lit(2025), lit("9M")), times.as_time(lit("H1")))] == [(2024, "Q4"), (2025, "Q2"), (2024, "Q4"), ("Q2", "6M")]
    refuse = lambda y, p, wy, wp: times.interval_refusal(lit(y), lit(p), lit(wy), lit(wp))
    assert values(spark, refuse(2025, "Q2", 2024, "Q4"), refuse(2025, "year", 2024, "year"), refuse(2025, "year", 2024, "Q4"), refuse(2025, "Q2", 2025, "Q2")) == [None, None, "not as long", "does not end before"]
    assert values(spark, times.period_phrase(lit(2026), lit("Q1"), lit(2025), lit("Q4"), lit(False)), times.period_phrase(lit(2025), lit("year"), lit(None).cast("int"), lit(None).cast("string"), lit(True))) == ["Q1 FY2026 over Q4 FY2025", "as at the end of FY2025"]
    assert len(values(spark, times.now())[0]) == 25


def test_scopes(spark):
    every = ["bank", "retail"]
    lit = F.lit
    assert values(spark, scopes.refusal(lit("*"), every), scopes.refusal(lit("bank, *"), every), scopes.refusal(lit("x"), every), scopes.normal(lit("retail,bank"), every), scopes.normal(lit(" bank "), every), scopes.covers(lit("*"), lit("bank"), every), scopes.covers(lit("bank"), lit("retail"), every)) == [None, "scope is * or a list of known scopes", "scope is * or a list of known scopes", "*", "bank", True, False]


@pytest.mark.parametrize(("text_", "want"), [("(1200 * 1.07) ** 2", (1200 * 1.07) ** 2), ("7 % 4 + 1 / 2", 3.5), ("-3 + 2", -1.0), ("__import__('os')", None), ("1 / 0", None), ("9 ** 9 ** 9", None), ("2 + x", None)])
def test_calculator(spark, text_, want):
    got = values(spark, python.calculated(F.lit(text_)))[0]
    assert got is None if want is None else math.isclose(got, want)


def test_digits(spark):
    lit = F.lit
    tol = lambda call, v=1.0: python.tolerance_of(lit(call).cast("string"), lit(v))
    got = values(spark, tol("1,250 * 10**7"), tol("2.5 * 10**5"), tol("7.25 / 100"), tol(None, 12.25), tol("x * 10"))
    assert got[:2] == [0.5e7, 0.05 * 1e5] and got[2] is None and got[3] == 0.005 and got[4] is None
    assert values(spark, *[python.significant(lit(x)) for x in (1200.0, 0.0045, 12.5, 1e20, 0.0)]) == [2, 2, 3, 1, 1]
    assert values(spark, python.rounds_to(lit(1234.0), lit(12340.0)), python.rounds_to(lit(123456.0), lit(123000.0)), python.rounds_to(lit(2.0), lit(2.04))) == [False, True, False]


def test_costs(spark):
    lit = F.lit
    price = F.struct(lit(2.0).alias("input"), lit(10.0).alias("output"), lit(None).cast("double").alias("cached_input"))
    got = values(spark, costs.cost(price, lit(1000), lit(100)), costs.cost(price, lit(0), lit(0), written=lit(1000), written_hour=lit(400), read=lit(500), searches=lit(2), batched=lit(True)), costs.cost(lit(None).cast("struct<input:double,output:double,cached_input:double>"), lit(9), lit(9)))
    assert [round(x, 12) for x in got] == [0.003, round(0.02 + 0.5e-6 * (600 * 2.5 + 400 * 4 + 500 * 0.2), 12), 0.0]
    n = values(spark, costs.affordable_output(price, lit(1000), lit(0.01)), costs.run_estimate(price, lit(3), lit(2), lit(1000), lit(100), lit(600)), costs.worst_case(price, lit(1000), lit(100), cached=True, hour=True), costs.refusal(price, lit(2.0), lit(1.0)), costs.back_off(lit(20), 0.5, 8.0, lit("a")))
    assert n[0] == 799 and math.isclose(n[1], (400 * 2 + 1000 + 600 * 2.5) * 1e-6 + 5 * (400 * 2 + 1000 + 600 * 0.2) * 1e-6) and math.isclose(n[2], 0.005) and n[3] == "above the limit" and 0 <= n[4] <= 8


def test_citations(spark):
    lit = F.lit
    answer = "Up 4 % [ITC-FY25#0012; ABC#0001], not ITC-FY25#0099 [see ITC-FY25#0003]."
    assert values(spark, citations.cited(lit(answer))) == [["ITC-FY25#0012", "ABC#0001", "ITC-FY25#0003"]]
    broken = citations.violations(lit(answer + " sk-abcdefghijklmnop1234"), F.array(lit("ITC-FY25#0012")))
    assert values(spark, broken, citations.shown(lit("x"), broken), citations.masked(lit("key sk-abcdefghijklmnop1234.")), citations.violations(lit(" "), F.array(lit("a")))) == [["cites passages it never retrieved: ABC#0001, ITC-FY25#0003", "contains 1 credential-shaped string(s)"], citations.WITHHELD, "key [redacted].", ["the answer is empty"]]
    chunks = F.array(*[F.struct(lit(f"A#000{i}").alias("id"), lit("A · p.1").alias("citation"), lit(f"text {i}\n\nmore").alias("text")) for i in range(2)])
    block = citations.context_block(chunks)
    assert [tuple(p) for p in values(spark, citations.passages_in(block))[0]] == [("A#0000", "A · p.1", "text 0\n\nmore"), ("A#0001", "A · p.1", "text 1\n\nmore")]
    assert values(spark, citations.fact_citation(lit("ITC"), lit(2025), lit("standalone"), lit("Q1"), lit("Revenue"), lit(None).cast("string")), citations.chunk_citation(lit("A"), lit(3), lit("H"))) == ["FACT:ITC:2025:standalone:Q1:Revenue", "A · p.3 · H"]
    assert values(spark, citations.first_object(lit('so {"a": {"b": 1}} done')), citations.first_object(lit("none"))) == ['{"a": {"b": 1}}', None]
    b = citations.bindings(lit('{"z": {"concept": "A", "at": "current"}, "a": {"concept": "B", "at": "opening"}}'))
    assert values(spark, citations.bindings_json(b)) == ['{"a":{"at":"opening","concept":"B"},"z":{"at":"current","concept":"A"}}']
    rows = lambda *p: F.array(*[F.struct(lit(k).alias("k"), lit(v).alias("v")) for k, v in p])
    assert [tuple(x) for x in values(spark, citations.pairs(rows(("a", "1"), ("b", "2")), "k", "v"), citations.pairs(rows(("a", "1"), ("a", "2")), "k", "v"))] == [({"a": "1", "b": "2"}, None), (None, "a name is given twice")]
    assert values(spark, citations.merged(F.create_map(lit("a"), lit(1), lit("b"), lit(2)), F.create_map(lit("b"), lit(3)))) == [{"a": 1, "b": 3}]
    leak = 'Fine. <tool_call>{"name": "calculate", "arguments": {"expression": "1+1"}}</tool_call>'
    got = values(spark, citations.leaked_calls(lit(leak), ["calculate"]), citations.leaked_calls(lit(leak), ["other"]))
    assert (got[0].text, [tuple(c) for c in got[0].calls]) == ("Fine.", [("calculate", '{"expression": "1+1"}')]) and got[1].text == leak and got[1].calls == []
    facts = citations.facts_as_evidence(lit('{"facts": [{"cite_as": "F1", "source": "s"}, {"x": 1}]}'))
    assert [(p.id, p.source) for p in values(spark, facts)[0]] == [("F1", "s")] and values(spark, citations.facts_as_evidence(lit("no json"))) == [[]]
