"""Queries of documents: pages, headings, chunks, keys, printed tables and the facts checked against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.operators import chunks as H
from tallyforge.operators import crosscheck as C
from tallyforge.operators import documents as D
from tallyforge.operators.sheets import sheets
from tallyforge.register import query
from tallyforge.sinks.snapshots import written

l = F.lit  # noqa: E741
s = lambda c: F.col(c).cast("string")
row = lambda *cells: F.array(*[x.cast("string") if not isinstance(x, str) else l(x) for x in cells])

LINES = "l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), o AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS off, regexp_extract_all(line, '[^ ]+') AS w FROM l)"


@query(f"""WITH {LINES}, a AS (SELECT *, trim(line) AS t, list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}')) AS alpha FROM o)
SELECT doc_id, CAST(off + length(line) - length(ltrim(line)) AS INTEGER) AS begin, t AS heading FROM a WHERE t <> '' AND length(t) <= 80 AND NOT regexp_matches(t, '[.,;]$') AND len(w) <= 12
 AND (regexp_matches(t, '^\\d+(\\.\\d+)*\\.?\\s+\\S') OR (len(alpha) > 0 AND len(list_filter(alpha, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.6 * len(alpha)))""")
def heading_lines(read, spark):
    return D.heading_lines(read("documents"))


@query("""WITH p AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id AS doc_id, list_aggregate(t, 'string_agg', chr(10) || chr(10)) AS text, list_transform(range(len(t)), lambda i: CAST(coalesce(list_sum(list_transform(t[1:i], lambda x: length(x) + 2)), 0) AS INTEGER)) AS page_starts FROM p""")
def joined_pages(read, spark):
    return D.joined_pages(read("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("""SELECT conv_id AS doc_id, turn AS page, trim(text, chr(10) || ' ') AS text FROM conversations""")
def stripped_pages(read, spark):
    """A head with the page's number is put on every page and taken off again; so are feet."""
    pages = read("conversations").groupBy("conv_id").agg(F.count("*").alias("n")).filter("n >= 1").join(read("conversations"), "conv_id")
    long = pages.select("conv_id", "turn", F.explode(F.array(l(0), l(1), l(2), l(3))).alias("copy"), "text")
    dressed = long.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 4 + F.col("copy")).alias("page"), F.concat(l("Annual Report Q"), s("copy"), l("X\nPage "), (F.col("turn") * 4 + F.col("copy")).cast("string"), l("\n"), F.when(F.col("copy") == 0, F.col("text")).otherwise(F.concat(l("own line "), F.translate(F.md5(F.concat(s("conv_id"), l(":"), s("turn"), s("copy"))), "0123456789", "ghijklmnop"))), l("\n\nAll rights reserved 19"), s("copy"), l("5\nend of page")).alias("text"))
    out = D.stripped_pages(dressed, share=0.9)
    return out.filter(F.col("page") % 4 == 0).select("doc_id", (F.col("page") / 4).cast("long").alias("page"), F.trim("text", l("\n ")).alias("text"))


def reports(read):
    """A report of each supplier with two pages: a title, a scale, a table that goes on on the next page, a closing text."""
    k = F.col("s_suppkey")
    head = F.concat(l("1 Results of "), F.col("s_name"), l("\n(Rs in crore) standalone figures.\n"))
    one = F.array(row("", "Quarter ended", "", "Year ended"), row("Particulars", "30.06.1995", "30.06.1994", "31.03.1995"), row("Income", "", "", ""), row("Sales", k * 100 + 1, k * 100 + 2, k * 100 + 3), row("", k * 100 + 4, k * 100 + 5, k * 100 + 6), row("II. Expenses", k * 100 + 7, k * 100 + 8, k * 100 + 9))
    two = F.array(row("Tax paid", k * 1000 + 1, k * 1000 + 2, k * 1000 + 3), row("3", F.concat(l("("), s("s_suppkey"), l(")")), k * 1000 + 5, k * 1000 + 6))
    printed = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), "\n")
    d = read("supplier").select(s("s_suppkey").alias("doc_id"), "s_suppkey", head.alias("head"), one.alias("one"), two.alias("two"))
    d = d.withColumns({"t1": printed(F.col("one")), "t2": printed(F.col("two"))})
    between, tail = l("\n\n"), l("\nThe board met on Monday. It was a long meeting. Dividend is Rs. 5 a share.")
    begin1 = F.length("head")
    begin2 = begin1 + F.length("t1") + 2
    table = lambda begin, end, rows, header: F.struct(begin.alias("begin"), end.alias("end"), rows.alias("rows"), l(header).alias("header_rows"), F.array().cast("array<int>").alias("sections"))
    title = F.struct(l(0).alias("begin"), (F.locate("\n", "head") - 1).alias("end"))
    return d.select(
        "doc_id", "s_suppkey", F.concat("head", "t1", between, "t2", tail).alias("text"), F.array(l(0), begin2).alias("page_starts"), F.array(l("Standalone"), l("Standalone")).alias("running"),
        F.array(table(begin1, begin1 + F.length("t1"), F.col("one"), 2), table(begin2, begin2 + F.length("t2"), F.col("two"), 0)).alias("tables"), F.array(title).alias("headings"),
    )


def report_sheets(read):
    r = reports(read)
    tables = r.select(F.col("doc_id").alias("document"), F.posexplode("tables").alias("sheet", "t")).select("document", "sheet", "t.begin", "t.end", (F.col("sheet") + 1).alias("page"), "t.rows")
    return sheets(tables, r.select(F.col("doc_id").alias("document"), "text"))


CELLS = """x AS (SELECT s_suppkey AS k, c FROM supplier, (SELECT unnest(range(1, 4)) AS c)),
y AS (SELECT k, 0 AS sheet, 3 AS r, c, 'Sales' AS label, 'Income' AS heading, k * 100 + c AS v FROM x UNION ALL SELECT k, 0, 4, c, 'Income', 'Income', k * 100 + 3 + c FROM x UNION ALL SELECT k, 0, 5, c, 'II. Expenses', 'II. Expenses', k * 100 + 6 + c FROM x
 UNION ALL SELECT k, 1, 0, c, 'Tax paid', 'II. Expenses', k * 1000 + c FROM x UNION ALL SELECT k, 1, 1, c, 'II. Expenses', 'II. Expenses', CASE c WHEN 1 THEN -k ELSE k * 1000 + 3 + c END FROM x),
cells AS (SELECT CAST(k AS VARCHAR) AS document, k, sheet, sheet + 1 AS page, r AS "row", c AS "column", label, heading, CAST(v AS DOUBLE) AS value, [DATE '1995-06-30', DATE '1994-06-30', DATE '1995-03-31'][c] AS period_end, [3, 3, 12][c] AS months FROM y)"""


@query(f"WITH {CELLS} SELECT document, sheet, page, \"row\", \"column\", label, heading, value, period_end, months, 'standalone' AS basis, 1e7 AS scale FROM cells")
def sheet_cells(read, spark):
    return report_sheets(read).select("document", "sheet", "page", "row", "column", "label", "heading", "value", "period_end", "months", "basis", "scale")


@query(f"""WITH {CELLS}, f AS (SELECT k, document, 'sales' AS c, DATE '1995-06-30' AS e, 3 AS m, (k * 100 + 1) * 1e7 AS v, 'Sales' AS want FROM cells GROUP BY ALL UNION ALL SELECT k, document, 'tax', DATE '1995-03-31', 12, (k * 1000 + 3) * 1e7 + CASE WHEN k % 2 = 1 THEN 1e9 ELSE 0 END, 'Tax paid' FROM cells GROUP BY ALL UNION ALL SELECT k, document, 'none', DATE '1995-03-31', 12, 5.0, 'x' FROM cells GROUP BY ALL)
SELECT k || c AS fact_id, CASE WHEN c = 'none' THEN 'unmatched' WHEN c = 'tax' AND k % 2 = 1 THEN 'differ' ELSE 'agree' END AS outcome, CASE WHEN c = 'none' OR (c = 'tax' AND k % 2 = 1) THEN NULL ELSE 'label' END AS rule, CASE c WHEN 'sales' THEN 'Sales' WHEN 'tax' THEN 'Tax paid' END AS row_label,
 CASE c WHEN 'sales' THEN CAST(k * 100 + 1 AS VARCHAR) WHEN 'tax' THEN CAST(k * 1000 + 3 AS VARCHAR) END AS printed, CASE WHEN c = 'none' OR (c = 'tax' AND k % 2 = 1) THEN 'xbrl-ai' ELSE 'xbrl-filed' END AS tier FROM f""")
def crosscheck_match(read, spark):
    k = F.col("s_suppkey")
    fact = lambda name, label, start, end, value: F.struct(F.concat(s("s_suppkey"), l(name)).alias("fact_id"), l(start).cast("date").alias("period_start"), l(end).cast("date").alias("period_end"), value.cast("double").alias("value"), F.array(l(label)).alias("labels"))
    made = F.array(fact("sales", "Sales", "1995-04-01", "1995-06-30", (k * 100 + 1) * 1e7), fact("tax", "Tax paid for the period", "1994-04-01", "1995-03-31", (k * 1000 + 3) * 1e7 + F.when(k % 2 == 1, 1e9).otherwise(0.0)), fact("none", "Goodwill", "1994-04-01", "1995-03-31", l(5.0)))
    facts = read("supplier").select(s("s_suppkey").alias("document"), F.explode(made).alias("f")).select("document", "f.*", l("standalone").alias("basis"), l("INR").alias("unit"), l(None).cast("string").alias("segment"))
    outcomes = C.best_outcome(C.checked(facts, report_sheets(read)).withColumn("ord", l(0)))
    held = facts.select("fact_id", l("xbrl-ai").alias("tier"), l(None).cast("string").alias("verified_by"), l(None).cast("string").alias("verified_at"), l(None).cast("string").alias("printed"), l(None).cast("int").alias("page"))
    origins = read("supplier").select(s("s_suppkey").alias("document"), l("nse-pdf").alias("origin"))
    after = C.applied(held, outcomes, origins, l("2026-01-01"))
    return outcomes.select("fact_id", "outcome", "rule", "row_label", "printed").join(after.select("fact_id", "tier"), "fact_id")


@query("""WITH f AS (SELECT o_orderkey AS fact_id, 'T' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS e, o_orderkey % 3 AS k FROM orders), g AS (SELECT *, CASE WHEN k = 0 THEN make_date(year(e), 3, 31) ELSE e END AS filed FROM f)
SELECT fact_id, 0 AS ord, CASE WHEN month(filed) = 3 AND k = 0 THEN ticker || '-FY' || lpad(CAST(year(filed) % 100 AS VARCHAR), 2, '0') ELSE ticker || '-' || filed END AS document FROM g UNION ALL SELECT fact_id, 1, ticker || '-' || filed FROM g WHERE month(filed) = 3 AND k = 0 UNION ALL SELECT fact_id, 1, ticker || '-' || filed FROM g WHERE month(filed) = 3 AND k = 2""".replace("WHEN month(filed) = 3 AND k = 0 THEN ticker", "WHEN month(filed) = 3 AND k IN (0, 2) THEN ticker"))
def documents_for(read, spark):
    k, e = F.col("o_orderkey") % 3, F.to_date("o_orderdate")
    march = F.make_date(F.year(e), l(3), l(31))
    end = F.when(k == 0, march).otherwise(e)
    start = F.when(k == 0, F.make_date(F.year(e) - 1, l(4), l(1))).when(k == 1, F.date_sub(e, 90))
    facts = read("orders").select(F.col("o_orderkey").alias("fact_id"), F.concat(l("T"), s("o_custkey")).alias("ticker"), start.alias("period_start"), end.alias("period_end"), end.alias("filed"))
    return C.documents_for(facts).select("fact_id", "ord", "document")


@query("""SELECT CAST(s_suppkey AS VARCHAR) || '#000' || o AS id, CASE o WHEN 3 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS page, '1 Results of ' || s_name AS heading, o IN (1, 2) AS is_table FROM supplier, (SELECT unnest(range(4)) AS o)""")
def element_chunks(read, spark):
    c = H.inventory(H.element_chunks(reports(read)))
    return c.select("id", "page", "heading", F.col("text").startswith("[Table").alias("is_table"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, kind, n FROM supplier, (VALUES ('chunk', 4), ('row', 4), ('table', 2), ('sentence', 3)) t(kind, n)""")
def search_keys(read, spark):
    r = reports(read)
    keys = H.search_keys(r, H.element_chunks(r))
    return keys.groupBy("doc_id", "kind").agg(F.count("*").cast("int").alias("n"))


@query()
def heading_chunks(read, spark):
    return H.heading_chunks(read("documents").select("doc_id", "text"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, ['Particulars', 'Quarter ended 30.06.1995', '30.06.1994', 'Year ended 31.03.1995'] AS headers, ['12', 's_suppkey%', '', 'x'] AS joined FROM supplier""")
def table_columns(read, spark):
    t = reports(read).select("doc_id", F.col("tables")[0].alias("t"))
    joined = labels.percent_joined(F.array(l("12"), l("5"), l("%"), l("x")))
    return t.select("doc_id", H.column_headers(F.col("t.rows"), F.col("t.header_rows")).alias("headers"), F.transform(joined, lambda x: F.replace(x, l("5%"), l("s_suppkey%"))).alias("joined"))


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey || '/' || l_linenumber AS fact_id, (l_orderkey + l_linenumber) % 9 AS k, 1 + l_orderkey % 900 AS p FROM lineitem)
    SELECT fact_id, CASE WHEN k IN (0, 1, 2, 3, 5, 8) THEN 'agree' WHEN k = 4 THEN 'differ' ELSE 'unmatched' END AS outcome,
      CASE WHEN k IN (0, 3, 5, 8) THEN 'label' WHEN k = 1 THEN 'distinct' WHEN k = 2 THEN 'per-share' END AS rule, CASE WHEN k IN (6, 7) THEN NULL WHEN k = 8 THEN 2 ELSE 1 END AS "row",
      CASE WHEN k IN (0, 4, 5, 8) THEN CAST(p AS VARCHAR) WHEN k = 1 THEN CAST(12000 + p AS VARCHAR) WHEN k = 2 THEN p || '.5' WHEN k = 3 THEN p || '.5 %' END AS printed FROM f"""
)
def crosscheck_rules(read, spark):
    """Every line of an order is a fact with a document of its own, and by its number what the document prints: the figure beside its
    label, a distinctive one beside another, one a share, a percentage, the wrong scale, the same twice, another figure, one of
    few digits beside another label, and one whose first row names the wrong thing."""
    k, p = F.col("k"), F.col("p")
    lines = read("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("fact_id"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).alias("k"), (1 + F.col("l_orderkey") % 900).alias("p")).distinct()
    lines = written(lines, "lines")  # facts and cells are read several times
    pure, share = k == 3, k == 2
    value = F.when(pure, (p + 0.5) / 100).when(share, p + 0.5).when(k == 4, p * 1e5).when(k == 1, (12000 + p) * 1e7).otherwise(p * 1e7)
    labels = F.when(share, F.array(l("Basic earnings per equity share from continuing operations, restated"))).otherwise(F.array(l("Sales of services")))
    facts = lines.select("fact_id", F.col("fact_id").alias("document"), l("standalone").alias("basis"), l(None).cast("date").alias("period_start"), l("1995-03-31").cast("date").alias("period_end"), value.alias("value"), F.when(pure, "pure").when(share, "INRPerShare").otherwise("INR").alias("unit"), labels.alias("labels"), l(None).cast("string").alias("segment"))

    def cell(at, label, printed, value, places=l(0)):
        return F.struct(l(at).alias("row"), label.alias("label"), printed.alias("printed"), value.cast("double").alias("value"), places.alias("places"), F.endswith(printed, l("%")).alias("percent"))

    own, other = l("Sales of services"), l("Cost of materials")
    half = F.when(pure | share, 1).otherwise(0)
    name = F.when(share, "Basic EPS (Rs)").when(k.isin(1, 6, 7, 8), other).otherwise(own)
    printed = F.when(pure, F.concat(s("p"), l(".5 %"))).when(share, F.concat(s("p"), l(".5"))).when(k == 1, (12000 + p).cast("string")).when(k == 6, (p + 1).cast("string")).otherwise(s("p"))
    number = F.when(pure | share, p + 0.5).when(k == 1, 12000 + p).when(k == 6, p + 1).otherwise(p)
    cells = F.array(cell(0, l("Other income"), l("5000"), l(5000)), cell(1, name, printed, number, half), cell(2, own, F.when(k.isin(5, 8), s("p")).otherwise("4000"), F.when(k.isin(5, 8), p).otherwise(4000)))
    # a second row with the label is there for some alone
    cells = lines.select(F.col("fact_id").alias("document"), F.inline(F.when(k.isin(5, 8), cells).otherwise(F.slice(cells, 1, 2))))
    cells = cells.select("*", l(0).alias("sheet"), l(1).alias("column"), l(1).alias("page"), l("").alias("heading"), l("1995-03-31").cast("date").alias("period_end"), l(12).alias("months"), l(True).alias("alone"), l("standalone").alias("basis"), l(1e7).alias("scale"))
    return C.checked(facts, cells).select("fact_id", "outcome", "rule", "row", "printed")
