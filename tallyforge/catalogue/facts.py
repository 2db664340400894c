"""Queries of looking facts up, metrics over them, labels, manifests and migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import citations
from tallyforge.operators import crosscheck as C
from tallyforge.operators import facts as A
from tallyforge.operators import lookup as K
from tallyforge.operators import migrations as G
from tallyforge.plans import metrics as M
from tallyforge.plans.metrics import Metric, Metrics
from tallyforge.register import query
from tallyforge.sources import listings as L
from tallyforge.sources import manifests as S

l = F.lit  # noqa: E741
s = lambda c: F.col(c).cast("string")

BOOK = """book AS (SELECT o_orderkey AS fact_id, 'T' || o_custkey % 20 AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis, o_orderpriority AS concept, CASE WHEN o_orderkey % 5 = 0 THEN 'Hotels' END AS segment, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE make_date(year(o_orderdate) - 1, 4, 1) END AS s, make_date(year(o_orderdate), 3, 31) AS e, o_totalprice AS value,
 CASE o_orderstatus WHEN 'F' THEN 'xbrl-filed' ELSE 'xbrl-ai' END AS tier, CASE WHEN o_orderkey % 7 = 0 THEN 'me' ELSE 'other' END AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 40 END AS filing_id FROM orders), filings AS (SELECT CAST(i AS BIGINT) AS filing_id, 'f' || i AS origin, DATE '1990-01-01' + CAST(i * 37 % 100 AS INTEGER) AS filed FROM (SELECT unnest(range(40)) AS i))"""


def book(read):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    return read("orders").select(
        k.alias("fact_id"), F.concat(l("T"), (F.col("o_custkey") % 20).cast("string")).alias("ticker"), F.when(k % 2 == 0, "standalone").otherwise("consolidated").alias("basis"), F.col("o_orderpriority").alias("concept"), F.col("o_orderpriority").alias("label"), F.when(k % 5 == 0, "Hotels").alias("segment"),
        y.alias("y"), F.when(k % 3 != 0, F.make_date(y - 1, l(4), l(1))).alias("period_start"), F.make_date(y, l(3), l(31)).alias("period_end"), F.col("o_totalprice").alias("value"), l("INR").alias("unit"), F.when(F.col("o_orderstatus") == "F", "xbrl-filed").otherwise("xbrl-ai").alias("tier"), F.when(k % 7 == 0, "me").otherwise("other").alias("run_id"), F.when(k % 4 != 0, k % 40).alias("filing_id"),
    )


def book_filings(spark):
    return spark.range(40).select(F.col("id").alias("filing_id"), F.concat(l("f"), s("id")).alias("origin"), F.date_add(l("1990-01-01").cast("date"), (F.col("id") * 37 % 100).cast("int")).alias("filed"))


@query(f"""WITH {BOOK}, q AS (SELECT DISTINCT ticker || basis || y AS query_id, ticker, basis, y FROM book), c AS (SELECT DISTINCT concept FROM book), near AS (SELECT q.query_id, b.*, f.filed, f.origin, row_number() OVER (PARTITION BY q.query_id, b.concept ORDER BY CASE WHEN tier = 'xbrl-filed' THEN 0 WHEN run_id = 'me' THEN 1 ELSE 2 END, filed NULLS FIRST, fact_id) AS o FROM q JOIN book b ON q.ticker = b.ticker AND q.basis = b.basis AND q.y = b.y LEFT JOIN filings f USING (filing_id) WHERE segment IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY concept) AS rank FROM near WHERE o = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, 'FACT:' || ticker || ':' || y || ':' || basis || ':year:' || concept AS cite_as, value, tier, CASE WHEN origin IS NULL THEN 'written back' ELSE 'filing of the period ended ' || filed || ': ' || origin END AS source FROM r WHERE rank <= 3""")
def lookup_find(read, spark):
    b = book(read)
    q = b.select(F.concat("ticker", "basis", s("y")).alias("query_id"), "ticker", "basis", F.col("y").alias("year")).distinct()
    concepts = b.select("concept").distinct()
    asked = q.join(F.broadcast(concepts), l(True)).select("*", l("year").alias("period"), l(None).cast("string").alias("segment"), F.col("concept").alias("place"))  # five concepts
    return K.find(b, book_filings(spark), asked, "me", 3).select("query_id", "rank", "cite_as", "value", "tier", "source")


@query("""WITH h AS (SELECT DISTINCT 'T' || o_custkey % 20 AS ticker, make_date(year(o_orderdate), 3, 31) AS e, CASE o_orderkey % 4 WHEN 0 THEN 'Hotels' WHEN 1 THEN 'Paper' WHEN 2 THEN 'Paper board' END AS seg FROM orders), q AS (SELECT DISTINCT ticker, e FROM h), a AS (SELECT q.*, w FROM q, (VALUES ('hotels '), ('PAPER'), ('board'), ('a'), (' ')) t(w))
SELECT ticker || e || w AS query_id, CASE WHEN trim(w) = '' THEN NULL ELSE coalesce(min(seg) FILTER (WHERE lower(seg) = trim(lower(w))), CASE WHEN count(DISTINCT seg) FILTER (WHERE contains(lower(seg), trim(lower(w)))) = 1 THEN min(seg) FILTER (WHERE contains(lower(seg), trim(lower(w)))) END) END AS found FROM a LEFT JOIN h USING (ticker, e) GROUP BY ticker, e, w""")
def segments_asked(read, spark):
    k = F.col("o_orderkey") % 4
    facts = read("orders").select(F.concat(l("T"), (F.col("o_custkey") % 20).cast("string")).alias("ticker"), l("standalone").alias("basis"), F.make_date(F.year("o_orderdate"), l(3), l(31)).alias("period_end"), F.when(k == 0, "Hotels").when(k == 1, "Paper").when(k == 2, "Paper board").alias("segment"))
    words = spark.createDataFrame([("hotels ",), ("PAPER",), ("board",), ("a",), (" ",)], "segment string")
    asked = facts.select("ticker", "basis", "period_end").distinct().join(F.broadcast(words), l(True)).withColumn("query_id", F.concat("ticker", s("period_end"), "segment"))  # five questions
    return K.segment_asked(asked, facts).select("query_id", "found")


@query("""WITH m AS (SELECT p_partkey, p_brand || ' ' || p_type AS text FROM part), q AS (SELECT DISTINCT p_type AS what FROM part), tok AS (SELECT p_partkey, regexp_extract_all(lower(text), '[a-z0-9]+(?:[.,][0-9]+)*') AS t FROM m)
SELECT what AS query_id, count(*) AS n FROM q, tok WHERE list_has_any(t, regexp_extract_all(lower(what), '[a-z0-9]+(?:[.,][0-9]+)*')) GROUP BY 1""")
def concepts_matched(read, spark):
    texts = K.concept_texts(read("part").select(s("p_partkey").alias("concept"), F.col("p_brand").alias("label")), read("part").select(s("p_partkey").alias("concept"), F.col("p_type").alias("label")))
    questions = read("part").select(F.col("p_type").alias("query_id"), F.col("p_type").alias("what")).distinct()
    return K.matched(questions, texts, 1_000_000).groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"""WITH {BOOK}, q AS (SELECT DISTINCT ticker, concept FROM book), i AS (SELECT concept FROM book GROUP BY 1 HAVING count(*) FILTER (WHERE s IS NULL) > count(*) FILTER (WHERE s IS NOT NULL)), r AS (SELECT ticker AS query_id, concept, row_number() OVER (PARTITION BY ticker ORDER BY concept) AS rank FROM q)
SELECT query_id, CAST(rank AS INTEGER) AS rank, concept, concept IN (SELECT concept FROM i) AS snapshot FROM r WHERE rank <= 2""")
def filed_candidates(read, spark):
    b = book(read)
    every = b.select("concept").distinct().unionByName(spark.createDataFrame([("0-never filed",)], "concept string"))
    asked = b.select("ticker").distinct().join(F.broadcast(every), l(True)).select(F.col("ticker").alias("query_id"), "ticker", "concept", F.col("concept").alias("place"))  # six concepts
    return K.candidates(asked, b, A.mostly_instants(b), 2)


@query(
    """WITH p AS (SELECT p_partkey AS query_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 4 AS k FROM part),
    m AS (SELECT DISTINCT upper(a[1]) || a[2:] || upper(b[1]) || b[2:] AS name, list_distinct([a, b, a || b, 'the']) AS own FROM p),
    q AS (SELECT query_id, CASE WHEN k = 0 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] END AS exactly,
            list_distinct(CASE k WHEN 0 THEN [a, b, a || b] WHEN 1 THEN [a, b] WHEN 2 THEN [a, 'zz'] ELSE ['unheard'] END) AS asked FROM p),
    s AS (SELECT query_id, name, len(list_intersect(asked, own)) AS shared, len(asked) AS n, coalesce(exactly = name, FALSE) AS exact FROM q, m WHERE list_has_any(asked, own))
    SELECT query_id, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, shared DESC, name) AS INTEGER) AS rank, exact OR shared = n AS holds FROM s"""
)
def metrics_named(read, spark):
    """Parts' names are metrics; parts ask for theirs by name, in words, by one of its words, or for what no metric has."""
    part, k = read("part"), F.col("p_partkey") % 4
    a, b = F.split_part("p_name", l(" "), l(1)), F.split_part("p_name", l(" "), l(2))
    camel = F.concat(F.initcap(a), F.initcap(b))
    metrics = part.select(camel.alias("name"), F.concat(l("the "), F.col("p_name")).alias("label")).distinct()
    what = F.when(k == 0, camel).when(k == 1, F.concat(l("what was the "), F.col("p_name"))).when(k == 2, F.concat(a, l(" zz"))).otherwise("unheard of")
    found = K.metrics_ranked(part.select(F.col("p_partkey").alias("query_id"), what.alias("what")), metrics)
    return found.select("query_id", "name", "rank", "holds")


def library() -> Metrics:
    return Metrics([
        Metric.of("Margin", "ratio", {"numerator": ("profit", "current"), "denominator": ("revenue", "current")}),
        Metric.of("RevenueGrowth", "growth", {"current": ("revenue", "current"), "previous": ("revenue", "previous")}),
        Metric.of("Both", "total", {"first": ("profit", "current"), "second": ("revenue", "current")}),
        Metric.of("AverageAssets", "average", {"first": ("assets", "current"), "second": ("assets", "opening")}),
        Metric.of("Turnover", "ratio", {"numerator": ("revenue", "current"), "denominator": ("AverageAssets", "current")}),
    ])


NATIONS = """f AS (SELECT n_nationkey AS k, CAST(y AS INTEGER) AS y, round(sum(o_totalprice), 2) AS revenue, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS profit, CAST(count(*) AS DOUBLE) AS assets FROM (SELECT *, year(o_orderdate) + CAST(month(o_orderdate) > 3 AS INTEGER) AS y FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def nation_facts(read):
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = F.year("o_orderdate") + (F.month("o_orderdate") > 3).cast("int")
    wide = joined.groupBy(F.col("c_nationkey").alias("k"), y.alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("profit"), F.count("*").cast("double").alias("assets"))
    long = wide.select("k", "y", F.expr("stack(3, 'revenue', revenue, 'profit', profit, 'assets', assets) AS (concept, value)")).filter("value IS NOT NULL")
    # revenue and profit are of years, assets as at the end of a year's last quarter; odd nations print profit in dollars
    return long.select(F.concat(l("N"), s("k")).alias("ticker"), "concept", F.col("y").alias("year"), F.when(F.col("concept") == "assets", "Q4").otherwise("year").alias("period"), "value", F.when((F.col("concept") == "profit") & (F.col("k") % 2 == 1), "USD").otherwise("INR").alias("unit"))


@query(f"""WITH {NATIONS}, q AS (SELECT k, y, m FROM f, (VALUES ('Margin'), ('RevenueGrowth'), ('Both'), ('Turnover')) t(m)), j AS (SELECT q.*, a.revenue, a.profit, a.assets, b.revenue AS was, b.assets AS opening FROM q JOIN f a USING (k, y) LEFT JOIN f b ON b.k = q.k AND b.y = q.y - 1),
v AS (SELECT *, CASE WHEN (m = 'Margin' AND profit IS NULL) OR (m = 'RevenueGrowth' AND was IS NULL) OR (m = 'Both' AND profit IS NULL) OR (m = 'Turnover' AND opening IS NULL) THEN 'a fact is missing' WHEN m = 'Both' AND k % 2 = 1 THEN 'it needs one unit' END AS refusal FROM j)
SELECT 'N' || k || y || m AS query_id, CASE WHEN refusal IS NULL THEN round(CASE m WHEN 'Margin' THEN profit / revenue WHEN 'RevenueGrowth' THEN (revenue - was) / abs(was) WHEN 'Both' THEN profit + revenue ELSE revenue / ((assets + opening) / 2) END, 6) END AS value, CASE WHEN refusal IS NULL THEN CASE m WHEN 'Both' THEN 'INR' ELSE 'pure' END END AS unit, refusal FROM v""")
def metrics_computed(read, spark):
    facts, lib, out = nation_facts(read), library(), None
    for name in ("Margin", "RevenueGrowth", "Both", "Turnover"):
        was = F.col("year") - 1 if lib.compares(name) else l(None).cast("int")
        q = facts.select("ticker", "year").distinct().select(F.concat("ticker", s("year"), l(name)).alias("query_id"), "ticker", l("standalone").alias("basis"), "year", l("year").alias("period"), was.alias("was_year"), F.when(was.isNotNull(), "year").alias("was"))
        found = lib.asked(name, q, {"assets"}).join(facts, ["ticker", "concept", "year", "period"], "left").withColumn("multiplier", l(None).cast("double"))
        one = lib.computed(name, found).select("query_id", F.round("value", 6).alias("value"), "unit", "refusal")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'flow' WHEN 1 THEN 'flow' WHEN 2 THEN 'snapshot' ELSE 'mixed' END AS kind, n_nationkey % 5 IN (0, 2, 4) AS one_time, n_nationkey % 5 = 3 AS opening FROM nation
    UNION ALL SELECT 'share of ' || n_name, CASE n_nationkey % 5 WHEN 0 THEN 'flow' ELSE 'mixed' END, n_nationkey % 5 IN (0, 2, 4), n_nationkey % 5 = 3 FROM nation WHERE n_nationkey % 5 <> 1"""
)
def metric_kinds(read, spark):
    """A metric a nation, by its key a ratio or growth of flows, a ratio or average of balances, or a ratio of both; and one on top
    of each that compares no times, over a flow."""
    shapes = (
        ("ratio", {"numerator": ("profit", "current"), "denominator": ("revenue", "current")}),
        ("growth", {"current": ("revenue", "current"), "previous": ("revenue", "previous")}),
        ("ratio", {"numerator": ("cash", "current"), "denominator": ("assets", "current")}),
        ("average", {"first": ("assets", "current"), "second": ("assets", "opening")}),
        ("ratio", {"numerator": ("profit", "current"), "denominator": ("assets", "current")}),
    )
    rows = read("nation").select("n_name", "n_nationkey").orderBy("n_nationkey").collect()  # definitions are few
    named = [Metric.of(r.n_name, *shapes[r.n_nationkey % 5]) for r in rows]
    lib = Metrics(named + [Metric.of(f"share of {m.name}", "ratio", {"numerator": (m.name, "current"), "denominator": ("revenue", "current")}) for r, m in zip(rows, named, strict=True) if r.n_nationkey % 5 != 1])
    return spark.createDataFrame([(n, lib.kind(n, {"assets", "cash"}), lib.one_time(n), lib.reads_opening(n)) for n in lib.by_name], "name string, kind string, one_time boolean, opening boolean")


@query("""WITH c AS (SELECT 'T' || o_custkey % 20 AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS e, o_orderkey AS filing, o_totalprice AS p, 1 + o_orderkey % 3 AS v FROM orders) SELECT ticker, e AS period_end, round(max(p / v), 6) AS count FROM c GROUP BY 1, 2""")
def share_counts(read, spark):
    e = F.to_date(F.date_trunc("month", "o_orderdate"))
    rows = read("orders").select(F.concat(l("T"), (F.col("o_custkey") % 20).cast("string")).alias("ticker"), l("standalone").alias("basis"), e.alias("period_end"), e.alias("filed"), F.col("o_orderkey").alias("filing_id"), F.explode(F.array(F.struct(l("PaidUpCapital").alias("concept"), F.col("o_totalprice").alias("value")), F.struct(l("FaceValue").alias("concept"), (1 + F.col("o_orderkey") % 3).cast("double").alias("value")))).alias("f")).select("*", "f.*")
    return K.share_counts(rows).select("ticker", "period_end", F.round("count", 6).alias("count"))


@query("""WITH t AS (SELECT o_custkey % 9 AS ticker, max(CAST(date_trunc('quarter', o_orderdate) AS DATE)) - 1 AS e FROM orders GROUP BY 1) SELECT e AS period_end, string_agg('T' || ticker, ', ' ORDER BY ticker) AS tickers, 'Q' || (1 + (month(e) + 8) % 12 // 3) || ' FY' || (year(e) + CAST(month(e) > 3 AS INTEGER)) || ' (' || day(e) || ' ' || monthname(e) || ' ' || year(e) || ')' AS quarter FROM t GROUP BY 1""")
def held_to(read, spark):
    return K.held_to(read("orders").select(F.concat(l("T"), (F.col("o_custkey") % 9).cast("string")).alias("ticker"), F.date_sub(F.to_date(F.date_trunc("quarter", "o_orderdate")), 1).alias("period_end")))


@query("""WITH p AS (SELECT l_suppkey % 3 AS ord, l_partkey AS concept, CASE l_linenumber % 3 WHEN 0 THEN 'standard' ELSE 'terse' END AS role, l_shipmode AS label FROM (SELECT *, 'M' || l_linenumber || l_suppkey % 5 AS l_shipmode FROM lineitem)), s AS (SELECT concept, min_by(label, (ord, label)) FILTER (WHERE role = 'standard') AS label, list_sort(list_distinct(list(label))) AS a FROM p GROUP BY 1)
SELECT concept, label, list_filter(a, lambda x: x IS DISTINCT FROM label) AS aliases FROM s""")
def labels_merged(read, spark):
    label = F.concat(l("M"), s("l_linenumber"), (F.col("l_suppkey") % 5).cast("string"))
    return K.labels_merged(read("lineitem").select((F.col("l_suppkey") % 3).alias("ord"), F.col("l_partkey").alias("concept"), F.when(F.col("l_linenumber") % 3 == 0, "standard").otherwise("terse").alias("role"), label.alias("label")))


@query("""WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'results/S' || s_suppkey || '-2025-09-30.pdf' ELSE 'results/S' || s_suppkey || '-2025-09-30.html' END AS name, s_suppkey % 5 AS t, s_suppkey % 3 AS o FROM supplier), x AS (SELECT *, k % 2 = 0 AS pdf, k % 2 = 0 AND t + o > 2 AS scan, k % 2 = 0 AND t + o > 2 AND t <= 2 AS ocr FROM m)
SELECT name, CASE WHEN ocr THEN 'nse-pdf-ocr' WHEN pdf THEN 'nse-pdf' ELSE 'nse-html' END AS origin, scan AND NOT (ocr AND k % 10 < 4) AS refused, CASE WHEN scan AND k % 10 < 4 THEN 2 ELSE 1 END AS readings, CASE WHEN ocr THEN 'filed OCR layer' ELSE 'born-digital PDF' END AS kind FROM x""")
def document_entries(read, spark):
    k = F.col("s_suppkey")
    name = F.concat(l("results/S"), s("s_suppkey"), l("-2025-09-30."), F.when(k % 2 == 0, "pdf").otherwise("html"))
    manifest = read("supplier").select("s_suppkey", name.alias("name"), l("nse").alias("source"))
    pages = manifest.select("name", "s_suppkey", F.explode(F.sequence(l(1), l(20))).alias("page")).select("name", "page", F.when(F.col("page") <= F.col("s_suppkey") % 5, 10).otherwise(900).alias("letters"), ((F.col("page") > 10) & (F.col("page") <= 10 + F.col("s_suppkey") % 3)).alias("invisible"))
    companies = read("supplier").filter(k % 10 < 4).select(F.concat(l("S"), s("s_suppkey")).alias("ticker"))  # whose OCR text may be used
    m = S.with_ocr_companies(S.flagged(manifest, pages), companies)
    usable = F.col("ocr_usable")
    readings = S.readings(m, usable).groupBy("name").agg(F.count("*").cast("int").alias("readings"))
    one = m.select("name", S.origin(F.col("name")).alias("origin"), S.refusal(usable).isNotNull().alias("refused"))
    return one.join(readings, "name").withColumn("kind", C.copy_kind(F.col("name"), F.col("origin")))


@query("""WITH f AS (SELECT o_orderkey AS fact_id, CASE o_orderkey % 5 WHEN 0 THEN 'xbrl' WHEN 1 THEN 'xbrl' WHEN 2 THEN 'xbrl-pdf' WHEN 3 THEN 'pdf-read' ELSE 'row' END AS tier, CASE o_orderkey % 5 WHEN 1 THEN 'pdf:results/A.pdf' WHEN 2 THEN 'pdf:results/B.htm' WHEN 3 THEN 'anna' END AS who FROM orders)
SELECT fact_id, CASE WHEN tier = 'xbrl' AND who IS NULL THEN 'xbrl-ai' WHEN tier IN ('xbrl', 'xbrl-pdf') THEN 'xbrl-filed' WHEN tier = 'pdf-read' THEN 'filed-read' ELSE tier END AS tier, CASE WHEN who LIKE 'pdf:%.pdf' THEN 'nse-' || who WHEN who LIKE 'pdf:%' THEN 'sec-6k-html:' || substr(who, 5) ELSE who END AS verified_by FROM f""")
def facts_migrated(read, spark):
    k = F.col("o_orderkey") % 5
    tier = F.when(k < 2, "xbrl").when(k == 2, "xbrl-pdf").when(k == 3, "pdf-read").otherwise("row")
    by = F.when(k == 1, "pdf:results/A.pdf").when(k == 2, "pdf:results/B.htm").when(k == 3, "anna")
    return G.facts_now(read("orders").select(F.col("o_orderkey").alias("fact_id"), tier.alias("tier"), by.alias("verified_by")))


@query("""WITH r AS (SELECT o_custkey % 30 AS t, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders), x AS (SELECT 'T' || t AS ticker, make_date(year(d), (quarter(d) - 1) * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS e, CASE WHEN k % 2 = 0 THEN 'consolidated' ELSE 'standalone' END AS basis, 'http://x/' || k || '.xml' AS url, d AS sent FROM r WHERE k % 7 <> 0)
SELECT ticker, CAST(e AS DATE) AS period_end, basis, max_by(url, (sent, -CAST(regexp_extract(url, '\\d+') AS BIGINT) * 0, url)) IS NOT NULL AS listed, CAST(max(sent) AS DATE) AS broadcast FROM x WHERE year(e) + CAST(month(e) > 3 AS INTEGER) IN (1995, 1996) GROUP BY 1, 2, 3""")
def filings_listed(read, spark):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    end = F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2))
    raw = read("orders").select(F.concat(l("T"), (F.col("o_custkey") % 30).cast("string")).alias("ticker"), F.when(k % 2 == 0, "Consolidated").otherwise("Non-Consolidated").alias("consolidated"), F.concat(l("http://x/"), s("o_orderkey"), F.when(k % 7 == 0, ".zip").otherwise(".xml")).alias("xbrl"), F.upper(F.date_format(end, "dd-MMM-yyyy")).alias("toDate"), F.date_format(d, "dd-MMM-yyyy 10:00:00").alias("broadCastDate"))
    return L.latest(L.rows_of(raw, L.OLD, 0), [1995, 1996]).select("ticker", "period_end", "basis", F.col("url").isNotNull().alias("listed"), F.to_date("broadcast").alias("broadcast"))


@query("""SELECT doc_id || '#0001/' || i AS id, CASE WHEN doc_id % 6 = 0 THEN 'no named metric' WHEN doc_id % 6 = 1 THEN 'no year or no value' WHEN doc_id % 6 = 2 THEN 'not a year that is held' WHEN doc_id % 6 = 3 THEN 'not an amount in rupees' WHEN doc_id % 6 = 4 THEN 'zero, which any nil fact would match' WHEN i = 1 THEN 'repeats a figure already counted' END AS left_out FROM documents, (SELECT unnest(range(2)) AS i)""")
def teacher_figures(read, spark):
    k = F.col("doc_id") % 6
    rows = read("documents").select("doc_id", F.explode(F.array(l(0), l(1))).alias("i"), F.concat(l("ITC-FY25#"), s("doc_id")).alias("chunk_id"), F.concat(l("question "), s("doc_id")).alias("question"), F.when(k != 0, "revenue").alias("metric"), F.when(k != 1, F.when(k == 4, 0.0).otherwise(5.0)).alias("value"), F.when(k == 3, "USD").otherwise("INR").alias("unit"), F.when(k == 2, 1990).otherwise(2025).alias("year"), l(None).cast("string").alias("description"), l(0.5).alias("tolerance"))
    return S.labelled_figures(rows, ["ITC"], [2025], ["revenue"]).select(F.concat(s("doc_id"), l("#0001/"), s("i")).alias("id"), "left_out")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{"at":"current","concept":"A' || o_custkey || '"}' ELSE '{"at":"opening","concept":"B"}' END AS binding, o_orderkey % 3 = 0 AS twice FROM orders""")
def binding_texts(read, spark):
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat(l('{"v": {"concept": "A'), s("o_custkey"), l('", "at": "current"}}'))).otherwise('{"v": {"concept": "B", "at": "opening"}}')
    listed = F.array(F.struct(l("a").alias("k"), l("1").alias("v")), F.struct(F.when(k % 3 == 0, "a").otherwise("b").alias("k"), l("2").alias("v")))
    out = F.regexp_extract(citations.bindings_json(citations.bindings(text)), r'^\{"v":(.*)\}$', 1)
    return read("orders").select("o_orderkey", out.alias("binding"), citations.pairs(listed, "k", "v")["refusal"].isNotNull().alias("twice"))


@query(f"""WITH {NATIONS}, x AS (SELECT k, y, 'N' || k || y AS query_id, profit IS NULL AS missing FROM f) SELECT query_id, CASE WHEN missing THEN 'a fact is missing' WHEN k % 3 = 0 THEN 'an input is unchecked' END AS refusal, CASE WHEN NOT missing AND k % 3 > 0 THEN CASE WHEN k % 3 = 1 THEN 'derived' ELSE 'derived-ai' END END AS tier FROM x""")
def derived_written(read, spark):
    facts, lib = nation_facts(read), library()
    q = facts.select("ticker", "year").distinct().select(F.concat("ticker", s("year")).alias("query_id"), "ticker", l("standalone").alias("basis"), "year", l("year").alias("period"), l(None).cast("int").alias("was_year"), l(None).cast("string").alias("was"))
    found = lib.asked("Margin", q, {"assets"}).join(facts, ["ticker", "concept", "year", "period"], "left").withColumn("multiplier", l(None).cast("double"))
    nation = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    inputs = found.filter("value IS NOT NULL").select("query_id", F.col("cite_as").alias("fact_id"), F.when(nation % 3 == 0, "xbrl-ai").otherwise("xbrl").alias("tier"))
    who = q.select("query_id", F.when(nation % 3 == 1, "Margin[*]@anna").alias("who"))
    rows = lib.computed("Margin", found).join(who, "query_id")
    return M.derived_rows(rows, inputs, A.CHECKED, F.col("who")).select("query_id", "refusal", "tier")


@query("""WITH w AS (SELECT 'T' || o_custkey % 10 AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice)) AS value FROM orders GROUP BY 1, 2) SELECT ticker, year, CASE WHEN year % 3 = 0 THEN 'not filed' WHEN year % 3 = 1 THEN 'equal' ELSE 'differs' END AS status FROM w""")
def held_figures(read, spark):
    w = read("orders").groupBy(F.concat(l("T"), (F.col("o_custkey") % 10).cast("string")).alias("ticker"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice")).alias("value"))
    end = F.make_date(F.col("year"), l(3), l(31))
    wanted = w.select("ticker", l("Revenue").alias("concept"), l("consolidated").alias("basis"), "year", "value")
    facts = w.filter(F.col("year") % 3 != 0).select("ticker", l("Revenue").alias("concept"), l("consolidated").alias("basis"), F.make_date(F.col("year") - 1, l(4), l(1)).alias("period_start"), end.alias("period_end"), end.alias("filed"), (F.col("value") * F.when(F.col("year") % 3 == 1, 1.001).otherwise(1.5)).alias("value"))
    return K.held_check(wanted, facts).select("ticker", "year", "status")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{"as_at":"' || CAST(o_orderdate AS DATE) || '"}' ELSE '{"from":"1990-01-01","to":"' || CAST(o_orderdate AS DATE) || '"}' END AS period, 'FACT:T:1995:s:year:c' AS cite_as FROM orders""")
def fact_texts(read, spark):
    k = F.col("o_orderkey")
    fact = F.struct(l("FACT:T:1995:s:year:c").alias("cite_as"), l("c").alias("label"), F.col("o_totalprice").alias("value"), l("INR").alias("unit"), F.when(k % 2 == 1, l("1990-01-01").cast("date")).alias("period_start"), F.to_date("o_orderdate").alias("period_end"), l("s").alias("basis"), l(None).cast("string").alias("segment"), l("xbrl").alias("tier"), l("here").alias("source"))
    answer = F.concat(l('{"facts": ['), citations.fact_json(fact), l("]}"))
    one = citations.facts_as_evidence(answer)[0]
    return read("orders").select("o_orderkey", F.get_json_object(one["text"], "$.period").alias("period"), one["id"].alias("cite_as"))


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderkey % 7 AS j FROM orders) SELECT k AS fact_id FROM d WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = 1 AND l_returnflag = 'R')""")
def dependants_dropped(read, spark):
    derived = read("orders").select(F.col("o_orderkey").alias("fact_id"))
    links = read("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("input_id"))
    changed = read("lineitem").filter("l_linenumber = 1 AND l_returnflag = 'R'").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("input_id"))
    return A.without_dependants(derived, links, changed)


@query("""SELECT 'T' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS period_end, CASE WHEN o_orderkey % 2 = 0 THEN 'consolidated' ELSE 'standalone' END AS basis, 'http://x/' || o_orderkey || '.xml' AS url FROM orders WHERE o_orderkey % 3 <> 0""")
def filings_nested(read, spark):
    """The new list: pages of JSON, dates in capitals."""
    k = F.col("o_orderkey")
    entry = F.struct(F.when(k % 2 == 0, "Consolidated").otherwise("Standalone").alias("consolidated"), F.concat(l("http://x/"), s("o_orderkey"), F.when(k % 3 == 0, ".pdf").otherwise(".xml")).alias("xbrl"), F.upper(F.date_format(F.to_date("o_orderdate"), "dd-MMM-yyyy")).alias("qe_Date"), F.date_format(F.to_date("o_orderdate"), "dd-MMM-yyyy 09:30:00").alias("broadcast_Date"))
    pages = read("orders").select(F.concat(l("T"), s("o_custkey")).alias("ticker"), entry.alias("e")).groupBy("ticker").agg(F.to_json(F.struct(F.collect_list("e").alias("data"), F.count("*").alias("totalCount"))).alias("body"))
    return L.rows_of(L.nested(pages), L.NEW, 1).select("ticker", "period_end", "basis", "url")


@query("""WITH x AS (SELECT s_suppkey AS k, 'S' || s_suppkey || '-1995-03-31-C' AS name FROM supplier) SELECT name, k % 3 <> 0 AS fetched, CASE WHEN k % 4 = 1 THEN 'absent' WHEN k % 4 = 2 THEN 'its digest differs' END AS why FROM x""")
def filings_to_fetch(read, spark):
    """What the manifest has under its name with its address isn't fetched again; a revision is. Files are held against their digest."""
    k = F.col("s_suppkey")
    ticker = F.concat(l("S"), s("s_suppkey"))
    listing = read("supplier").select("s_suppkey", ticker.alias("ticker"), l("1995-03-31").cast("date").alias("period_end"), l("consolidated").alias("basis"), F.concat(l("http://x/"), s("s_suppkey")).alias("url"))
    name = F.concat(ticker, l("-1995-03-31-C"))
    manifest = read("supplier").select(name.alias("name"), F.concat(l("http://x/"), s("s_suppkey"), F.when(k % 3 == 0, "").otherwise("/old")).alias("url"), F.sha2(F.concat(l("body "), s("s_suppkey")), 256).alias("sha256"))
    fetched = L.to_fetch(listing, manifest).select("name", l(True).alias("fetched"))
    files = read("supplier").filter(k % 4 != 1).select(name.alias("name"), F.concat(l("body "), s("s_suppkey"), F.when(k % 4 == 2, "!").otherwise("")).cast("binary").alias("content"))
    bad = L.verified(files, manifest)[1]
    return manifest.select("name").join(fetched, "name", "left").join(bad, "name", "left").select("name", F.coalesce("fetched", l(False)).alias("fetched"), "why")
