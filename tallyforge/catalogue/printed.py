"""Queries of what is printed: numbers, dates, labels, periods, citations, costs, scopes.

Texts are made from the columns of the tables, so that SQL knows what must be read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import citations, costs, labels, python, scopes, times
from tallyforge.functions import printed as N
from tallyforge.operators import lookup as K
from tallyforge.register import query
from tallyforge.sizes import dealt

s = lambda c: F.col(c).cast("string")
l = F.lit  # noqa: E741
two = lambda c: F.lpad(c.cast("string"), 2, "0")


def cases(k, *options):
    """The option whose place is ``k``."""
    out = l(None)
    for i, o in enumerate(options):
        out = F.when(k == i, o).otherwise(out)
    return out


LINE = "l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 12 AS k, CAST(l_partkey AS VARCHAR) AS n, lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS c FROM lineitem)"


@query(f"""WITH {LINE} SELECT l_orderkey, l_linenumber,
 CASE WHEN k IN (0, 2, 3, 6) THEN CAST(CASE WHEN k = 3 THEN c || '.' || c ELSE n || '.' || c END AS DOUBLE) WHEN k IN (1, 8) THEN 0 - CAST(n AS DOUBLE) WHEN k = 4 THEN 0 WHEN k = 5 THEN CAST(n AS DOUBLE) WHEN k = 9 THEN CAST(n || '500.' || c AS DOUBLE) END AS value,
 CASE WHEN k IN (0, 2, 3, 6, 9) THEN 2 WHEN k IN (1, 4, 5, 8) THEN 0 END AS places, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 6, 8, 9) THEN k = 3 END AS percent FROM l""")
def printed_numbers(read, spark):
    n, c, k = s("l_partkey"), two(F.col("l_suppkey") % 100), (F.col("l_orderkey") + F.col("l_linenumber")) % 12
    text = cases(k, F.concat(n, l("."), c), F.concat(l("("), n, l(")")), F.concat(n, l(","), c), F.concat(c, l("."), c, l(" %")), l(".."), F.concat(l(". . "), n), F.concat(n, l(". "), c), F.concat(l("31.12.19"), l("95")), F.concat(l("−"), n), F.concat(n, l(".500."), c), l("Total"), F.concat(n, l(" "), c))
    return read("lineitem").select("l_orderkey", "l_linenumber", N.number(text).alias("p")).select("l_orderkey", "l_linenumber", "p.value", "p.places", "p.percent")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3) THEN d WHEN k = 4 THEN make_date(2000 + year(d) % 100, month(d), day(d)) END AS stated,
 CASE WHEN k = 5 THEN make_date(2000 + year(d) % 100, 3, 31) WHEN k = 6 THEN make_date(2001 + year(d) % 30, 3, 31) END AS fiscal,
 CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 9 WHEN 3 THEN 6 WHEN 5 THEN 12 END AS months FROM o""")
def stated_dates(read, spark):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 8
    text = cases(
        k,
        F.concat(l("As at "), F.date_format(d, "dd.MM.yyyy")),
        F.concat(l("Quarter ended "), F.date_format(d, "MMMM d, yyyy")),
        F.concat(l("Nine months to "), F.date_format(d, "d'th' MMMM yyyy")),
        F.concat(l("Half-year to "), F.date_format(d, "dd/MM/yyyy")),
        F.concat(F.date_format(d, "d MMM"), l("'"), F.date_format(d, "yy")),
        F.concat(l("FY"), F.date_format(d, "yy")),
        F.concat((2000 + F.year(d) % 30).cast("string"), l("-"), two((2001 + F.year(d) % 30) % 100)),
        l("no date"),
    )
    # 2-digit years are read as 20yy
    return read("orders").select("o_orderkey", text.alias("t")).select("o_orderkey", N.date_in(F.col("t")).alias("stated"), N.fiscal_end_in(F.col("t")).alias("fiscal"), N.months_in(F.col("t")).alias("months"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1e7 WHEN 1 THEN 1e5 WHEN 2 THEN 1e6 END AS scale, CASE p_size % 3 WHEN 0 THEN 'standalone' WHEN 1 THEN 'consolidated' END AS basis,
 CASE p_size % 4 WHEN 0 THEN 10000000 WHEN 1 THEN 100000 WHEN 2 THEN 1000000 END AS multiplier, CASE p_size % 4 WHEN 0 THEN '(₹ in crore)' WHEN 1 THEN 'in lakhs' WHEN 2 THEN 'Rs in Million' END AS phrase,
 p_size % 100 BETWEEN 0 AND 99 AS serial, 'Brand-' || p_size || ' total' AS row_label, [CAST(2000 + p_size % 30 AS VARCHAR), 'FY' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0')] AS years FROM part""")
def table_texts(read, spark):
    z = F.col("p_size")
    scale = cases(z % 4, l("(₹ in crore)"), l("in lakhs"), l("Rs in Million"), l("in units"))
    text = F.concat(l("Table "), scale, l(" "), cases(z % 3, l("consolidated, standalone"), l("consolidated"), l("group")))
    cells = F.array((z % 100).cast("string"), l(""), F.concat(l("Brand-x"), l("  total")), l("5"))
    label = F.replace(N.row_label(cells), l("x"), z.cast("string"))
    years = N.years_in(F.array(F.concat(l("March "), (2000 + z % 30).cast("string")), F.concat(l("FY"), two(z % 100), l(" and "), (2000 + z % 30).cast("string"))))
    phrase = labels.scale_phrase(text)
    return read("part").select("p_partkey", N.scale_in(text).alias("scale"), N.basis_in(text).alias("basis"), labels.multiplier_of(phrase).alias("multiplier"), phrase.alias("phrase"), N.is_serial(l(0), (z % 100).cast("string")).alias("serial"), label.alias("row_label"), years.alias("years"))


WORDS = "list_distinct(list_filter(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: CASE w WHEN 'eps' THEN ['earnings', 'per', 'share'] WHEN 'crar' THEN ['capital', 'adequacy', 'ratio'] WHEN 'npa' THEN ['non', 'performing', 'assets'] WHEN 'npas' THEN ['non', 'performing', 'assets'] ELSE [w] END)), lambda w: NOT list_contains(['of','and','the','in','on','or','to','for','from','by','a','an','with','at'], w)))"


@query(f"""WITH w AS (SELECT doc_id, {WORDS.format("substr(text, 1, 60)")} AS mine, {WORDS.format("substr(text, 20, 200)")} AS theirs, {WORDS.format("substr(text, 1, 30)")} AS short FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(greatest(CASE WHEN len(mine) > 0 THEN len(list_intersect(mine, theirs))::DOUBLE / len(mine) ELSE 0 END, CASE WHEN len(short) > 0 THEN len(list_intersect(short, theirs))::DOUBLE / len(short) ELSE 0 END), 9) AS share, CAST(len(theirs) AS INTEGER) AS words
FROM w WHERE NOT list_has_any(theirs || mine, ['basic', 'diluted', 'gross', 'net', 'discontinued'])""")
def label_shares(read, spark):
    """Words of whole labels; the exclusive pairs are tested on fixtures."""
    t = F.col("text")
    a, b, c = F.substring(t, 1, 60), F.substring(t, 20, 200), F.substring(t, 1, 30)
    rows = read("documents").filter("text IS NOT NULL").select("doc_id", labels.label_share(F.array(a, c), l(None).cast("string"), b).alias("share"), labels.label_words(b).alias("w"), labels.label_words(a).alias("v"))
    odd = F.array(*map(l, ("basic", "diluted", "gross", "net", "discontinued")))
    return rows.filter(~F.arrays_overlap(F.concat("w", "v"), odd)).select("doc_id", F.round("share", 9).alias("share"), F.size("w").alias("words"))


@query("""SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9&]', '', 'g') AS company, CASE s_suppkey % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'tonnes' END AS unit,
 s_suppkey || ' * 10**' || (3 + s_suppkey % 5) AS call, CASE WHEN s_suppkey % 3 = 0 THEN 'names a period' WHEN s_suppkey % 3 = 1 THEN 'no CamelCase name' END AS refusal, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 'S' || s_suppkey AS ticker, 2000 + s_suppkey % 100 AS fy, 'verify-annual-S' || s_suppkey || '-FY' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS cache, s_suppkey || '; ' || (s_suppkey + 1) || '; x; …' AS shown, 'a\\| ' || s_suppkey AS cell FROM supplier""")
def names_and_units(read, spark):
    k = F.col("s_suppkey")
    path = F.concat(l("annual/S"), s("s_suppkey"), l("-FY"), two(k % 100), l(".pdf"))
    unit = cases(k % 4, l("Rs. crore"), l("usd mn"), l(" tonnes "), l("  "))
    zeros = F.rpad(l("1"), (4 + k % 5).cast("int"), "0")
    name = cases(k % 3, l("ProfitFY25"), l("net profit"), l("NetProfit"))
    return read("supplier").select(
        "s_suppkey",
        labels.company_key(F.concat(F.col("s_name"), l(" Ltd."))).alias("company"),
        labels.unit_key(unit).alias("unit"),
        labels.canonical_call(F.concat(l("("), s("s_suppkey"), l(" * "), zeros, l(")"))).alias("call"),
        labels.metric_name_refusal(name).alias("refusal"),
        labels.slug(F.col("s_name")).alias("slug"),
        labels.ticker_of(path).alias("ticker"),
        labels.fiscal_year_of(labels.document_stem(path)).cast("bigint").alias("fy"),
        labels.cache_name(path).alias("cache"),
        labels.examples(F.array(s("s_suppkey"), (k + 1).cast("string"), s("s_suppkey"), l("x"), l("y"))).alias("shown"),
        labels.table_cell(F.concat(l("a|\n"), s("s_suppkey"))).alias("cell"),
    )


PERIODS = "p(period, first, last, quarter, length) AS (VALUES ('year', 1, 12, 'Q4', '12M'), ('Q1', 1, 3, 'Q1', '3M'), ('Q2', 4, 6, 'Q2', '3M'), ('Q3', 7, 9, 'Q3', '3M'), ('Q4', 10, 12, 'Q4', '3M'), ('H1', 1, 6, 'Q2', '6M'), ('9M', 1, 9, 'Q3', '9M'))"


@query(f"""WITH {PERIODS}, o AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), x AS (SELECT y, p.*, CAST(make_date(y - 1, 4, 1) + to_months(CAST(first - 1 AS INTEGER)) AS DATE) AS starts, last_day(CAST(make_date(y - 1, 4, 1) + to_months(CAST(last - 1 AS INTEGER)) AS DATE)) AS ends FROM o, p),
b AS (SELECT x.*, was.period AS was, was.ends AS was_ends, was.y AS was_y FROM x JOIN x was ON was.y = x.y - 1)
SELECT y, period, quarter, length, was, CASE WHEN first = 1 THEN (y - 1) || ' Q4' ELSE y || ' Q' || ((first - 1) // 3) END AS opening,
 CASE WHEN NOT (period = was OR (period LIKE 'Q%' AND was LIKE 'Q%')) THEN 'not as long' WHEN was_ends >= starts THEN 'does not end before' END AS refusal,
 CASE WHEN period = 'year' THEN 'FY' || y ELSE period || ' FY' || y END || ' over ' || CASE WHEN was = 'year' THEN 'FY' || was_y ELSE was || ' FY' || was_y END AS told, period AS named FROM b""")
def fiscal_times(read, spark):
    years = read("orders").select(F.year("o_orderdate").alias("y")).distinct()
    names = spark.createDataFrame([(p,) for p in ("year", "Q1", "Q2", "Q3", "Q4", "H1", "9M")], "period string")
    x = years.join(F.broadcast(names), l(True)).join(F.broadcast(names.withColumnRenamed("period", "was")), l(True)).join(years.select((F.col("y") + 1).alias("y")), "y")  # seven periods
    t, o = times.as_time(F.col("period")), times.opening_of(F.col("y"), F.col("period"))
    return x.select(
        "y", "period", t["quarter"].alias("quarter"), t["length"].alias("length"), "was",
        F.concat_ws(" ", o["year"].cast("string"), o["period"]).alias("opening"),
        times.interval_refusal(F.col("y"), F.col("period"), F.col("y") - 1, F.col("was")).alias("refusal"),
        times.period_phrase(F.col("y"), F.col("period"), F.col("y") - 1, F.col("was"), l(False)).alias("told"),
        times.as_period(t["quarter"], t["length"], l(False))["period"].alias("named"),
    )


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'scope is * or a list of known scopes' END AS refusal, CASE n_nationkey % 4 WHEN 1 THEN '*' WHEN 2 THEN 'AFRICA,ASIA' WHEN 3 THEN '*' WHEN 0 THEN 'MARS' END AS normal, n_nationkey % 4 IN (1, 2, 3) AS covers_asia FROM nation""")
def scope_rules(read, spark):
    every = [r.r_name.strip() for r in read("region").select("r_name").collect()]  # five regions
    spec = cases(F.col("n_nationkey") % 4, l("MARS"), l(" * "), l("ASIA, AFRICA,ASIA"), l(",".join(every)))
    return read("nation").select("n_nationkey", scopes.refusal(spec, every).alias("refusal"), scopes.normal(spec, every).alias("normal"), scopes.covers(spec, l("ASIA"), every).alias("covers_asia"))


@query("""WITH u AS (SELECT doc_id, lang, n_chars AS n, n_chars // 10 AS w, n_chars // 20 AS h, doc_id % 3 AS web, doc_id % 2 = 0 AS batched, CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 5.0 END AS i, CASE lang WHEN 'en' THEN 10.0 WHEN 'de' THEN 25.0 END AS o FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, round(coalesce(web * 0.01 + 1e-6 * CASE WHEN batched THEN 0.5 ELSE 1 END * (n * i + 100 * o + (w - h) * i * 1.25 + h * i * 2.0 + 50 * i * 0.1), 0), 9) AS cost, round(coalesce(1e-6 * (n * i * 1.25 + 1000 * o), 0), 9) AS worst,
 CAST(coalesce(greatest(0, floor((0.05 - 1e-6 * n * i) / (o * 1e-6)) - 1), 0) AS BIGINT) AS affordable, CASE WHEN i IS NULL THEN 'no price' WHEN 1e-6 * (n * i * 1.25 + 1000 * o) > 0.02 THEN 'above the limit' END AS refusal FROM u""")
def request_costs(read, spark):
    prices = spark.createDataFrame([("en", 2.0, 10.0), ("de", 5.0, 25.0)], "lang string, input double, output double")
    rows = read("documents").filter("n_chars IS NOT NULL AND lang IS NOT NULL").join(F.broadcast(prices.select("lang", F.struct("input", "output", l(None).cast("double").alias("cached_input")).alias("price"))), "lang", "left")  # a price list
    n, p = F.col("n_chars"), F.col("price")
    cost = costs.cost(p, n, l(100), written=F.floor(n / 10), written_hour=F.floor(n / 20), read=l(50), searches=F.col("doc_id") % 3, batched=F.col("doc_id") % 2 == 0)
    worst = costs.worst_case(p, n, l(1000), cached=True)
    return rows.select("doc_id", F.round(cost, 9).alias("cost"), F.round(worst, 9).alias("worst"), costs.affordable_output(p, n, l(0.05)).alias("affordable"), costs.refusal(p, worst, l(0.02)).alias("refusal"))


@query("""SELECT conv_id, turn, ['DOC-' || conv_id || '#0001', 'DOC#0002'] AS cited, CASE WHEN turn % 2 = 0 THEN ['cites passages it never retrieved: DOC#0002'] ELSE [] END AS broken,
 'FACT:C' || conv_id || ':2025:standalone:Q1:Turn' || turn || CASE WHEN turn % 2 = 1 THEN ':' || role ELSE '' END AS cite_as, role || ' · p.' || turn AS chunk, CASE WHEN turn % 3 = 0 THEN '{"a": ' || turn || '}' END AS object FROM conversations""")
def answer_guards(read, spark):
    c, t = s("conv_id"), s("turn")
    answer = F.concat(l("So [DOC-"), c, l("#0001; DOC#0002] and not DOC#0003."))
    found = F.when(F.col("turn") % 2 == 0, F.array(F.concat(l("DOC-"), c, l("#0001")))).otherwise(F.array(F.concat(l("DOC-"), c, l("#0001")), l("DOC#0002")))
    segment = F.when(F.col("turn") % 2 == 1, F.col("role"))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(l('here {"a": '), t, l("} it is"))).otherwise("none")
    return read("conversations").select("conv_id", "turn", citations.cited(answer).alias("cited"), citations.violations(answer, found).alias("broken"), citations.fact_citation(F.concat(l("C"), c), l(2025), l("standalone"), l("Q1"), F.concat(l("Turn"), t), segment).alias("cite_as"), citations.chunk_citation(F.col("role"), F.col("turn"), l("")).alias("chunk"), citations.first_object(reply).alias("object"))


@query("""SELECT kind, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)(sk-[a-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)')) AS withheld, count(*) FILTER (WHERE regexp_replace(text, '(?i)(sk-[a-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)', '[redacted]', 'g') <> text) AS masked
FROM (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY 1""")
def masked_texts(read, spark):
    both = read("documents").select(l("documents").alias("kind"), "text").unionByName(read("conversations").select(l("conversations").alias("kind"), "text"))
    broken = citations.violations(F.col("text"), F.array().cast("array<string>"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(citations.shown(F.col("text"), broken) == citations.WITHHELD).alias("withheld"), F.count_if(citations.masked(F.col("text")) != F.col("text")).alias("masked"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, 'Q' || (1 + (month(d) + 8) % 12 // 3) || ' FY' || (year(d) + CAST(month(d) > 3 AS INTEGER)) || ' (' || day(d) || ' ' || monthname(d) || ' ' || year(d) || ')' AS quarter,
 CASE k WHEN 0 THEN 'at ' || d WHEN 1 THEN 'ending ' || d WHEN 2 THEN '3 months to ' || d ELSE 'no date read' END AS period, CASE WHEN k = 0 THEN 0.5::DOUBLE WHEN k = 1 THEN 1 ELSE 2 END AS multiplier, CASE WHEN k < 2 THEN NULL WHEN k = 2 THEN 'changes no share count' ELSE 'no ratio of shares after to before' END AS refusal FROM o""")
def period_texts(read, spark):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    end, months = F.when(k < 3, d), cases(k, l(0), l(None).cast("int"), l(3))
    before, after = cases(k, l(1), l(None).cast("int"), l(4), l(4)), cases(k, l(2), l(5), l(2), l(2))
    ratio = K.ratio_parsed(cases(k, l("2:1"), l(" 3 : 1"), l("2:2"), l("two")))
    return read("orders").select("o_orderkey", N.quarter_end(d).alias("quarter"), N.period_text(end, months).alias("period"), K.event_multiplier(before, after).cast("double").alias("multiplier"), ratio["refusal"].alias("refusal"))


@query("""SELECT p_partkey, CAST(p_size * 2 + 1 AS DOUBLE) AS calculated, CAST(p_size AS DOUBLE) * 1000 AS factor, 0.5 * 1e7 AS allowed, len(rtrim(CAST(p_size AS VARCHAR), '0')) AS digits FROM part""")
def arithmetic_texts(read, spark):
    z = F.col("p_size").cast("string")
    return dealt(read("part").select("p_partkey", "p_size")).select("p_partkey", python.calculated(F.concat(l("("), z, l(" * 4 + 2) / 2"))).alias("calculated"), python.multiplier(F.concat(z, l(" * 10 ** 3"))).alias("factor"), python.tolerance_of(F.concat(z, l(" * 10**7")), l(1.0)).alias("allowed"), python.significant(F.col("p_size").cast("double")).cast("bigint").alias("digits"))
