"""Queries of what is kept between runs: indexes, derived rows, the fact store, journals, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.catalogue.core import bench, bm25_sql
from tallyforge.operators import crossval, identity, lineage
from tallyforge.operators.classifier import folded
from tallyforge.operators.journal import Journal
from tallyforge.operators.postings import Postings
from tallyforge.plans import build
from tallyforge.register import query
from tallyforge.sinks.derived import Derived
from tallyforge.sinks.snapshots import shared_folder, written

l = F.lit  # noqa: E741
s = lambda c: F.col(c).cast("string")


@query(
    f"""WITH {bm25_sql(5)}
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""
)
def bm25_stored(read, spark):
    """Two segments, indexed one after the other, and a search that reads the index alone."""
    index = Postings(spark, shared_folder(spark, "postings"))
    docs = read("documents").filter("text IS NOT NULL").select("doc_id", "text")
    for part in (0, 1):
        index.add(docs.filter(F.col("doc_id") % 2 == part))
    return index.bm25(bench(read), k=5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {bm25_sql(5).replace("text IS NOT NULL", "text IS NOT NULL AND doc_id % 7 <> 3")}
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""
)
def bm25_merged(read, spark):
    """Three segments made one, without the documents that are gone."""
    index = Postings(spark, shared_folder(spark, "postings"))
    docs = read("documents").filter("text IS NOT NULL").select("doc_id", "text")
    for part in (0, 1, 2):
        index.add(docs.filter(F.col("doc_id") % 3 == part))
    index.merged(docs.filter("doc_id % 7 = 3").select("doc_id"))
    return index.bm25(bench(read), k=5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def page_parts(pages):
    """Of each page its tags, their number and the hash of their names."""
    tags = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"<([a-z]+)"), 1)
    return pages.select("content_key", F.size(tags).alias("tags"), F.md5(F.array_join(tags, " ")).alias("names"))


@query(
    r"""WITH first AS (SELECT html AS h FROM pages WHERE html IS NOT NULL AND page_id % 3 <> 0),
    second AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || '<b>' || page_id || '</b>' ELSE html END AS h FROM pages WHERE html IS NOT NULL),
    n AS (SELECT count(DISTINCT h) AS new FROM second WHERE h NOT IN (SELECT h FROM first))
    SELECT page_id, CAST(len(regexp_extract_all(h, '<([a-z]+)', 1)) AS INTEGER) AS tags, md5(array_to_string(regexp_extract_all(h, '<([a-z]+)', 1), ' ')) AS names, new FROM second, n"""
)
def pages_derived(read, spark):
    """A store filled with two thirds of the pages, and then with all, a fifth of them changed: only contents that are new are
    parsed, in batches; a third run parses none."""
    pages = read("pages").filter("html IS NOT NULL").select("page_id", F.encode("html", "UTF-8").alias("html"))
    store = Derived(spark, shared_folder(spark, "pages"), page_parts, "content_key string, tags int, names string")
    store.update(pages.filter("page_id % 3 <> 0"), "html")
    mark = F.encode(F.concat(l("<b>"), s("page_id"), l("</b>")), "UTF-8")
    now = pages.withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", mark)).otherwise(F.col("html")))
    new = store.update(now, "html", batch_bytes=1 << 22)
    if store.update(now, "html"):
        raise ValueError("contents were derived twice")
    return store.read(now, "html").select("page_id", "tags", "names", l(new).cast("long").alias("new"))


def parsed_lines(lines):
    """Lines of orders as facts of a filing."""
    return lines.select(
        s("l_orderkey").alias("filing_id"),
        F.concat(l("line"), s("l_linenumber")).alias("concept"),
        l(None).cast("date").alias("period_start"),
        F.to_date("l_shipdate").alias("period_end"),
        l(None).cast("string").alias("segment"),
        l("INR").alias("unit"),
        F.col("l_quantity").cast("double").alias("value"),
        l(0).alias("decimals"),
    )


@query(
    """WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, 'line' || l_linenumber AS concept, l_orderkey AS k, l_linenumber AS n, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
    a AS (SELECT * FROM v WHERE k % 2 = 0),
    b AS (SELECT filing_id, concept, CASE WHEN n = 1 AND k % 2 = 0 THEN value + 1 ELSE value END AS value FROM v WHERE (k % 4 = 0 AND n <> 2) OR k % 4 = 1),
    f AS (SELECT filing_id, concept, value FROM b UNION ALL SELECT filing_id, concept, value FROM a WHERE filing_id NOT IN (SELECT filing_id FROM b)),
    c AS (SELECT (SELECT count(*) FROM b WHERE CAST(filing_id AS BIGINT) % 4 = 1) AS added, (SELECT count(*) FROM a WHERE k % 4 = 0 AND n = 1) AS changed, (SELECT count(*) FROM a WHERE n = 2 AND filing_id IN (SELECT filing_id FROM b)) AS removed)
    SELECT filing_id, concept, value, added, changed, removed, 2 AS version FROM f, c"""
)
def build_rounds(read, spark):
    """Two rounds of filings and the second once more, which commits nothing. Every order is a filing."""
    store = build.Store(spark, shared_folder(spark, "facts"), buckets=16)
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    # those of either round, dealt once by their order: what the rounds then ask of an order is at one place
    lines = read("lineitem").filter((k % 2 == 0) | (k % 4 == 1)).select(k, n, "l_quantity", "l_shipdate").repartition("l_orderkey")
    lines = written(lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_shipdate").alias("l_shipdate")), "lines")
    listed = lambda rows: rows.select(s("l_orderkey").alias("filing_id"), F.md5(s("l_orderkey")).alias("sha"), l("2026-01-01").cast("timestamp").alias("fetched"), l(None).cast("timestamp").alias("broadcast")).distinct()
    first = lines.filter(k % 2 == 0)
    second = lines.filter(((k % 4 == 0) & (n != 2)) | (k % 4 == 1)).withColumn("l_quantity", F.when((n == 1) & (k % 2 == 0), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    store.apply(listed(first), parsed_lines(first))
    counts = store.apply(listed(second), parsed_lines(second))
    store.apply(listed(second), parsed_lines(second))
    told = [l(counts.get(c, 0)).cast("long").alias(c) for c in ("added", "changed", "removed")]
    return store.facts().select("filing_id", "concept", "value", *told, l(store.tables.manifest().version).cast("int").alias("version"))


def told(text: str) -> tuple[str, float]:
    """A task that says how long its input is, at a price by letters."""
    return str(len(text)), len(text) / 8


def marked(text: str) -> tuple[str, float]:
    return text.replace("e", "#"), len(text) / 8


@query(
    """WITH c AS (SELECT item_id AS case_id, variant, text, length(text) / 8::DOUBLE AS cost FROM benchmark, (VALUES ('marked'), ('told')) v(variant) WHERE text IS NOT NULL),
    w AS (SELECT *, sum(cost) OVER (ORDER BY case_id, variant) AS total, sum(cost) OVER () * 0.4 AS most FROM c)
    SELECT case_id, variant, CASE WHEN total > most THEN NULL WHEN variant = 'told' THEN CAST(length(text) AS VARCHAR) ELSE replace(text, 'e', '#') END AS output, CASE WHEN total > most THEN 'budget' END AS error, CASE WHEN total > most THEN 0.0 ELSE cost END AS cost FROM w"""
)
def journal_waves(read, spark):
    """Two tasks over all items in waves, on two fifths of what all would cost."""
    cases = read("benchmark").filter("text IS NOT NULL").select(F.col("item_id").alias("case_id"), F.col("text").alias("input"))
    worst = F.length("input") / 8
    limit = 0.8 * (cases.agg(F.sum(worst)).first()[0] or 0.0)
    journal = Journal(spark, shared_folder(spark, "journal"), "items", cases.schema["case_id"].dataType.simpleString())
    return journal.run(cases, {"told": told, "marked": marked}, worst=worst, limit=limit, wave=100).select("case_id", "variant", "output", "error", "cost")


@query(
    """WITH hit AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey % 50 = 7),
    c AS (SELECT DISTINCT o_custkey AS c FROM orders JOIN hit ON o_orderkey = k), n AS (SELECT DISTINCT c_nationkey AS n FROM customer JOIN c ON c_custkey = c)
    SELECT 'o' || o_orderkey AS fact_id, 1 AS depth FROM orders JOIN hit ON o_orderkey = k UNION ALL SELECT 'c' || c, 2 FROM c UNION ALL SELECT 'n' || n, 3 FROM n"""
)
def stale_facts(read, spark):
    """Facts of lines, orders, customers and nations, each computed from the level below; the lines of some parts change."""
    named = lambda mark, c: F.concat(l(mark), s(c))
    line = F.concat(named("l", "l_orderkey"), l("/"), s("l_linenumber"))
    lines = read("lineitem")
    links = (
        lines.select(named("o", "l_orderkey").alias("fact_id"), line.alias("input_id"))
        .unionByName(read("orders").select(named("c", "o_custkey").alias("fact_id"), named("o", "o_orderkey").alias("input_id")))
        .unionByName(read("customer").select(named("n", "c_nationkey").alias("fact_id"), named("c", "c_custkey").alias("input_id")))
    )
    return lineage.dependants(links, lines.filter("l_partkey % 50 = 7").select(line.alias("input_id"))).select("fact_id", "depth")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, CASE WHEN o_orderkey % 11 = 0 THEN 'held' WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'unplanned' WHEN k = 2 THEN 'unknown' WHEN k = 3 THEN 'wrong' WHEN k = 4 THEN 'unchecked' WHEN k = 5 THEN 'wrong' END AS reason
    FROM (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)"""
)
def proposals_judged(read, spark):
    """Totals over orders, proposed as shares of two facts of their customer, with every fault of citing by the order's key."""
    k = F.col("o_orderkey") % 8
    fact = lambda kind, c="o_custkey": F.concat(l(kind), s(c))
    cite = lambda slot, ident: F.struct(l(slot).alias("slot"), ident.alias("input_id"))
    upper = F.when(k == 2, l("nothing")).when(k == 3, fact("below")).when(k == 4, fact("open")).when(k == 5, F.concat(l("above"), (F.col("o_custkey") + 1_000_000).cast("string"))).otherwise(fact("above"))
    cites = F.when(k == 0, F.array(cite("above", upper))).when(k == 1, F.array(cite("above", upper), cite("below", fact("below")), cite("more", fact("above")))).otherwise(F.array(cite("above", upper), cite("below", fact("below"))))
    orders = read("orders")
    proposals = orders.select(s("o_orderkey").alias("fact_id"), l("Share").alias("name"), s("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("period_end"), l(0.5).alias("value"), cites.alias("cites"))
    plan = spark.createDataFrame([("Share", "above", "Above"), ("Share", "below", "Below")], "name string, slot string, concept string")
    owners = orders.select("o_custkey").distinct()
    owners = owners.unionByName(owners.select((F.col("o_custkey") + 1_000_000).alias("o_custkey")))
    kinds = F.explode(F.array(*[F.struct(l(i).alias("id"), l(c).alias("concept"), l(t).alias("tier")) for i, c, t in (("above", "Above", "xbrl"), ("below", "Below", "row"), ("open", "Above", "xbrl-ai"))]))
    facts = owners.select("o_custkey", kinds.alias("f")).select(F.concat("f.id", s("o_custkey")).alias("input_id"), "f.concept", s("o_custkey").alias("ticker"), "f.tier")
    # a name that is held for every eleventh order; dates are made unlike by the order's number
    proposals = proposals.withColumn("period_end", F.date_add(l("1970-01-01").cast("date"), F.col("fact_id").cast("int")))
    held = proposals.filter(F.col("fact_id").cast("long") % 11 == 0).select("name", "ticker", "period_end")
    good, _, bad = lineage.written_back(proposals, plan, facts, held)
    return good.select("fact_id", l(None).cast("string").alias("reason")).unionByName(bad.select("fact_id", "reason"))


CANON = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 's' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "text", "lang", "n_chars"))


@query(
    f"""WITH h AS (SELECT source, sha256({CANON}) AS h, count(*) AS n FROM documents GROUP BY ALL),
    a AS (SELECT source, h[1:6] AS p, sha256(string_agg(h || ':' || n, '' ORDER BY h)) AS h, sum(n) AS n FROM h GROUP BY ALL),
    b AS (SELECT source, p[1:3] AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM (SELECT source, p AS q, h, n, p FROM a) GROUP BY source, p[1:3])
    SELECT source, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM b GROUP BY source"""
)
def source_digests(read, spark):
    """What each source's documents are, whatever their order."""
    return identity.digests(read("documents"), ["doc_id", "text", "lang", "n_chars"], ["source"])


@query(
    """WITH r AS (SELECT doc_id, ('0x' || md5('7:' || doc_id)[1:8])::BIGINT % 5 AS fold, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    t AS (SELECT fold, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM r WHERE w IS NOT NULL),
    c AS (SELECT fold, doc_id, term, count(*) AS n FROM t GROUP BY ALL)
    SELECT CAST(fold AS INTEGER) AS fold, count(DISTINCT doc_id) AS rows, count(DISTINCT term) AS terms, count(*) AS entries, CAST(sum(n) AS BIGINT) AS counted FROM c GROUP BY fold"""
)
def fold_terms(read, spark):
    """The folds of all documents, and the words and pairs that a fold's rows count."""
    rows = folded(read("documents").select(F.col("doc_id").alias("key"), "text"))
    # one row a fold and term is dealt, however many rows count the term
    by_term = crossval.term_counts(rows, "fold").groupBy("fold", "term").agg(F.count("*").alias("entries"), F.sum("n").alias("counted"))
    sums = by_term.groupBy("fold").agg(F.count("*").alias("terms"), F.sum("entries").alias("entries"), F.sum("counted").alias("counted"))
    there = rows.filter(F.lower("text").rlike("[a-z0-9]")).groupBy(F.col("fold").alias("f")).agg(F.count_distinct("key").alias("rows"))
    return sums.join(F.broadcast(there), F.col("fold").eqNullSafe(F.col("f"))).select("fold", "rows", "terms", "entries", "counted")  # a row a fold
