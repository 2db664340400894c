"""Every query of the engine's own operators by name, over whole tables, with the SQL that gives the same rows.

Facts are made from the order tables: a customer's nation stands for a company, an order for a filing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import periods as P
from tallyforge.functions import text as X
from tallyforge.functions.binding import let
from tallyforge.functions.labels import FULL_CASE
from tallyforge.operators import crosscheck as C
from tallyforge.operators import documents as D
from tallyforge.operators import evaluation as E
from tallyforge.operators import facts as A
from tallyforge.operators import ranges as G
from tallyforge.operators import retrieval as R
from tallyforge.operators.classifier import out_of_fold
from tallyforge.plans.metrics import Metric, Metrics
from tallyforge.register import query
from tallyforge.sizes import sized, spread
from tallyforge.streaming import events as S

def folded(c: str) -> str:
    for a, b in FULL_CASE:
        c = f"replace({c}, '{a}', '{b}')"
    return c


TOK = f"regexp_extract_all({folded('lower(text)')}, '{X.TOKEN}')"


def bm25_sql(k: int, k1: float = 1.5, b: float = 0.75) -> str:
    return f"""
    tok AS (SELECT doc_id, {TOK} AS t FROM documents WHERE text IS NOT NULL),
    stat AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
    asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) GROUP BY 1, 2),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
    idf AS (SELECT term, mean, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), stat),
    scored AS (SELECT query_id, doc_id, round(sum(idf * times * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / mean))), 9) AS score FROM tf JOIN asked USING (term) JOIN idf USING (term) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def bench(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("query_id"), "text")


def ranked(read, k: int, **kw) -> DataFrame:
    return R.bm25(read("documents").select("doc_id", "text").filter("text IS NOT NULL"), bench(read), k=k, **kw)


@query(f"WITH {bm25_sql(5)} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def bm25_topk(read, spark):
    return ranked(read, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH c AS (SELECT label, i, avg(embedding[i]) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM c GROUP BY 1),
s AS (SELECT query_id, vec_id, round(list_dot_product(q, CAST(embedding AS DOUBLE[])), 9) AS score FROM embeddings, q)
SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def dense_topk(read, spark):
    e = read("embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return R.dense(e.select("vec_id", F.col("embedding").alias("v")), means, k=5).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


LETTERS = "etaoinshrdlucmfwyp"


def letter_vector(text):
    """A stand-in for a model: how often each of some letters stands in a text, as a vector of unit length."""
    # within lambdas nothing is shared, so what is used often is named
    count = lambda low, c: (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double")
    counts = let(F.lower(text), lambda low: F.array(*[count(low, c) for c in LETTERS], F.lit(1.0)))
    scaled = lambda v, length: F.transform(v, lambda x: x / length)
    return let(counts, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), lambda length: scaled(v, length)))


def letter_sql(text: str) -> str:
    counts = ", ".join(f"(length(lower({text})) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in LETTERS)
    return f"list_transform([{counts}, 1.0::DOUBLE], lambda x: x / sqrt(list_sum(list_transform([{counts}, 1.0::DOUBLE], lambda y: y * y))))"


def dense_sql(k: int) -> str:
    return f"""dv AS (SELECT doc_id, {letter_sql("text")} AS v FROM documents WHERE text IS NOT NULL), qv AS (SELECT item_id AS query_id, {letter_sql("text")} AS q FROM benchmark),
    near AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(list_dot_product(q, v), 9) AS score FROM dv, qv)) WHERE rank <= {k})"""


FUSED = """u AS (SELECT query_id, doc_id AS id, rank, 0 AS l FROM near UNION ALL SELECT query_id, doc_id, rank, 1 FROM ranked WHERE rank <= 100),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min((l, rank)) AS seen FROM u GROUP BY 1, 2)"""


@query(f"WITH {bm25_sql(100)}, {dense_sql(100)}, {FUSED} SELECT query_id, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM f) WHERE rank <= 5")
def hybrid_rrf(read, spark):
    """A dense and a lexical arm, fused."""
    found = R.rankers(letter_vector)["hybrid"](read("documents"), bench(read), 5)
    return found.select("query_id", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {bm25_sql(5)}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM ranked WHERE doc_id % 3 = query_id % 3) SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS INTEGER) AS rank FROM c WHERE place <= 3""")
def scoped_topk(read, spark):
    docs, asked = read("documents").filter("text IS NOT NULL").select("doc_id", "text"), bench(read)
    scores = R.Terms(docs, asked).scored(1.5, 0.75)
    found = R.scoped_by(scores, asked.select("query_id", (F.col("query_id") % 3).alias("r")), docs.select("doc_id", (F.col("doc_id") % 3).alias("r")), 3)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {bm25_sql(20)}, c AS (SELECT query_id, doc_id AS id, rank AS before FROM ranked WHERE rank <= 20),
s AS (SELECT c.query_id, id, before, CAST(len(list_filter({TOK.replace('text', 'd.text')}, lambda w: list_contains({TOK.replace('text', 'b.text')}, w))) AS DOUBLE) AS score FROM c JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = c.query_id)
SELECT query_id, id, CAST(before AS INTEGER) AS before, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s) WHERE rank <= 5""")
def rerank_topk(read, spark):
    first = ranked(read, 20).select("query_id", F.col("doc_id").alias("id"), "rank")
    return R.rerank(first, bench(read), read("documents"))


def squeezed(c: str) -> str:
    marks, plain = X.CURLY, X.PLAIN.replace("'", "''")
    return folded(rf"lower(trim(regexp_replace(regexp_replace(translate({c}, '{marks}', '{plain}'), '\s+([,.;:!?%)\]])', '\1', 'g'), '\s+', ' ', 'g')))")


RESOLVED = f"resolved AS (SELECT item_id AS quote_id, doc_id FROM (SELECT doc_id, {squeezed('text')} AS t FROM documents), (SELECT item_id, {squeezed('text')} AS q FROM benchmark) WHERE contains(t, q))"


def resolved(read) -> DataFrame:
    return R.resolve_quotes(read("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), read("documents"))


@query(f"WITH {RESOLVED} SELECT * FROM resolved")
def quote_resolution(read, spark):
    return resolved(read)


@query(f"""
WITH {RESOLVED}, {bm25_sql(10)}, rel AS (SELECT quote_id AS query_id, list(doc_id ORDER BY doc_id) AS rel FROM resolved GROUP BY 1),
ids AS (SELECT query_id, list(doc_id ORDER BY rank) AS ids FROM ranked WHERE rank <= 10 GROUP BY 1)
SELECT query_id, CAST(len(list_intersect(ids[1:5], rel)) AS DOUBLE) / len(rel) AS recall_5, CAST(list_has_any(ids[1:5], rel) AS INTEGER)::DOUBLE AS hit_5,
       coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(rel, lambda r: coalesce(list_position(ids, r), 0)), lambda p: p > 0)), 0) AS rr
FROM ids LEFT JOIN rel USING (query_id)""".replace("coalesce(1.0::DOUBLE /", "CASE WHEN rel IS NOT NULL THEN coalesce(1.0::DOUBLE /").replace("), 0) AS rr", "), 0) END AS rr"))
def hit_recall_mrr(read, spark):
    rel = resolved(read).groupBy(F.col("quote_id").alias("query_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("rel"))
    ids = ranked(read, 10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    return ids.join(rel, "query_id", "left").select("query_id", *[f(F.col("ids"), F.col("rel"), 5).alias(n) for f, n in ((R.recall_at, "recall_5"), (R.hit_at, "hit_5"))], R.reciprocal_rank(F.col("ids"), F.col("rel")).alias("rr"))


GRAMS = "SELECT DISTINCT {1} AS id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS g FROM (SELECT {1}, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT {1}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {0}))"


@query(f"WITH a AS ({GRAMS.format('documents', 'doc_id')}), b AS ({GRAMS.format('benchmark', 'item_id')}) SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2")
def contamination_4gram(read, spark):
    """Runs of four words are two 64-bit hashes. Those of documents meet the benchmark's first, and only what both have is
    told apart: a document's repeats are not looked for before."""

    def grams(name: str, key: str) -> DataFrame:
        w = spread(read(name).select(key, "text")).select(key, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("w")).filter(F.size("w") >= 4)
        run = lambda i: [F.get("w", i + k) for k in range(4)]
        hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 4), lambda i: F.struct(F.xxhash64(*run(i)).alias("g"), F.xxhash64(F.lit(1), *run(i)).alias("h")))
        return w.select(key, F.inline(hashes))

    held = grams("benchmark", "item_id").distinct()
    return grams("documents", "doc_id").join(sized(held), ["g", "h"]).distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS ordinal, CAST(i * 1000 AS INTEGER) AS start, md5(substr(text, i * 1000 + 1, 1200)) AS piece
FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE length(text) > 0) WHERE length(substr(text, i * 1000 + 1, 1200)) >= 80""")
def fixed_chunks(read, spark):
    return D.fixed_chunks(read("documents")).select("doc_id", "ordinal", "start", F.md5("text").alias("piece"))


@query()
def sentence_chunks(read, spark):
    return D.sentence_chunks(read("documents"))


@query()
def html_elements(read, spark):
    return D.html_elements(read("pages"))


@query(r"""
WITH l AS (SELECT source, doc_id, pos, line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents), LATERAL (SELECT unnest(x) AS line, unnest(range(len(x))) AS pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY pos) AS up, row_number() OVER (PARTITION BY source, doc_id ORDER BY pos DESC) AS down FROM l WHERE trim(line) <> ''),
p AS (SELECT source, count(DISTINCT doc_id) AS n_of FROM l GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4),
s AS (SELECT source, regexp_replace(trim(line), '\d+', '#', 'g') AS skeleton, count(DISTINCT doc_id) AS pages FROM f WHERE up <= 2 OR down <= 2 GROUP BY 1, 2)
SELECT source, skeleton, pages, n_of FROM s JOIN p USING (source) WHERE pages >= 0.02 * n_of""")
def furniture_lines(read, spark):
    lines = read("documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return D.furniture(lines, by="source", page="doc_id", share=0.02).withColumnRenamed("of", "n_of")


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first_id")
def exact_dedupe(read, spark):
    return D.equal_texts(read("documents"))


@query(r"""
WITH t AS (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations)
SELECT kind, CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty' WHEN length(text) > 4000 THEN 'too long' WHEN regexp_matches(text, '[\x00-\x08\x0b-\x1f\x7f]') THEN 'control characters'
  WHEN regexp_matches(text, '(?i)(sk-[a-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)') THEN 'credential' ELSE 'fine' END AS reason, count(*) AS n FROM t GROUP BY 1, 2""")
def guard_flags(read, spark):
    both = read("documents").select(F.lit("documents").alias("kind"), "text").union(read("conversations").select(F.lit("conversations"), "text"))
    return both.groupBy("kind", F.coalesce(X.guard_reason(F.col("text")), F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, {squeezed('text')} AS folded, regexp_replace(trim(text), '\\d+', '#', 'g') AS masked, substr(sha256(text), 1, 32) AS text_key, CAST(len({TOK}) AS INTEGER) AS n_tokens FROM conversations")
def text_functions(read, spark):
    t = F.col("text")
    return read("conversations").select("conv_id", "turn", X.squeeze(t).alias("folded"), X.skeleton(t).alias("masked"), X.text_key(t).alias("text_key"), F.size(X.tokens(t)).alias("n_tokens"))


FACTS = """facts AS (SELECT l_orderkey AS filing, 'quantity' AS concept, CAST(l_shipdate AS DATE) AS period_end, l_quantity AS value FROM lineitem
 UNION ALL SELECT l_orderkey, 'price', CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem UNION ALL SELECT l_orderkey, 'discount', CAST(l_shipdate AS DATE), l_discount FROM lineitem
 UNION ALL SELECT l_orderkey, 'tax', CAST(l_shipdate AS DATE), l_tax FROM lineitem)"""


def melted(read) -> DataFrame:
    return read("lineitem").select(F.col("l_orderkey").alias("filing"), F.to_date("l_shipdate").alias("period_end"), F.expr("stack(4, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS (concept, value)"))


@query(f"WITH {FACTS} SELECT concept, CAST(year(period_end) + CAST(month(period_end) > 3 AS INTEGER) AS INTEGER) AS fy, count(*) AS n, round(sum(value), 2) AS total, max(value) AS largest FROM facts GROUP BY 1, 2")
def fact_melt(read, spark):
    return melted(read).groupBy("concept", P.fiscal_year(F.col("period_end")).alias("fy")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("largest"))


@query("""SELECT concept, count(*) FILTER (WHERE instant) AS instants, count(*) FILTER (WHERE NOT instant) AS durations
FROM (SELECT o_orderpriority AS concept, o_orderstatus <> 'F' AS instant FROM orders) GROUP BY 1 HAVING count(*) FILTER (WHERE instant) > count(*) FILTER (WHERE NOT instant)""")
def mostly_instants(read, spark):
    start = F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))
    return A.mostly_instants(read("orders").select(F.col("o_orderpriority").alias("concept"), start.alias("period_start")))


@query("""
WITH w AS (SELECT l_orderkey AS filing, round(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE, 0) AS gross, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) / 100.0::DOUBLE AS net, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) / 100.0::DOUBLE AS off FROM lineitem GROUP BY 1)
SELECT filing, gross AS stated, round(net + off, 2) AS added, 0.015::DOUBLE AS slack FROM w WHERE abs(gross - (net + off)) > 0.015""")
def sum_check(read, spark):
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    cents = lambda x: F.sum(F.round(x * 100).cast("long")) / 100.0
    w = read("lineitem").groupBy(F.col("l_orderkey").alias("filing")).agg(F.round(cents(price), 0).alias("gross"), cents(price * (1 - off)).alias("net"), cents(price * off).alias("off"))
    facts = w.select("filing", F.expr("stack(3, 'gross', gross, 'net', net, 'off', off) AS (concept, value)"), F.lit(2).alias("decimals"))
    return A.sum_issues(facts, "gross", ["net", "off"], [], ["filing"]).select("filing", "stated", F.round("added", 2).alias("added"), F.round("slack", 4).alias("slack"))


SNAPSHOTS = """old AS (SELECT o_custkey AS filing_id, o_orderkey, o_totalprice AS value, CASE WHEN o_orderpriority LIKE '1%' THEN 'xbrl' ELSE 'xbrl-ai' END AS tier FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
new AS (SELECT o_custkey AS filing_id, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01')"""


@query(f"""WITH {SNAPSHOTS}, held AS (SELECT * FROM old WHERE filing_id IN (SELECT filing_id FROM new))
SELECT coalesce(h.filing_id, n.filing_id) AS filing_id, CAST(coalesce(h.o_orderkey, n.o_orderkey) AS VARCHAR) AS concept, coalesce(n.value, h.value) AS value,
 CASE WHEN h.filing_id IS NULL THEN 'added' WHEN n.filing_id IS NULL THEN 'removed' WHEN h.value = n.value THEN 'kept' ELSE 'changed' END AS change,
 CASE WHEN h.filing_id IS NULL OR (n.filing_id IS NOT NULL AND h.value <> n.value) THEN 'xbrl-ai' ELSE h.tier END AS tier
FROM held h FULL JOIN new n ON h.filing_id = n.filing_id AND h.o_orderkey = n.o_orderkey""")
def fact_sync(read, spark):
    o = read("orders")
    common = [F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").cast("string").alias("concept"), F.lit(None).cast("date").alias("period_start"), F.to_date("o_orderdate").alias("period_end"), F.lit(None).cast("string").alias("segment"), F.lit("INR").alias("unit"), F.lit(2).alias("decimals")]
    held = o.filter("o_orderdate < '1997-01-01'").select(*common, F.col("o_totalprice").alias("value"), F.when(F.col("o_orderpriority").startswith("1"), "xbrl").otherwise("xbrl-ai").alias("tier"), F.lit(None).cast("string").alias("verified_by"))
    parsed = o.filter("o_orderdate >= '1993-01-01'").select(*common, F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("value"))
    return A.sync(held, parsed).select("filing_id", "concept", "value", "change", "tier")


@query("""WITH o AS (SELECT o_custkey AS origin, min(o_totalprice) AS sha, NULL::DOUBLE AS broadcast FROM orders GROUP BY 1), c AS (SELECT c_custkey AS origin, 0.0::DOUBLE AS sha, c_acctbal AS broadcast FROM customer)
SELECT coalesce(c.origin, o.origin) AS origin, coalesce(o.sha, c.sha) AS sha, coalesce(o.broadcast, c.broadcast) AS broadcast FROM c FULL JOIN o ON c.origin = o.origin""")
def filing_upsert(read, spark):
    old = read("customer").select(F.col("c_custkey").alias("origin"), F.lit(0.0).alias("sha"), F.col("c_acctbal").alias("broadcast"))
    new = read("orders").groupBy(F.col("o_custkey").alias("origin")).agg(F.min("o_totalprice").alias("sha"), F.lit(None).cast("double").alias("broadcast"))
    return A.upsert(old, new, "origin", ["sha"], ["broadcast"])


@query("""SELECT concept, fact_id, value, tier FROM (SELECT o_orderpriority AS concept, o_orderkey AS fact_id, o_totalprice AS value, CASE o_orderstatus WHEN 'F' THEN 'xbrl-filed' ELSE 'xbrl-ai' END AS tier,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, CAST(o_orderdate AS DATE), o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY concept LIMIT 5""")
def lookup_priority(read, spark):
    facts = read("orders").select(F.col("o_orderpriority").alias("concept"), F.col("o_orderkey").alias("fact_id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", "xbrl-filed").otherwise("xbrl-ai").alias("tier"), F.to_date("o_orderdate").alias("filed"))
    wanted = facts.select("concept").distinct().withColumn("place", F.col("concept"))
    return A.lookup(facts, wanted).select("concept", "fact_id", "value", "tier")


SALES = """sales AS (SELECT n_name AS nation, CAST(year(o_orderdate) + CAST(month(o_orderdate) > 3 AS INTEGER) AS INTEGER) AS fy, round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS orders
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def sales(read) -> DataFrame:
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return joined.groupBy(F.col("n_name").alias("nation"), P.fiscal_year(F.to_date("o_orderdate")).alias("fy")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").cast("double").alias("orders"))


@query(f"WITH {SALES} SELECT a.nation, a.fy, round((a.revenue - b.revenue) / abs(b.revenue), 9) AS growth FROM sales a LEFT JOIN sales b ON a.nation = b.nation AND a.fy = b.fy + 1")
def fiscal_growth(read, spark):
    facts = sales(read).select("nation", "fy", F.lit("revenue").alias("concept"), F.col("revenue").alias("value"))
    m = Metrics([Metric("growth", "(now - before) / abs(before)", {"now": ("revenue", "current"), "before": ("revenue", "previous")})])
    return m.evaluate("growth", facts, ["nation"], "fy").select("nation", "fy", F.round("metric", 9).alias("growth"))


@query(f"WITH {SALES} SELECT a.nation, a.fy, round((a.revenue / a.orders) / ((a.orders + b.orders) / 2), 9) AS value FROM sales a LEFT JOIN sales b ON a.nation = b.nation AND a.fy = b.fy + 1")
def derived_metric(read, spark):
    facts = sales(read).select("nation", "fy", F.expr("stack(2, 'revenue', revenue, 'orders', orders) AS (concept, value)"))
    m = Metrics([
        Metric("per_order", "revenue / orders", {"revenue": ("revenue", "current"), "orders": ("orders", "current")}),
        Metric("per_order_on_average", "value / ((now + opening) / 2)", {"value": ("per_order", "current"), "now": ("orders", "current"), "opening": ("orders", "opening")}),
    ])
    return m.evaluate("per_order_on_average", facts, ["nation"], "fy").select("nation", "fy", F.round("metric", 9).alias("value"))


MONTHLY = "m AS (SELECT c_nationkey AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_end, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def monthly(read) -> DataFrame:
    return read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("ticker"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period_end")).agg(F.count("*").alias("count"))


@query(f"""WITH {MONTHLY}, p AS (SELECT ticker, lag(period_end) OVER w AS seen_from, period_end AS seen_to, n::DOUBLE / lag(n) OVER w AS seen_ratio FROM m WINDOW w AS (PARTITION BY ticker ORDER BY period_end))
SELECT ticker, seen_from, seen_to, round(seen_ratio, 9) AS seen_ratio FROM p WHERE abs(seen_ratio - 1) > 0.05 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = ticker AND DATE '1995-06-15' > seen_from AND DATE '1995-06-15' <= seen_to)""")
def jump_events(read, spark):
    events = read("nation").select(F.col("n_nationkey").alias("ticker"), F.to_date(F.lit("1995-06-15")).alias("effective"))
    return A.jumps(monthly(read), events).select("ticker", "seen_from", "seen_to", F.round("seen_ratio", 9).alias("seen_ratio"))


@query(f"""WITH {MONTHLY}, e AS (SELECT n_nationkey AS ticker, DATE '1995-06-15' AS effective, 0.5::DOUBLE AS multiplier, n_regionkey <> 2 AS checked FROM nation UNION ALL SELECT n_nationkey, DATE '1996-09-01', 0.8, TRUE FROM nation),
i AS (SELECT *, max(period_end) OVER (PARTITION BY ticker) AS latest FROM m),
j AS (SELECT i.ticker, i.period_end, i.n, coalesce(product(multiplier), 1) AS f, coalesce(bool_or(NOT checked), FALSE) AS open FROM i LEFT JOIN e ON i.ticker = e.ticker AND effective > period_end AND effective <= latest GROUP BY 1, 2, 3)
SELECT ticker, CAST(period_end AS VARCHAR) AS input_id, CASE WHEN NOT open THEN round(n * f, 6) END AS restated FROM j""")
def restated_inputs(read, spark):
    n = read("nation")
    events = n.select(F.col("n_nationkey").alias("ticker"), F.to_date(F.lit("1995-06-15")).alias("effective"), F.lit(0.5).alias("multiplier"), (F.col("n_regionkey") != 2).alias("checked")).union(n.select("n_nationkey", F.to_date(F.lit("1996-09-01")), F.lit(0.8), F.lit(True)))
    inputs = monthly(read).select("ticker", F.col("period_end").cast("string").alias("input_id"), F.col("period_end").alias("published"), F.col("count").cast("double").alias("value"))
    return A.restated(inputs, events).select("ticker", "input_id", F.round("restated", 6).alias("restated"))


@query("SELECT o_orderkey AS fact_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def promotion(read, spark):
    links = read("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("input_id"))
    facts = read("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.when(F.col("l_returnflag") == "R", "xbrl-ai").otherwise("xbrl").alias("tier"))
    return A.promote(read("orders").select(F.col("o_orderkey").alias("fact_id")), links, facts)


@query("""SELECT p_brand, count(DISTINCT n_regionkey) AS scopes FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1 HAVING count(DISTINCT n_regionkey) = (SELECT count(*) FROM region)""")
def scope_intersection(read, spark):
    where = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    pairs = read("lineitem").select("l_partkey", "l_suppkey").join(where, F.col("l_suppkey") == F.col("s_suppkey")).join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "n_regionkey").distinct()
    return pairs.groupBy("p_brand").agg(F.count("*").alias("scopes")).join(F.broadcast(read("region").agg(F.count("*").alias("of"))), F.col("scopes") == F.col("of")).select("p_brand", "scopes")


@query("""WITH w AS (SELECT l_suppkey AS case_id, l_quantity AS q, l_discount AS d, count(*) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3), g AS (SELECT l_suppkey AS case_id, l_quantity AS q, l_discount AS d, count(*) AS g FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3),
b AS (SELECT coalesce(w.case_id, g.case_id) AS case_id, coalesce(w, 0) AS w, coalesce(g, 0) AS g FROM w FULL JOIN g ON w.case_id = g.case_id AND w.q = g.q AND w.d = g.d)
SELECT case_id, CAST(sum(least(w, g)) AS BIGINT) AS found, CAST(sum(greatest(w - g, 0)) AS BIGINT) AS missed, CAST(sum(greatest(g - w, 0)) AS BIGINT) AS extra FROM b GROUP BY 1""")
def figure_multiset_match(read, spark):
    rows = read("lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), "l_returnflag")
    return E.multiset_match(rows.filter("l_returnflag = 'R'").drop("l_returnflag"), rows.filter("l_returnflag = 'A'").drop("l_returnflag"), ["q", "d"])


@query("""WITH s AS (SELECT lang AS variant, 'quality' AS grader, quality = 1 AS passed, CAST(quality AS DOUBLE) AS value FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'clean', toxic = 0, CAST(1 - toxic AS DOUBLE) FROM labels JOIN documents USING (doc_id))
SELECT variant, grader, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, round(avg(value), 9) AS mean_value, round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 9) AS rate FROM s GROUP BY 1, 2""")
def eval_report(read, spark):
    rows = read("labels").join(read("documents").select("doc_id", "lang"), "doc_id")
    none = F.lit(None).cast("string").alias("error")
    one = rows.select(F.col("lang").alias("variant"), F.lit("quality").alias("grader"), F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"), F.col("quality").cast("double").alias("value"), none)
    two = rows.select(F.col("lang").alias("variant"), F.lit("clean").alias("grader"), F.col("doc_id").alias("case_id"), (F.col("toxic") == 0).alias("passed"), (1 - F.col("toxic")).cast("double").alias("value"), none)
    return E.report(one.unionByName(two)).select("variant", "grader", "cases", "passed", F.round("mean_value", 9).alias("mean_value"), F.round("rate", 9).alias("rate"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1)
SELECT conv_id, list_contains(r, 'user') AND list_contains(r, 'assistant') AND NOT list_contains(r, 'system') AS right_tools,
 coalesce(list_position(r, 'assistant'), 0) = 0 OR (coalesce(list_position(r, 'user'), 0) > 0 AND list_position(r, 'user') < list_position(r, 'assistant')) AS in_order FROM c""")
def tool_order(read, spark):
    c = read("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return c.select("conv_id", E.right_tools(F.col("r"), F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("system"))).alias("right_tools"), E.in_order(F.col("r"), F.lit("user"), F.lit("assistant")).alias("in_order"))


@query("""WITH p AS (SELECT source, doc_id, CASE lang WHEN 'en' THEN n_chars * 3.0 / 1000000 WHEN 'de' THEN n_chars * 5.0 / 1000000 ELSE 0 END AS cost FROM documents)
SELECT doc_id, source, round(sum(cost) OVER w, 9) AS spent, round(sum(cost) OVER w, 9) > 0.2 AS tripped FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def cost_ledger(read, spark):
    usage = read("documents").select("doc_id", "source", F.col("lang").alias("model"), F.col("n_chars").alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(False).alias("batched"))
    prices = spark.createDataFrame([("en", 3.0, 15.0), ("de", 5.0, 25.0)], "model string, input_price double, output_price double")
    return E.ledger(usage, prices, 0.2, by="source", order="doc_id").select("doc_id", "source", F.round("spent", 9).alias("spent"), (F.round("spent", 9) > 0.2).alias("tripped"))


@query("SELECT doc_id, source, lang, CAST(draw AS INTEGER) AS draw FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) AS draw FROM documents) WHERE draw <= 3")
def stratified_draw(read, spark):
    return E.stratified(read("documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 3)


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM p WHERE n <= 5 OR list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4.0::DOUBLE, 0) AS BIGINT)), place)""")
def even_spread(read, spark):
    return E.evenly(read("documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("""SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CAST(grouping(r_name, n_name) AS BIGINT) AS level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def report_rollup(read, spark):
    place = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s""")
def sessions(read, spark):
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(e).select("user_id", F.unix_micros("start").alias("start_us"), "n", F.round("total", 6).alias("total"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windows(read, spark):
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed(e).select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def forward_fill(read, spark):
    """As-of look-up of each event in its user's purchases, itself included."""
    e = read("events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    bought = e.filter("last_purchase IS NOT NULL").select("user_id", "at", "last_purchase")
    return G.asof(e.drop("last_purchase"), bought, ["user_id"], "at", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


WINDOWS = """w AS (SELECT event_id AS opened_by, user_id, epoch_us(ts) AS low, epoch_us(ts) + 1000000 * CAST(CASE event_type WHEN 'signup' THEN 86400 * (1 + event_id % 5) ELSE 60 * (1 + event_id % 90) END AS BIGINT) AS high FROM events WHERE event_type IN ('signup', 'error'))"""


@query(f"""WITH {WINDOWS} SELECT opened_by, count(*) AS n, round(sum(value), 6) AS total FROM w JOIN events e ON e.user_id = w.user_id AND epoch_us(e.ts) BETWEEN low AND high GROUP BY 1""")
def events_within(read, spark):
    """What a user does within some minutes of an error and within some days of signing up."""
    e = read("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "user_id", "event_type", "at", "value")
    seconds = F.when(F.col("event_type") == "signup", 86400 * (1 + F.col("event_id") % 5)).otherwise(60 * (1 + F.col("event_id") % 90)).cast("long")
    windows = e.filter("event_type IN ('signup', 'error')").select(F.col("event_id").alias("opened_by"), "user_id", F.col("at").alias("low"), (F.col("at") + 1_000_000 * seconds).alias("high"))
    found = G.within(e.select("user_id", "at", "value"), windows, ["user_id"], "at", "low", "high")
    return found.groupBy("opened_by").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH y AS (SELECT unnest(range(1993, 2000)) AS fy), p(period, first, last) AS (VALUES ('year', 1, 12), ('Q1', 1, 3), ('Q2', 4, 6), ('Q3', 7, 9), ('Q4', 10, 12), ('H1', 1, 6), ('9M', 1, 9)),
s AS (SELECT fy, period, CAST(make_date(fy - 1, 4, 1) + to_months(CAST(first - 1 AS INTEGER)) AS DATE) AS starts, last_day(CAST(make_date(fy - 1, 4, 1) + to_months(CAST(last - 1 AS INTEGER)) AS DATE)) AS ends FROM y, p)
SELECT CAST(fy AS INTEGER) AS fy, period, starts, ends, count(o_orderkey) AS orders FROM s LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN starts AND ends GROUP BY 1, 2, 3, 4""")
def fiscal_periods(read, spark):
    years = spark.range(1993, 2000).select(F.col("id").cast("int").alias("fy"))
    first, last = P.span(F.col("fy"), F.col("first"), F.col("last"))
    spans = years.join(P.period_table(spark), F.lit(True)).select("fy", "period", first.alias("starts"), last.alias("ends"))  # seven rows a year
    daily = read("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return F.broadcast(spans).join(daily, (F.col("day") >= F.col("starts")) & (F.col("day") <= F.col("ends")), "left").groupBy("fy", "period", "starts", "ends").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query()
def tfidf_classifier(read, spark):
    rows = read("documents").select(F.col("doc_id").alias("key"), "text").join(read("labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("label")), "key").filter("text IS NOT NULL AND label IS NOT NULL")
    return out_of_fold(rows, (0.1, 0.01))[0].select(F.col("key").alias("doc_id"), "label", "prediction")


@query("""WITH p AS (SELECT doc_id, list(s ORDER BY s) AS starts FROM (SELECT doc_id, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1 AS BIGINT) AS s FROM (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))) GROUP BY 1),
c AS (SELECT doc_id, unnest(range(0, (length(text) - 1) // 1000 + 1)) * 1000 AS begins, text FROM documents WHERE length(text) > 0)
SELECT doc_id, begins, CAST(len(list_filter(starts, lambda s: s <= begins)) AS INTEGER) AS page FROM c JOIN p USING (doc_id) WHERE length(substr(text, begins + 1, 1200)) >= 80""")
def offset_pages(read, spark):
    """As-of look-up: the page (here: line) on which a chunk starts."""
    lines = F.split("text", "\n")
    docs = read("documents").filter("text IS NOT NULL")
    chunks = D.fixed_chunks(docs).select("doc_id", F.col("start").cast("long").alias("begins"))
    pages = docs.select("doc_id", F.posexplode(lines).alias("pos", "line")).withColumn("s", F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - F.length("line") - 1)
    starts = pages.select("doc_id", F.col("s").cast("long").alias("begins"), (F.col("pos") + 1).alias("page"))
    return G.asof(chunks, starts, ["doc_id"], "begins", ["page"]).select("doc_id", "begins", "page")


@query("""WITH s AS (SELECT source, lang AS phrasing, toxic IS NOT NULL AS held, CASE WHEN toxic IS NOT NULL THEN 1 + (n_chars > 500)::INT + 5 * (n_chars > 5000)::INT END AS rank, CASE WHEN quality = 1 THEN toxic = 0 END AS exact FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, phrasing, count(*) AS figures, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE rank <= 1) AS found_1, count(*) FILTER (WHERE rank <= 5) AS found_5, CASE WHEN count(exact) > 0 THEN count(*) FILTER (WHERE exact) END AS exact FROM s GROUP BY 1, 2""")
def coverage_summary(read, spark):
    rows = read("documents").join(read("labels"), "doc_id", "left")
    held = F.col("toxic").isNotNull()
    rank = F.when(held, 1 + (F.col("n_chars") > 500).cast("int") + 5 * (F.col("n_chars") > 5000).cast("int"))
    return C.coverage(rows.select("source", F.col("lang").alias("phrasing"), held.alias("held"), rank.alias("rank"), F.when(F.col("quality") == 1, F.col("toxic") == 0).alias("exact")))


@query("""SELECT l_suppkey AS concept, max(l_quantity) AS largest, count(DISTINCT l_partkey) AS parts, min(l_shipdate)::DATE AS first_day, max(l_returnflag) AS last_flag FROM lineitem GROUP BY 1""")
def concept_summary(read, spark):
    return read("lineitem").groupBy(F.col("l_suppkey").alias("concept")).agg(F.max("l_quantity").alias("largest"), F.count_distinct("l_partkey").alias("parts"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.max("l_returnflag").alias("last_flag"))


@query("""SELECT c_custkey, string_agg(o_orderkey::VARCHAR, '; ' ORDER BY o_orderkey) AS aliases, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def concept_aliases(read, spark):
    rows = read("customer").select("c_custkey").join(read("orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "; ")
    return rows.groupBy("c_custkey").agg(F.when(F.count("o_orderkey") > 0, listed).alias("aliases"), F.count("o_orderkey").alias("n"))
