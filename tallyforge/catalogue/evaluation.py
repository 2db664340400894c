"""Queries of graders, the runner, figures, draws and generated headlines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyforge.operators import answers as W
from tallyforge.operators import crosscheck as C
from tallyforge.operators import figures as G
from tallyforge.operators import grading as Q
from tallyforge.operators import headlines as H
from tallyforge.operators import sampling as S
from tallyforge.register import query
from tallyforge.sizes import dealt

l = F.lit  # noqa: E741
s = lambda c: F.col(c).cast("string")

CASES = """g AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderpriority AS p, o_orderstatus AS t FROM orders)"""


@query(f"""WITH {CASES}, x AS (SELECT id, unnest([{{'g': 'exact', 'ok': k IN (0, 1), 'v': NULL::DOUBLE}}, {{'g': 'contains', 'ok': k IN (0, 1, 2), 'v': NULL}}, {{'g': 'includes', 'ok': k < 3, 'v': NULL}}, {{'g': 'excludes', 'ok': k <> 3, 'v': NULL}},
 {{'g': 'regex', 'ok': k IN (0, 2), 'v': NULL}}, {{'g': 'valid', 'ok': k <> 4, 'v': NULL}}, {{'g': 'fields', 'ok': k = 0, 'v': NULL}}, {{'g': 'flag', 'ok': t = 'F' AND k <> 4, 'v': CASE WHEN k = 4 THEN NULL ELSE (t = 'F')::INT END}}, {{'g': 'tools', 'ok': k < 2, 'v': NULL}}, {{'g': 'resolvable', 'ok': k <> 2, 'v': (k <> 2)::INT}},
 {{'g': 'recall', 'ok': k IN (0, 1), 'v': CASE k WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 3 THEN 0.5 ELSE 1 END}}]) AS s FROM g)
SELECT id, s.g AS grader, s.ok AS passed, s.v AS value FROM x""")
def graders(read, spark):
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    # answers: equal in another case; equal; with more words; another; none at all
    answer = F.when(k == 0, p).when(k == 1, F.concat(l("  "), F.upper(p))).when(k == 2, F.concat(p, l(" it is"))).when(k == 3, "planted")
    got = F.struct(answer.alias("answer"), F.when(k == 0, F.col("o_orderkey")).when(k < 4, l(-1)).alias("n"), (F.when(k < 4, F.col("o_orderstatus") == "F")).alias("done"), F.when(k < 4, F.array(l("search"), F.when(k < 2, "calculate").otherwise("write"))).alias("tools"), F.when(k < 4, F.array(l("a"), l("a"), l("b"), F.when(k < 2, "c").otherwise("d"))).alias("retrieved"))
    label = F.struct(p.alias("answer"), F.col("o_orderkey").alias("n"), F.array(F.lower(p)).alias("includes"), F.array(l("Planted")).alias("excludes"), F.array(l("search"), l("calculate")).alias("tools"), F.array(l("write")).alias("forbid"), F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(l("a"), l("c"))).alias("relevant"))
    rows = dealt(read("orders")).select(F.col("o_orderkey").alias("id"), F.to_json(label).alias("expected"), F.to_json(got).alias("output"))
    made = {"exact": Q.exact_match(), "contains": Q.contains(), "includes": Q.includes(), "excludes": Q.excludes(), "regex": Q.regex(pattern=r"^\d-[A-Z ]*[A-Z]( it is)?$"), "valid": Q.valid("answer string, n bigint"), "fields": Q.field_match(["answer", "n"]), "flag": Q.flag("done"), "tools": Q.right_tools(), "resolvable": Q.resolvable(), "recall": Q.ranking(3)}
    scores = F.array(*[F.struct(l(n).alias("grader"), g(F.col("expected"), F.col("output")).alias("s")) for n, g in made.items()])
    return rows.select("id", scores.alias("scores")).select("id", F.explode("scores").alias("x")).select("id", "x.grader", "x.s.passed", "x.s.value")


@query(
    """WITH g AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k FROM orders)
    SELECT id, 'answered' AS grader, k <> 0 AS passed, CASE WHEN k <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM g
    UNION ALL SELECT id, 'cites_relevant', k IN (1, 2), CASE WHEN k IN (1, 2) THEN 1.0 WHEN k <> 4 THEN 0.0 END::DOUBLE FROM g
    UNION ALL SELECT id, 'correct', k IN (1, 2, 3), NULL FROM g"""
)
def rag_grades(read, spark):
    """Answers from passages: an abstention, citing what is relevant, citing it second, other things, without a label, it too late."""
    k, own = F.col("o_orderkey") % 6, F.concat(l("p"), s("o_orderkey"))
    cited = F.when(k == 1, F.array(own, own)).when(k == 2, F.array(l("x"), own)).when(k == 3, F.array(l("x"))).when(k == 4, F.array(own)).when(k == 5, F.array(l("x"), l("y"), own)).otherwise(F.array().cast("array<string>"))
    got = F.struct((k != 0).alias("answered"), F.when(k == 0, l(None)).when(k <= 3, "right").otherwise("wrong").cast("string").alias("answer"), cited.alias("cited"))
    label = F.struct(l("right").alias("answer"), F.when(k == 4, F.array().cast("array<string>")).otherwise(F.array(own, l("other"))).alias("relevant"))
    rows = dealt(read("orders")).select(F.col("o_orderkey").alias("id"), F.to_json(label).alias("expected"), F.to_json(got).alias("output"))
    scores = F.array(*[F.struct(l(n).alias("grader"), g(F.col("expected"), F.col("output")).alias("s")) for n, g in Q.rag_graders(Q.exact_match(), 2).items()])
    return rows.select("id", F.explode(scores).alias("x")).select("id", "x.grader", "x.s.passed", "x.s.value")


def echo(text: str) -> str:
    given = json.loads(text)
    if given["n"] % 7 == 0:
        raise ValueError("seven")
    return json.dumps({"answer": given["word"], "_cost": 0.5})


def shout(text: str) -> str:
    return json.dumps({"answer": json.loads(text)["word"] + "!"})


@query("""WITH c AS (SELECT s_suppkey AS id, s_name AS w FROM supplier), e AS (SELECT 'echo' AS variant, id, CASE WHEN id % 7 = 0 THEN 'ValueError: seven' END AS error, id % 7 <> 0 AS ok FROM c UNION ALL SELECT 'shout', id, NULL, FALSE FROM c)
SELECT variant, 'exact' AS grader, count(*) AS cases, count(*) FILTER (WHERE ok) AS passed, (SELECT count(*) FROM e x WHERE x.variant = e.variant AND error IS NOT NULL) AS errors FROM e WHERE error IS NULL GROUP BY variant""")
def eval_runner(read, spark):
    cases = read("supplier").select(F.col("s_suppkey").alias("case_id"), F.to_json(F.struct(F.col("s_name").alias("word"), F.col("s_suppkey").alias("n"))).alias("input"), F.to_json(F.struct(F.col("s_name").alias("answer"))).alias("expected"))
    rows = Q.run(cases, {"echo": echo, "shout": shout}, {"exact": Q.exact_match()})
    errors = rows.groupBy("variant").agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    return rows.filter("error IS NULL").groupBy("variant", "grader").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).join(errors, "variant")


@query("""WITH a AS (SELECT l_orderkey AS id, list({'m': CASE WHEN l_linenumber % 2 = 0 THEN 'profit' ELSE 'revenue' END, 'v': l_quantity, 'y': 2000 + l_linenumber}) AS e FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS gone FROM lineitem GROUP BY 1)
SELECT id, n - gone AS found, gone AS missed, CAST(1 AS BIGINT) AS extra, round((n - gone)::DOUBLE / n, 9) AS recall, FALSE AS described FROM f""")
def figures_matched(read, spark):
    one = lambda x, unit: F.struct(F.when(x["l_linenumber"] % 2 == 0, "profit").otherwise("revenue").alias("metric"), x["l_quantity"].cast("double").alias("value"), l(unit).alias("unit"), (2000 + x["l_linenumber"]).cast("int").alias("year"), l(None).cast("string").alias("description"))
    odd = F.struct(l("other").alias("metric"), l(-1.0).alias("value"), l(None).cast("string").alias("unit"), l(None).cast("int").alias("year"), l("nowhere").alias("description"))
    # an order's lines are listed once, and only after they are dealt by order, as narrow rows
    lines = read("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity").repartition("id").groupBy("id").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("x"))
    got = F.transform(F.filter("x", lambda x: x["l_linenumber"] % 3 != 0), lambda x: one(x, "INR"))
    rows = lines.select("id", F.transform("x", lambda x: one(x, "Rs. crore")).alias("expected"), F.concat(got, F.array(odd)).alias("got"), l("a passage").alias("passage"))
    return G.matched(rows).select("id", "found", "missed", "extra", F.round("recall", 9).alias("recall"), "described")


@query("""SELECT fault, count(*) AS n FROM (SELECT unnest(CASE p_partkey % 10 WHEN 0 THEN [] WHEN 1 THEN ['metric'] WHEN 2 THEN ['year dropped'] WHEN 3 THEN ['percentage not converted'] WHEN 4 THEN ['wrong scale'] WHEN 5 THEN ['missed', 'extra'] WHEN 6 THEN ['invalid JSON'] WHEN 7 THEN ['expression in JSON'] WHEN 8 THEN ['no prediction'] ELSE ['no call when needed', 'unit not a currency'] END) AS fault FROM part) GROUP BY 1""")
def fault_census(read, spark):
    k = F.col("p_partkey") % 10
    value = (F.col("p_size") + l(0.25)).cast("double")
    figure = lambda metric, v, unit, year: F.struct(metric.alias("metric"), v.alias("value"), unit.alias("unit"), year.alias("year"), l(None).cast("string").alias("description"))
    want = F.array(figure(l("profit"), value, l("INR"), l(2025)))
    got = F.to_json(F.struct(F.array(figure(F.when(k == 1, "revenue").otherwise("profit"), value * F.when(k == 3, 100.0).when(k == 4, 1000.0).when(k == 5, 7.0).otherwise(1.0), F.when(k == 9, "tonnes").otherwise("INR"), F.when(k != 2, 2025))).alias("figures")))
    final = F.when(k == 6, "none").when(k == 7, "{3 * 10 ** 5").otherwise(got)
    passage = F.when(k == 9, "one and two").otherwise(F.concat(l("It was "), value.cast("string")))
    rows = read("part").select(F.col("p_partkey").alias("id"), passage.alias("passage"), want.alias("expected"))
    predictions = read("part").filter(k != 8).select(F.col("p_partkey").alias("id"), final.alias("final"), F.array().cast("array<string>").alias("calls"))
    return G.census(G.answered(rows, predictions))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size || ' / 100' WHEN 2 THEN '-' || p_size || ' * 10**7' END AS call, p_partkey % 4 < 3 AS found, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END AS missed, p_partkey % 4 <> 3 AS scaled FROM part""")
def inferred_calls(read, spark):
    k, z = F.col("p_partkey") % 4, (F.col("p_size") + 12).cast("double")
    value = F.when(k == 0, z).when(k == 1, z / 100).when(k == 2, -z * 1e7).otherwise(z * 3 + 0.5)
    passage = F.concat(l("In all "), z.cast("int").cast("string"), l(" units"))
    label = F.struct(F.when(k == 2, -z).when(k == 3, value + 1).otherwise(value).alias("value"), l(None).cast("string").alias("call"), l(None).cast("int").alias("year"))
    figure = F.struct(value.alias("value"), l(2025).alias("year"))
    call = F.replace(G.inferred_call(value, passage), z.cast("int").cast("string"), F.col("p_size").cast("string"))
    return read("part").select("p_partkey", call.alias("call"), G.found_as(label, figure).alias("found"), F.size(G.missed(F.array(label), F.array(figure))).alias("missed"), G.scaled(label["value"], value).alias("scaled"))


HEAD = "h AS (SELECT c_custkey AS id, list_transform(range(8), lambda i: CAST('0x' || substr(md5('7:' || c_custkey), CAST(4 * i + 1 AS BIGINT), 4) AS INTEGER)) AS h FROM customer), v AS (SELECT id, h, h[1] % 2 = 0 AS up, 1 + h[2] % 40 AS pct, ['Q1','Q2','Q3','Q4'][h[3] % 4 + 1] AS q, ['revenue','profit'][h[4] % 2 + 1] AS m, ['Acme','Bolt','Crux'][h[5] % 3 + 1] AS co, 5 + h[7] % 20 AS low, 30 + h[8] % 15 AS high FROM h)"


@query(f"""WITH {HEAD} SELECT id, co AS company, CASE id % 16 WHEN 2 THEN 'margin' WHEN 3 THEN 'margin' WHEN 6 THEN 'guidance' WHEN 7 THEN 'orders' WHEN 8 THEN 'headcount' WHEN 10 THEN 'profit' WHEN 11 THEN 'none' WHEN 12 THEN 'none' WHEN 15 THEN 'profit' ELSE m END AS metric,
 CASE WHEN id % 16 = 6 THEN 'FY' WHEN id % 16 IN (11, 12, 13) THEN 'unknown' WHEN id % 16 = 14 THEN ['H1','H2','FY'][h[3] % 3 + 1] ELSE q END AS quarter, CASE WHEN id % 16 = 5 THEN 'flat' WHEN id % 16 IN (7, 11, 12) THEN 'unknown' WHEN id % 16 = 9 OR up THEN 'up' ELSE 'down' END AS direction,
 CASE WHEN id % 16 IN (0, 1, 10, 13, 14) THEN pct WHEN id % 16 = 9 THEN CASE WHEN up THEN high ELSE low END END AS change_pct, CASE WHEN id % 16 = 0 THEN co || ' ' || q || ' ' || CASE m WHEN 'revenue' THEN 'revenue' ELSE 'net profit' END || CASE WHEN up THEN ' rises ' ELSE ' falls ' END || pct || '%' END AS moved FROM v""")
def headline_templates(read, spark):
    made = H.generated(read("customer").select(F.col("c_custkey").alias("id")), ["Acme", "Bolt", "Crux"])
    return made.select("id", "company", "metric", "quarter", "direction", "change_pct", F.when(F.col("rule") == "percent-move", F.col("text")).alias("moved"))


@query("""WITH d AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9&]', '', 'g') AS key, n_nationkey AS t FROM nation), x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_nationkey END AS ticker, CASE WHEN c_custkey % 3 = 0 THEN 'Nowhere ' || c_custkey % 4 ELSE n_name || ' Ltd' END AS mention FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT mention, count(*) AS n FROM x WHERE ticker IS NULL GROUP BY 1""")
def unresolved_mentions(read, spark):
    companies = read("nation").select(F.col("n_nationkey").cast("string").alias("ticker"), F.col("n_name").alias("name"), F.array(F.concat(l("The "), F.col("n_name"))).alias("aliases"), F.col("n_nationkey").alias("ord"))
    c = read("customer").join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    mentions = c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(l("Nowhere "), (F.col("c_custkey") % 4).cast("string"))).otherwise(F.concat(F.col("n_name"), l(" Ltd"))).alias("mention"))
    return H.unresolved(H.resolved(mentions, H.directory(companies)))


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
rr AS (SELECT doc_id FROM r ORDER BY turn, source LIMIT 40), st AS (SELECT doc_id FROM o WHERE place % (n // 30) = 0 AND place < (n // 30) * 30), tv AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT 'robin' AS draw, doc_id FROM rr UNION ALL SELECT 'strided', doc_id FROM st UNION ALL SELECT 'valid', doc_id FROM tv WHERE place >= n - greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT))""")
def seeded_draws(read, spark):
    d = read("documents").select("doc_id", "source")
    valid = S.train_valid(d, "doc_id", 0.1).filter("part = 'valid'")
    return S.round_robin(d, "source", "doc_id", 40).select(l("robin").alias("draw"), "doc_id").unionByName(S.strided(d, "doc_id", 30).select(l("strided").alias("draw"), "doc_id")).unionByName(valid.select(l("valid").alias("draw"), "doc_id"))


@query("""WITH k AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), q AS (SELECT lang, least(n, 10) AS quota FROM k WHERE lang IN ('en', 'de'))
SELECT lang, quota AS n FROM q""")
def spread_draw(read, spark):
    return S.drawn_by_kind(read("documents").select("doc_id", "lang"), "lang", "doc_id", 20, ["en", "de"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n >= 400 AND length(regexp_replace(text, '[^\\p{L}\\s]', '', 'g')) >= 0.85 * n AS eligible, CASE WHEN regexp_matches(text, '(?i)profit|revenue') AND regexp_matches(text, '\\d') THEN 'core' WHEN regexp_matches(text, '\\d\\s*(crore|million)') THEN 'scaled' WHEN len(list_filter(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: NOT regexp_full_match(replace(x, ',', ''), '(19|20)\\d\\d'))) > 0 THEN 'plain' END AS kind FROM t""")
def passage_kinds(read, spark):
    t = F.col("text")
    return read("documents").filter("text IS NOT NULL").select("doc_id", S.eligible(t).alias("eligible"), S.kind_of_passage(t, r"(?i)profit|revenue", r"\d\s*(crore|million)").alias("kind"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), x AS (SELECT doc_id, c.lang AS l, c.n - (c.lang = d.lang)::INT AS n FROM documents d, c WHERE d.lang IS NOT NULL)
SELECT doc_id, l AS majority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, l) AS r FROM x) WHERE r = 1""")
def majority_baseline(read, spark):
    return H.majority(read("documents").filter("lang IS NOT NULL").select("doc_id", "lang"), "lang").select("doc_id", "majority")


@query("""WITH a AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS u, max(turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT 'va-' || lpad(CAST(row_number() OVER (ORDER BY a.conv_id) - 1 AS VARCHAR), 4, '0') AS id, a.conv_id, u.text AS passage, r.text AS reply FROM a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.u AND u.role = 'user' LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.a AND r.role = 'assistant'""")
def conversation_rows(read, spark):
    return G.conversation_rows(read("conversations")).select("id", "conv_id", "passage", "reply")


@query("""WITH x AS (SELECT s_suppkey AS fact_id, s_nationkey AS ticker, s_acctbal AS v, s_suppkey % 4 AS k FROM supplier), i AS (SELECT *, CASE k WHEN 0 THEN 'printed x100' WHEN 1 THEN 'not printed' ELSE 'differs' END AS issue FROM x WHERE k < 3)
SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, ticker, issue) AS INTEGER) AS number, ticker, issue, count(*) AS n, list(fact_id ORDER BY fact_id) AS ids FROM i GROUP BY ticker, issue""")
def review_groups(read, spark):
    k, v = F.col("s_suppkey") % 4, F.col("s_acctbal")
    printed = F.when(k == 0, F.format_string("%.2f", F.round(v * 100, 2))).when(k == 2, "7")
    rows = read("supplier").select(F.col("s_suppkey").alias("fact_id"), F.col("s_nationkey").alias("ticker"), l("Balance").alias("concept"), l(None).cast("string").alias("segment"), v.alias("value"), F.when(k == 3, "agree").when(k == 1, "unmatched").otherwise("differ").alias("outcome"), printed.alias("printed"))
    return C.groups(rows).select("number", "ticker", "issue", "n", "ids")


@query("""WITH x AS (SELECT s_suppkey AS fact_id, 'N' || s_nationkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis, ['agree', 'differ', 'unmatched'][s_suppkey % 3 + 1] AS o FROM supplier)
SELECT ticker, basis, count(*) FILTER (WHERE o = 'agree') AS agree, count(*) FILTER (WHERE o = 'differ') AS differ, count(*) FILTER (WHERE o = 'unmatched') AS unmatched FROM x GROUP BY 1, 2""")
def outcome_counts(read, spark):
    k = F.col("s_suppkey")
    return C.counts(read("supplier").select(k.alias("fact_id"), F.concat(l("N"), s("s_nationkey")).alias("ticker"), F.when(k % 2 == 0, "standalone").otherwise("consolidated").alias("basis"), F.element_at(F.array(l("agree"), l("differ"), l("unmatched")), (k % 3 + 1).cast("int")).alias("outcome")))


@query("SELECT fact_id FROM (SELECT o_orderkey AS fact_id, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r <= 30")
def agreement_sample(read, spark):
    rows = read("orders").select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "F", "agree").otherwise("differ").alias("outcome"))
    return C.agreement_sample(rows, 30).select("fact_id")


@query("""SELECT count(*) FILTER (WHERE NOT p AND n) AS named, count(*) FILTER (WHERE NOT p AND NOT n) AS other, count(*) FILTER (WHERE p) AS two_companies, count(*) FILTER (WHERE y > 1) AS two_years_or_more, count(*) FILTER (WHERE y > 1 AND p) AS paired_years FROM (SELECT l_linenumber % 2 = 0 AS p, l_returnflag = 'R' AS n, l_linenumber AS y FROM lineitem)""")
def draw_mix(read, spark):
    return H.draw_mix(read("lineitem").select((F.col("l_linenumber") % 2 == 0).alias("paired"), (F.col("l_returnflag") == "R").alias("named"), F.col("l_linenumber").alias("years")))


@query("""WITH x AS (SELECT l_orderkey + l_linenumber AS k, l_linenumber % 3 AS found, l_linenumber % 2 AS missed FROM lineitem)
SELECT count(*) AS cases, count(*) FILTER (WHERE missed = 0 AND k % 5 <> 0 AND k % 7 <> 0) AS passed, count(*) FILTER (WHERE k % 11 <> 0) AS parsed, round(avg(found / 3.0::DOUBLE), 9) AS recall, count(*) FILTER (WHERE missed = 0) AS all_found, count(*) FILTER (WHERE k % 5 <> 0) AS no_extra, count(*) FILTER (WHERE k % 7 <> 0) AS described,
 count(*) FILTER (WHERE k % 2 = 0 AND k % 3 = 0) AS called_when_needed, count(*) FILTER (WHERE k % 2 = 0) AS needed, count(*) FILTER (WHERE k % 2 = 1 AND k % 3 = 0) AS called_when_not, count(*) FILTER (WHERE k % 2 = 1) AS not_needed FROM x""")
def figure_totals(read, spark):
    k = F.col("l_orderkey") + F.col("l_linenumber")
    n = F.col("l_linenumber")
    graded = read("lineitem").select((n % 3).alias("found"), (n % 2).alias("missed"), (k % 5 == 0).cast("int").alias("extra"), (n % 3 / 3).alias("recall"), (k % 7 != 0).alias("described"), (k % 11 != 0).alias("parsed"), (k % 3 == 0).alias("called"), (k % 2 == 0).alias("needed"))
    return G.totals(graded).withColumn("recall", F.round("recall", 9))


@query("""SELECT o_orderpriority AS model, count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS tokens, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1""")
def usage_totals(read, spark):
    return Q.usage_totals(read("orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("tokens"), F.col("o_totalprice").alias("cost")), ["model"]).withColumn("cost", F.round("cost", 2))


@query("""SELECT label, term, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT l_returnflag AS label, l_linenumber AS term, sum(l_quantity) AS weight, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, l_linenumber) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3""")
def top_terms(read, spark):
    weights = read("lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("term")).agg(F.sum("l_quantity").alias("weight"))
    return H.top_terms(weights, 3)


@query("""SELECT conv_id, turn, ['1 + ' || turn] AS calls FROM conversations""")
def label_calls(read, spark):
    messages = F.concat(l('[{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [{"function": {"name": "calculate", "arguments": {"expression": "1 + '), s("turn"), l('"}}}]}]'))
    return read("conversations").select("conv_id", "turn", G.label_calls(messages).alias("calls"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS input, l_suppkey AS output, 2 * l_linenumber AS written, l_linenumber AS hour, 7 AS read_, CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 0 END AS searches, greatest(l_partkey - 5, 0) AS input_2, CASE WHEN l_linenumber % 2 = 0 THEN ['search', 'calc'] ELSE ['search'] END AS called, CASE WHEN l_linenumber % 2 = 0 THEN ['u' || l_suppkey] ELSE [] END AS pages FROM lineitem WHERE l_partkey >= 5""")
def usage_read(read, spark):
    k = F.col("l_linenumber")
    even = k % 2 == 0
    one = F.to_json(F.struct(F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), (2 * k).alias("cache_creation_input_tokens"), l(7).alias("cache_read_input_tokens"), F.struct(k.alias("ephemeral_1h_input_tokens")).alias("cache_creation"), F.when(even, F.struct(l(3).alias("web_search_requests"))).alias("server_tool_use")))
    two = F.to_json(F.struct(F.col("l_partkey").alias("prompt_tokens"), l(1).alias("completion_tokens"), F.struct(l(5).alias("cached_tokens")).alias("prompt_tokens_details")))
    block = lambda kind, name, url=None: F.struct(l(kind).alias("type"), l(name).alias("name"), (F.array(F.struct(url.alias("url")), F.struct(url.alias("url"))) if url is not None else l(None).cast("array<struct<url:string>>")).alias("content"))
    blocks = F.to_json(F.when(even, F.array(block("text", None), block("tool_use", "search"), block("server_tool_use", "calc"), block("web_search_tool_result", None, F.concat(l("u"), s("l_suppkey"))))).otherwise(F.array(block("tool_use", "search"))))
    u, v = W.usage_of_blocks(one), W.usage_of_completion(two)
    rows = dealt(read("lineitem").filter("l_partkey >= 5").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select(F.col("l_orderkey").alias("k"), k.alias("n"), u.alias("u"), v.alias("v"), W.tools_called(blocks).alias("called"), W.pages_returned(blocks).alias("pages"))
    return rows.select("k", "n", "u.input", "u.output", "u.written", F.col("u.written_hour").alias("hour"), F.col("u.read").alias("read_"), "u.searches", F.col("v.input").alias("input_2"), "called", "pages")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'tax' WHEN 1 THEN 'other' WHEN 2 THEN 'assets' WHEN 3 THEN 'other' ELSE 'profit' END AS metric, CASE p_size % 5 WHEN 1 THEN 'total assets' WHEN 3 THEN 'branches' WHEN 4 THEN 'net worth' END AS description FROM part""")
def labels_renamed(read, spark):
    k = F.col("p_size") % 5
    pick = lambda *v: F.element_at(F.array(*[l(x).cast("string") for x in v]), (k + 1).cast("int"))
    label = F.struct(pick("other", "other", "other", "other", "profit").alias("metric"), pick(None, None, "INR", None, "INR").alias("unit"), pick("Effective tax rate", "total assets", "Segment assets", "branches", "net worth").alias("description"))
    return read("part").select("p_partkey", W.relabelled(label).alias("x")).select("p_partkey", "x.metric", "x.description")


@query("""SELECT p_partkey AS answer_id, CASE p_partkey % 5 WHEN 1 THEN 'X#0002 is not a passage its searches returned' WHEN 2 THEN 'X#0001 does not name the segment' WHEN 3 THEN 'X#0001 does not back a value' END AS refusal, p_partkey % 5 NOT IN (3) AS backed, p_partkey % 5 = 4 AS by_call FROM part""")
def answers_checked(read, spark):
    k, z = F.col("p_partkey") % 5, F.col("p_size") + 20
    passages = read("part").select(F.col("p_partkey").alias("answer_id"), l("X#0001").alias("chunk_id"), F.concat(l("Hotels made "), z.cast("string"), l(" in all")).alias("text"))
    value = F.when(k == 3, z + 0.5).when(k == 4, z * 1e7).otherwise(z).cast("double")
    figures = read("part").select(F.col("p_partkey").alias("answer_id"), l(0).alias("pos"), F.when(k == 1, "X#0002").otherwise("X#0001").alias("chunk_id"), value.alias("value"), F.when(k == 2, "Paper").when(k == 0, "hotels").alias("basis"), F.when(k == 4, F.array(F.concat(z.cast("string"), l(" * 10000000")))).alias("calls"))
    seen = passages.join(read("part"), F.col("answer_id") == F.col("p_partkey")).select("answer_id", W.backed(value, F.col("text")).alias("backed"), W.called_value(F.concat(z.cast("string"), l("*1e7")), F.col("text"), value).alias("by_call"))
    return W.figures_refused(figures, passages).join(seen, "answer_id")


@query("""SELECT conv_id, turn, turn % 4 <> 1 AND turn % 4 <> 3 AS passed, CASE turn % 4 WHEN 0 THEN 'no answer to check' WHEN 1 THEN 'withheld: it carried a credential' WHEN 2 THEN '' ELSE 'cites passages it never retrieved: B#0002' END AS detail, CASE WHEN turn % 2 = 0 THEN 'seen' ELSE '{"cite_as":"A#0001"}' END AS fact FROM conversations""")
def answers_guarded(read, spark):
    k = F.col("turn") % 4
    answer = F.when(k == 1, "[answer withheld: it contained something shaped like a credential]").when(k == 2, "It is [A#0001].").when(k == 3, "It is [B#0002].")
    rows = read("conversations").select("conv_id", "turn", W.guarded(answer, F.array(l("A#0001"))).alias("g"))
    cited = read("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), l(0).alias("pos"), l("A#0001").alias("id"), "conv_id", "turn")
    even = W.evidence(cited.filter("turn % 2 = 0"), spark.createDataFrame([("A#0001", "seen")], "id string, text string"))
    odd = W.evidence(cited.filter("turn % 2 = 1"), spark.createDataFrame([], "id string, text string"))
    return rows.select("conv_id", "turn", "g.*").join(even.unionByName(odd).select("conv_id", "turn", "fact"), ["conv_id", "turn"])
