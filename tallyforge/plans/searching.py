"""Searches as they are used: by keys within a scope, with labels resolved, methods and chunkings compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.labels import fiscal_year_of
from tallyforge.functions.text import squeeze
from tallyforge.operators import chunks as H
from tallyforge.operators import evaluation as E
from tallyforge.operators import retrieval as R
from tallyforge.sinks.snapshots import written
from tallyforge.sizes import dealt

KEY_DEPTH = 400


def report_scope(reports: DataFrame, company: str = "all", year: str = "all") -> DataFrame:
    """Reports (``doc_id, ticker``) of one company or all and of one fiscal year or all; an unknown one is an error."""
    out = reports
    if company != "all":
        out = out.filter(F.col("ticker") == company)
    if year != "all":
        if not year.isdigit():
            raise ValueError(f"no year {year!r}")
        out = out.filter(fiscal_year_of(F.col("doc_id")) == int(year))
    if out.isEmpty():
        raise ValueError(f"no reports of {company!r} and {year!r}")
    return out


def single_report(tags: Column, reports: list[str]) -> Column:
    """The one report that a case's tags name; null if they name none or several."""
    named = F.array_intersect(tags, F.array(*map(F.lit, reports)))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def keyed_search(documents: DataFrame, questions: DataFrame, ranker: Callable, k: int = 5, *, scope: DataFrame | None = None, rerank: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: chunks by element that the keys of ``ranker`` find, each once, at its best key's place. With
    ``rerank`` the first ones are read whole. ``scope(doc_id)``: documents that are searched. Of ``ranker(docs, queries, k)``, ``k``
    only says where a ranking ends, as with all of ``retrieval.rankers``.

    Of the first ``KEY_DEPTH`` keys only those are asked for that can matter: n - 1 chunks have n - 1 times the keys of the chunk
    that has most, so that one key more names an n-th chunk, or there is none."""
    R.refuse(k)
    docs = documents if scope is None else documents.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    # chunks and keys are cut once, by all cores, however few splits the documents are read in
    chunks = written(H.element_chunks(dealt(docs)), "chunks")
    keys = written(H.search_keys(docs, chunks), "keys")
    first = max(k, 20) if rerank else k
    most = 1 if first == 1 else keys.groupBy("parent").count().agg(F.max("count")).first()[0] or 1
    depth = min(max(KEY_DEPTH, k), (first - 1) * most + 1)
    ranked = ranker(keys.select(F.col("key_id").alias("doc_id"), "text"), questions, depth).select("query_id", F.col("doc_id").alias("key_id"), "rank", "score")
    found = H.parents(ranked, keys, first)
    if not rerank:
        return found
    return R.rerank(found, questions, chunks.select(F.col("id").alias("doc_id"), "text"), k=k).select("query_id", "id", "score", "rank")


def resolved(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cases (``case_id, quote``) with ``relevant``: ids of the chunks that hold the quote, an empty list if none does."""
    hits = R.resolve_quotes(cases.select(F.col("case_id").alias("quote_id"), "quote"), chunks.select(F.col("id").alias("doc_id"), "text"))
    listed = hits.groupBy(F.col("quote_id").alias("case_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("relevant"))
    return cases.join(listed, "case_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))


def scored(cases: DataFrame, ranking: DataFrame, variant: str, k: int = 5) -> DataFrame:
    """``variant, grader, case_id, passed, value, error`` of ranked chunks (``query_id, id, rank``) against resolved cases: whether the
    label resolves, hit, recall and reciprocal rank. Metrics of a case without a label are null."""
    ids = ranking.groupBy(F.col("query_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    both = cases.select("case_id", "relevant").join(ids, "case_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    there = F.size("relevant") > 0
    values = {"resolvable": there.cast("double"), f"hit@{k}": R.hit_at(F.col("ids"), F.col("relevant"), k), f"recall@{k}": F.when(there, R.recall_at(F.col("ids"), F.col("relevant"), k)), "mrr": R.reciprocal_rank(F.col("ids"), F.col("relevant"))}
    rows = both.select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("grader"), v.alias("value")) for n, v in values.items()])).alias("s"))
    return rows.select(F.lit(variant).alias("variant"), "s.grader", "case_id", F.coalesce(F.col("s.value") == 1, F.lit(False)).alias("passed"), "s.value", F.lit(None).cast("string").alias("error"))


def methods_compared(cases: DataFrame, chunks: DataFrame, rankers: dict[str, Callable], k: int = 5) -> DataFrame:
    """The report of several rankers over the same chunks and labels, a variant each."""
    labelled = resolved(cases, chunks)
    texts, asked = chunks.select(F.col("id").alias("doc_id"), "text"), cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"))
    runs = [scored(labelled, r(texts, asked, k).select("query_id", F.col("doc_id").alias("id"), "rank"), name, k) for name, r in rankers.items()]
    return E.report(E.combined(runs))


def chunkings_compared(cases: DataFrame, inventories: dict[str, DataFrame], ranker: Callable, k: int = 5) -> DataFrame:
    """The report of one ranker over several ways to cut the documents; labels resolve to each one's own chunks."""
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"))
    runs = []
    for name, chunks in inventories.items():
        ranking = ranker(chunks.select(F.col("id").alias("doc_id"), "text"), asked, k).select("query_id", F.col("doc_id").alias("id"), "rank")
        runs.append(scored(resolved(cases, chunks), ranking, name, k))
    return E.report(E.combined(runs))


def questions_verified(questions: DataFrame, docs: DataFrame, least: int = 25, fold: Callable[[Column], Column] = squeeze) -> DataFrame:
    """``question_id, refusal`` of written questions (``question_id, doc_id, usable, question, quote``): the first reason why one can't be
    used. Its quote must be long enough, stand in its document word for word, in no other one, and not in the question, all compared as ``fold`` has them."""
    q = questions.withColumn("folded", fold(F.col("quote")))
    hits = R.resolve_quotes(q.filter(F.length("folded") >= least).select(F.col("question_id").alias("quote_id"), "quote"), docs, fold)
    where = hits.groupBy(F.col("quote_id").alias("question_id")).agg(F.collect_set(F.col("doc_id").cast("string")).alias("held"))
    rows = q.join(where, "question_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    others = F.array_sort(F.array_except("held", F.array(F.col("doc_id").cast("string"))))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == ""
    why = (
        F.when(~F.coalesce("usable", F.lit(False)), "the passage is unusable")
        .when(blank("question") | blank("quote"), "question or quote is empty")
        .when(F.length("folded") < least, "the quote is too short")
        .when(~F.array_contains("held", F.col("doc_id").cast("string")), "the quote is not in the document")
        .when(F.contains(fold(F.col("question")), F.col("folded")), "the question contains its own answer")
        .when(F.size(others) > 0, F.concat(F.lit("the quote also appears in "), F.array_join(others, ", ")))
    )
    return rows.select("question_id", why.alias("refusal"))


def claims_gated(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims (``claim_id, passage_id, quote``) with ``kept``: at least three words that stand in the cited passage."""
    rows = claims.join(passages.select("passage_id", "text"), "passage_id", "left")
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace("quote", r"(?U)\s+", " ")), " "), lambda w: w != ""))
    return rows.select("claim_id", F.coalesce((words >= 3) & F.contains(squeeze(F.col("text")), squeeze(F.col("quote"))), F.lit(False)).alias("kept"))


def merged_answers(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Answers (``pos, key, answer``) with those that were written anew, in the old order."""
    return old.join(fresh.select("key", F.col("answer").alias("new")), "key", "left").select("pos", "key", F.coalesce("new", "answer").alias("answer"))


def truncated(texts: DataFrame, limit: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """How many texts are longer than an embedder reads."""
    return texts.agg(F.count("*").alias("texts"), F.count_if(F.size(tokens(F.col("text"))) > limit).alias("truncated"))


def unresolved(cases: DataFrame) -> DataFrame:
    return cases.filter(F.size("relevant") == 0).select("case_id")


def first_places(ranking: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first place at which a wanted id (``query_id, id``) was found; null if it wasn't."""
    best = ranking.join(wanted, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return wanted.select("query_id").distinct().join(best, "query_id", "left")


def numbered_in(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
