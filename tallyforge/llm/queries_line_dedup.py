"""Query of line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.line_dedup import deduplicated


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its lines, those dropped, and a checksum of what is left."""
    docs = shared.cased(shared.documents(spark, sf_dir), "doc_id", "text")
    return deduplicated(docs, shortest=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = {
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(x) AS raw, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
        t AS (SELECT *, trim(raw, ' ') AS line FROM l),
        f AS (SELECT line, min((doc_id, pos)) AS first FROM t WHERE regexp_matches(line, '\S') GROUP BY line),
        v AS (SELECT line, first, unnest(range(length(line) + 1)) AS place FROM f WHERE length(line) >= 20),
        x AS (SELECT line, first, place, CASE WHEN place = 0 THEN line ELSE substr(line, 1, place - 1) || substr(line, place + 1) END AS s FROM v),
        near AS (SELECT DISTINCT b.line FROM x a JOIN x b ON a.s = b.s AND a.line <> b.line AND a.first < b.first AND (a.place = b.place OR a.place = 0 OR b.place = 0)),
        d AS (SELECT t.*, f.line IS NOT NULL AND ((doc_id, pos) <> first OR t.line IN (SELECT line FROM near)) AS gone FROM t LEFT JOIN f ON t.line = f.line),
        k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS left_ FROM d GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped, CASE WHEN n_lines IS NOT NULL THEN sha256(left_) END AS text_sha256 FROM documents LEFT JOIN k USING (doc_id)
    """
}
