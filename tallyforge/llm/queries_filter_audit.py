"""Query of the audit of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import shared
from tallyforge.llm.filter_audit import audited


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = {
    "op12_filter_audit": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                list_concat(CASE WHEN len(w) < 100 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN ['B'] ELSE [] END,
                    CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN ['C'] ELSE [] END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN ['D'] ELSE [] END,
                    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN ['E'] ELSE [] END) AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
        o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(filter_order, x)),
        s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
        j AS (SELECT *, list_contains(fails, x) AS failed, step > 1 AND list_has_any(fails, before) AS gone FROM c, s)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step,
               CAST(sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN fails = [x] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN NOT gone AND failed THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
               CAST(sum(CASE WHEN failed THEN n * 120 // len(fails) ELSE 0 END) AS BIGINT) AS shapley
        FROM j GROUP BY part, filter_order, step
    """
}
