"""Query of near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.cover_tree import linked


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = {
    "op11_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(id, place) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.place),
        c AS (SELECT id, min(place) AS component_id FROM reach GROUP BY id),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM e JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
    """
}
