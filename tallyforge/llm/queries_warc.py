"""Query of WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.warc import read_archive, write_archive


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM l
    """
}
