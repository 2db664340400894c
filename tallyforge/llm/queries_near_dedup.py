"""Query of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import shared
from tallyforge.llm.near_dedup import near_groups


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(shared.documents(spark, sf_dir), n=2)


#: A pair at the threshold shares a shingle among the rarest of either set, as many as the sets may differ in and one more.
ORACLE_SQL = {
    "op8_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        z AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE coalesce(w, []) END)) AS s FROM w),
        y AS (SELECT doc_id, len(s) AS n, hash(s) AS h, s FROM z),
        c AS (SELECT h, n, any_value(s) AS s FROM y WHERE n > 0 GROUP BY h, n),
        e AS (SELECT h, n, unnest(s) AS g FROM c),
        f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
        r AS (SELECT h, n, g, row_number() OVER (PARTITION BY h ORDER BY df, g) AS place FROM e JOIN f USING (g)),
        p AS (SELECT h, n, g FROM r WHERE place <= n - (8 * n + 9) // 10 + 1),
        q AS (SELECT DISTINCT a.h AS a, b.h AS b FROM p a JOIN p b ON a.g = b.g AND a.h < b.h AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
        l AS (SELECT a, b FROM q JOIN c x ON x.h = a JOIN c v ON v.h = b WHERE 100 * len(list_intersect(x.s, v.s)) >= 80 * (x.n + v.n - len(list_intersect(x.s, v.s)))),
        m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(h, root) AS (SELECT h, h FROM c UNION SELECT m.b, reach.root FROM reach JOIN m ON m.a = reach.h),
        least_id AS (SELECT reach.h, min(first) AS component_id FROM reach JOIN (SELECT h, min(doc_id) AS first FROM y WHERE n > 0 GROUP BY h) i ON i.h = reach.root GROUP BY reach.h)
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(CASE WHEN n > 0 THEN component_id END, doc_id) AS component_id, coalesce(CASE WHEN n > 0 THEN component_id END, doc_id) = doc_id AS kept
        FROM y LEFT JOIN least_id USING (h)
    """
}
