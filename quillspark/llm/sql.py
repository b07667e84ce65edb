"""DuckDB SQL for the queries that SQL can express.

WARC: the rules for payloads and revisits, without the archives.
Balls: plain k-means, every vector against every centroid, a component a row.
"""

from __future__ import annotations


def kmeans(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Rounds as CTEs: squared distances ``dN``, the nearest ``aN``, and the centroids ``cN`` that follow."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"d{n} AS MATERIALIZED (SELECT v.vec_id, c.num, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c USING (i) GROUP BY 1, 2)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, num, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, num) AS r FROM d{n}) WHERE r = 1)")
        if n < rounds:
            mean = "CAST(sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT)"
            steps.append(f"m{n} AS (SELECT num, i, {mean} AS x FROM a{n} JOIN v USING (vec_id) GROUP BY 1, 2)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.num, c.i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (num, i))")
    return f"""
WITH e AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
v AS MATERIALIZED (SELECT vec_id, unnest(range({dim})) AS i, CAST(floor(256 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM e),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS num FROM e ORDER BY num LIMIT {k}),
c0 AS MATERIALIZED (SELECT num, i, x FROM s JOIN v USING (vec_id)),
{", ".join(steps)},
h AS (SELECT num, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sign FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sign AS centroid_sha256
FROM a{rounds} JOIN h USING (num)
"""


SQL = {
    "op12_balls": kmeans(),
    "op5_warc": """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM f
""",
}
