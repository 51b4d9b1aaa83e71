"""Registered queries of the training-data operators."""

from __future__ import annotations

from tidemark.llm import email_lines, mixing, near_duplicates, neighbours, pii, subjects, tokenizing

QUERIES = {
    "p3_found": near_duplicates.p3_found,
    "p3_classes": near_duplicates.p3_classes,
    "p3_groups": near_duplicates.p3_groups,
    "p4_found": neighbours.p4_found,
    "p5_found": email_lines.p5_found,
    "p6_found": pii.p6_found,
    "p9_found": subjects.p9_found,
    "p9_makeup": subjects.p9_makeup,
    "p6_replaced": pii.p6_replaced,
    "p7_ids": tokenizing.p7_ids,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
}
ORACLES: dict[str, str] = {
    "p3_found": """
WITH c AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM chunks),
s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 30)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE 2 * k >= x.n + y.n - k""",
    "p4_found": """
WITH v AS (SELECT chunk_id, min(embedding)::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE round(list_cosine_similarity(a.e, b.e), 9) >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM c)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE n <= 5""",
}
