"""SQL text for the vector codes, written out round by round."""

from __future__ import annotations


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The whole fit over ``embeddings``; the dimension is a multiple of the number of parts."""
    nearest = """
a{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + e)::BIGINT AS best FROM (
  SELECT p.vec_id, p.part, b.e, (p.xx + b.xx - 2 * list_dot_product(p.x, b.x))::BIGINT AS d FROM p JOIN b{k} b USING (part)) GROUP BY ALL)"""
    moved = """
m{k} AS (SELECT part, e, list(v ORDER BY i) AS x FROM (
  SELECT part, best % 256 AS e, i, floor(sum(x[i]) / count(*))::DOUBLE AS v
  FROM a{j} JOIN p USING (vec_id, part), generate_series(1, len(x)) AS s(i) GROUP BY ALL) GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT part, e, x, list_dot_product(x, x) AS xx FROM (
  SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{j} b LEFT JOIN m{k} m USING (part, e)))"""
    steps = [nearest.format(k=0)]
    for k in range(1, rounds + 1):
        steps += [moved.format(k=k, j=k - 1), nearest.format(k=k)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, [floor({scale} * c::DOUBLE) FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, x, list_dot_product(x, x) AS xx FROM (
    SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}]::DOUBLE[] AS x FROM k, range({parts}) AS r(part))),
b0 AS MATERIALIZED (
  SELECT part, e, x, xx FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{",".join(steps).strip()},
c AS (SELECT vec_id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (
  SELECT part, e, i, x[i] AS v FROM b{rounds}, generate_series(1, len(x)) AS s(i)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""
