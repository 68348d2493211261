"""DuckDB SQL of the vector operators: components as rows, one set of clauses a round."""

from __future__ import annotations


def _clauses(scale: int, parts: int, entries: int, rounds: int, first: str) -> str:
    """``kept`` vectors, their components ``xs``, and for each round the nearest
    entries ``a<n>`` (``m``: distance and number in one) and the entries ``c<n>``."""
    d = 64 // parts
    said = f"""
    kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, * FROM (
            SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
    xs AS MATERIALIZED (SELECT rid, i // {d} AS p, i % {d} AS j, v[i + 1] AS x FROM kept, range(64) t(i)),
    firsts AS (SELECT rid, row_number() OVER (ORDER BY {first}) - 1 AS e FROM kept),
    c0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM xs JOIN firsts USING (rid) WHERE e < {entries})"""
    for n in range(rounds + 1):
        said += f""",
    a{n} AS MATERIALIZED (
        SELECT rid, p, min(m) % {entries} AS e, min(m) // {entries} AS distance
        FROM (SELECT rid, p, sum((x - c) * (x - c)) * {entries} + e AS m FROM xs JOIN c{n} USING (p, j) GROUP BY rid, p, e) GROUP BY rid, p)"""
        if n < rounds:
            said += f""",
    c{n + 1} AS MATERIALIZED (
        SELECT p, e, j, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c
        FROM c{n} LEFT JOIN (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM xs JOIN a{n} USING (rid, p) GROUP BY p, e, j) USING (p, e, j))"""
    return said


OP11_SQL = f"""
    WITH {_clauses(256, 16, 64, 2, "vec_id, v")},
    coded AS (SELECT rid, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(distance) AS error FROM a2 GROUP BY rid)
    SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) FROM c2) AS codebooks_sha256
    FROM kept JOIN coded USING (rid)"""

OP12_SQL = f"""
    WITH {_clauses(64, 1, 16, 3, "sha256('1:' || vec_id), v")},
    named AS (SELECT e, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY e)
    SELECT vec_id, e::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY e))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM kept JOIN a3 USING (rid) JOIN named USING (e)"""
