"""DuckDB SQL that must give the same rows as the pN_ queries that SQL can express."""

from __future__ import annotations

CURRENT = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC NULLS LAST, words DESC NULLS LAST, text DESC NULLS LAST) AS rn
  FROM sessions WHERE session_id IS NOT NULL
), cur AS (
  SELECT *, lower(trim(source)) AS s, lower(trim(provenance)) AS p FROM ranked WHERE rn = 1
)"""

CUTS = f"""
WITH {CURRENT},
scored AS (SELECT s, p, session_id, words FROM cur WHERE words >= 0),
sizes AS (SELECT s, p, count(*) AS n FROM scored GROUP BY s, p),
steps AS (SELECT s, p, words AS cutoff, sum(count(*)) OVER (PARTITION BY s, p ORDER BY words DESC) AS kept FROM scored GROUP BY s, p, words),
cuts AS (
  SELECT t.source, t.provenance, t.keep_pct, z.s, z.p, z.n, max(c.cutoff) AS cutoff, min(c.kept)::BIGINT AS kept
  FROM (SELECT DISTINCT * FROM keep_targets) t
  JOIN sizes z ON z.s = lower(trim(t.source)) AND z.p = lower(trim(t.provenance))
  JOIN steps c ON c.s = z.s AND c.p = z.p AND c.kept * 100 >= t.keep_pct * z.n
  GROUP BY ALL
)"""

#: Exact nearest-rank percentiles of coded values: what sketches of groups with few enough codes must give.
VALUED = f"""
WITH {CURRENT},
v AS (
  SELECT s AS source, ingested_at::DATE AS day, 'words' AS metric, words::BIGINT AS value, 1.0 AS units FROM cur WHERE words >= 0
  UNION ALL
  SELECT s, ingested_at::DATE, 'duration_s', round(duration_s * 1000)::BIGINT, 1000.0 FROM cur WHERE duration_s >= 0 AND NOT isnan(duration_s) AND duration_s < 1e15
), d AS (
  SELECT *, CASE WHEN value < 8192 THEN value::DOUBLE ELSE (value >> (floor(log2(value))::INT - 12) << (floor(log2(value))::INT - 12)) + ((1::BIGINT << (floor(log2(value))::INT - 12)) - 1) / 2.0 END / units AS x FROM v
)"""
PERCENTILES = "count(*) AS n, quantile_disc(x, 0.5) AS median, quantile_disc(x, 0.9) AS p90, quantile_disc(x, 0.99) AS p99, 0.0::DOUBLE AS median_rank_error, 0.0::DOUBLE AS p90_rank_error, 0.0::DOUBLE AS p99_rank_error, (1 / 4096.0)::DOUBLE AS value_error"

#: The five most similar chunks of each by brute force.
NEAREST = """
WITH u AS (
  SELECT DISTINCT model, session_id, ordinal, vec::DOUBLE[] AS v FROM chunk_vectors
  WHERE model IS NOT NULL AND session_id IS NOT NULL AND ordinal IS NOT NULL AND vec IS NOT NULL AND len(vec) = dim
    AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.model, a.session_id, a.ordinal, b.session_id AS other_session_id, b.ordinal AS other_ordinal, max(list_cosine_similarity(a.v, b.v)) AS cosine
  FROM u a JOIN u b ON a.model = b.model AND len(a.v) = len(b.v) AND (a.session_id <> b.session_id OR a.ordinal <> b.ordinal) GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY model, session_id, ordinal ORDER BY round(cosine, 9) DESC, other_session_id, other_ordinal)::INT AS rank FROM pairs QUALIFY rank <= 5
)"""

ORACLE: dict[str, str] = {
    "p1_found": CUTS + " SELECT DISTINCT c.source, c.provenance, d.session_id FROM cuts c JOIN scored d ON d.s = c.s AND d.p = c.p AND d.words >= c.cutoff",
    "p1_cutoffs": CUTS + " SELECT source, provenance, keep_pct, n, cutoff::BIGINT AS cutoff, kept FROM cuts",
    "p1_batches": CUTS + " SELECT source, provenance, keep_pct, n, cutoff::BIGINT AS cutoff, kept FROM cuts",
    "p2_found": f"WITH {CURRENT} SELECT session_id FROM cur WHERE length(text) > 8000 OR len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) > 1000",
    "p2_checked": f"WITH {CURRENT} SELECT session_id, true AS within, true AS whole, true AS repeated, true AS split FROM cur WHERE length(text) > 8000 OR len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) > 1000",
    "p4_neighbors": f"{NEAREST} SELECT model, session_id, ordinal, other_session_id, other_ordinal, rank, round(cosine, 5) AS cosine FROM best",
    "p4_found": f"{NEAREST} SELECT DISTINCT model, least(a, b).s AS session_id_a, least(a, b).o AS ordinal_a, greatest(a, b).s AS session_id_b, greatest(a, b).o AS ordinal_b FROM (SELECT model, {{'s': session_id, 'o': ordinal}} AS a, {{'s': other_session_id, 'o': other_ordinal}} AS b FROM best WHERE cosine >= 0.93)",
    "p5_daily": f"{VALUED} SELECT source, day, metric, {PERCENTILES} FROM d GROUP BY ALL",
    "p5_span": f"{VALUED} SELECT source, metric, {PERCENTILES} FROM d GROUP BY ALL",
    "p6_checked": "SELECT doc_id, strlen(text)::BIGINT AS tokens, true AS whole, true AS fits FROM documents WHERE strlen(text) > 0",
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
}
