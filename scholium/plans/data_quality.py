"""Queries of the data-quality operators over the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholium.operators import orphans as O
from scholium.session import read_table


def _graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, d, t) for t in ("graph_edges", "graph_evidence", "graph_nodes", "graph_sources")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(_graph(spark, d), O.GRAPH_KEYS, O.GRAPH_REFERENCES)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_graph(spark, d), O.GRAPH_KEYS, O.GRAPH_REFERENCES)


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}

_FOUND = r"""
WITH clean AS (
  SELECT 'graph_edges' AS rec_table, edge_id AS rec_id, loaded_at, subject_id, object_id, evidence_ids, NULL AS source_id,
         row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at) AS rn
  FROM graph_edges WHERE edge_id IS NOT NULL AND loaded_at IS NOT NULL
  UNION ALL
  SELECT 'graph_evidence', evidence_id, loaded_at, NULL, NULL, NULL, source_id,
         row_number() OVER (PARTITION BY evidence_id ORDER BY loaded_at)
  FROM graph_evidence WHERE evidence_id IS NOT NULL AND loaded_at IS NOT NULL),
firsts AS (SELECT * FROM clean WHERE rn = 1),
raw AS (
  SELECT rec_table, rec_id, loaded_at AS t, 'subject_id' AS field_name, 'n' AS tgt, subject_id AS r FROM firsts
  UNION ALL SELECT rec_table, rec_id, loaded_at, 'object_id', 'n', object_id FROM firsts
  UNION ALL SELECT rec_table, rec_id, loaded_at, 'evidence_ids', 'e', unnest(evidence_ids) FROM firsts
  UNION ALL SELECT rec_table, rec_id, loaded_at, 'source_id', 's', source_id FROM firsts),
refs AS (SELECT DISTINCT rec_table, rec_id, t, field_name, tgt, lower(regexp_replace(r, '^\s+|\s+$', '', 'g')) AS ref_id
         FROM raw WHERE trim(r) <> ''),
hist AS (
  SELECT DISTINCT 'n' AS tgt, lower(trim(node_id)) AS id, loaded_at AS l, deleted_at AS x FROM graph_nodes
  UNION SELECT 'e', lower(trim(evidence_id)), loaded_at, deleted_at FROM graph_evidence
  UNION SELECT 's', lower(trim(source_id)), loaded_at, deleted_at FROM graph_sources),
judged AS (
  SELECT rec_table, rec_id, field_name, ref_id, t, count(h.id) AS n_rows, count(h.id) FILTER (h.l <= t) AS n_seen,
         arg_max(coalesce(h.x, TIMESTAMP '9999-01-01'), h.l) FILTER (h.l <= t) AS x
  FROM refs LEFT JOIN hist h ON h.tgt = refs.tgt AND h.id = refs.ref_id GROUP BY ALL)
SELECT rec_table, rec_id, field_name, ref_id,
       CASE WHEN n_rows = 0 THEN 'missing' WHEN n_seen = 0 THEN 'late' ELSE 'deleted' END AS reason, strftime(t, '%Y-%m') AS period
FROM judged WHERE n_rows = 0 OR n_seen = 0 OR x <= t
"""

SQL = {
    "p1_found": _FOUND,
    "p1_counts": f"SELECT rec_table, field_name, period, reason, count(*) AS n_refs, count(DISTINCT ref_id) AS n_ids FROM ({_FOUND}) GROUP BY ALL",
}
