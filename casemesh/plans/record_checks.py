"""Queries on heavy keys and on references without a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemesh.operators.heavy_keys import heavy_keys, key_counts
from casemesh.operators.orphans import orphan_counts, reference_orphans
from casemesh.plans.registry import Registry
from casemesh.sources.tables import load

REGISTRY = Registry()

_KEYS_SQL = """
WITH k AS (
  SELECT 'target_id' AS key_field, target_id AS key_value, * EXCLUDE (target_id, target_authority_id) FROM citations WHERE target_id IS NOT NULL
  UNION ALL BY NAME
  SELECT 'target_authority_id' AS key_field, target_authority_id AS key_value, * EXCLUDE (target_id, target_authority_id) FROM citations WHERE target_authority_id IS NOT NULL)
SELECT key_field, key_value, count(*) AS n_rows, count(DISTINCT (id, source_id)) AS n_edges, count(DISTINCT source_id) AS n_sources
FROM k GROUP BY ALL
"""


@REGISTRY.query("p2_key_counts", _KEYS_SQL)
def p2_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_counts(load(spark, sf_dir, "citations"))


@REGISTRY.query(
    "p2_found",
    f"SELECT key_field, key_value FROM ({_KEYS_SQL}) WHERE n_rows >= 0.02 * (SELECT count(*) FROM citations)",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(load(spark, sf_dir, "citations")).select("key_field", "key_value")


def _jid(c: str) -> str:
    """The SQL of a trimmed jid with full-width signs as ASCII."""
    full = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    signs = "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''")
    return f"trim(translate({c}, '{full}', '{signs}'), ' \t\n\r　')"


_ORPHANS_SQL = f"""
WITH ids AS (SELECT CAST(id AS VARCHAR) AS key, min(created_at) AS since FROM decisions GROUP BY 1),
jids AS (SELECT {_jid("jid")} AS key, min(received_at) AS since FROM raw_records WHERE jid IS NOT NULL GROUP BY 1),
gone AS (SELECT DISTINCT record_table, CASE record_table WHEN 'decisions' THEN record_key ELSE {_jid("record_key")} END AS key FROM removed_records),
refs AS (
  SELECT 'citations.target_id' AS ref_field, id AS row_id, CAST(target_id AS VARCHAR) AS key, created_at FROM citations
  UNION SELECT 'citations.target_canonical_id', id, CAST(target_canonical_id AS VARCHAR), created_at FROM citations
  UNION SELECT 'decisions.jid', id, {_jid("jid")}, created_at FROM decisions),
j AS (
  SELECT r.ref_field, r.row_id, r.created_at, coalesce(i.since, k.since) AS since, g.key IS NOT NULL AS gone
  FROM (SELECT * FROM refs WHERE key IS NOT NULL) r
  LEFT JOIN ids i ON r.ref_field <> 'decisions.jid' AND i.key = r.key
  LEFT JOIN jids k ON r.ref_field = 'decisions.jid' AND k.key = r.key
  LEFT JOIN gone g ON g.key = r.key AND g.record_table = CASE r.ref_field WHEN 'decisions.jid' THEN 'raw_records' ELSE 'decisions' END)
SELECT ref_field, row_id, CASE WHEN since IS NULL AND gone THEN 'removed' WHEN since IS NULL THEN 'absent' ELSE 'late' END AS ref_state,
       strftime(created_at, '%Y-%m') AS ref_month
FROM j WHERE since IS NULL OR since > created_at
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_orphans(*(load(spark, sf_dir, t) for t in ("citations", "decisions", "raw_records", "removed_records")))


@REGISTRY.query("p5_found", _ORPHANS_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


@REGISTRY.query(
    "p5_counts",
    f"SELECT ref_field, ref_state, ref_month, count(*) AS n_records FROM ({_ORPHANS_SQL}) GROUP BY ALL",
)
def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))
