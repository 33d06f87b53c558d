"""Queries of the general data problems (nested records, orphan references, feature tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import features, nested, orphans
from tracewright.sources.tables import prepare, settled, table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return nested.flatten(table(prepare(spark), base, "decision_journals")).select("record_id", "parent_path", "node_path")


def p3_tables(spark: SparkSession, base: str) -> DataFrame:
    """Rows of each flat table, i.e. of each schema path."""
    return p3_flat(spark, base).groupBy("table_path").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("dewey")).alias("depth"))


def p3_flat(spark: SparkSession, base: str) -> DataFrame:
    """The rows of all flat tables."""
    return nested.flat_rows(table(prepare(spark), base, "decision_journals"))


def _references(spark: SparkSession, base: str) -> DataFrame:
    events = orphans.references(table(spark, base, "agent_events"), "agent_events", "event_id", "decision_journal_id")
    return events.unionByName(orphans.references(table(spark, base, "spans"), "spans", "span_id", "journal_id"))


def _orphans(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    refs = settled(_references(prepare(spark), base))
    return refs, orphans.orphans(refs, table(spark, base, "decision_journals"), table(spark, base, "journal_deletions"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return _orphans(spark, base)[1].select("table_name", "row_key", "orphan_kind")


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    refs, found = _orphans(spark, base)
    return orphans.per_period(found, refs)


def p7_features(spark: SparkSession, base: str) -> DataFrame:
    return features.event_features(table(prepare(spark), base, "agent_events"))


def p7_cells(spark: SparkSession, base: str) -> DataFrame:
    """The same features as rows of an agent and a type."""
    return features.event_features(table(prepare(spark), base, "agent_events"), long=True)


def p3_tool_calls(spark: SparkSession, base: str) -> DataFrame:
    """The table of the tool calls with typed columns."""
    own = nested.typed(p3_flat(spark, base), "tool_calls[]", {"tool_name": "string", "result": "string", "duration_ms": "double"})
    return own.select("record_id", "node_path", "parent_path", "tool_name", "result", "duration_ms")


def p3_usages(spark: SparkSession, base: str) -> DataFrame:
    """The table of token usages with typed columns."""
    own = nested.typed(p3_flat(spark, base), "model_calls[].token_usage", {"input_tokens": "bigint", "output_tokens": "bigint"})
    return own.select("record_id", "node_path", "parent_path", F.to_json("parent_dewey").alias("parent_dewey"), "input_tokens", "output_tokens")


QUERIES = {f.__name__: f for f in (p3_found, p3_tables, p3_flat, p3_tool_calls, p3_usages, p6_found, p6_report, p7_features, p7_cells)}

_REFS = """
refs AS (
  SELECT table_name, row_key, key, seen_at FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, row_key ORDER BY seen_at NULLS FIRST, key NULLS FIRST) AS copy_no FROM (
      SELECT 'agent_events' AS table_name, event_id AS row_key, nullif(lower(trim(decision_journal_id)), '') AS key, ingested_at AS seen_at FROM agent_events
      UNION ALL
      SELECT 'spans', span_id, nullif(lower(trim(journal_id)), ''), ingested_at FROM spans
    )
  ) WHERE copy_no = 1 AND key IS NOT NULL
),
born AS (SELECT lower(trim(journal_id)) AS key, min(ingested_at) AS born FROM decision_journals GROUP BY 1),
gone AS (SELECT DISTINCT lower(trim(journal_id)) AS key FROM journal_deletions),
judged AS (
  SELECT r.*, CASE WHEN g.key IS NOT NULL THEN 'deleted' WHEN b.key IS NULL THEN 'missing'
    WHEN b.born > r.seen_at + INTERVAL 60 MINUTE THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN born b ON r.key = b.key LEFT JOIN gone g ON r.key = g.key
)"""

_ROOTS = """
m AS (SELECT record_id, unnest(range(len(model_calls))) AS i, unnest(model_calls) AS c FROM decision_journals),
t AS (SELECT record_id, 'tool_calls[' || unnest(range(len(tool_calls))) || ']' AS call, unnest(tool_calls).tool_args AS args FROM decision_journals),
once AS (SELECT record_id, call, CASE WHEN json_valid(args) THEN CASE WHEN json_type(args) = 'VARCHAR' THEN args ->> '$' ELSE args END END AS held FROM t),
r AS (SELECT record_id, call, CASE WHEN json_valid(held) THEN CAST(held AS JSON) END AS root FROM once)"""

_NODES = f"""
WITH {_ROOTS}, n AS (SELECT r.record_id, r.call, j.fullkey AS k FROM r, json_tree(r.root) AS j WHERE j.type = 'OBJECT')
SELECT record_id, '' AS parent_path, 'model_calls[' || i || ']' AS node_path FROM m
UNION ALL SELECT record_id, 'model_calls[' || i || ']', 'model_calls[' || i || '].token_usage' FROM m WHERE cardinality(c.token_usage) > 0
UNION ALL SELECT record_id, '', call FROM t
UNION ALL SELECT record_id, CASE WHEN regexp_matches(k, '^\\$(\\[[0-9]+\\])*$') THEN call
  WHEN regexp_replace(k, '\\.[^.\\[\\]]+(\\[[0-9]+\\])*$', '') = '$' THEN call || '.tool_args'
  ELSE call || '.tool_args' || substr(regexp_replace(k, '\\.[^.\\[\\]]+(\\[[0-9]+\\])*$', ''), 2) END, call || '.tool_args' || substr(k, 2) FROM n"""

# Objects, and elements of arrays that are no object and no array with something in it.
_TABLES = f"""
WITH {_ROOTS}, n AS (SELECT j.fullkey AS k FROM r, json_tree(r.root) AS j WHERE j.type = 'OBJECT' OR (regexp_matches(j.fullkey, '\\]$') AND (j.type <> 'ARRAY' OR CAST(j.value AS VARCHAR) = '[]'))),
p AS (
  SELECT 'journals' AS table_path, 0 AS depth FROM decision_journals UNION ALL SELECT 'model_calls[]', 2 FROM m UNION ALL SELECT 'model_calls[].token_usage', 3 FROM m WHERE cardinality(c.token_usage) > 0
  UNION ALL SELECT 'tool_calls[]', 2 FROM t UNION ALL SELECT 'tool_calls[].tool_args' || regexp_replace(substr(k, 2), '\\[[0-9]+\\]', '[]', 'g'), 3 + len(regexp_extract_all(k, '\\.[^.\\[\\]]+|\\[[0-9]+\\]')) FROM n
)
SELECT table_path, count(*) AS n_rows, CAST(max(depth) AS INTEGER) AS depth FROM p GROUP BY table_path"""

ORACLE = {
    "p3_found": _NODES,
    "p3_tables": _TABLES,
    "p3_tool_calls": """WITH t AS (SELECT record_id, unnest(range(len(tool_calls))) AS i, unnest(tool_calls) AS c FROM decision_journals)
SELECT record_id, 'tool_calls[' || i || ']' AS node_path, '' AS parent_path, c.tool_name, c.result, c.duration_ms FROM t""",
    "p3_usages": """WITH m AS (SELECT record_id, unnest(range(len(model_calls))) AS i, unnest(model_calls) AS c FROM decision_journals)
SELECT record_id, 'model_calls[' || i || '].token_usage' AS node_path, 'model_calls[' || i || ']' AS parent_path, '[0,' || i || ']' AS parent_dewey, c.token_usage['input_tokens'] AS input_tokens, c.token_usage['output_tokens'] AS output_tokens
FROM m WHERE cardinality(c.token_usage) > 0""",
    "p6_found": f"WITH {_REFS} SELECT table_name, row_key, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL",
    "p6_report": f"""WITH {_REFS}
SELECT table_name, CAST(seen_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS refs,
  count(*) FILTER (orphan_kind = 'deleted') AS deleted_refs, count(*) FILTER (orphan_kind = 'late') AS late_refs,
  count(*) FILTER (orphan_kind = 'missing') AS missing_refs, round(count(orphan_kind) / count(*), 6) AS orphan_share
FROM judged GROUP BY ALL""",
    "p7_cells": """
WITH copies AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS FIRST, nullif(lower(trim(agent_id)), '') NULLS FIRST, lower(trim(event_type)), event_timestamp, payload) AS copy_no FROM agent_events
), e AS (
  SELECT nullif(lower(trim(agent_id)), '') AS agent_id, coalesce(nullif(lower(trim(event_type)), ''), 'untyped') AS event_type,
    CASE WHEN event_timestamp <= ingested_at + INTERVAL 60 MINUTE AND event_timestamp >= ingested_at - INTERVAL 30 DAY THEN epoch_us(event_timestamp) // 1000000 END AS seen_at,
    CASE WHEN json_valid(payload) THEN CAST(round(coalesce(TRY_CAST(payload ->> '$.latency_ms' AS DOUBLE), TRY_CAST(payload ->> '$.duration_ms' AS DOUBLE)) * 1000) AS BIGINT) END AS micros
  FROM copies WHERE copy_no = 1 OR event_id IS NULL
)
SELECT agent_id, event_type, count(*) AS n, (SELECT epoch_us(max(ingested_at)) // 1000000 FROM agent_events) - max(seen_at) AS recency_s, coalesce(sum(micros), 0) / 1000.0 AS total_ms
FROM e GROUP BY agent_id, event_type""",
}
