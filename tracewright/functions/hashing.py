"""Integrity hashes over a canonical form, version ``v1``.

Fields stand in a fixed order, each with its length in front so that no text can imitate a border; null is
``-``. Times are microseconds since the epoch, doubles thousandths rounded to whole numbers. A hash covers one record and proves
nothing about others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "v1"


def field(c: Column) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def time(c: Column) -> Column:
    return F.unix_micros(c).cast("string")


def millis(c: Column) -> Column:
    return F.round(c * 1000).cast("bigint").cast("string")


def canonical(*columns: Column) -> Column:
    return F.concat_ws("|", F.lit(VERSION), *(field(c) for c in columns))


def integrity(*columns: Column) -> Column:
    return F.sha2(canonical(*columns), 256)


def event_hash() -> Column:
    """The hash of an event row over all its fields but the hash."""
    return integrity(*(F.col(c) for c in ("event_id", "agent_id", "agent_name", "event_type", "source_tier", "payload", "decision_journal_id")), time(F.col("event_timestamp")))


def journal_hash() -> Column:
    """The hash of a journal row: its own fields, then its calls in order. Sealing twice gives the same hash."""
    calls = F.array_join(F.transform(F.col("tool_calls"), lambda c: canonical(c["tool_name"], c["tool_args"], c["result"], millis(c["duration_ms"]))), "/")
    usage = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    models = F.array_join(F.transform(F.col("model_calls"), lambda c: canonical(c["model_id"], c["prompt_preview"], c["cot_reasoning"], usage(c["token_usage"]), millis(c["latency_ms"]))), "/")
    return integrity(F.col("journal_id"), F.col("agent_id"), F.col("agent_name"), time(F.col("started_at")), time(F.col("completed_at")), F.col("user_message"), F.col("final_response"), models, calls, F.col("total_tokens").cast("string"))
