"""Writing canonical tables, redacted right before they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import hashing, redact
from tracewright.operators.spans import otlp


def append_events(events: DataFrame, path: str, redacted: bool = True) -> None:
    """Events with their hash, appended and laid out by day of arrival, in each file by type, which lookups prune on; payloads redacted before they are hashed.

    Days of arrival are few, whatever the clocks of the senders say.
    """
    rows = events.withColumn("payload", redact.redact_pii(F.col("payload"))) if redacted else events
    rows = rows.withColumn("integrity_hash", hashing.event_hash()).withColumn("arrival_day", F.to_date("ingested_at")).withColumn("type", F.lower(F.trim("event_type")))
    rows.sortWithinPartitions("arrival_day", "type").write.mode("append").partitionBy("arrival_day").parquet(path)


def export_spans(spans: DataFrame, path: str, enabled: bool = True, service_name: str = "agent") -> DataFrame:
    """Spans as lines of the OTLP JSON mapping, free text redacted, appended to ``path``; returns what was written.

    Where export is off nothing is written and the frame, of the same columns, is empty.
    """
    lines = otlp(spans, service_name)
    if not enabled:
        return lines.limit(0)
    lines.select("line").write.mode("append").text(path)
    return lines


def clear(df: DataFrame, path: str) -> None:
    """An empty table of the same schema in the place of ``path``; for tests."""
    df.limit(0).write.mode("overwrite").parquet(path)
