"""Keyed lookups and validation over events and journals; all are filters that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.schemas import EVENT_TYPES, SOURCE_TIERS


def by_agent(df: DataFrame, agent_id: str) -> DataFrame:
    return df.where(F.col("agent_id") == agent_id)


def by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def by_journal(events: DataFrame, journal_id: str | None) -> DataFrame:
    """Events of a journal; None asks for those without one."""
    return events.where(F.col("decision_journal_id").eqNullSafe(F.lit(journal_id)))


def journal(journals: DataFrame, journal_id: str) -> DataFrame:
    """The latest row of one journal, or none."""
    return journals.where(F.col("journal_id") == journal_id).orderBy(F.desc("record_id")).limit(1)


def _valid():
    return F.coalesce(F.col("event_type").isin(*EVENT_TYPES) & F.col("source_tier").isin(*SOURCE_TIERS) & (F.trim("agent_id") != ""), F.lit(False))


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(_valid())


def quarantined(events: DataFrame) -> DataFrame:
    """Rows that aren't canonical, with the reason."""
    reason = F.when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "event_type").when(~F.coalesce(F.col("source_tier").isin(*SOURCE_TIERS), F.lit(False)), "source_tier").otherwise("agent_id")
    return events.where(~_valid()).withColumn("reason", reason)


def with_journal(events: DataFrame, journals: DataFrame) -> DataFrame:
    """Events whose journal is stored."""
    return events.join(journals.select(F.col("journal_id").alias("decision_journal_id")).distinct(), "decision_journal_id", "left_semi")


def without_journal(events: DataFrame, journals: DataFrame) -> DataFrame:
    """Events that name a journal which isn't stored."""
    return events.where("decision_journal_id is not null").join(journals.select(F.col("journal_id").alias("decision_journal_id")).distinct(), "decision_journal_id", "left_anti")
