"""Folding lifecycle events into journals, and the windows over calls that need an order.

Event order within a group is (event_timestamp, event_id); ``collect_list`` alone has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import hashing
from tracewright.operators import blocks

PAYLOAD = "tool_name string, result_preview string, duration_ms double, cot_preview string, latency_ms double, user_message string, total_tokens bigint, tool_calls bigint, integrity_hash string"


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once, by its earliest arrival."""
    rest = [c for c in events.columns if c not in (key, "ingested_at")]
    first = F.min(F.struct("ingested_at", *rest)).alias("e")
    return events.groupBy(key).agg(first).select(key, "e.*")


def read_payload(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


def fold(events: DataFrame) -> DataFrame:
    """One row per journal from its events, already unique.

    tool_count counts attempts, so blocked calls count; tool_results counts what came back. Tool names, in order.
    """
    kind = F.lower(F.trim("event_type"))
    e = read_payload(events.where("decision_journal_id is not null")).withColumn("kind", kind)

    def ordered(of: str, what: Column) -> Column:
        kept = F.collect_list(F.when(kind == of, F.struct("event_timestamp", "event_id", what.alias("v"))))
        return F.transform(F.array_sort(kept), lambda x: x["v"])

    count = lambda of: F.count_if(F.col("kind") == of)
    return e.groupBy(F.col("decision_journal_id").alias("journal_id")).agg(
        F.min("agent_id").alias("agent_id"),
        F.min("event_timestamp").alias("started_at"),
        F.max("event_timestamp").alias("completed_at"),
        count("tool_call").alias("tool_count"),
        count("tool_result").alias("tool_results"),
        count("cot_reasoning").alias("model_count"),
        F.coalesce(F.max(F.when(F.col("kind") == "evidence_seal", F.col("p.total_tokens"))), F.lit(0)).alias("total_tokens"),
        (count("evidence_seal") > 0).alias("sealed"),
        ordered("tool_call", F.col("p.tool_name")).alias("tool_names"),
    )


_MODEL = "struct<model_id:string,prompt_preview:string,cot_reasoning:string,token_usage:map<string,bigint>,latency_ms:double>"
_TOOL = "struct<tool_name:string,tool_args:string,result:string,duration_ms:double>"


def fold_records(events: DataFrame, by: str = "decision_journal_id", order: tuple[str, ...] = ("event_timestamp", "event_id")) -> DataFrame:
    """Journals from events that carry whole records: the model and the tool calls in order, and the sum of the calls' tokens.

    events are unique and have ``by``, event_type, payload and the columns of ``order``; tool_count counts attempts. An array
    of a journal is as long as the journal is; a group of another size isn't one.
    """
    kind = F.lower(F.trim("event_type"))
    record = F.from_json("payload", f"record {_MODEL[:-1]},{_TOOL[7:]}")["record"]
    e = events.where(F.col(by).isNotNull()).withColumn("kind", kind).withColumn("r", F.when(F.col("kind").isin("cot_reasoning", "tool_result"), record))

    def calls(of: str, like: str) -> Column:
        names = ("model_id", "prompt_preview", "cot_reasoning", "token_usage", "latency_ms") if like == _MODEL else ("tool_name", "tool_args", "result", "duration_ms")
        one = F.struct(*(F.col("r")[n].alias(n) for n in names))
        # Maps can't be compared, so the order stands in front and decides alone.
        kept = F.collect_list(F.when(F.col("kind") == of, F.struct(F.struct(*order).alias("o"), one.alias("c"))))
        return F.transform(F.array_sort(kept, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["c"])

    usage = F.coalesce(F.col("r.token_usage")["input_tokens"], F.lit(0)) + F.coalesce(F.col("r.token_usage")["output_tokens"], F.lit(0))
    return e.groupBy(F.col(by).alias("journal_id")).agg(
        calls("cot_reasoning", _MODEL).alias("model_calls"),
        calls("tool_result", _TOOL).alias("tool_calls"),
        F.coalesce(F.sum(F.when(F.col("kind") == "cot_reasoning", usage)), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("kind") == "tool_call").alias("tool_count"),
        (F.count_if(F.col("kind") == "evidence_seal") > 0).alias("sealed"),
    )


def last_user_message(events: DataFrame) -> DataFrame:
    """Per journal the text of the last message that has one; later messages without text don't count, empty ones do."""
    said = read_payload(events).where("decision_journal_id is not null and p.user_message is not null")
    return said.groupBy(F.col("decision_journal_id").alias("journal_id")).agg(F.max_by("p.user_message", F.struct("event_timestamp", "event_id")).alias("user_message"))


def sealed(journals: DataFrame) -> DataFrame:
    """Journals with their seal; sealing again changes nothing."""
    return journals.withColumn("sealed", F.lit(True)).withColumn("integrity_hash", hashing.journal_hash())


def seal_ids(journals: DataFrame, ids: DataFrame) -> DataFrame:
    """(journal_id, integrity_hash) of each id asked for, by the row of the journal with the highest record_id; null for ids that aren't there."""
    wanted = ids.select("journal_id").distinct()
    own = journals.join(wanted, "journal_id", "left_semi")
    # Hashes before the choice, so that only they are shuffled and not the calls.
    hashed = own.select("journal_id", "record_id", hashing.journal_hash().alias("h")).groupBy("journal_id").agg(F.max_by("h", "record_id").alias("integrity_hash"))
    return wanted.join(hashed, "journal_id", "left")


def seal_events(folded: DataFrame) -> DataFrame:
    """The summary event of each folded journal; its hash is that of the fold's own ``integrity_hash``, or over what was folded."""
    own = F.col("integrity_hash") if "integrity_hash" in folded.columns else hashing.integrity(F.col("journal_id"), F.col("agent_id"), hashing.time(F.col("started_at")), hashing.time(F.col("completed_at")), F.col("total_tokens").cast("string"), F.col("tool_count").cast("string"))
    payload = F.to_json(F.struct("journal_id", "total_tokens", F.col("tool_count").alias("tool_calls"), own.alias("integrity_hash")))
    return folded.select(F.sha2(F.concat(F.lit("seal|"), F.col("journal_id")), 256).alias("event_id"), F.col("completed_at").alias("event_timestamp"), "agent_id", F.lit("evidence_seal").alias("event_type"), F.lit("T4").alias("source_tier"), payload.alias("payload"), F.col("journal_id").alias("decision_journal_id"))


def deltas(df: DataFrame, by: list[str], order: list[str], total: str, name: str) -> DataFrame:
    """Differences of a running total; the first value of a group is kept whole."""
    before = F.lag(total).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.col(total) - F.coalesce(before, F.lit(0)))


def paired(events: DataFrame, opens: str = "tool_call", closes: str = "tool_result", block: str = "day") -> DataFrame:
    """Each opening event with the closing one that follows it next in its journal: (event_id, result_event_id, elapsed_ms).

    ``prompt_capture`` and ``cot_reasoning`` give the latency of model calls the same way. Blocks of time keep a journal of any size out of one task.
    """
    kind = F.lower(F.trim("event_type"))
    by = ["decision_journal_id"]
    w = Window.partitionBy(*by, "block").orderBy("event_timestamp", "event_id")
    one = F.struct(F.col("event_timestamp").alias("at"), F.col("event_id").alias("id"), F.col("kind"))
    calls = events.where("decision_journal_id is not null").where(kind.isin(opens, closes)).select("event_id", "decision_journal_id", kind.alias("kind"), "event_timestamp", blocks.of("event_timestamp", block).alias("block"))
    carried = blocks.after(calls.groupBy(*by, "block").agg(F.min(one).alias("first")), by, F.last("first")).select(*by, "block", "carried")
    nxt = blocks.joined(calls.withColumn("own", F.lead(one).over(w)), carried, by).withColumn("n", F.coalesce("own", "carried"))
    answered = F.col("n.kind") == closes
    return nxt.where(F.col("kind") == opens).select("event_id", "decision_journal_id", F.when(answered, F.col("n.id")).alias("result_event_id"), F.when(answered, (F.unix_micros("n.at") - F.unix_micros("event_timestamp")) / F.lit(1000.0)).alias("elapsed_ms"))


def islands(events: DataFrame, block: str = "day") -> DataFrame:
    """Events with the running number of their invocation per agent: all between one start and the next share it.

    Numbers run within blocks of time and are shifted by the starts of the blocks before.
    """
    start = F.coalesce((F.lower(F.trim("event_type")) == "invocation_start").cast("bigint"), F.lit(0))
    rows = events.withColumn("block", blocks.of("event_timestamp", block))
    w = Window.partitionBy("agent_id", "block").orderBy("event_timestamp", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = blocks.before(rows.groupBy("agent_id", "block").agg(F.sum(start).alias("starts")), ["agent_id"], F.sum("starts")).select("agent_id", "block", "carried")
    inside = rows.withColumn("own", F.sum(start).over(w))
    return blocks.joined(inside, shift, ["agent_id"]).withColumn("invocation_no", F.col("own") + F.coalesce("carried", F.lit(0))).select(*events.columns, "invocation_no")
