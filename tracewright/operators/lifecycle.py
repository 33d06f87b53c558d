"""Canonical events from journals: one row per lifecycle step, payloads by type and capped as captured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import hashing
from tracewright.schemas import CAPS


def _step(kind: str, payload: Column) -> Column:
    return F.struct(F.lit(kind).alias("event_type"), payload.alias("payload"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def steps(model_fields: frozenset[str] = frozenset(), records: bool = False) -> Column:
    """The array of (event_type, payload) of one journal row, in the order they occur.

    model_fields: those of a model call; the keys of its state and its stop reason come from there if it has them. records: the payloads of
    answers also hold the whole record, so that the journal can be folded back from them.
    """
    def field(call: Column, name: str, missing: Column) -> Column:
        return F.coalesce(call[name], missing) if name in model_fields else missing

    def whole(record: Column) -> dict[str, Column]:
        return {"record": record} if records else {}

    start = _step("invocation_start", _json(user_message=F.left("user_message", F.lit(CAPS["event.user_message"]))))
    seal = _step("evidence_seal", _json(journal_id=F.col("journal_id"), total_tokens=F.col("total_tokens"), tool_calls=F.coalesce(F.size("tool_calls"), F.lit(0)), integrity_hash=F.col("integrity_hash")))

    def of_model(call: Column) -> Column:
        preview = F.left(call["cot_reasoning"], F.lit(CAPS["event.cot_preview"]))
        keys = field(call, "invocation_state_keys", F.array().cast("array<string>"))
        answer = _json(cot_preview=preview, stop_reason=field(call, "stop_reason", F.lit("")), latency_ms=call["latency_ms"], **whole(call))
        return F.array(_step("prompt_capture", _json(invocation_state_keys=keys)), _step("cot_reasoning", answer))

    def of_tool(call: Column) -> Column:
        preview = F.left(call["result"], F.lit(CAPS["tool_call.result"]))
        return F.array(_step("tool_call", _json(tool_name=call["tool_name"])), _step("tool_result", _json(tool_name=call["tool_name"], result_preview=preview, duration_ms=call["duration_ms"], **whole(call))))

    none = F.array().cast("array<struct<event_type:string,payload:string>>")
    models = F.coalesce(F.flatten(F.transform("model_calls", of_model)), none)
    tools = F.coalesce(F.flatten(F.transform("tool_calls", of_tool)), none)
    return F.concat(F.array(start), models, tools, F.when(F.col("sealed"), F.array(seal)).otherwise(none))


def journal_events(journals: DataFrame, records: bool = False) -> DataFrame:
    """(event_id, seq, event_type, payload, agent_id, decision_journal_id, source_tier, integrity_hash) of every step; map-only, ids from natural keys."""
    fields = frozenset(journals.schema["model_calls"].dataType.elementType.fieldNames())
    e = journals.select("record_id", "agent_id", "agent_name", F.col("journal_id").alias("decision_journal_id"), F.posexplode(steps(fields, records)).alias("seq", "s")).select("*", "s.event_type", "s.payload").drop("s")
    e = e.withColumn("event_id", F.sha2(F.concat_ws("|", "record_id", "seq"), 256)).withColumn("source_tier", F.lit("T4"))
    columns = ("event_id", "agent_id", "agent_name", "event_type", "source_tier", "payload", "decision_journal_id")
    return e.withColumn("integrity_hash", hashing.integrity(*(F.col(c) for c in columns), F.col("seq").cast("string")))
