"""Verdicts on proposed tool calls, approvals with a deadline, and the marks they leave on spans.

A missing or broken rule allows (fail open); an approval without an answer in time refuses (fail closed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars

# Seconds.
GATE_TIMEOUT_S = 120
#: Rules are broadcast up to this number; beyond it they are joined by tool name like any table.
BROADCAST_RULES = 20_000


def decide(calls: DataFrame, policies: DataFrame | None) -> DataFrame:
    """``calls`` (with call_id, tool_name, amount) with ``decision``, ``rule`` and ``rule_message`` of the first policy that applies.

    policies: (rule, priority, tool_name, min_amount, decision and, if it has one, message); None observes only. The rules of a tool are
    one array, the first that applies is taken from it in a projection, so calls aren't shuffled.
    """
    if policies is None:
        return calls.withColumn("decision", F.lit("ALLOW")).withColumn("rule", F.lit(None).cast("string")).withColumn("rule_message", F.lit(None).cast("string"))
    message = F.col("message") if "message" in policies.columns else F.lit(None).cast("string")
    p = policies.where("tool_name is not null").select(F.col("tool_name"), F.struct("priority", "rule", F.col("decision").alias("verdict"), "min_amount", message.alias("message")).alias("r"))
    rules = p.groupBy("tool_name").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    if policies.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    first = F.get(F.filter("rules", lambda r: amount >= r["min_amount"]), F.lit(0))
    known = F.when(F.col("v.verdict").isin("BLOCK", "GATE"), F.col("v.verdict")).otherwise("ALLOW")
    return calls.join(rules, "tool_name", "left").withColumn("v", first).withColumn("decision", known).withColumn("rule", F.col("v.rule")).withColumn("rule_message", F.col("v.message")).drop("v", "rules")


def resolve_gates(holds: DataFrame, approvals: DataFrame, timeout_s: int = GATE_TIMEOUT_S) -> DataFrame:
    """(hold_id, outcome, wait_ms): the first status other than ``pending`` within the time, verbatim, else ``timeout``."""
    end = F.col("requested_at") + F.make_interval(secs=F.lit(timeout_s))
    within = (F.col("at") >= F.col("requested_at")) & (F.col("at") <= end) & (F.coalesce(F.col("status"), F.lit("pending")) != "pending")
    seen = holds.join(approvals, "hold_id").where(within).groupBy("hold_id").agg(F.min(F.struct("at", "status")).alias("a"))
    waited = F.coalesce(scalars.elapsed_ms(F.col("requested_at"), F.col("a.at")), F.lit(timeout_s * 1000.0))
    return holds.join(seen, "hold_id", "left").select("hold_id", F.coalesce("a.status", F.lit("timeout")).alias("outcome"), waited.alias("wait_ms"))


def enforce(calls: DataFrame, policies: DataFrame | None, approvals: DataFrame | None = None, timeout_s: int = GATE_TIMEOUT_S) -> DataFrame:
    """What becomes of every proposed call: ``calls`` (call_id, tool_name, amount, proposed_at) with

    decision and rule; ``approval``, the outcome of a gate; ``gate_wait_ms``; ``cancelled``: blocked, or gated and not approved;
    ``cancel_message``; ``mark``, the decision that a cancelled call's span carries. An approved gate leaves none.

    approvals: (hold_id = call_id, at, status). Without it no gate is answered. Only gated calls are joined with answers.
    """
    decided = decide(calls, policies)
    gated = decided.where("decision = 'GATE'").select(F.col("call_id").alias("hold_id"), F.col("proposed_at").alias("requested_at"))
    if approvals is None:
        approvals = gated.select("hold_id", F.col("requested_at").alias("at"), F.lit("pending").alias("status")).limit(0)
    outcomes = resolve_gates(gated, approvals, timeout_s).select(F.col("hold_id").alias("call_id"), F.col("outcome").alias("approval"), F.col("wait_ms").alias("gate_wait_ms"))
    stopped = (F.col("decision") == "BLOCK") | (F.col("decision") == "GATE") & (F.col("approval") != "approved")
    out = decided.join(outcomes, "call_id", "left").withColumn("cancelled", F.coalesce(stopped, F.lit(False)))
    said = scalars.verdict_message(F.col("rule_message"), F.col("decision"), F.col("rule"), F.col("approval"))
    return out.withColumn("cancel_message", F.when(F.col("cancelled"), said)).withColumn("mark", F.when(F.col("cancelled"), F.col("decision"))).withColumn("gate_wait_ms", F.coalesce("gate_wait_ms", F.lit(0.0))).drop("rule_message")


def applied(journals: DataFrame, enforced: DataFrame) -> DataFrame:
    """Journals in which cancelled calls took place as they did: the result is the message, and each call has its ``enforced_decision``.

    enforced: ``enforce`` over the calls of these journals, with record_id and i, the place of the call. Spans and lifecycle events made
    of the outcome carry both. Only cancelled calls are shuffled.
    """
    stop = F.struct(F.col("i").cast("int").alias("i"), F.struct("cancel_message", "mark").alias("what"))
    stops = enforced.where("cancelled").groupBy("record_id").agg(F.map_from_entries(F.collect_list(stop)).alias("stops"))

    def call(c: Column, i: Column) -> Column:
        what = F.col("stops")[i]
        kept = [c[f].alias(f) for f in fields if f not in ("result", "enforced_decision")]
        return F.struct(*kept, F.coalesce(what["cancel_message"], c["result"]).alias("result"), what["mark"].alias("enforced_decision"))

    fields = journals.schema["tool_calls"].dataType.elementType.fieldNames()
    return journals.join(stops, "record_id", "left").withColumn("tool_calls", F.transform("tool_calls", call)).select(*journals.columns)


def marked(tool_spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tool spans with the ``mark`` of their call as ``enforced_decision``. Calls and spans are matched by tool-use id, else by name and turn within the
    journal; each verdict is used once. Cancelled calls keep their span."""
    def keyed(df: DataFrame) -> DataFrame:
        key = F.coalesce(F.nullif("tool_use_id", F.lit("")), F.col("tool_name"))
        w = Window.partitionBy("journal_id", "key").orderBy("seq")
        return df.withColumn("key", key).withColumn("turn", F.row_number().over(w))

    v = keyed(verdicts).select("journal_id", "key", "turn", F.col("mark").alias("enforced_decision"))
    return keyed(tool_spans).join(v, ["journal_id", "key", "turn"], "left").drop("key", "turn")
