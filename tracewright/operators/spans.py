"""Span rows from journals and HTTP exchanges, their nesting, and the attachment of orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import endpoints, redact, scalars
from tracewright.operators import blocks
from tracewright.schemas import CAPS

COLUMNS = ("span_id", "parent_span_id", "span_name", "span_kind", "journal_id", "agent_id", "agent_name", "input_value", "output_value", "model_name", "tool_name", "prompt_tokens", "completion_tokens", "total_tokens", "tool_count", "latency_ms", "status", "session_id", "integrity_hash", "source", "enforced_decision")
#: What names the maker of a span in its attributes; the prefix of attributes of its own.
SOURCE, NAMESPACE = "tracewright", "governance"


def _span(df: DataFrame, **columns) -> DataFrame:
    kinds = {"prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint", "tool_count": "bigint", "latency_ms": "double"}
    return df.select(*((columns[c] if c in columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def _id(*parts) -> F.Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def agent_spans(journals: DataFrame) -> DataFrame:
    """The root span of each journal row; the span's own status is an attribute, never the transport's. The status is that of the invocation if the table has one, else ``ok``."""
    key = F.col("record_id").cast("string")
    cap = CAPS["span.value"]
    known = F.col("invocation_status") if "invocation_status" in journals.columns else F.lit(None).cast("string")
    return _span(
        journals,
        span_id=_id(key, F.lit("agent")), span_name=F.lit("governance.invocation"), span_kind=F.lit("AGENT"), journal_id=F.col("journal_id"), agent_id=F.col("agent_id"), agent_name=F.col("agent_name"),
        input_value=redact.safe_value(F.col("user_message"), cap), output_value=redact.safe_value(F.col("final_response"), cap), total_tokens=F.col("total_tokens"),
        tool_count=F.coalesce(F.size("tool_calls"), F.lit(0)), status=scalars.status(known), session_id=F.col("journal_id"), integrity_hash=F.col("integrity_hash"), source=F.lit(SOURCE),
    )


def llm_spans(journals: DataFrame, keep_zero_latency: bool = True) -> DataFrame:
    """Model call spans; their input is the system prompt, of the call if it has one, else of the journal."""
    fields = journals.schema["model_calls"].dataType.elementType.fieldNames()
    key = F.col("record_id").cast("string")
    own = F.col("system_prompt") if "system_prompt" in journals.columns else F.lit(None).cast("string")
    calls = journals.select("record_id", "journal_id", own.alias("prompt"), F.posexplode("model_calls").alias("i", "c"))
    prompt = F.coalesce(F.col("c.system_prompt"), F.col("prompt")) if "system_prompt" in fields else F.col("prompt")
    return _span(
        calls,
        span_id=_id(key, F.lit("llm"), F.col("i")), parent_span_id=_id(key, F.lit("agent")), span_name=F.lit("governance.model_call"), span_kind=F.lit("LLM"), journal_id=F.col("journal_id"), model_name=F.col("c.model_id"),
        input_value=redact.safe_value(F.left(F.coalesce(prompt, F.lit("")), F.lit(CAPS["llm_span.input"])), CAPS["span.value"]), output_value=redact.safe_value(F.col("c.cot_reasoning"), CAPS["llm_span.output"]), prompt_tokens=F.element_at("c.token_usage", "input_tokens"), completion_tokens=F.element_at("c.token_usage", "output_tokens"),
        latency_ms=scalars.kept_latency(F.col("c.latency_ms"), keep_zero_latency),
    )


def tool_spans(journals: DataFrame, keep_zero_latency: bool = True) -> DataFrame:
    """Tool spans carry the agent, so that they can be attached when they arrive without their parent. Arguments that are no object become ``{}``;
    the decision that cancelled a call comes from the call's ``enforced_decision``, if it has one."""
    enforced = "enforced_decision" in journals.schema["tool_calls"].dataType.elementType.fieldNames()
    key = F.col("record_id").cast("string")
    calls = journals.select("record_id", "journal_id", "agent_id", "agent_name", F.posexplode("tool_calls").alias("i", "c"))
    cap = CAPS["tool_span.value"]
    return _span(
        calls,
        span_id=_id(key, F.lit("tool"), F.col("i")), parent_span_id=_id(key, F.lit("agent")), span_name=F.col("c.tool_name"), span_kind=F.lit("TOOL"), journal_id=F.col("journal_id"), agent_id=F.col("agent_id"), agent_name=F.col("agent_name"),
        input_value=redact.safe_value(F.coalesce(scalars.object_json(F.col("c.tool_args")), F.lit("{}")), cap), output_value=redact.safe_value(F.col("c.result"), cap), tool_name=F.col("c.tool_name"),
        latency_ms=scalars.kept_latency(F.col("c.duration_ms"), keep_zero_latency), enforced_decision=F.col("c.enforced_decision") if enforced else F.lit(None),
    )


def one_shot(calls: DataFrame) -> DataFrame:
    """Two spans, an invocation and its model call, for each (call_id, agent_id, model_id, prompt, response, input_tokens, output_tokens, latency_ms, status)."""
    cap = CAPS["span.value"]
    kinds = F.explode(F.array(F.lit("AGENT"), F.lit("LLM"))).alias("kind")
    d = calls.select("*", kinds)
    agent = F.col("kind") == "AGENT"
    return _span(
        d,
        span_id=_id(F.col("call_id"), F.lower("kind")), parent_span_id=F.when(~agent, _id(F.col("call_id"), F.lit("agent"))),
        span_name=F.when(agent, "governance.invocation").otherwise("governance.model_call"), span_kind=F.col("kind"), journal_id=scalars.trace_id(F.col("call_id")), agent_id=F.when(agent, F.col("agent_id")),
        input_value=redact.safe_value(F.col("prompt"), cap), output_value=redact.safe_value(F.col("response"), cap), model_name=F.when(~agent, F.col("model_id")),
        prompt_tokens=F.when(~agent, F.col("input_tokens")), completion_tokens=F.when(~agent, F.col("output_tokens")), total_tokens=F.when(agent, F.col("input_tokens") + F.col("output_tokens")),
        tool_count=F.when(agent, F.lit(0)), latency_ms=F.when(~agent, F.col("latency_ms")), status=F.when(agent, scalars.status(F.col("status"))),
    )


def http_calls(exchanges: DataFrame) -> DataFrame:
    """(method, url, status int, error) as one-shot calls: the host as model, method and path as prompt, no tokens."""
    return exchanges.select(
        F.concat_ws(" ", "method", "url").alias("call_id"), F.lit("").alias("agent_id"), endpoints.http_host(F.col("url")).alias("model_id"), endpoints.http_prompt(F.col("method"), F.col("url")).alias("prompt"), F.lit("").alias("response"),
        F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"), F.lit(None).cast("double").alias("latency_ms"), endpoints.http_class(F.col("status"), F.col("error")).alias("status"),
    )


def attribute_names(namespace: str = NAMESPACE) -> dict[str, str]:
    """Attribute and column of every exported value."""
    own = {"agent.id": "agent_id", "journal.id": "journal_id", "invocation.status": "invocation_status", "journal.integrity_hash": "integrity_hash", "tool.count": "tool_count", "latency_ms": "latency_ms", "enforcement.decision": "enforcement_decision"}
    shared = {
        "openinference.span.kind": "span_kind", "agent.name": "agent_name", "session.id": "session_id", "input.value": "input_value", "output.value": "output_value", "llm.model_name": "llm_model_name",
        "llm.token_count.prompt": "token_count_prompt", "llm.token_count.completion": "token_count_completion", "llm.token_count.total": "token_count_total", "tool.name": "tool_name",
    }
    return shared | {f"{namespace}.{k}": c for k, c in own.items()}


def attribute_bag(spans: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(span_id, attributes): the export form, absent values left out, free text redacted; root spans name their source."""
    pairs = [x for k, c in attribute_names(namespace).items() for x in (F.lit(k), F.col(c).cast("string"))]
    bag = F.create_map(*pairs, F.lit("source"), F.when(F.col("span_kind") == "AGENT", SOURCE))
    return spans.select("span_id", redact.redact_attributes(F.map_filter(bag, lambda k, v: v.isNotNull())).alias("attributes"))


def otlp(spans: DataFrame, service_name: str = "agent", namespace: str = NAMESPACE) -> DataFrame:
    """(span_id, line): each span as one line of the OTLP JSON mapping, numbers typed, free text redacted."""
    kinds = {"bigint": "intValue", "int": "intValue", "double": "doubleValue"}
    types = dict(spans.dtypes)

    def value(column: str, c) -> F.Column:
        slot = kinds.get(types[column], "stringValue")
        # The mapping writes 64-bit integers as text.
        slots = {"stringValue": "string", "intValue": "string", "doubleValue": "double"}
        return F.struct(*((c if k == slot else F.lit(None)).cast(t).alias(k) for k, t in slots.items()))

    found = [F.struct(F.lit(k).alias("key"), value(c, redact.redact_pii(F.col(c)) if c in ("input_value", "output_value") else F.col(c)).alias("value"), F.col(c).isNotNull().alias("there")) for k, c in attribute_names(namespace).items()]
    source = F.struct(F.lit("source").alias("key"), F.struct(F.lit(SOURCE).alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value"), (F.col("span_kind") == "AGENT").alias("there"))
    held = F.transform(F.filter(F.array(*found, source), lambda x: x["there"]), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    nanos = lambda c: F.concat(F.unix_micros(c).cast("string"), F.lit("000"))
    # Kind 1 is internal, status code 1 is ok: the transport is always well, the invocation's own status is an attribute.
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("span_name").alias("name"), F.lit(1).alias("kind"),
        nanos("start_time").alias("startTimeUnixNano"), nanos("end_time").alias("endTimeUnixNano"), held.alias("attributes"), F.struct(F.lit(1).alias("code")).alias("status"),
    )
    name = F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service_name).alias("stringValue")).alias("value"))
    whole = F.struct(F.array(F.struct(F.struct(F.array(name).alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit(NAMESPACE).alias("name")).alias("scope"), F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return spans.select("span_id", F.to_json(whole).alias("line"))


def nested(spans: DataFrame) -> DataFrame:
    """Children with their parents: (span_id, parent_span_id, span_name, parent_name); ``spans`` are unique."""
    parents = spans.select(F.col("span_id").alias("parent_span_id"), F.col("span_name").alias("parent_name"))
    return spans.where("parent_span_id is not null").select("span_id", "parent_span_id", "span_name").join(parents, "parent_span_id")


def attached(children: DataFrame, invocations: DataFrame, block: str = "day") -> DataFrame:
    """Each child with the latest invocation of its agent that began at or before it.

    A union and windows over blocks of time instead of a range join, so work grows with the rows, and an agent with
    a third of them is spread over its blocks; what the blocks before end with is carried in.
    """
    rows = invocations.select("agent_id", F.col("start_time").alias("at"), F.lit(0).alias("late"), F.col("span_id").alias("root"), F.lit(None).cast("string").alias("span_id"))
    rows = rows.unionByName(children.select("agent_id", F.col("start_time").alias("at"), F.lit(1).alias("late"), F.lit(None).cast("string").alias("root"), "span_id")).withColumn("block", blocks.of("at", block))
    w = Window.partitionBy("agent_id", "block").orderBy("at", "late", F.coalesce("root", "span_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.groupBy("agent_id", "block").agg(F.max(F.when(F.col("root").isNotNull(), F.struct("at", "root"))).alias("last"))
    carried = blocks.before(ends, ["agent_id"], F.last("last", ignorenulls=True)).select("agent_id", "block", F.col("carried.root").alias("carried"))
    inside = rows.withColumn("own", F.last("root", ignorenulls=True).over(w)).where("late = 1")
    return blocks.joined(inside, carried, ["agent_id"]).select("span_id", "agent_id", F.coalesce("own", "carried").alias("attached_to"))
