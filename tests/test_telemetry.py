import datetime as dt
import json

from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import journals, policy, spans
from tracewright.schemas import AGENT_EVENT
from tracewright.sources import sinks

T0 = dt.datetime(2026, 1, 1)


def test_gate_times_out_and_keeps_the_status(spark):
    holds = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0), ("d", T0)], "hold_id string, requested_at timestamp")
    s = lambda n: T0 + dt.timedelta(seconds=n)
    answers = [("a", s(1), "pending"), ("a", s(5), "approved"), ("a", s(9), "denied"), ("b", s(121), "approved"), ("c", s(120), "expired"), ("c", s(2), None)]
    got = policy.resolve_gates(holds, spark.createDataFrame(answers, "hold_id string, at timestamp, status string"))
    assert {r["hold_id"]: r["outcome"] for r in got.collect()} == {"a": "approved", "b": "timeout", "c": "expired", "d": "timeout"}


def test_decisions_fail_open(spark):
    calls = spark.createDataFrame([("1", "sql", 5.0), ("2", "sql", 50.0), ("3", "mail", None), ("4", None, 1.0)], "call_id string, tool_name string, amount double")
    rules = spark.createDataFrame([("big", 1, "sql", 10.0, "BLOCK"), ("odd", 1, "mail", 0.0, "PERHAPS")], "rule string, priority int, tool_name string, min_amount double, decision string")
    assert {r["call_id"]: r["decision"] for r in policy.decide(calls, rules).collect()} == {"1": "ALLOW", "2": "BLOCK", "3": "ALLOW", "4": "ALLOW"}
    assert {r["decision"] for r in policy.decide(calls, None).collect()} == {"ALLOW"}


def test_verdicts_are_used_once(spark):
    tools = spark.createDataFrame([("j", 1, "sql", ""), ("j", 2, "sql", ""), ("j", 3, "sql", "id7")], "journal_id string, seq int, tool_name string, tool_use_id string")
    verdicts = spark.createDataFrame([("j", 1, "sql", "", "BLOCK"), ("j", 9, "sql", "id7", "GATE")], "journal_id string, seq int, tool_name string, tool_use_id string, mark string")
    assert {r["seq"]: r["enforced_decision"] for r in policy.marked(tools, verdicts).collect()} == {1: "BLOCK", 2: None, 3: "GATE"}


def test_attach_takes_the_latest_before(spark):
    roots = spark.createDataFrame([("p1", "a", T0), ("p2", "a", T0 + dt.timedelta(seconds=5))], "span_id string, agent_id string, start_time timestamp")
    kids = spark.createDataFrame([("c0", "a", T0 - dt.timedelta(seconds=1)), ("c1", "a", T0), ("c2", "a", T0 + dt.timedelta(seconds=9)), ("c3", "b", T0)], "span_id string, agent_id string, start_time timestamp")
    assert {r["span_id"]: r["attached_to"] for r in spans.attached(kids, roots).collect()} == {"c0": None, "c1": "p1", "c2": "p2", "c3": None}


def test_once_keeps_the_earliest(spark):
    df = spark.createDataFrame([("e", T0 + dt.timedelta(1), "late"), ("e", T0, "early")], "event_id string, ingested_at timestamp, v string")
    assert [r["v"] for r in journals.once(df).collect()] == ["early"]


SPAN = "span_id string, trace_id string, parent_span_id string, span_name string, span_kind string, start_time timestamp, end_time timestamp, agent_id string, agent_name string, journal_id string, session_id string, input_value string, output_value string, invocation_status string, integrity_hash string, token_count_total bigint, tool_count bigint, llm_model_name string, token_count_prompt bigint, token_count_completion bigint, tool_name string, latency_ms double, enforcement_decision string"


def test_sinks(spark, tmp_path):
    row = ("1", "t", None, "governance.invocation", "AGENT", T0, T0, "a", "n", "j", "j", "a@b.co", "x", "ok", "h", 7, 2, None, None, None, None, None, None)
    s = spark.createDataFrame([row], SPAN)
    assert sinks.export_spans(s, str(tmp_path / "o")).count() == 1
    line = json.loads(spark.read.text(str(tmp_path / "o")).first()[0])
    span = line["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    held = {a["key"]: a["value"] for a in span["attributes"]}
    assert held["input.value"] == {"stringValue": "[EMAIL]"} and held["llm.token_count.total"] == {"intValue": "7"} and held["source"] == {"stringValue": spans.SOURCE} and "tool.name" not in held
    assert span["startTimeUnixNano"] == str(int(T0.replace(tzinfo=dt.UTC).timestamp()) * 10**9) and "parentSpanId" not in span and line["resourceSpans"][0]["resource"]["attributes"][0]["value"]["stringValue"] == "agent"
    none = sinks.export_spans(s, str(tmp_path / "none"), enabled=False)
    assert not (tmp_path / "none").exists() and none.count() == 0 and none.columns == ["span_id", "line"]
    sinks.append_events(spark.createDataFrame([("e", T0, T0, "a", "n", "Tool_Call", "T4", "a@b.co", "j", None)], AGENT_EVENT), str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert stored.first()["payload"] == "[EMAIL]" and stored.first()["type"] == "tool_call" and len(stored.first()["integrity_hash"]) == 64
    sinks.clear(stored, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 0


def test_enforcement(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    calls = spark.createDataFrame([("1", "sql", 50.0, T0), ("2", "mail", 1.0, T0), ("3", "mail", 1.0, T0), ("4", "mail", 1.0, T0), ("5", "other", None, T0), ("6", "odd", 1.0, None), ("7", None, 1.0, T0)], "call_id string, tool_name string, amount double, proposed_at timestamp")
    rules = spark.createDataFrame([("big", 1, "sql", 10.0, "BLOCK", "too big"), ("ask", 2, "mail", 0.0, "GATE", None), ("never", 3, "mail", 0.0, "BLOCK", None), ("what", 1, "odd", 0.0, "MAYBE", None)], "rule string, priority int, tool_name string, min_amount double, decision string, message string")
    answers = spark.createDataFrame([("2", s(3), "approved"), ("2", s(9), "denied"), ("3", s(1), "pending"), ("3", s(4), "denied"), ("4", s(130), "approved")], "hold_id string, at timestamp, status string")
    got = {r["call_id"]: r for r in policy.enforce(calls, rules, answers).collect()}
    assert {k: (r["cancelled"], r["mark"], r["approval"]) for k, r in got.items()} == {"1": (True, "BLOCK", None), "2": (False, None, "approved"), "3": (True, "GATE", "denied"), "4": (True, "GATE", "timeout"), "5": (False, None, None), "6": (False, None, None), "7": (False, None, None)}
    assert got["1"]["cancel_message"] == "too big" and got["3"]["cancel_message"] == "GATE by policy ask (approval denied)" and [got[k]["gate_wait_ms"] for k in "1234"] == [0.0, 3000.0, 4000.0, 120000.0]
    assert not any(r["cancelled"] for r in policy.enforce(calls, None).collect()) and {r["approval"] for r in policy.enforce(calls, rules).collect()} == {None, "timeout"}


def test_blocks_carry_over(spark):
    """The same in blocks of an hour as in one."""
    rows = [(f"e{i:03d}", T0 + dt.timedelta(minutes=17 * i), ("invocation_start", "tool_call", "tool_result", "other")[i * 7 % 4], "hot", "j") for i in range(60)] + [("n", None, "tool_call", "hot", "j"), ("o", T0, "tool_call", None, None)]
    events = spark.createDataFrame(rows, "event_id string, event_timestamp timestamp, event_type string, agent_id string, decision_journal_id string")
    for f in (journals.paired, journals.islands):
        assert sorted(map(str, f(events, block="hour").collect())) == sorted(map(str, f(events, block="year").collect()))
    kids, roots = (events.where(c).select(F.col("event_id").alias("span_id"), "agent_id", F.col("event_timestamp").alias("start_time")) for c in ("event_type = 'tool_call'", "event_type = 'invocation_start'"))
    assert sorted(map(str, spans.attached(kids, roots, "hour").collect())) == sorted(map(str, spans.attached(kids, roots, "year").collect()))


def test_conversations(spark):
    text = "array<struct<role:string,content:string,blocks:array<struct<text:string>>>>"
    cases = [
        ([("user", "a", None), ("user", "b", None)], "b"), ([("user", "a", None), ("user", None, [("",), (None,)])], "a"), ([("user", "a", None), ("user", "", None)], ""), ([("user", None, [("",), ("x",), ("y",)])], "x"),
        ([("user", "a", None), ("assistant", "b", None)], "a"), ([], ""), ([("assistant", "b", None)], ""),
    ]
    for turns, want in cases:
        assert spark.createDataFrame([(turns,)], f"m {text}").select(scalars.user_message(F.col("m"))).first()[0] == want, turns


def test_streams_agree_with_batch(spark, tmp_path):
    from tracewright.streaming import jobs

    rows = [("e1", T0, T0, "a", "n", "tool_call", "T4", "{}", "j", "h"), ("e1", T0, T0, "a", "n", "tool_call", "T4", "{}", "j", "h"), ("e2", T0, T0, "a", "n", "Evidence_Seal ", "T4", '{"total_tokens": 7}', "j", "h"), ("e3", T0, T0, "a", "n", "tool_call", "T4", None, "open", "h")]
    spark.createDataFrame(rows, jobs.AGENT_EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"))
    assert jobs.drained(jobs.deduplicated(stream)).count() == 3
    assert [tuple(r) for r in jobs.drained(jobs.folded(stream)).collect()] == [("j", 1, 0, 7, [None])]
    seen, errors = [], []

    def bad(batch, n):
        raise RuntimeError("no")

    q = jobs.subscribed(stream, [bad, lambda b, n: seen.append(b.count())], errors.append).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 4 and len(errors) == 1


def test_gate_stream(spark, tmp_path):
    from tracewright.streaming import jobs

    s = lambda n: T0 + dt.timedelta(seconds=n)
    holds = [("a", s(0)), ("b", s(0)), ("c", s(10))]
    answers = [("a", s(5), "approved"), ("a", s(6), "pending"), ("a", s(7), "denied"), ("a", s(-5), "early"), ("b", s(300), "approved"), ("z", s(90_000), "late enough")]
    requests = "hold_id string, requested_at timestamp"
    replies = "hold_id string, at timestamp, status string"
    spark.createDataFrame(holds, requests).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("end", s(90_000))], requests).write.mode("append").parquet(str(tmp_path / "r"))
    spark.createDataFrame(answers, replies).write.parquet(str(tmp_path / "a"))
    out = jobs.drained(jobs.gates(spark.readStream.schema(requests).parquet(str(tmp_path / "r")), spark.readStream.schema(replies).parquet(str(tmp_path / "a"))))
    assert sorted((r["hold_id"], r["outcome"]) for r in out.where("hold_id <> 'end'").collect()) == [("a", "approved"), ("b", "timeout"), ("c", "timeout")]


def test_gate_stream_keeps_holds_together(spark, tmp_path):
    """Thousands of holds share states, since each state is a call of Python; answers of an earlier batch count, whatever came before them."""
    from tracewright.streaming import jobs

    requests, replies = "hold_id bigint, requested_at timestamp", "hold_id bigint, at timestamp, status string"
    s = lambda n: T0 + dt.timedelta(seconds=n)
    n = 3000
    spark.createDataFrame([(2**60 + i, s(0)) for i in range(n)] + [(-2, s(90_000))], requests).write.parquet(str(tmp_path / "r/1"))
    spark.createDataFrame([(2**60 + i, s(100 + i % 50), f"said {i}") for i in range(n)], replies).write.parquet(str(tmp_path / "a/1"))
    spark.createDataFrame([(-1, s(89_950), "early"), (-1, s(90_070), "approved")], replies).write.parquet(str(tmp_path / "a/2"))
    r, a = (spark.readStream.schema(x).option("recursiveFileLookup", True).parquet(str(tmp_path / f)) for x, f in ((requests, "r"), (replies, "a")))

    def run():
        q = jobs.gates(r, a).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])

    assert run() < n
    # Hold -1 is asked after its answers have come.
    spark.createDataFrame([(-1, s(90_060)), (-3, s(180_000))], requests).write.parquet(str(tmp_path / "r/2"))
    run()
    want = {2**60 + i: f"said {i}" if i % 50 <= 20 else "timeout" for i in range(n)} | {-1: "approved", -2: "timeout"}
    out = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {h: o for h, _, o in out} == want and len(out) == len(want) and {at for h, at, _ in out if h > 0} == {s(0)}


def test_span_stream_keeps_ids_together(spark, tmp_path):
    """Thousands of ids share states; a child waits over batches, also those of the first one, and comes once."""
    from tracewright.streaming import jobs

    shape = "span_id string, parent_span_id string, span_name string, ingested_at timestamp"
    s = lambda n: T0 + dt.timedelta(hours=n)
    n = 2000
    first = [(f"p{i}", None, f"n{i}", s(0)) for i in range(n)] + [(f"c{i}", f"p{i}", "c", s(i % 2)) for i in range(n)] + [("c0", "p0", "c", s(1)), ("waits", "later", "w", s(1)), ("lone", "never", None, s(1))]
    batches = [first, [("x", None, "x", s(2))], [("later", None, None, s(3)), ("waits", "later", "w", s(3)), ("c1", "p1", "c", s(3))], [("waits", "later", "w", s(4)), ("new", "p5", "c", s(4))]]
    states = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = jobs.nested(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        states += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    want = [(f"c{i}", f"p{i}", "c", f"n{i}") for i in range(n)] + [("waits", "later", "w", None), ("new", "p5", "c", "n5")]
    assert sorted(map(str, (tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()))) == sorted(map(str, want))
    assert max(states) < n
