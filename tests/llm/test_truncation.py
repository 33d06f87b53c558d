import datetime as dt
import json
import random

from tracewright.llm import endings, truncation

T0 = dt.datetime(2026, 1, 1)
J = "record_id long, agent_id string, model_calls array<struct<model_id:string,prompt_preview:string,cot_reasoning:string,latency_ms:double>>, column string"
E = "event_id string, event_type string, payload string, agent_id string, grp string"
S = "trace_id string, span_kind string, span_id string, span_name string, agent_id string, llm_model_name string, output_value string"
WORDS = "the cache of every feed came back after some minutes and reads its own settings again".split()


def sentence(r, n):
    text = ""
    while len(text) < n:
        text += " ".join(r.choice(WORDS) for _ in range(r.randint(4, 9))).capitalize() + ". "
    return text.strip()


def test_cuts(spark):
    r = random.Random(3)
    events, want = [], set()

    def event(i, kind, field, text, cut, raw=None):
        events.append((f"e{i}", kind, raw or json.dumps({field: text}), "a", "g"))
        if cut:
            want.add(("agent_events.payload", f"e{i}", -1))

    for i in range(400):
        text = sentence(r, r.randint(20, 400))
        if len(text) > 200:
            cut = text[:200]
            event(i, "tool_result", "result_preview", cut, not cut.rstrip().endswith("."))
        else:
            event(i, "tool_result", "result_preview", text, False)
    exact = "A" + "a" * 198 + "."
    event(900, "tool_result", "result_preview", exact, False)
    event(901, "cot_reasoning", "cot_preview", "It came back after some min", True)
    event(902, "cot_reasoning", "cot_preview", "It came back.\n- Torul\n- Zanel", False)
    event(903, "cot_reasoning", "cot_preview", "It came ba…", True)
    event(904, "cot_reasoning", "", "", True, '{"cot_preview": "It came ba')
    event(905, "cot_reasoning", "cot_preview", "", False)
    event(906, "cot_reasoning", "", "", False, '{"n": 4}')
    for i in range(30):
        event(1000 + i, "tool_result", "result_preview", "done", False)
    events += [events[-1], (None, "x", None, None, None), ("dup", "cot_reasoning", '{"cot_preview": "half a wo', "a", "g"), ("dup", "cot_reasoning", '{"cot_preview": "half a wo', "a", "g")]
    want.add(("agent_events.payload", "dup", -1))
    journals = [(1, "a", [("m", "It came back. We", "It came back. We left.", 1.0), ("m", "All fine.", "All fine.", 1.0), ("m", None, None, None), None], "c"), (2, "a", None, "c"), (1, "a", [("m", "It came back. We", "It came back. We left.", 1.0)], "c")]
    spans = [("t1", "LLM", "s1", "governance.model_call", "a", "m", "It stops in the mid"), ("t2", "LLM", "s2", "other", "a", "m", "It stops in the mid"), ("t1", "LLM", "s3", "governance.model_call", None, "m", None), ("t1", "AGENT", "r1", "governance.invocation", "root", None, "It stops"), ("t1", "LLM", "s4", "governance.model_call", None, "m", "All fine.")]
    values = truncation.all_values(spark.createDataFrame(journals, J), spark.createDataFrame(events, E), spark.createDataFrame(spans, S))
    got = [tuple(x) for x in truncation.cut_values(values).collect()]
    journal = ("decision_journals.prompt_preview", "1", 0)
    assert got.count(journal) == 2  # each stored row counts
    assert {x for x in got} == want | {journal, ("spans.output_value", "s1", -1)}
    shares = {(x["source_field"], x["column"]): x for x in truncation.cut_shares(values).where("grp is not null").groupBy("source_field", "column").sum("n_values", "n_cut").collect()}
    assert shares["spans.output_value", "output_value"]["sum(n_cut)"] == 1
    reasons = truncation.cut_shares(values).groupBy("source_field").sum(*(f"n_{r}" for r in truncation.REASONS)).collect()
    events = next(x for x in reasons if x["source_field"] == "agent_events.payload")
    assert events["sum(n_spike)"] > 100 and events["sum(n_broken_json)"] == 2 and events["sum(n_mark)"] == 1 and events["sum(n_open_end)"] == 1
    rooted = truncation.span_values(spark.createDataFrame(spans, S), True).collect()
    assert {x["row_key"]: x["grp"] for x in rooted} == {"s1": "a", "s3": "root", "s4": "root"}


def test_byte_caps(spark):
    """A cap of 120 bytes over texts of mixed scripts: one length in bytes, many in characters."""
    r = random.Random(4)
    spans, want = [], set()
    for i in range(600):
        text = ""
        while len(text.encode()) < r.randint(20, 260):
            text += r.choice(["the cache came back", "请先保存登录表单", "налаштування", "après"]) + r.choice([" ", ", ", ". "])
        raw = text.strip().encode()
        cut = len(raw) > 120
        kept = raw[:120].decode("utf-8", "ignore") if cut else text.strip().rstrip(",") + "."
        spans.append(("t", "LLM", f"s{i}", "governance.model_call", "a", "m", kept))
        if cut and not kept.rstrip().endswith("."):
            want.add(f"s{i}")
    values = truncation.all_values(spark.createDataFrame([], J), spark.createDataFrame([], E), spark.createDataFrame(spans, S))
    assert 120 in {x["at"] for x in truncation.spikes(values, "n_bytes", slack=3).collect()} and truncation.spikes(values, "n_chars").count() == 0
    judged = truncation.judged(values).collect()
    assert {x["row_key"] for x in judged if x["reason"]} == want
    spike = [x for x in judged if x["reason"] == "spike"]
    assert len(spike) > 100 and any(x["ending"] == endings.NATURAL or x["ending"] == endings.OPEN for x in spike)


def test_a_stock_phrase_is_no_spike(spark):
    spans = [("t", "LLM", f"s{i}", "governance.model_call", "a", "m", "done") for i in range(50)] + [("t", "LLM", f"l{i}", "governance.model_call", "a", "m", "no such " + "very " * 30 + "long phrase") for i in range(50)]
    values = truncation.all_values(spark.createDataFrame([], J), spark.createDataFrame([], E), spark.createDataFrame(spans, S))
    assert truncation.cut_values(values).count() == 0


def test_empty_tables(spark):
    values = truncation.all_values(*(spark.createDataFrame([], s) for s in (J, E, S)))
    assert truncation.cut_values(values).count() == 0 and truncation.cut_shares(values).count() == 0


def test_both_readings_of_an_end_agree(spark):
    texts = ["Done.", "and the cac", "wait…", "x [cut]", "`a --b 1`", "See https://a.example/b", "​", "", "完了。", "请先保存登录表单，然后", "[1, 2]", "null", "Total: 12", "ok [...]", "1. a\n2. b", "x" * 100_000, " N/A ", "- no item" * 300, "- a" + " long item" * 300, "Done." + " " * 500, "*" * 500 + "null", "a\nb.", "a.\nb", "ร้านปิดแล้ว", "half �"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("l", truncation.last_line(rows_col("t"))).select("t", truncation.end_kind(rows_col("t"), rows_col("l")).alias("k")).collect()
    for row in rows:
        assert row["k"] == endings.ending(row["t"]), row["t"][:40]


def rows_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
