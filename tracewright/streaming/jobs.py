"""Structured Streaming forms of the batch operators.

All take and give streaming DataFrames; ``drained`` runs one over what is there now, for tests and
backfills. Event-time timers, not processing-time ones, so that a replay decides as the first run did.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.schemas import AGENT_EVENT
from tracewright.sources.tables import new_folder, prepare

#: A call of Python takes about a millisecond, whatever it gets; keys with little state are kept together in so many states.
BUCKETS = 1024
DAY_MS = 24 * 3_600_000


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Events from a folder of Parquet files, new files as they arrive."""
    return spark.readStream.schema(AGENT_EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, within: str = "7 days") -> DataFrame:
    """Each event once, however often it is delivered within a time of arrival."""
    return events.withWatermark("ingested_at", within).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Events per type and window of arrival; later ones than ``late`` are dropped with their window."""
    return events.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _stateful(df: DataFrame, by: str, function, out: str, state: str) -> DataFrame:
    return df.groupBy(by).applyInPandasWithState(function, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _later(state: GroupState, hours: int = 24) -> None:
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + hours * 3_600_000)


def _folded(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
    """State: what is known of the journal so far, as JSON: its tool calls by event (order and name), its model calls' events, its seal."""
    if state.hasTimedOut:
        state.remove()
        return
    held = json.loads(state.get[0]) if state.exists else {"tools": {}, "models": [], "tokens": None}
    models = set(held["models"])
    for b in batches:
        for kind, event, at, tool, tokens in zip(b["kind"], b["event_id"], b["at"], b["tool_name"], b["total_tokens"], strict=True):
            if kind == "tool_call":
                held["tools"].setdefault(event, [int(at), tool])
            elif kind == "cot_reasoning":
                models.add(event)
            elif kind == "evidence_seal":
                held["tokens"] = max(held["tokens"] or 0, int(tokens) if pd.notna(tokens) else 0)
    if held["tokens"] is not None:
        # A seal closes the journal; a state that is kept would count a repeat twice.
        if state.exists:
            state.remove()
        names = [name for _, _, name in sorted((at, event, name) for event, (at, name) in held["tools"].items())] if held["tools"] else []
        yield pd.DataFrame({"journal_id": [key[0]], "tool_count": [len(names)], "model_count": [len(models)], "total_tokens": [held["tokens"]], "tool_names": [names]})
    else:
        held["models"] = sorted(models)
        state.update((json.dumps(held),))
        _later(state)


def folded(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(journal_id, tool_count, model_count, total_tokens, tool_names) as soon as a journal's seal is seen, repeats of an event once and names in the order of their
    times; open journals are let go a day behind the watermark."""
    kind = F.lower(F.trim("event_type"))
    payload = F.from_json("payload", "total_tokens bigint, tool_name string")
    rows = events.withWatermark("ingested_at", late).where("decision_journal_id is not null").where(kind.isin("tool_call", "cot_reasoning", "evidence_seal"))
    rows = rows.select("decision_journal_id", kind.alias("kind"), "event_id", "ingested_at", F.coalesce(F.unix_micros("event_timestamp"), F.lit(0)).alias("at"), payload["tool_name"].alias("tool_name"), payload["total_tokens"].alias("total_tokens"))
    return _stateful(rows, "decision_journal_id", _folded, "journal_id string, tool_count bigint, model_count bigint, total_tokens bigint, tool_names array<string>", "held string")


def _bucketed(df: DataFrame, by: str, function, out: str) -> DataFrame:
    """``function`` once for each bucket of keys, not for each key."""
    return _stateful(df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS))), "bucket", function, out, "held string")


def _kept(entries: list[list], state: GroupState) -> None:
    """Keeps the entries of a bucket, which have their deadline last; its timer is the first of them."""
    if entries:
        state.update((json.dumps(entries),))
        state.setTimeoutTimestamp(max(min(e[-1] for e in entries), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def _first_answers(timeout_us: int):
    def of_bucket(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
        """State: open holds with when they were asked, their answers (at, status) that may count, and when the hold is due."""
        now = max(state.getCurrentWatermarkMs(), 0)
        held = {hold: rest for hold, *rest in json.loads(state.get[0])} if state.exists else {}
        for b in () if state.hasTimedOut else batches:
            for hold, at, said in zip(b["hold_id"].tolist(), b["us"].tolist(), b["status"].tolist(), strict=True):
                x = held.setdefault(hold if isinstance(hold, str) else None, [None, [], 0])
                if not isinstance(said, str):
                    x[0] = at if x[0] is None else min(x[0], at)
                else:
                    x[1].append([at, said])
                    # The first batch has no watermark yet.
                    x[2] = max(x[2], (now or at // 1000) + DAY_MS)
        left, done = [], []
        for hold, (asked, answers, due) in held.items():
            if asked is not None:
                # Answers before the question or after its end are none; as long as it isn't known, all are kept.
                answers = sorted(x for x in answers if asked <= x[0] <= asked + timeout_us)[:1]
                due = (asked + timeout_us) // 1000 + 1
            if due >= now:
                left.append([hold, asked, answers, due])
            elif asked is not None:
                done.append((hold, asked, answers[0][1] if answers else "timeout"))
        _kept(left, state)
        if done:
            yield pd.DataFrame(done, columns=["hold_id", "asked", "outcome"])

    return of_bucket


def gates(requests: DataFrame, answers: DataFrame, timeout_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """(hold_id, requested_at, outcome), one for each hold: its first answer within the time, else ``timeout``, when the watermark has passed the deadline.

    requests: (hold_id, requested_at); answers: (hold_id, at, status), pending and null ones count as none. Answers may come in any order
    and before their question by up to ``late``; which was first is decided by ``at``.
    """
    hold = F.col("hold_id").cast("string").alias("hold_id")
    r = requests.select(hold, F.col("requested_at").alias("seen"), F.lit(None).cast("string").alias("status"))
    a = answers.where("coalesce(status, 'pending') <> 'pending'").select(hold, F.col("at").alias("seen"), "status")
    rows = r.unionByName(a).where("seen is not null").withWatermark("seen", late).withColumn("us", F.unix_micros("seen"))
    out = _bucketed(rows, "hold_id", _first_answers(timeout_s * 1_000_000), "hold_id string, asked bigint, outcome string")
    return out.select(F.col("hold_id").cast(dict(requests.dtypes)["hold_id"]).alias("hold_id"), F.timestamp_micros("asked").alias("requested_at"), "outcome")


def _used(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
    """State: the last snapshot and the calls already given out."""
    if state.hasTimedOut:
        state.remove()
        return
    last, seen = (state.get[0], set(json.loads(state.get[1]))) if state.exists else (0, set())
    rows = pd.concat(list(batches)).sort_values("seen_at", kind="stable").drop_duplicates("span_id")
    ids, deltas = [], []
    for span, total in zip(*(rows.sort_values(["at", "span_id"])[c] for c in ("span_id", "total")), strict=True):
        if span not in seen:
            seen.add(span)
            ids.append(span)
            deltas.append(int(total) - last)
            last = int(total)
    state.update((last, json.dumps(sorted(seen))))
    _later(state)
    yield pd.DataFrame({"span_id": ids, "delta": deltas})


def usage(snapshots: DataFrame, late: str = "7 days") -> DataFrame:
    """(span_id, delta) of snapshots (trace_id, span_id, seen_at, at, total): what each call adds to what its trace had used before; the first is kept whole.

    Within a batch snapshots are put in order of ``at``; over batches arrival decides.
    """
    return _stateful(snapshots.withWatermark("seen_at", late), "trace_id", _used, "span_id string, delta bigint", "last bigint, seen string")


def _consumed(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
    """State: verdicts without a result and results without a verdict, in order."""
    if state.hasTimedOut:
        _, results = (json.loads(x) for x in state.get)
        state.remove()
    else:
        verdicts, results = ([json.loads(x) for x in state.get]) if state.exists else ([], [])
        for b in batches:
            for what, seq, mark in zip(b["what"], b["seq"], b["mark"], strict=True):
                (verdicts if what == "verdict" else results).append([int(seq), mark if isinstance(mark, str) else None])
        verdicts.sort(key=lambda x: x[0])
        results.sort(key=lambda x: x[0])
        n = min(len(verdicts), len(results))
        done = [(results[i][0], verdicts[i][1]) for i in range(n)]
        if n < max(len(verdicts), len(results)):
            state.update((json.dumps(verdicts[n:]), json.dumps(results[n:])))
            _later(state)
        elif state.exists:
            state.remove()
        results = []
        if done:
            yield _marks(key, done)
    if results:
        yield _marks(key, [(seq, None) for seq, _ in results])


def _marks(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    journal, name = key[0].split("\x1f", 1)
    return pd.DataFrame({"journal_id": journal, "seq": [r[0] for r in rows], "key": name, "enforced_decision": pd.Series([r[1] for r in rows], dtype="object")})


def consumed(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """(journal_id, seq, key, enforced_decision) of every result; each verdict is used once, by the next result of its journal and key.

    calls: verdicts and results in one stream, (journal_id, key, seq, what ``verdict`` or ``result``, mark, ingested_at). A result waits for its
    verdict, at most a day behind the watermark, and comes out without one then.
    """
    one = F.concat_ws("\x1f", "journal_id", "key").alias("slot")
    rows = calls.withWatermark("ingested_at", late).select(one, "seq", "what", "mark", "ingested_at")
    return _stateful(rows, "slot", _consumed, "journal_id string, seq bigint, key string, enforced_decision string", "verdicts string, results string")


def _met(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState):
    """State: for each id in which children and a parent meet whether the parent is there, its name, the children that wait, which came out, and when all this is let go."""
    now = max(state.getCurrentWatermarkMs(), 0)
    held = {meets: [there, name, dict(waiting), set(out), due] for meets, there, name, waiting, out, due in json.loads(state.get[0])} if state.exists else {}
    met = []
    if not state.hasTimedOut:
        # Of repeats in a batch the earliest counts.
        rows = pd.concat(list(batches)).sort_values("seen_ms", kind="stable")
        for meets, parent, span, own, seen in zip(*(rows[c].tolist() for c in ("meets", "parent", "span_id", "span_name", "seen_ms")), strict=True):
            x = held.setdefault(meets, [False, None, {}, set(), 0])
            # The first batch has no watermark yet.
            x[4] = max(x[4], (now or int(seen)) + DAY_MS)
            if parent:
                x[0], x[1] = True, x[1] if x[0] else own
            elif span not in x[3]:
                x[2].setdefault(span, own)
        for meets, x in held.items():
            if x[0] and x[2]:
                met += [(span, meets, own, x[1]) for span, own in x[2].items()]
                x[3].update(x[2])
                x[2] = {}
    _kept([[meets, there, name, list(waiting.items()), list(out), due] for meets, (there, name, waiting, out, due) in held.items() if due >= now], state)
    if met:
        yield pd.DataFrame(met, columns=["span_id", "parent_span_id", "span_name", "parent_name"], dtype="object")


def nested(spans: DataFrame, late: str = "7 days") -> DataFrame:
    """(span_id, parent_span_id, span_name, parent_name), whichever of the two arrives first; children wait for their parent a day behind the watermark, repeats come once."""
    roles = F.explode(F.array(F.struct(F.lit(True).alias("parent"), F.col("span_id").alias("meets")), F.struct(F.lit(False).alias("parent"), F.col("parent_span_id").alias("meets"))))
    rows = spans.withWatermark("ingested_at", late).select("span_id", "span_name", "ingested_at", F.coalesce(F.unix_millis("ingested_at"), F.lit(0)).alias("seen_ms"), roles.alias("r"))
    rows = rows.select("span_id", "span_name", "ingested_at", "seen_ms", "r.parent", "r.meets").where("meets is not null")
    return _bucketed(rows, "meets", _met, "span_id string, parent_span_id string, span_name string, parent_name string")


def subscribed(stream: DataFrame, callbacks: list[Callable[[DataFrame, int], None]], on_error: Callable[[Exception], None] | None = None):
    """A writer that hands every micro-batch to each callback in order; one that fails doesn't stop the others."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for f in callbacks:
                try:
                    f(batch, number)
                except Exception as e:  # noqa: BLE001
                    if on_error:
                        on_error(e)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over what is there now and gives its rows as a table in the shared folder.

    ``complete`` gives aggregates whose windows are still open too.
    """
    spark = prepare(stream.sparkSession)
    folder = new_folder(spark)
    if mode == "complete":
        writer = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    else:
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows")
    query = writer.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
