"""One row per entity from its events: for every event type a count, the recency and a total.

Events delivered more than once count once. Then, in each task, entities and types are encoded as
integers and a block of events becomes cells ``entity * types + type`` for ``bincount`` (counts, totals)
and a maximum scatter (last time); only these partial cells are shuffled, so an entity with a third of
all events sends a few cells per task. Entities are hash-bucketed so that a bucket's dense block
(entities x types) has a planned size; a bucket's partial cells are combined the same way and leave as Arrow columns.

The event types are read first (distinct, so their number is that of the vocabulary, hundreds); each gets
three columns. All types get columns, none are capped; the more types there are, the fewer entities a bucket has.

Defined results: types are compared without case and outer blanks, types that are null or blank count as ``untyped``; dots
become underscores in column names, and names that then clash get a number behind them in the order of their types; agents that are null or blank share the row with a null
``agent_id``; a null, broken or non-numeric latency adds nothing; an event whose clock is implausible
counts but doesn't move the recency; recency is null where an agent has no plausible event of a type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.tables import clean_key, settled

NEVER = np.iinfo(np.int64).min
#: Cells planned for the dense block of one bucket, agents x types, of 4 x 8 bytes each.
BUCKET_CELLS = 500_000
#: Latencies of more milliseconds are summed as floating numbers, the others in whole thousandths.
EXACT = 1e12
#: Cells kept in a task before they are sent on.
FLUSH = 200_000


def distinct_events(events: DataFrame, future_minutes: int = 60, past_days: int = 30) -> DataFrame:
    """(agent_id, event_type, at, micros) of each event once, by its earliest arrival.

    at: seconds of a plausible ``event_timestamp``, not over ``future_minutes`` after its arrival nor over
    ``past_days`` before it, else null. micros: latency or duration of the payload in thousandths of a ms.
    """
    got, was = F.unix_micros("ingested_at"), F.unix_micros("event_timestamp")
    plausible = (was <= got + F.lit(future_minutes * 60_000_000)) & (was >= got - F.lit(past_days * 86_400_000_000))
    ms = F.from_json("payload", "latency_ms double, duration_ms double")
    # An unreadable payload keeps no partial value.
    value = F.when(F.col("payload").rlike(r"\}\s*$"), F.coalesce(ms["latency_ms"], ms["duration_ms"]))
    value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    exact = F.abs(value) < EXACT
    micros, huge = F.when(exact, F.round(F.when(exact, value) * 1000).cast("bigint")), F.when(~exact, value)
    kind = F.coalesce(clean_key("event_type"), F.lit("untyped"))
    narrow = events.select(
        "event_id", F.coalesce(got, F.lit(NEVER + 1)).alias("got"), clean_key("agent_id").alias("agent_id"), kind.alias("event_type"), F.when(plausible, F.floor(was / F.lit(1_000_000))).alias("at"), micros.alias("micros"), huge.alias("huge")
    )
    first = F.min(F.struct("got", "agent_id", "event_type", "at", "micros", "huge"))
    named = narrow.where("event_id is not null").groupBy("event_id").agg(first.alias("e")).select("e.agent_id", "e.event_type", "e.at", "e.micros", "e.huge")
    return named.unionByName(narrow.where("event_id is null").select("agent_id", "event_type", "at", "micros", "huge"))


Cells = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cells(agents: np.ndarray, kinds: np.ndarray, width: int, counts: np.ndarray, micros: np.ndarray, at: np.ndarray, huge: np.ndarray) -> Cells:
    """(cell, count, micros, last, huge) of the cells that occur; whole numbers stay exact beyond 2**53."""
    used, cell = np.unique(agents * width + kinds, return_inverse=True)
    n = np.zeros(len(used), np.int64)
    total = np.zeros(len(used), np.int64)
    last = np.full(len(used), NEVER, np.int64)
    if len(used) and counts.max() == 1:
        n += np.bincount(cell, minlength=len(used))
    else:
        np.add.at(n, cell, counts)
    np.add.at(total, cell, micros)
    np.maximum.at(last, cell, at)
    return used, n, total, last, np.bincount(cell, weights=huge, minlength=len(used))


PARTIAL = "agent_id string, kind int, n bigint, micros bigint, last bigint, huge double"
_VALUES = ("n", "micros", "last", "huge")


def _encoded(table: pa.Table, width: int) -> tuple[pa.Array, Cells]:
    """The distinct agents and the cells of a table of partial cells."""
    words = pc.dictionary_encode(table["agent_id"], null_encoding="encode").combine_chunks()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return words.dictionary, cells(codes, table["kind"].to_numpy().astype(np.int64), width, *(table[c].to_numpy() for c in _VALUES))


def _partials(kinds: dict[str, int]):
    names = pa.array(list(kinds), pa.string())
    width = len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            agents, (used, *values) = _encoded(pa.concat_tables(held), width)
            return pa.table({"agent_id": agents.take(pa.array(used // width)), "kind": pa.array((used % width).astype(np.int32)), **dict(zip(_VALUES, values, strict=True))})

        rows = 0
        for batch in batches:
            kind = pc.index_in(batch.column("event_type"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int32)
            filled = {c: pc.fill_null(batch.column(c), v).to_numpy(zero_copy_only=False) for c, v in (("micros", 0), ("at", int(NEVER)), ("huge", 0.0))}
            held.append(pa.table({"agent_id": batch.column("agent_id"), "kind": kind, "n": np.ones(len(kind), np.int64), "micros": filled["micros"], "last": filled["at"], "huge": filled["huge"]}))
            rows += len(kind)
            if rows > FLUSH:
                held = [merged()]
                rows = len(held[0])
                if rows > FLUSH // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if rows:
            yield from merged().to_batches()

    return run


def _columns(names: list[str]) -> list[str]:
    """A column name for each type: dots become underscores, later ones that clash get a number."""
    out: list[str] = []
    for name in names:
        bare = base = name.replace(".", "_")
        k = 2
        while bare in out:
            bare, k = f"{base}__{k}", k + 1
        out.append(bare)
    return out


def _recency(last: np.ndarray, now: int) -> pa.Array:
    seen = last != NEVER
    return pa.array(np.where(seen, now - np.where(seen, last, 0), 0), pa.int64(), mask=~seen)


def _blocks(columns: list[str], now: int):
    width = len(columns)

    def run(group: pa.Table) -> pa.Table:
        agents, (used, *values) = _encoded(group, width)
        block = {c: np.full(len(agents) * width, NEVER if c == "last" else 0, v.dtype) for c, v in zip(_VALUES, values, strict=True)}
        for c, v in zip(_VALUES, values, strict=True):
            block[c][used] = v
        n, micros, last, huge = (block[c].reshape(len(agents), width) for c in _VALUES)
        out = {"agent_id": agents}
        for i, name in enumerate(columns):
            out[f"{name}_n"] = pa.array(n[:, i])
            out[f"{name}_recency_s"] = _recency(last[:, i], now)
            out[f"{name}_total_ms"] = pa.array(micros[:, i] / 1000.0 + huge[:, i])
        return pa.table(out)

    return run


def _rows(names: list[str], now: int):
    words = pa.array(names, pa.string())

    def run(group: pa.Table) -> pa.Table:
        agents, (used, n, micros, last, huge) = _encoded(group, len(names))
        who, what = agents.take(pa.array(used // len(names))), words.take(pa.array(used % len(names)))
        return pa.table({"agent_id": who, "event_type": what, "n": n, "recency_s": _recency(last, now), "total_ms": micros / 1000.0 + huge})

    return run


def event_features(events: DataFrame, buckets: int | None = None, long: bool = False) -> DataFrame:
    """One row per ``agent_id`` with ``<type>_n``, ``<type>_recency_s`` and ``<type>_total_ms`` for each type.

    Recency is counted from the latest arrival in the table. buckets: by default from a count of the agents. long: a row for each
    agent and type that occur together instead.
    """
    kind = F.coalesce(clean_key("event_type"), F.lit("untyped"))
    # One pass: a row for each type, from which the rest is read.
    sketch = F.hll_sketch_agg(F.coalesce(clean_key("agent_id"), F.lit("")))
    seen = settled(events.groupBy(kind.alias("kind")).agg(F.max("ingested_at").alias("latest"), sketch.alias("agents")))
    names = sorted(r["kind"] for r in seen.select("kind").collect())
    facts = seen.agg(F.floor(F.unix_micros(F.max("latest")) / F.lit(1_000_000)).alias("now"), F.hll_sketch_estimate(F.hll_union_agg("agents")).alias("agents")).first()
    if not names:
        none = events.select(clean_key("agent_id").alias("agent_id")).limit(0)
        return none.selectExpr("agent_id", "'' AS event_type", "0L AS n", "0L AS recency_s", "0D AS total_ms") if long else none
    now = facts["now"] if facts["now"] is not None else 0
    # Small tables still give every executor a bucket.
    buckets = buckets or max(12, 1 + int(facts["agents"] * 1.2 * len(names) / BUCKET_CELLS))
    partial = distinct_events(events).mapInArrow(_partials({k: i for i, k in enumerate(names)}), PARTIAL)
    columns = _columns(names)
    schema = "agent_id string, " + ", ".join(f"`{k}_n` bigint, `{k}_recency_s` bigint, `{k}_total_ms` double" for k in columns)
    if long:
        schema = "agent_id string, event_type string, n bigint, recency_s bigint, total_ms double"
    bucket = F.pmod(F.xxhash64("agent_id"), F.lit(buckets))
    return partial.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_rows(names, now) if long else _blocks(columns, now), schema)
