import datetime as dt
import random

import numpy as np
import pyarrow as pa

from tracewright.operators import orphans

T0 = dt.datetime(2026, 1, 5, 0, 30)
EVENTS = "event_id string, decision_journal_id string, ingested_at timestamp, key string"
JOURNALS = "journal_id string, ingested_at timestamp, range int"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def run(spark, events, journals, deletions, ranges=3):
    refs = orphans.references(spark.createDataFrame([(*e, "x") for e in events], EVENTS), "agent_events", "event_id", "decision_journal_id")
    found = orphans.orphans(refs, spark.createDataFrame([(*j, 1) for j in journals], JOURNALS), spark.createDataFrame([(d,) for d in deletions], "journal_id string"), ranges=ranges)
    return refs, found


def brute(events, journals, deletions):
    norm = lambda k: (k or "").strip(" ").lower() or None
    first = {}
    for e, k, t in events:
        first[e] = min(first.get(e, (t, norm(k) or "")), (t, norm(k) or ""))
    born = {}
    for k, t in journals:
        if norm(k):
            born[norm(k)] = min(born.get(norm(k), t), t)
    gone = {norm(d) for d in deletions}
    out = {}
    for e, (t, k) in first.items():
        if not k:
            continue
        if k in gone:
            out[e] = "deleted"
        elif k not in born:
            out[e] = "missing"
        elif born[k] > t + dt.timedelta(minutes=60):
            out[e] = "late"
    return out


def test_random_against_brute_force(spark):
    r = random.Random(1)
    keys = [f"inv-{i:03d}" for i in range(60)]
    spell = lambda k: r.choice([k, k.upper(), f" {k} ", k.title()])
    journals = [(spell(k), at(r.randint(0, 500))) for k in keys[:45] for _ in range(r.randint(1, 2))]
    events = [(f"e{i}", r.choice([None, "", spell(r.choice(keys)), spell(keys[0])]), at(r.randint(0, 500))) for i in range(700)]
    events += [(e, k, t + dt.timedelta(minutes=r.randint(1, 300))) for e, k, t in events[::5]]
    deletions = keys[45:50]
    _, found = run(spark, events, journals, deletions)
    assert {x["row_key"]: x["orphan_kind"] for x in found.collect()} == brute(events, journals, deletions)


def test_the_hour_of_grace_is_exact(spark):
    events = [("a", "j", at(0)), ("b", "j", at(1)), ("c", "k", at(0))]
    journals = [("j", at(61)), ("k", at(60))]
    _, found = run(spark, events, journals, [])
    assert {x["row_key"]: x["orphan_kind"] for x in found.collect()} == {"a": "late"}


def test_empty_tables_and_reports(spark):
    refs, found = run(spark, [], [], [])
    assert found.count() == 0 and orphans.per_period(found, refs).count() == 0
    refs, found = run(spark, [("a", "gone", at(0)), ("b", "here", at(0))], [("here", at(0))], ["gone"])
    row = orphans.per_period(found, refs).first()
    assert (row["refs"], row["deleted_refs"], row["orphan_share"]) == (2, 1, 0.5)


def test_bitmaps_sparse_and_dense():
    rng = np.random.default_rng(0)
    for n, size in ((50, 60_000), (20_000, 60_000), (10_000, 200_000)):
        codes, there = rng.choice(size, n, replace=False), rng.random(size) < 0.5
        b = orphans.Bitmap(codes, size)
        assert (b.sparse is None) == (n > orphans.DENSE or size > 1 << 16)
        assert sorted(b.and_not(there)) == sorted(c for c in codes if not there[c])
        assert np.flatnonzero(b.flags()).tolist() == sorted(codes)


def test_a_range_without_references():
    keys, hours = orphans.range_suspects(pa.array(["a", "b"]), np.array([1, 2]), np.array([True, True]))
    assert len(keys) == 0 and len(hours) == 0
