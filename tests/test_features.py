import datetime as dt
import random
from collections import defaultdict

from tracewright.operators import features

T0 = dt.datetime(2026, 2, 1)
SCHEMA = "event_id string, event_timestamp timestamp, ingested_at timestamp, agent_id string, event_type string, payload string, n string, bucket int"


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(800):
        got = T0 + dt.timedelta(seconds=r.randint(0, 10_000))
        was = r.choice([got - dt.timedelta(seconds=5), dt.datetime(1970, 1, 1), dt.datetime(2036, 1, 1), None])
        payload = r.choice([None, "{", '{"latency_ms": 1.25}', '{"duration_ms": 2.5, "x": 1}', '{"latency_ms": null}', '{"latency_ms": "a"}', '{"latency_ms": 3.0'])
        rows.append((f"e{i}", was, got, r.choice(["hot"] * 5 + ["b", " B ", "", None]), r.choice(["tool_call", "Tool_Call ", "gw.x.y", None]), payload, "n", 1))
    rows += [(*x[:2], x[2] + dt.timedelta(hours=1), *x[3:]) for x in rows[::3]]
    now = max(x[2] for x in rows)
    want = defaultdict(lambda: [0, None, 0.0])
    for e in {x[0] for x in rows}:
        _, was, got, agent, kind, payload, *_ = min((x for x in rows if x[0] == e), key=lambda x: x[2])
        agent = (agent or "").strip().lower() or None
        kind = (kind or "untyped").strip().lower().replace(".", "_")
        cell = want[agent, kind]
        cell[0] += 1
        if was and got - dt.timedelta(days=30) <= was <= got + dt.timedelta(hours=1):
            age = int((now - was).total_seconds())
            cell[1] = age if cell[1] is None else min(cell[1], age)
        cell[2] += {'{"latency_ms": 1.25}': 1.25, '{"duration_ms": 2.5, "x": 1}': 2.5}.get(payload, 0)
    out = features.event_features(spark.createDataFrame(rows, SCHEMA), buckets=3)
    got = {r["agent_id"]: r for r in out.collect()}
    assert set(got) == {a for a, _ in want} and len(got) == out.count()
    for agent, row in got.items():
        for kind in ("tool_call", "gw_x_y", "untyped"):
            n, age, total = want[agent, kind] if (agent, kind) in want else (0, None, 0.0)
            assert (row[f"{kind}_n"], row[f"{kind}_recency_s"], row[f"{kind}_total_ms"]) == (n, age, total)


def test_empty(spark):
    assert features.event_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partial_cells_flush(spark, monkeypatch):
    rows = [(f"e{i}", T0, T0, f"a{i % 50}", f"t{i % 7}", '{"latency_ms": 1.0}', "n", 1) for i in range(3000)]
    monkeypatch.setattr(features, "FLUSH", 100)
    out = features.event_features(spark.createDataFrame(rows, SCHEMA))
    assert sum(sum(r[f"t{k}_n"] for k in range(7)) for r in out.collect()) == 3000


def test_clashing_names_huge_values_and_many_types(spark, monkeypatch):
    rows = [("1", T0, T0, "a", "x.y", '{"latency_ms": 5e13}', "n", 1), ("2", T0, T0, "a", "x_y", '{"latency_ms": 1.5}', "n", 1), ("3", T0, T0, "a", "X.Y", '{"latency_ms": 2.5}', "n", 1), ("4", T0, T0, None, "z", '{"latency_ms": 1e400}', "n", 1)]
    monkeypatch.setattr(features, "BUCKET_CELLS", 2)
    events = spark.createDataFrame(rows, SCHEMA)
    row = features.event_features(events).where("agent_id = 'a'").first()
    assert (row["x_y_n"], row["x_y__2_n"], row["x_y_total_ms"], row["x_y__2_total_ms"]) == (2, 1, 5e13 + 2.5, 1.5)
    got = {(r["agent_id"], r["event_type"]): (r["n"], r["recency_s"], r["total_ms"]) for r in features.event_features(events, long=True).collect()}
    assert got == {("a", "x.y"): (2, 0, 5e13 + 2.5), ("a", "x_y"): (1, 0, 1.5), (None, "z"): (1, 0, 0.0)}
    assert features.event_features(spark.createDataFrame([], SCHEMA), long=True).count() == 0
