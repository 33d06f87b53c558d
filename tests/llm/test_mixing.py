import math

from tracewright.llm import mixing

DOCS = "doc_id long, source string, text string, whole int, rest double"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark):
    rows = [(i, "Big ", "word " * 20, 1, 1.0) for i in range(200)] + [(1000 + i, "mid", "word " * 20, 1, 1.0) for i in range(60)] + [(2000 + i, "tiny", "word " * 10, 1, 1.0) for i in range(3)]
    return spark.createDataFrame([*rows, (3000, None, "word", 1, 1.0), (3001, "other", "word", 1, 1.0), (3002, "mid", None, 1, 1.0)], DOCS)


def test_shares_and_limits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.1, 4)], TARGETS)
    mix, shares = mixing.mixed(docs(spark), targets)
    s = {r["source"]: r for r in shares.collect()}
    used = [(r["doc_id"], r["repeat_no"]) for r in mix.collect()]
    assert len(used) == len(set(used)) and not {3000, 3001, 3002} & {d for d, _ in used}
    assert s["tiny"]["limited"] and s["tiny"]["most_repeats"] == 4 and s["absent"]["mixed_tokens"] == 0 and s["other"]["target_share"] == 0
    assert abs(s["big"]["mixed_tokens"] / s["mid"]["mixed_tokens"] - 5 / 3) < 0.03 and s["mid"]["most_repeats"] <= 3
    assert abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-4
    again, _ = mixing.mixed(docs(spark), targets)
    assert {(r["doc_id"], r["repeat_no"]) for r in again.collect()} == set(used)


def test_budgets_hold_limits():
    got = mixing.budgets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100)
    assert got["b"] == 20 and abs(got["a"] - 80) < 1e-6
    assert mixing.budgets({"a": 5}, {"a": 1.0}, {"a": 2}, 100) == {"a": 10}
    assert mixing.budgets({}, {"a": 1.0}, {"a": 2}, 100) == {"a": 0.0}


def test_temperature():
    tokens = {"a": 900, "b": 90, "c": 10}
    for goal in (0.2, 0.5, 0.9):
        exponent, w = mixing.temperature_weights(tokens, 1000, goal)
        assert abs(mixing.entropy(w) - goal) < 1e-3 and abs(sum(w.values()) - 1) < 1e-9
    exponent, w = mixing.temperature_weights(tokens, 1000, math.log(3), {"a": 1, "b": 2, "c": 4})
    assert 0 < exponent <= 1 and all(w[s] * 1000 <= tokens[s] * k + 0.01 for s, k in (("a", 1), ("b", 2), ("c", 4)))


def test_empty(spark):
    mix, shares = mixing.mixed(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mix.count() == 0 and shares.first()["actual_share"] == 0
    mix, _ = mixing.mixed(docs(spark), spark.createDataFrame([], TARGETS))
    assert mix.count() == 0
    assert mixing.temperatures(docs(spark), spark.createDataFrame([("mid", 1.0, 1)], TARGETS)).count() == 1


def test_every_document_that_still_fits_is_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    sizes = [900, 500, 700, *range(5, 60)]
    rows = [("a", i, n) for i, n in enumerate(sizes)] + [("b", 1000 + i, 7) for i in range(5)]
    frame = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long")
    for seed in ("x", "y", "z"):
        mix = mixing.realise(frame, {"a": 1000.0, "b": 20.0}, {"a": sum(sizes), "b": 35}, {"a": len(sizes), "b": 5}, seed).collect()
        used = [r for r in mix if r["source"] == "a"]
        free = 1000 - sum(r["n_tokens"] for r in used)
        assert 0 <= free < min(n for i, n in enumerate(sizes) if i not in {r["doc_id"] for r in used}) and len(used) == len({r["doc_id"] for r in used})
        assert sum(r["source"] == "b" for r in mix) == 2
