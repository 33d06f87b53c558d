import random
from collections import Counter
from itertools import product

import pytest

from tracewright.llm import sequences


def brute(seqs, share, gap, sizes=(3, 4)):
    n, out = len(seqs), Counter()
    for s in seqs:
        found = set()

        def go(path, at):
            if len(path) in sizes:
                found.add(path)
            if len(path) < max(sizes):
                for j in range(at + 1, min(len(s), at + 2 + gap)):
                    if s[j] is not None:
                        go((*path, s[j]), j)

        for i, x in enumerate(s):
            if x is not None:
                go((x,), i)
        out.update(found)
    return {p: c for p, c in out.items() if c >= share * n - 1e-9}


def frame(spark, seqs):
    return spark.createDataFrame([(s, "x") for s in seqs], "items array<string>, support string")


def test_against_brute_force(spark):
    r = random.Random(5)
    seqs = [[r.choice(["a", "b", "c", "d", None]) for _ in range(r.randint(1, 12))] for _ in range(200)] + [["a", "b", "c", "d"]] * 100
    for gap, share in product((0, 2), (0.05, 0.2)):
        got = {tuple(x["steps"]): x["support"] for x in sequences.frequent_patterns(frame(spark, seqs), share, gap).collect()}
        assert got == brute(seqs, share, gap)


def test_closed(spark):
    got = {"".join(x["steps"]): x["closed"] for x in sequences.frequent_patterns(frame(spark, [list("abcd")] * 4 + [list("abc")]), 0.1, 0).collect()}
    assert got == {"abc": True, "bcd": False, "abcd": True}


def closed_brute(seqs, share, gap):
    every = brute(seqs, share, gap, (1, 2, 3, 4, 5))
    return {p for p, n in every.items() if len(p) in (3, 4) and not any(m == n and len(q) == len(p) + 1 and p in (q[1:], q[:-1]) for q, m in every.items())}


def chained(r):
    """What often stands behind what, so that prefixes are pruned: x before every a, y before every x in part of the cases."""
    out = []
    for _ in range(150):
        s = []
        for _ in range(r.randint(1, 3)):
            s += [*(["y"] if r.random() < 0.9 else []), "x", *(["z"] if r.random() < 0.3 else []), "a", r.choice("bc"), *(["d"] if r.random() < 0.5 else [])]
        out.append(s)
    return out


@pytest.mark.parametrize("block", [3, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_supports_are_recovered(spark, monkeypatch, block, seed):
    monkeypatch.setattr(sequences, "BLOCK", block)
    seqs = chained(random.Random(seed))
    for gap in (0, 2):
        got = {tuple(x["steps"]): x for x in sequences.frequent_patterns(frame(spark, seqs), 0.05, gap).collect()}
        assert {p: x["support"] for p, x in got.items()} == brute(seqs, 0.05, gap)
        assert {p for p, x in got.items() if x["closed"]} == closed_brute(seqs, 0.05, gap)


def test_backscan_prunes():
    code = {c: i for i, c in enumerate("xyzabcd")}
    places = sequences._places([([code[c] for c in s], 1) for s in chained(random.Random(1))])
    follows = dict.fromkeys(code.values(), frozenset(code.values()))
    found = sequences.grow(places, code["a"], follows, 2, 6, True, {})
    assert found == {(code["a"],): (150, code["x"])}  # every a has x before it, so nothing that begins with a is closed
    free = sequences.grow(places, code["a"], follows, 2, 6, False, {})
    assert len(free) > 50 and sequences.grow(places, code["x"], follows, 2, 6, True, {})


def test_blocks_of_a_hot_item(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 3)
    seqs = [["a", str(i % 11), "b", str(i % 7)] for i in range(60)]
    got = {tuple(x["steps"]): x["support"] for x in sequences.frequent_patterns(frame(spark, seqs), 0.1).collect()}
    assert got == brute(seqs, 0.1, 2)


def test_latest_rows_and_empty(spark):
    schema = "record_id long, journal_id string, tool_calls array<struct<tool_name:string>>"
    rows = [(1, "j", [("a",)]), (2, "j", [("b",), (None,)]), (3, "k", [("c",)]), (4, "k", []), (5, "l", None)]
    assert [tuple(r) for r in sequences.latest_sequences(spark.createDataFrame(rows, schema)).collect()] == [("j", ["b", None])]
    assert sequences.frequent_patterns(frame(spark, []), 0.03).count() == 0
