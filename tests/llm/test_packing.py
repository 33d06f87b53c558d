import math
import random
from collections import Counter, defaultdict

import pytest

from tracewright.llm import packing, tokens

DOCS = "doc_id long, source string, text string, n_tokens string, container_no string"
KINDS = "container_kind string, capacity_tokens int"


@pytest.mark.parametrize("seed", range(5))
def test_patterns_cover_the_histogram(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 100, 513])
    histogram = {n: r.randint(1, 50) for n in r.sample(range(1, capacity + 1), min(capacity, 40))}
    used = Counter()
    containers = 0
    fit = ("shortest", "best")[seed % 2]
    for pattern, count in packing.pack(histogram, capacity, fit):
        assert count > 0 and sum(n * k for n, k in pattern) <= capacity
        containers += count
        for n, k in pattern:
            used[n] += k * count
    assert used == histogram
    least = math.ceil(sum(n * k for n, k in histogram.items()) / capacity)
    assert containers <= 1.25 * least + 1


@pytest.mark.parametrize("seed", range(30))
def test_shortest_pack_first_item_by_item(seed):
    """The same packs, as multisets, as placing every item by itself into the pack with the most room."""
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64])
    histogram = {n: r.choice([1, 2, 5, 40]) for n in r.sample(range(1, capacity + 1), min(capacity, r.randint(1, 12)))}
    packs: list[list[int]] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            shortest = min(packs, key=sum, default=None)
            if shortest is not None and sum(shortest) + length <= capacity:
                shortest.append(length)
            else:
                packs.append([length])
    used = Counter()
    for pattern, count in packing.pack(histogram, capacity):
        used[sum(n * k for n, k in pattern)] += count
    assert used == Counter(map(sum, packs))
    with pytest.raises(ValueError):
        packing.pack(histogram, capacity, "first")


def test_assignment(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 20)
    r = random.Random(1)
    rows = [(i, "s", " ".join(["word"] * r.choice([1, 2, 3, 5, 8, 30, 70])), "x", "y") for i in range(300)] + [(900, "s", None, "x", "y"), (901, "s", "", "x", "y"), (902, "s", "dup", "x", "y"), (902, "s", "dup", "x", "y")]
    kinds = [("small", 10), ("large", 64), ("none", None), ("zero", 0)]
    out = packing.packed(spark.createDataFrame(rows, DOCS), spark.createDataFrame(kinds, KINDS)).collect()
    load, size = defaultdict(int), defaultdict(int)
    for x in out:
        size[x["container_kind"], x["doc_id"]] += x["n_tokens"]
        if x["container_no"] is None:
            assert x["doc_id"] in (900, 901)
            continue
        load[x["container_kind"], x["container_no"]] += x["n_tokens"]
        assert x["piece_no"] == -1 or size and x["n_tokens"] <= x["capacity_tokens"]
    assert all(v <= {"small": 10, "large": 64}[k] for (k, _), v in load.items())
    want = defaultdict(int)
    for i, _, t, *_ in rows:
        want[i] += tokens.count(t)
    for kind in ("small", "large"):
        assert {i: size[kind, i] for i in want} == want
        numbers = sorted(n for k, n in load if k == kind)
        assert numbers == list(range(len(numbers)))  # no container is left out or empty
    whole = {x["doc_id"] for x in out if x["container_kind"] == "large" and x["piece_no"] >= 0}
    assert whole == {i for i, _, t, *_ in rows if tokens.count(t) > 64}


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.packed(none, spark.createDataFrame([("a", 4)], KINDS)).count() == 0
    assert packing.packed(none, spark.createDataFrame([], KINDS)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    r = random.Random(2)
    whole = tokens.encoder(tokens.DEFAULT)
    texts = ["some words here, it's 12 " * 20_000, "".join(r.choice("ab 请保、。 \n\t'1,é") for _ in range(5000)), "x" * 5000, " " * 5000, "नमस्ते दुनिया। " * 300]
    monkeypatch.setattr(tokens, "PIECE", 37)
    for t in texts:
        assert tokens.count(t) == len(whole(t))
