"""Frequent ordered patterns across many sequences, with a bound on the gap between steps.

Sequences that are equal are counted once with a weight, items become small integers and pairs that can't
be part of a frequent pattern are struck first (the support of a pattern is at most that of each run of its
steps). Then the work is partitioned by first item, hot first items into several blocks of sequences; in a block
patterns grow depth-first over pseudo-projections: of each sequence only the end positions of the pattern
are kept, as the bits of one integer, so a growth step is shift, and, test. Blocks emit partial supports, which are added up.

Backscan pruning, as a bounded gap allows it: if an item x stands within the gap before *every* occurrence of a
prefix in every sequence that has it, each continuation of the prefix has the support of the same with x in front, so none
is closed and the prefix isn't continued. It is continued with x in front instead: x is taken only where nothing in turn
stands before every occurrence of x and the prefix, which also means that no prefix of that is pruned. Prefixes of one and
two steps are judged; what continues x and the prefix is longer and never pruned, so one step more is enough to recover
every support, and patterns stay bounded in length. A block that holds all sequences of its first item judges by itself; for
split items all their blocks are heard beforehand.

A pattern is closed if no pattern longer by one step at either end has the same support (the bidirectional extension
check, on the global supports). Steps in the middle don't count: taking one out may break the gap. All frequent patterns come out with
their supports, the pruned ones recovered from those that are one step longer.

Defined results: null items take up their place but match nothing; items are compared exactly; null and
empty sequences don't count; a repeated sequence counts as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.tables import settled

#: Distinct sequences planned for one block of a first item.
BLOCK = 20_000
#: Pairs a task keeps before it sends them on.
HELD = 200_000


def latest_sequences(journals: DataFrame) -> DataFrame:
    """(journal_id, items): the tool names of each journal's row with the highest record_id, where there are any."""
    names = F.transform("tool_calls", lambda c: c["tool_name"])
    return journals.groupBy("journal_id").agg(F.max_by(names, "record_id").alias("items")).where(F.size("items") > 0)


def _pairs(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"a": [p[0] for p in total], "b": [p[1] for p in total], "n": list(total.values())}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))
            total.clear()
            return batch

        for batch in batches:
            for items, n in zip(batch.column("items").to_pylist(), batch.column("n").to_pylist(), strict=True):
                found = {(a, b) for i, a in enumerate(items) if a is not None for b in items[i + 1 : i + 2 + gap] if b is not None}
                for p in found:
                    total[p] = total.get(p, 0) + n
                if len(total) > HELD:
                    yield out()
        yield out()

    return run


Places = list[tuple[dict[int, int], int]]


def _places(sequences: list[tuple[list[int], int]]) -> Places:
    """The positions of each item of each sequence as bits, with the sequence's weight."""
    out = []
    for items, n in sequences:
        at: dict[int, int] = {}
        for i, x in enumerate(items):
            if x >= 0:
                at[x] = at.get(x, 0) | 1 << i
        out.append((at, n))
    return out


def _within(bits: int, gap: int) -> int:
    """The positions behind ``bits`` within the gap."""
    reach = 0
    for step in range(1, gap + 2):
        reach |= bits << step
    return reach


def before_all(places: Places, pattern: tuple[int, ...], where: list[int], gap: int) -> frozenset[int]:
    """The items that stand within the gap before every occurrence of ``pattern`` in every sequence of ``where``."""
    common: frozenset[int] | None = None
    for k in where:
        at = places[k][0]
        starts = at[pattern[-1]]
        for x in reversed(pattern[:-1]):
            starts = at[x] & _before(starts, gap)
        here = frozenset(x for x, bits in at.items() if (common is None or x in common) and not starts & ~_within(bits, gap))
        common = here
        if not common:
            break
    return common or frozenset()


def _before(bits: int, gap: int) -> int:
    reach = 0
    for step in range(1, gap + 2):
        reach |= bits >> step
    return reach


def fronts(places: Places, pattern: tuple[int, ...], where: list[int], gap: int) -> dict[int, frozenset[int]]:
    """For each item that stands before every occurrence: what stands before every occurrence of both."""
    return {x: before_all(places, (x, *pattern), where, gap) for x in before_all(places, pattern, where, gap)}


def grow(places: Places, first: int, follows: dict[int, frozenset[int]], gap: int, most: int, whole: bool, pruned: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], tuple[int, int]]:
    """{pattern: (support, the item it is pruned for or -1)} of patterns that begin with ``first``, up to ``most`` steps.

    whole: these are all sequences with ``first``; pruned: what was decided for split items.
    """
    found: dict[tuple[int, ...], tuple[int, int]] = {}
    todo = [((first,), [(k, at[first]) for k, (at, _) in enumerate(places) if first in at])]
    while todo:
        pattern, projection = todo.pop()
        front = pruned.get(pattern, -1)
        if whole and len(pattern) <= 2:
            front = min((x for x, further in fronts(places, pattern, [k for k, _ in projection], gap).items() if not further), default=-1)
        found[pattern] = sum(places[k][1] for k, _ in projection), front
        if len(pattern) == most or front >= 0:
            continue
        after = follows.get(pattern[-1], frozenset())
        longer: dict[int, list[tuple[int, int]]] = {}
        for k, ends in projection:
            reach = _within(ends, gap)
            for x, bits in places[k][0].items():
                if x in after and (hit := bits & reach):
                    longer.setdefault(x, []).append((k, hit))
        todo.extend(((*pattern, x), p) for x, p in longer.items())
    return found


def _blocks(follows: dict[int, frozenset[int]], gap: int, most: int, split: frozenset[int], pruned: dict[tuple[int, ...], int]):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        first = key[0].as_py()
        places = _places(list(zip(group["items"].to_pylist(), group["n"].to_pylist(), strict=True)))
        found = grow(places, first, follows, gap, most, first not in split, pruned)
        return pa.table({"pattern": pa.array([list(p) for p in found], pa.list_(pa.int32())), "n": pa.array([n for n, _ in found.values()], pa.int64()), "front": pa.array([f for _, f in found.values()], pa.int32())})

    return run


def _openings(follows: dict[int, frozenset[int]], gap: int):
    """Prefixes of one and two steps of a block with what stands before all their occurrences there."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        places = _places(list(zip(group["items"].to_pylist(), group["n"].to_pylist(), strict=True)))
        patterns, fronts_, further = [], [], []
        for pattern in grow(places, key[0].as_py(), follows, gap, 2, False, {}):
            where = [k for k, (at, _) in enumerate(places) if pattern[0] in at and (len(pattern) == 1 or at.get(pattern[1], 0) & _within(at[pattern[0]], gap))]
            for x, more in (fronts(places, pattern, where, gap) or {-1: frozenset()}).items():
                patterns.append(list(pattern))
                fronts_.append(x)
                further.append(sorted(more))
        ints = pa.list_(pa.int32())
        return pa.table({"pattern": pa.array(patterns, ints), "front": pa.array(fronts_, pa.int32()), "further": pa.array(further, ints), "block": pa.array([key[1].as_py()] * len(patterns), pa.int64())})

    return run


def _decided(openings: DataFrame) -> dict[tuple[int, ...], int]:
    """The prefixes of split items that are pruned, with the item in front. Few reach the driver: a front must hold in every block of the prefix."""
    blocks = openings.groupBy("pattern").agg(F.count_distinct("block").alias("blocks"))
    held = openings.where("front >= 0").groupBy("pattern", "front").agg(F.count(F.lit(1)).alias("held"), F.collect_list("further").alias("further"))
    common = F.aggregate(F.slice("further", 2, F.greatest(F.size("further") - 1, F.lit(0))), F.element_at("further", 1), F.array_intersect)
    free = held.join(blocks, "pattern").where(F.col("held") == F.col("blocks")).where(F.size(common) == 0)
    return {tuple(r["pattern"]): r["front"] for r in free.groupBy("pattern").agg(F.min("front").alias("front")).collect()}


def frequent_patterns(sequences: DataFrame, min_share: float, max_gap: int = 2, min_steps: int = 3, max_steps: int = 4) -> DataFrame:
    """(steps array<string>, support, sequences, closed) of the patterns in at least ``min_share`` of the sequences.

    sequences: a column ``items``. max_gap: other items allowed between two steps.
    """
    weighted = settled(sequences.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    total = weighted.agg(F.sum("n")).first()[0] or 0
    least = max(1, -int(-(min_share * total - 1e-9) // 1))
    pairs = weighted.mapInArrow(_pairs(max_gap), "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # A sequence of k items adds at most k * (gap + 1) pairs, so the frequent ones are few whatever the number of sequences.
    kept = pairs.where(F.col("n") >= least).select("a", "b").collect()
    items = sorted({x for p in kept for x in p})
    code = {x: i for i, x in enumerate(items)}
    follows: dict[int, set[int]] = {}
    for a, b in kept:
        follows.setdefault(code[a], set()).add(code[b])
    fixed = {a: frozenset(b) for a, b in follows.items()}
    lookup = F.create_map(*(F.lit(v) for x in code.items() for v in x)) if code else F.create_map().cast("map<string,int>")
    coded = weighted.select(F.transform("items", lambda x: F.coalesce(lookup[x], F.lit(-1))).alias("items"), "n")
    each = coded.select("items", "n", F.explode(F.array_distinct("items")).alias("first")).where("first >= 0")
    shares = {r["first"]: r["n"] for r in each.groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.create_map(*(F.lit(v) for k, n in shares.items() for v in (k, 1 + n // BLOCK))) if shares else F.create_map().cast("map<int,int>")
    blocked = each.withColumn("block", F.pmod(F.xxhash64("items"), blocks[F.col("first")]))
    split = frozenset(k for k, n in shares.items() if n >= BLOCK)
    pruned: dict[tuple[int, ...], int] = {}
    if split:
        hot = blocked.where(F.col("first").isin(*split))
        pruned = _decided(hot.groupBy("first", "block").applyInArrow(_openings(fixed, max_gap), "pattern array<int>, front int, further array<int>, block bigint"))
    # Two steps more than asked for: one to recover what was pruned, one to check extensions.
    partial = blocked.groupBy("first", "block").applyInArrow(_blocks(fixed, max_gap, max_steps + 2, split, pruned), "pattern array<int>, n bigint, front int")
    mined = settled(partial.groupBy("pattern").agg(F.sum("n").alias("n"), F.max("front").alias("front")).where(F.col("n") >= least))
    size = F.size("pattern")
    # Every pattern that goes on behind (front, pruned prefix) is one of the pruned prefix too.
    cut = mined.where("front >= 0").select(F.concat(F.array("front"), F.col("pattern")).alias("prefix")).distinct()
    prefixes = mined.where(size > 2).select("pattern", "n", F.explode(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.slice("pattern", 1, k))).alias("prefix"))
    back = prefixes.join(cut, "prefix", "left_semi").select(F.slice("pattern", 2, size - 1).alias("pattern"), "n")
    support = settled(mined.select("pattern", "n").unionByName(back).groupBy("pattern").agg(F.max("n").alias("n")))
    ends = F.explode(F.array(F.slice("pattern", 1, size - 1), F.slice("pattern", 2, size - 1))).alias("pattern")
    extended = support.where(size > 1).select(ends, F.col("n").alias("m")).groupBy("pattern").agg(F.max("m").alias("m"))
    found = support.where(size.between(min_steps, max_steps)).join(extended, "pattern", "left")
    names = F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")
    steps = F.transform("pattern", lambda i: F.element_at(names, i + 1)).alias("steps")
    return found.select(steps, F.col("n").alias("support"), F.lit(total).cast("bigint").alias("sequences"), (~F.coalesce(F.col("m") == F.col("n"), F.lit(False))).alias("closed"))
