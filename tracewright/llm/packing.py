"""Whole documents into containers of a fixed number of tokens, with little space unused.

Shortest-pack-first over the histogram of lengths: lengths are placed from the longest down, each item into the
shortest pack, i.e. the one with the most room, and into a new one where none holds it. Packs of equal content are one pattern
with a count; a pattern that takes items is split off with the count that both share. ``fit="best"`` takes the pack with
the least room that holds the item instead. Only the histogram (at most one row per length up to the capacity) and the patterns reach the
driver; documents get a rank among those of their length and the pattern that owns this rank.

Ranks without one task per length: documents of a length are spread over blocks by the hash of their id,
ranked within a block, and blocks are shifted by the counts before them.

Defined results: a text longer than the capacity is cut into full pieces and a rest, a full piece fills a container by
itself, the rest is packed like a document; texts without tokens (null, empty) need no container and are listed with none;
rows that occur twice are two items; ties are broken by doc_id. Capacities that are null or below 1 give no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.tokens import DEFAULT, with_sizes
from tracewright.sources.tables import settled

#: Items planned for one block of a length.
BLOCK = 50_000


Pattern = tuple[tuple[int, int], ...]


class _Content:
    """What is in a pack: a length, how often, and what was put in before; packs share what they have in common."""

    __slots__ = ("before", "length", "times")

    def __init__(self, before: _Content | None, length: int, times: int):
        if before is not None and before.length == length:
            before, times = before.before, before.times + times
        self.before, self.length, self.times = before, length, times

    def all(self) -> Pattern:
        out, at = [], self
        while at is not None:
            out.append((at.length, at.times))
            at = at.before
        return tuple(out[::-1])


def pack(histogram: dict[int, int], capacity: int, fit: str = "shortest") -> list[tuple[Pattern, int]]:
    """(((length, times), ...), count) patterns for ``histogram`` {length: count}; lengths from 1 to ``capacity``.

    The same packs as placing items one by one, but whole counts at once: the packs of the pattern with the most room take one item
    each, or as many as bring them level with the next.
    """
    if fit not in ("shortest", "best"):
        raise ValueError(fit)
    rooms: dict[int, list[tuple[_Content, int]]] = defaultdict(list)
    order: list[int] = []  # the rooms that have patterns, ascending
    done: list[tuple[_Content, int]] = []

    def put(room: int, content: _Content, count: int) -> None:
        if room == 0:
            done.append((content, count))
            return
        if not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append((content, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                # None holds it. A new pack then has the most room for the next item too, until it is full.
                each = max(1, min(capacity // length, left))
                put(capacity - each * length, _Content(None, length, each), left // each)
                left -= each * (left // each)
                continue
            at = at if fit == "best" else len(order) - 1
            room = order[at]
            content, count = rooms[room].pop()
            below = room
            if not rooms[room]:
                order.pop(at)
                below = order[-1] if order else 0
            if fit == "best":
                each = max(1, min(room // length, left))
                taken = min(count, left // each)
            else:
                taken = min(count, left)
                # Rounds until these packs have no more room than the next ones, or hold no further item.
                each = max(1, min(room // length, -(-(room - below) // length), left // taken))
            put(room - each * length, _Content(content, length, each), taken)
            if count > taken:
                put(room, content, count - taken)
            left -= each * taken
    return [(c.all(), n) for c, n in [*done, *(x for room in order for x in rooms[room])]]


class Slots:
    """Which container each rank of each length goes to."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        first, self.starts, self.containers, self.times = 0, defaultdict(list), defaultdict(list), defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        for pattern, count in patterns:
            for length, times in pattern:
                self.starts[length].append(used[length])
                self.containers[length].append(first)
                self.times[length].append(times)
                used[length] += times * count
            first += count
        self.total = first
        self.starts, self.containers, self.times = ({k: np.array(v, np.int64) for k, v in x.items()} for x in (self.starts, self.containers, self.times))

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            where = lengths == n
            r = ranks[where]
            k = np.searchsorted(self.starts[int(n)], r, "right") - 1
            out[where] = self.containers[int(n)][k] + (r - self.starts[int(n)][k]) // self.times[int(n)][k]
        return out


def _placed(slots: Slots, kind: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("n_tokens").to_numpy(), b.column("rank").to_numpy()
            # Containers of full pieces are counted behind those of the patterns.
            whole = lengths == capacity
            where = np.where(whole, slots.total + ranks, 0)
            where[~whole] = slots.of(lengths[~whole], ranks[~whole])
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), b.column("doc_id"), b.column("piece_no"), b.column("n_tokens"), pa.array(where), pa.array(np.full(n, capacity))],
                ["container_kind", "doc_id", "piece_no", "n_tokens", "container_no", "capacity_tokens"],
            )

    return run


PLACED = "container_kind string, doc_id long, piece_no long, n_tokens long, container_no long, capacity_tokens long"


def assign(sizes: DataFrame, kind: str, capacity: int, fit: str = "shortest") -> DataFrame:
    """(container_kind, doc_id, piece_no, n_tokens, container_no, capacity_tokens) of every piece. ``sizes`` should be settled.

    piece_no is -1 for a whole document, else 0, 1, ... in the order of the text.
    """
    n, cap = F.col("n_tokens"), F.lit(capacity).cast("bigint")
    whole = F.array(F.struct(F.lit(-1).cast("bigint").alias("piece_no"), n.alias("n_tokens")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / cap)), lambda i: F.struct(i.cast("bigint").alias("piece_no"), F.least(cap, n - i * cap).cast("bigint").alias("n_tokens")))
    items = sizes.where(n > 0).select("doc_id", F.explode(F.when(n <= cap, whole).otherwise(pieces)).alias("p")).select("doc_id", "p.*")
    counted = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counted.collect()}
    blocks = max([1, *histogram.values()]) // BLOCK + 1
    slots = Slots(pack({k: v for k, v in histogram.items() if k < capacity}, capacity, fit))
    spread = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)))
    within = Window.partitionBy("n_tokens", "block").orderBy("doc_id", "piece_no")
    # At most one row for each length and block, i.e. for about BLOCK items.
    before = Window.partitionBy("n_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = spread.groupBy("n_tokens", "block").agg(F.count(F.lit(1)).alias("n")).select("n_tokens", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = spread.withColumn("r", F.row_number().over(within) - 1).join(shift, ["n_tokens", "block"]).select("doc_id", "piece_no", "n_tokens", (F.col("r") + F.col("shift")).cast("bigint").alias("rank"))
    return ranked.mapInArrow(_placed(slots, kind, capacity), PLACED)


def packed(documents: DataFrame, containers: DataFrame, tokenizer: str = DEFAULT, fit: str = "shortest") -> DataFrame:
    """The assignment for every kind of container; documents without tokens get a null container_no."""
    sizes = settled(with_sizes(documents, tokenizer).select("doc_id", "n_tokens"))
    out = None
    for r in containers.where("capacity_tokens >= 1").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind", "capacity_tokens").collect():
        kind, capacity = r[0], int(r[1])
        empty = sizes.where("n_tokens = 0").select(F.lit(kind).alias("container_kind"), "doc_id", F.lit(-1).cast("bigint").alias("piece_no"), "n_tokens", F.lit(None).cast("bigint").alias("container_no"), F.lit(capacity).cast("bigint").alias("capacity_tokens"))
        one = assign(sizes, kind, capacity, fit).unionByName(empty)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else documents.sparkSession.createDataFrame([], PLACED)


def report(assigned: DataFrame) -> DataFrame:
    """Per kind: containers, tokens in them, and the share of the space that stays unused."""
    by = assigned.groupBy("container_kind", "capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items")).where("container_no is not null")
    out = by.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used_tokens"), F.max("used").alias("fullest"))
    unused = F.col("containers") * F.col("capacity_tokens") - F.col("used_tokens")
    return out.withColumn("unused_tokens", unused).withColumn("unused_share", F.round(unused / (F.col("containers") * F.col("capacity_tokens")), 6))


def checked(assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per kind: documents that are there, containers over their capacity, documents whose pieces don't add up to their
    size, and documents cut though they fit. ``sizes`` has (doc_id, n_tokens); ids are unique."""
    by = ["container_kind", "capacity_tokens"]
    full = assigned.where("container_no is not null").groupBy(*by, "container_no").agg(F.sum("n_tokens").alias("used"))
    over = full.groupBy(*by).agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_full"))
    each = assigned.groupBy(*by, "doc_id").agg(F.sum("n_tokens").alias("placed"), F.max("piece_no").alias("last")).join(sizes, "doc_id", "left")
    kept = each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("wrong_size"),
        F.count_if((F.col("last") >= 0) & (F.col("placed") <= F.col("capacity_tokens"))).alias("cut_without_need"),
    )
    return kept.join(over, by, "left").select("container_kind", "documents", F.coalesce("over_full", F.lit(0)).alias("over_full"), "wrong_size", "cut_without_need")
