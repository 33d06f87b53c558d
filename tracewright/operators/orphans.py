"""References to journals that are not there, by compressed bitmaps per key range and period.

Every distinct (key, hour of arrival) goes to a key range by the hash of its key, so that a range holds a
bounded number of keys whatever their spelling. Within a range the keys are dictionary-encoded as integers,
the references of each hour and the journals present by the end of that hour become bitmaps (sorted 16-bit
codes while sparse, packed bits once dense), and ``references AND NOT journals`` leaves the few suspects,
which are decoded. A reference has an hour's grace, so a journal that is there by the end of the
reference's own hour can't be late; what is left is judged exactly against the rows.

Hot keys: a journal named by a third of all references is one key in each hour after the map-side distinct,
and the last join, with the few suspects, is left to adaptive skew handling. No side is broadcast by force.

Defined results: null and blank references are no case; ids are compared without case and outer blanks; a
row delivered again counts once, by its earliest arrival (ties: the smallest key); null arrival times of a
reference count as the earliest and never as late; a journal in the deletions is ``deleted`` even if a row of it is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.tables import clean_key, settled

HOUR = 3600
#: Codes of a range fit 16 bits; ranges are planned at half of that.
RANGE_KEYS = 1 << 15
DENSE = 4096


class Bitmap:
    """A set of codes: sorted 16-bit integers while sparse, packed bits once dense."""

    def __init__(self, codes: np.ndarray, size: int):
        self.size = size
        codes = np.unique(codes)
        if size <= 1 << 16 and len(codes) <= DENSE:
            self.sparse, self.bits = codes.astype(np.uint16), None
        else:
            flags = np.zeros(size, bool)
            flags[codes] = True
            self.sparse, self.bits = None, np.packbits(flags)

    def flags(self) -> np.ndarray:
        if self.bits is not None:
            return np.unpackbits(self.bits, count=self.size).astype(bool)
        flags = np.zeros(self.size, bool)
        flags[self.sparse] = True
        return flags

    def and_not(self, flags: np.ndarray) -> np.ndarray:
        """The codes that are set here and not in ``flags``."""
        if self.bits is None:
            return self.sparse[~flags[self.sparse]]
        return np.flatnonzero(np.unpackbits(self.bits & ~np.packbits(flags), count=self.size))


def range_suspects(keys: pa.ChunkedArray, hours: np.ndarray, parent: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(key, hour) of the references of one range whose journal isn't there by the end of the hour."""
    words = pc.dictionary_encode(keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys)
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    codes, size = words.indices.to_numpy(zero_copy_only=False), len(words.dictionary)
    there, found, when = np.zeros(size, bool), [], []
    # Sorted by hour once and cut where the hour changes.
    order = np.argsort(hours[~parent], kind="stable")
    ref_hours, ref_codes = hours[~parent][order], codes[~parent][order]
    each, begin = np.unique(ref_hours, return_index=True)
    refs = {int(h): Bitmap(c, size) for h, c in zip(each, np.split(ref_codes, begin[1:]), strict=False)}
    born = np.argsort(hours[parent], kind="stable")
    born_hours, born_codes = hours[parent][born], codes[parent][born]
    done = 0
    for h in sorted(refs):
        upto = np.searchsorted(born_hours, h, "right")
        there[born_codes[done:upto]] = True
        done = upto
        left = refs[h].and_not(there)
        found.append(left.astype(np.int64))
        when.append(np.full(len(left), h, np.int64))
    if not found:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    return words.dictionary.take(pa.array(np.concatenate(found))), np.concatenate(when)


def _suspects(group: pa.Table) -> pa.Table:
    keys, hours = range_suspects(group.column("key"), group.column("hour").to_numpy(), group.column("parent").to_numpy().astype(bool))
    return pa.table({"key": keys, "hour": pa.array(hours, pa.int64())})


def references(df: DataFrame, table: str, row_key: str, key: str) -> DataFrame:
    """(table_name, row_key, key, at) of each row once, by its earliest arrival."""
    rows = df.select(F.col(row_key).alias("row_key"), F.struct(F.col("ingested_at").alias("at"), clean_key(key).alias("key")).alias("r"))
    # A row whose every copy lacks a reference needs no judgement, but a null reference that arrived first wins.
    return rows.groupBy("row_key").agg(F.min("r").alias("r")).where("r.key is not null").select(F.lit(table).alias("table_name"), "row_key", "r.key", "r.at")


def _hour(column: str) -> F.Column:
    return F.coalesce(F.floor(F.unix_micros(column) / F.lit(HOUR * 1_000_000)), F.lit(-(1 << 40)))


def orphans(refs: DataFrame, journals: DataFrame, deletions: DataFrame, grace_minutes: int = 60, ranges: int | None = None) -> DataFrame:
    """(table_name, row_key, key, at, orphan_kind) of the dangling references.

    refs: as ``references`` gives them, of any number of tables, settled, as they are read three times. ranges: the number of key ranges; by
    default from a count of the distinct keys.
    """
    if grace_minutes < 60:
        raise ValueError("hours as periods need a grace of an hour at least")
    born = settled(journals.select(clean_key("journal_id").alias("key"), F.col("ingested_at").alias("at")).where("key is not null").groupBy("key").agg(F.min("at").alias("born")))
    gone = deletions.select(clean_key("journal_id").alias("key")).where("key is not null").distinct()
    if ranges is None:
        # Keys of both sides: references may name more journals than there are.
        keys = refs.select("key").unionByName(born.select("key"))
        ranges = 1 + int(keys.select(F.approx_count_distinct("key", 0.05)).first()[0] * 1.5 / RANGE_KEYS)
    used = refs.select("key", _hour("at").alias("hour")).distinct().select("key", "hour", F.lit(False).alias("parent"))
    # Deleted journals count as absent, so their references stay suspects.
    present = born.join(gone, "key", "left_anti").select("key", _hour("born").alias("hour"), F.lit(True).alias("parent"))
    keyed = used.unionByName(present).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    suspects = keyed.groupBy("range").applyInArrow(_suspects, "key string, hour bigint")
    # Settled, so that the last join knows how few they are and sends them around only if their size allows it.
    known = settled(suspects.join(born, "key", "left").join(gone.withColumn("deleted", F.lit(True)), "key", "left"))
    rows = refs.withColumn("hour", _hour("at")).join(known, ["key", "hour"])
    late = F.unix_micros("born") > F.unix_micros("at") + F.lit(grace_minutes * 60_000_000)
    kind = F.when(F.col("deleted"), "deleted").when(F.col("born").isNull(), "missing").when(late, "late")
    return rows.select("table_name", "row_key", "key", "at", kind.alias("orphan_kind")).where("orphan_kind is not null")


def per_period(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Dangling and all references per table and day of arrival, with the share that dangles."""
    day = F.to_date("at").alias("day")
    bad = found.groupBy("table_name", day).pivot("orphan_kind", ["deleted", "late", "missing"]).count()
    bad = bad.select("table_name", "day", *(F.coalesce(k, F.lit(0)).alias(f"{k}_refs") for k in ("deleted", "late", "missing")))
    total = refs.groupBy("table_name", day).agg(F.count(F.lit(1)).alias("refs"))
    out = total.join(bad, ["table_name", "day"], "left").na.fill(0, ["deleted_refs", "late_refs", "missing_refs"])
    return out.withColumn("orphan_share", F.round((F.col("deleted_refs") + F.col("late_refs") + F.col("missing_refs")) / F.col("refs"), 6))
