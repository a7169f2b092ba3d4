"""Segments of stored records: assignment, index order, liveness and compaction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import chains
from treeloom.scratch import Scratch

#: Bytes of a record beside its payload, and of a segment's first bytes.
RECORD_HEADER, SEGMENT_HEADER = 46, 8


def cost(slen: Column) -> Column:
    return slen + RECORD_HEADER


def exits(before: np.ndarray, full: int) -> np.ndarray:
    """Rows (last, exit, row, starts): from any record of a part as a segment's first, the place, as bytes and as a
    row, where the last segment that starts in the part does, and how many start there behind it. Neighbours
    that leave alike are one row, of the last of them. before: bytes of the part in front of each record."""
    n = len(before)
    follow = np.maximum(np.searchsorted(before, before + full, "left"), np.arange(n) + 1)
    follow = np.append(follow, n)
    last, starts = np.arange(n + 1), np.r_[(follow[:n] < n).astype(np.int64), 0]
    jump = np.where(follow < n, follow, last)
    while (jump != jump[jump]).any():  # doubling: as many rounds as the logarithm of the segments in the part
        starts = starts + np.where(jump != last, starts[jump], 0)
        jump = jump[jump]
    at, starts = jump[:n], starts[:n]
    ends = np.flatnonzero(np.r_[(at[1:] != at[:-1]) | (starts[1:] != starts[:-1]), True])
    return np.stack([before[ends], before[at[ends]], at[ends], starts[ends]], axis=1)


def assign(records: DataFrame, order: str, slen: str, threshold: int, first: int = 0) -> DataFrame:
    """records with segment_id, pos and off: a segment is sealed after the append that fills it.

    Where a segment ends depends on all appends before it. Parts of the order say at once where the last segment
    would start from any entry; only the way through these answers, a few numbers a part, is sequential."""
    spark = records.sparkSession
    scratch = Scratch(spark, "assign")
    full = max(1, threshold - SEGMENT_HEADER)
    narrow = records.select(F.col(order).cast("long").alias("o"), F.col(slen).cast("long").alias("n"))
    numbered = chains.parts(narrow, ["o"], scratch)

    def sizes(rows):
        rows = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in rows]
        o, n = (np.concatenate(c) for c in zip(*rows, strict=True))
        return o, np.r_[0, np.cumsum(n + RECORD_HEADER)]

    def tell(part, rows):
        _, total = sizes(rows)
        table = exits(total[:-1], full)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(total) - 1], pa.int64()), pa.array([int(total[-1])], pa.int64()), pa.array([table.astype(np.int64).tobytes()], pa.binary())], names=["part", "rows", "bytes", "table"])

    told = chains.each_part(numbered, ["o"], tell, "part int, rows long, bytes long, table binary").orderBy("part").toLocalIterator()
    entries, segment, start, row, at, n = {}, first - 1, None, 0, 0, 0
    for r in told:  # one part after the other: bytes and rows in front of it, and the segment that is open there
        entries[r["part"]] = (at, n, segment, start, row)
        table = np.frombuffer(r["table"], np.int64).reshape(-1, 4)
        entry = 0 if start is None else start + full - at
        i = int(np.searchsorted(table[:, 0], entry, "left"))
        if i < len(table):
            segment, start, row = segment + 1 + int(table[i, 3]), at + int(table[i, 1]), n + int(table[i, 2])
        at, n = at + r["bytes"], n + r["rows"]
    sent = spark.sparkContext.broadcast(entries)  # five numbers a part

    def place(part, rows):
        at, n, segment, start, row = sent.value[part]
        o, total = sizes(rows)
        before, starts = total[:-1], []
        i = int(np.searchsorted(before, 0 if start is None else start + full - at, "left"))
        while i < len(before):
            starts.append(i)
            i = max(int(np.searchsorted(before, before[i] + full, "left")), i + 1)
        which = np.searchsorted(np.array(starts, np.int64), np.arange(len(before)), "right")  # 0: the segment that was open
        begin = np.r_[0 if start is None else start - at, before[starts]] if starts else np.array([0 if start is None else start - at])
        begin_row = np.r_[row - n, starts] if starts else np.array([row - n])
        off = SEGMENT_HEADER + before - begin[which]
        pos = np.arange(len(before)) - begin_row[which]
        yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(segment + which, pa.int64()), pa.array(pos.astype(np.int32)), pa.array(off.astype(np.int64))], names=[order, "segment_id", "pos", "off"])

    placed = chains.each_part(numbered, ["o"], place, f"`{order}` long, segment_id long, pos int, off long")
    return records.join(placed, order)


def fanout(index: DataFrame) -> DataFrame:
    """last_byte and entries: how many keys have a last byte up to it, for all 256 values."""
    spark = index.sparkSession
    last = F.conv(F.hex(F.substring("key", 32, 1)), 16, 10).cast("int")
    counts = index.groupBy(last.alias("last_byte")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(256).select(F.col("id").cast("int").alias("last_byte"))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("last_byte").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(F.broadcast(counts), "last_byte", "left").select("last_byte", running.cast("long").alias("entries"))


def index_order(index: DataFrame) -> DataFrame:
    return index.orderBy(F.substring("key", 32, 1), "key")


def by_location(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Keys by segment and offset, absent ones last; keys: ord, key."""
    newest = index.groupBy("key").agg(F.max(F.struct("segment_id", "off")).alias("_at"))
    found = keys.join(newest, "key", "left").select("ord", "key", F.col("_at.segment_id").alias("segment_id"), F.col("_at.off").alias("off"))
    return found.orderBy(F.col("segment_id").asc_nulls_last(), F.col("off").asc_nulls_last(), "ord")


def stored_size(keys: DataFrame, index: DataFrame) -> DataFrame:
    """ord, key and slen of the newest record, null if absent."""
    newest = index.groupBy("key").agg(F.max_by("slen", "segment_id").alias("slen"))
    return keys.join(newest, "key", "left").select("ord", "key", "slen")


def liveness(index: DataFrame, live: DataFrame) -> DataFrame:
    """By segment: live and dead keys and bytes, headers included; live: key."""
    marked = index.join(live.select("key").distinct().withColumn("_live", F.lit(True)), "key", "left")
    alive, bytes_of = F.col("_live").isNotNull(), cost(F.col("slen"))
    total = lambda when: F.coalesce(F.sum(F.when(when, bytes_of)), F.lit(0)).cast("long")
    return marked.groupBy("segment_id").agg(F.count_if(alive).alias("live_keys"), F.count_if(~alive).alias("dead_keys"), total(alive).alias("live_bytes"), total(~alive).alias("dead_bytes"))


def threshold(garbage: float, default: float = 0.5, low_space: bool = False, low: float = 0.1) -> float:
    """The part of dead bytes from which a segment is rewritten; a negative argument asks for the policy."""
    return garbage if garbage >= 0 else low if low_space else default or 0.5


def victims(scored: DataFrame, segments: DataFrame, ratio: float, horizon: Column | None = None) -> DataFrame:
    """Sealed segments with a dead key, dead bytes of at least the ratio, sealed before the horizon."""
    s = scored.join(segments.where("sealed"), "segment_id")
    if horizon is not None:
        s = s.where(F.col("sealed_at") < horizon)
    return s.where((F.col("dead_keys") > 0) & (F.col("dead_bytes") >= F.lit(ratio) * (F.col("live_bytes") + F.col("dead_bytes"))))


def copy_set(index: DataFrame, chosen: DataFrame, live: DataFrame) -> DataFrame:
    """Records of the victims to be kept: live, in no segment that stays, one a key."""
    inside = index.join(chosen.select("segment_id"), "segment_id", "left_semi")
    survivors = index.join(chosen.select("segment_id"), "segment_id", "left_anti").select("key")
    wanted = inside.join(live.select("key"), "key", "left_semi").join(survivors, "key", "left_anti")
    return wanted.groupBy("key").agg(F.min(F.struct("segment_id", "off", "slen")).alias("_r")).select("key", "_r.*")


def compact_stats(index: DataFrame, segments: DataFrame, chosen: DataFrame, copied: DataFrame) -> DataFrame:
    """scanned, compacted, copied_records, copied_bytes, freed_bytes."""
    freed = segments.join(chosen.select("segment_id"), "segment_id", "left_semi").agg(F.count(F.lit(1)).alias("compacted"), F.coalesce(F.sum("file_bytes"), F.lit(0)).cast("long").alias("freed_bytes"))
    moved = copied.agg(F.count(F.lit(1)).alias("copied_records"), F.coalesce(F.sum(cost(F.col("slen"))), F.lit(0)).cast("long").alias("copied_bytes"))
    scanned = segments.where("sealed").agg(F.count(F.lit(1)).alias("scanned"))
    return scanned.crossJoin(freed).crossJoin(moved)


def status(scored: DataFrame, segments: DataFrame) -> DataFrame:
    """By sealed segment: bytes, keys, live ones and the part that is garbage."""
    s = segments.where("sealed").join(scored, "segment_id", "left")
    whole = F.col("live_bytes") + F.col("dead_bytes")
    return s.select("segment_id", "body_bytes", "keys", F.coalesce("live_keys", F.lit(0)).cast("long").alias("live_keys"), F.when(whole > 0, F.col("dead_bytes") / whole).otherwise(F.lit(0.0)).alias("garbage"))
