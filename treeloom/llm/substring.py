"""Substring deduplication behind a count-min prefilter.

A window is `width` consecutive words of a document. A first pass counts windows in a count-min
sketch: each task makes a sketch of its own part, sketches are merged by block and saturate at two.
Windows are counted by their least gram (the smallest hash among the shorter grams they hold): equal
windows have equal least grams, so the estimate is never below a window's count, and neighbouring
windows share cells, which makes the sketch several times smaller. A second pass emits only windows
estimated to be in two documents, finds each one's first document exactly, and joins that back to
every place of it. What the sketch overestimates is sorted out there; nothing is lost.

The sketch's size follows the input. Up to 2**most_bits cells it is broadcast; a larger one stays
distributed: one row whose cells are whole hashes, merged by a shuffle of each document's grams, and what it
counts twice goes back to the documents that hold it by a join. Results are the same. Of the largest groups of equal texts, at most `most_groups`, only the first
document takes part in the passes, as all windows of the others start in it too.

Defined cases: a null text has no words; fewer words than a window lose none; rows that repeat with
their id are judged alike and never against each other, as only a smaller id counts; null ids lose and
remove nothing; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import wordhash
from treeloom.llm.scratch import Scratch, release

ROWS = 2  # of the sketch
BLOCK_BITS = 16
#: Cells that a row of a broadcast sketch has at most (as a power of two): one bit a cell, 64 MB in all.
MOST_BITS = 28
#: Grams that a task counts before it passes them on.
HELD_GRAMS = 1_000_000
#: Groups of equal texts that are broadcast at most, the largest first: 24 bytes each.
MOST_GROUPS = 100_000
TEXT_CHARS_PER_GRAM = 20  # about as many characters of text as there are to one counted gram


def gram_width(width: int) -> int:
    return max(1, width * 5 // 8)


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    odd = (wordhash.ODD, wordhash.ODD2)[row]
    return (wordhash.mix(grams ^ odd) >> np.uint64(64 - bits)).astype(np.int64)


def large_groups(docs: DataFrame, key: str, text: str, most: int) -> list:
    """The largest groups of equal texts, at most `most` of them: digest and smallest id."""
    d = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("g"))
    groups = d.groupBy("g").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.orderBy(F.desc("n"), "g").limit(most).select("g", "first").collect()


def is_copy(first: dict, k, t: str) -> bool:
    """Whether an earlier document has the same text and is known to the broadcast groups."""
    f = first.get(hashlib.md5(t.encode()).digest()) if first else None
    return f is not None and k is not None and k > f


def sketch(spark: SparkSession, docs: DataFrame, key: str, text: str, width: int, bits: int, first) -> np.ndarray:
    """One bit a cell, set where two documents or more were counted; ROWS rows of 2**bits cells."""
    gram, span = gram_width(width), width - gram_width(width) + 1
    block_bits = min(BLOCK_BITS, bits)

    def count(batches):
        held, n = [], 0

        def flush():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            times = np.minimum(times, 2).astype(np.uint8)
            for row in range(ROWS):
                at = cells(value, row, bits)
                order = np.argsort(at, kind="stable")
                at, t = at[order], times[order]
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                t = np.minimum(np.add.reduceat(t.astype(np.int64), start), 2)
                at = at[start]
                block, low = at >> block_bits, (at & ((1 << block_bits) - 1)).astype("<u2")
                first_of = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                ends = np.r_[first_of[1:], len(block)]
                once, twice = [], []
                for a, b in zip(first_of, ends, strict=True):
                    once.append(low[a:b][t[a:b] == 1].tobytes())
                    twice.append(low[a:b][t[a:b] == 2].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(once), row, np.int32)), pa.array(block[first_of].astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["row", "block", "once", "twice"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t or k is None or is_copy(first.value, k, t):
                    continue
                h = wordhash.hashes(t.encode().split())
                if len(h) >= width:
                    held.append(np.unique(wordhash.least(wordhash.runs(h, gram), span)))
                    n += len(held[-1])
            if n > HELD_GRAMS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merge(batches):
        at, dense = None, None

        def done():
            bits_of = np.packbits(dense >= 2).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([bits_of], pa.binary())], names=["row", "block", "bits"])

        for b in batches:
            for row, block, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (row, block) != at:
                    if at is not None:
                        yield done()
                    at, dense = (row, block), np.zeros(1 << block_bits, np.uint8)
                one = np.frombuffer(once, "<u2")
                dense[one] = np.minimum(dense[one] + 1, 2)
                dense[np.frombuffer(twice, "<u2")] = 2
        if at is not None:
            yield done()

    parts = docs.select(F.col(key).cast("long"), text).mapInArrow(count, "row int, block int, once binary, twice binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    size = (1 << block_bits) // 8
    for b in merged.toArrow().to_batches():  # of a bounded size: a bit a cell
        for row, block, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out[row, block * size : (block + 1) * size] = np.frombuffer(x, np.uint8)
    return out


def repeated(bits_set: np.ndarray, grams: np.ndarray, bits: int) -> np.ndarray:
    """Where every row of the sketch counts two or more."""
    out = np.ones(len(grams), bool)
    for row in range(ROWS):
        at = cells(grams, row, bits)
        out &= (bits_set[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def distributed(docs: DataFrame, key: str, text: str, width: int, first, scratch: Scratch) -> DataFrame:
    """_k2 and gs: each document's grams that are in another document too, by a sketch that no one holds as a whole."""
    gram, span = gram_width(width), width - gram_width(width) + 1

    def count(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and k is not None and not is_copy(first.value, k, t):
                    h = wordhash.hashes(t.encode().split())
                    if len(h) >= width:
                        g = np.unique(wordhash.least(wordhash.runs(h, gram), span))
                        out.append((g.view(np.int64), np.full(len(g), k, np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["g", "k"])

    grams = scratch.save(docs.select(F.col(key).cast("long"), text).mapInArrow(count, "g long, k long"), "grams")
    often = grams.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select(F.col("g").alias("og"))
    mine = scratch.save(grams.join(often, F.col("g") == F.col("og"), "left_semi").groupBy(F.col("k").alias("_k2")).agg(F.collect_set("g").alias("gs")), "often")
    scratch.drop(grams)
    return mine


def repeats(spark: SparkSession, docs: DataFrame, key: str, text: str, width: int, scratch: Scratch, first, most_bits: int = MOST_BITS) -> DataFrame:
    """_k, _x (hash of the text) and at: the starts of windows that also start in a smaller id."""
    chars = docs.agg(F.sum(F.char_length(text))).collect()[0][0] or 0
    bits = max(10, int(np.ceil(np.log2(max(1, 3 * chars / TEXT_CHARS_PER_GRAM)))))
    gram, span = gram_width(width), width - gram_width(width) + 1
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.xxhash64(text).alias("_x"), F.col(text).alias("_t"))
    small = bits <= most_bits
    if small:
        sent, often = spark.sparkContext.broadcast(sketch(spark, docs, key, text, width, bits, first)), None
    else:
        sent, often = None, distributed(docs, key, text, width, first, scratch)
        rows = rows.join(often.hint("shuffle_hash"), F.col("_k") == F.col("_k2")).select("_k", "_x", "_t", "gs")
    release(spark)

    def emit(batches):
        for b in batches:
            out = []
            for i, (k, x, t) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if not t or k is None or is_copy(first.value, k, t):
                    continue
                h = wordhash.hashes(t.encode().split())
                if len(h) < width:
                    continue
                grams = wordhash.least(wordhash.runs(h, gram), span)
                if small:
                    at = np.flatnonzero(repeated(sent.value, grams, bits))
                else:
                    at = np.flatnonzero(np.isin(grams, b.column(3)[i].values.to_numpy().view(np.uint64)))
                if len(at):
                    one, two = wordhash.runs(h, width)[at], wordhash.runs(h, width, wordhash.ODD2)[at]
                    out.append((one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), k), np.full(len(at), x), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "c", "_k", "_x", "at"])

    windows = scratch.save(rows.mapInArrow(emit, "h long, c int, _k long, _x long, at int"), "windows")
    if often is not None:
        scratch.drop(often)
    firsts = scratch.save(windows.groupBy("h", "c").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).where("lo < hi").select(F.col("h").alias("_h"), F.col("c").alias("_c"), "lo"), "firsts")
    release(spark)
    later = windows.join(firsts, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c"))).where("_k > lo")
    starts = scratch.save(later.groupBy("_k", "_x").agg(F.collect_list("at").alias("at")), "starts")
    scratch.drop(windows, firsts)
    release(spark)
    return starts


def covered(n: int, starts, width: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    at = np.unique(np.asarray(starts, np.int64))
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:n]) > 0


def dedup(spark: SparkSession, docs: DataFrame, key: str, text: str, width: int = 13, most_bits: int = MOST_BITS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """Per row: key, n_words, n_removed and kept, the words that are left, joined by one space."""
    scratch = Scratch(spark, "substring")
    first = spark.sparkContext.broadcast({bytes(r["g"]): r["first"] for r in large_groups(docs, key, text, most_groups)})
    starts = repeats(spark, docs, key, text, width, scratch, first, most_bits)
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.xxhash64(text).alias("_x"), F.col(text).alias("_text"))
    joined = rows.join(starts.withColumnsRenamed({"_k": "_k2", "_x": "_x2"}), (F.col("_k") == F.col("_k2")) & (F.col("_x") == F.col("_x2")), "left").select("_k", "_text", "at")

    def cut(batches):
        for b in batches:
            words_of, gone, kept = [], [], []
            for k, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if n >= width and is_copy(first.value, k, t):
                    words = []
                elif at.is_valid:
                    words = [words[i] for i in np.flatnonzero(~covered(n, at.values.to_numpy(), width))]
                words_of.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_of, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"`{key}` long, n_words long, n_removed long, kept string")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
