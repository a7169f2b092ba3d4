"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that hold more than white space; a line's hash is that of its
text without outer white space. Hashes of `gram` consecutive lines are winnowed: of each `window`
neighbouring grams the least is selected, so every run of at least gram + window - 1 lines that occurs
twice has a selected gram at the same place in both. Runs of fewer lines count if they are long: from
`size` words in all, each of them is a gram of its own. Selected grams that are shared are joined back
to all their positions; from there matches are extended both ways: every run of the guaranteed length
that holds the position, whose hash travels with the gram, is looked up exactly, and runs that overlap
grow into one. Lines of a run that occurs at an earlier position (smaller id, then earlier line) are
deleted, the first is kept. No text moves but those of documents that hold such a run.

Every line that a brute-force search over all runs of gram + window - 1 lines, and over all shorter ones
of at least `size` words, would delete is deleted and no other: grams only choose where to look.

Defined cases: a null text stays null; blank lines separate nothing and are kept, unless their
neighbours on both sides are deleted; eight bytes count as a word at least, as some scripts have no
spaces; rows that repeat with their id are judged alike, rows with a null id lose and remove nothing; documents of which no line is left are dropped;
other columns pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import wordhash
from treeloom.llm.idfilter import split
from treeloom.llm.scratch import Scratch, release

GRAM, WINDOW = 2, 2
#: Words from which a run of any number of lines counts.
SIZE = 13


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of the lines that aren't blank."""
    lines = [x for x in (x.strip() for x in text.encode().split(b"\n")) if x]
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64), np.array([max(len(x.split()), len(x) // 8) for x in lines], np.int64)


def long_runs(sizes: np.ndarray, lines: int, size: int) -> np.ndarray:
    """First lines of the runs of so many lines that hold at least `size` words."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.flatnonzero(total[lines:] - total[:-lines] >= size)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the selected grams: the rightmost least of each window."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n) + window - 1
    for j in range(window - 2, -1, -1):
        other = np.arange(n) + j
        best = np.where(grams[other] < grams[best], other, best)
    return np.unique(best)


def positions(docs: DataFrame, key: str, text: str, gram: int, window: int, size: int) -> DataFrame:
    """h, k, at, runs and checks: every selected gram, and two hashes of each run that holds it.

    A gram of at % length + 1 lines, if that is less than the length, is a run of its own and begins at line
    at // length; runs of the full length begin `window - 1` lines before the gram's line, then one line
    further each. Runs that would leave the document have null hashes."""
    length = gram + window - 1

    def read(batches):
        for b in batches:
            grams, keys, places, runs, checks, held = [], [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k is None or not t:
                    continue
                h, sizes = line_hashes(t)
                for n in range(1, length + 1):
                    whole, check = wordhash.runs(h, n), wordhash.runs(h, n, wordhash.ODD2)
                    if n < length:
                        at = long_runs(sizes, n, size)
                        g, start = wordhash.mix(whole ^ wordhash.ODD)[at], at[:, None]  # unlike grams
                    else:
                        at = winnow(selected := wordhash.runs(h, gram), window)
                        g, start = selected[at], at[:, None] - window + 1 + np.arange(window)[None, :]
                    if not len(at):
                        continue
                    inside = (start >= 0) & (start < len(whole))
                    start = np.where(inside, start, 0)
                    grams.append(g)
                    keys.append(np.full(len(at), k, np.int64))
                    places.append(at * length + n - 1)
                    runs.append(whole[start].ravel())
                    checks.append(check[start].ravel())
                    held.append((inside.ravel(), np.full(len(at), start.shape[1])))
            if grams:
                absent = ~np.concatenate([x[0] for x in held])
                ends = pa.array(np.r_[0, np.cumsum(np.concatenate([x[1] for x in held]))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).view(np.int64), mask=absent)) for x in (runs, checks)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), *lists], names=["h", "k", "at", "runs", "checks"])

    return docs.select(F.col(key).cast("long").alias("k"), text).mapInArrow(read, "h long, k long, at long, runs array<long>, checks array<long>")


def repeats(spark: SparkSession, docs: DataFrame, key: str, text: str, gram: int, window: int, size: int, scratch: Scratch) -> DataFrame:
    """k and at: the first lines of runs that occur earlier too, and with them how many lines (as in positions)."""
    length = gram + window - 1
    found = scratch.save(positions(docs, key, text, gram, window, size), "positions")
    shared = scratch.save(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("sh")), "shared")
    joined = found.join(shared, F.col("h") == F.col("sh"), "left_semi")
    # both ways from each position: the runs that hold its gram; two grams may be held by the same run
    each = joined.select("k", "at", F.posexplode(F.arrays_zip("runs", "checks")).alias("j", "x")).where("x.runs is not null")
    full = F.col("at") % length == length - 1
    runs = each.select(F.col("x.runs").alias("h"), F.col("x.checks").alias("c"), "k", F.when(full, F.col("at") + (F.col("j") - (window - 1)) * length).otherwise(F.col("at")).alias("at"))
    runs = scratch.save(runs, "runs")
    scratch.drop(found, shared)
    release(spark)
    first = runs.groupBy("h", "c").agg(F.min(F.col("k")).alias("k1"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.save(first.select(F.col("h").alias("fh"), F.col("c").alias("fc"), "k1"), "first")
    same = (F.col("h") == F.col("fh")) & (F.col("c") == F.col("fc"))
    matched = scratch.save(runs.join(first, same).select("h", "c", "k", "at", "k1"), "matched")
    # within the first document a run's first line tells
    own = matched.where("k = k1").groupBy("h", "c", "k").agg(F.min("at").alias("a1"), F.max("at").alias("a2")).where("a1 < a2")
    own = scratch.save(own.select(F.col("h").alias("oh"), F.col("c").alias("oc"), "a1"), "own")
    again = matched.where("k = k1").join(own, (F.col("h") == F.col("oh")) & (F.col("c") == F.col("oc"))).where("at > a1").select("k", "at")
    starts = matched.where("k > k1").select("k", "at").unionByName(again)
    out = scratch.save(starts.groupBy("k").agg(F.collect_set("at").alias("at")), "starts")
    scratch.drop(runs, first, matched, own)
    release(spark)
    return out


def kept_lines(text: str, starts: np.ndarray, length: int) -> str | None:
    """The text without the runs at `starts` (as in positions); None if no line that isn't blank is left."""
    lines = text.split("\n")
    places = np.array([i for i, x in enumerate(lines) if x.encode().strip()], np.int64)
    gone = np.zeros(len(places), bool)
    for s in starts:
        gone[s // length : s // length + s % length + 1] = True
    if gone.all():
        return None
    drop = np.zeros(len(lines), bool)
    drop[places[gone]] = True
    # blank lines between two deleted lines go with them
    for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
        if gone[i] and gone[i + 1]:
            drop[a:b] = True
    return "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)


def dedup(spark: SparkSession, docs: DataFrame, key: str, text: str, gram: int = GRAM, window: int = WINDOW, size: int = SIZE) -> DataFrame:
    """docs with repeated runs of lines deleted from the text, and without the documents that this empties.

    Only documents that a filter of a fixed size lets pass move; all others stay where they are read."""
    length = gram + window - 1
    scratch = Scratch(spark, "lines")
    columns = docs.columns
    rest = [c for c in columns if c != text]
    own = "_" * (1 + max((len(c) for c in columns), default=0))  # longer than any name of the table
    starts = repeats(spark, docs, key, text, gram, window, size, scratch)
    others, moving = split(spark, docs, key, starts.select("k"))
    starts = starts.withColumnsRenamed({"k": f"{own}k", "at": f"{own}at"})
    joined = moving.join(starts.hint("shuffle_hash"), F.col(f"`{key}`").cast("long") == F.col(f"{own}k"), "left").select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(f"{own}t"), f"{own}at")

    def cut(batches):
        for b in batches:
            texts, keep = [], []
            for i, (t, at) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1), strict=True)):
                if t and at.is_valid:
                    t = kept_lines(t, np.asarray(at.values.to_numpy(), np.int64), length)
                    if t is None:
                        continue
                keep.append(i)
                texts.append(t)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(rest))), pa.array(texts, pa.string())], names=[*rest, text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    done = joined.mapInArrow(cut, (f"{kinds}, " if kinds else "") + f"`{text}` string")
    return others.unionByName(done.select(*[F.col(f"`{c}`") for c in columns]))
