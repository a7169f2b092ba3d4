"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in lower case with white space runs as one space. An item is
cut into parts of equal length that overlap by half, so that an excerpt of one and a half parts holds a
whole one; a part of m characters has an edit budget of k = rate * m edits. By
the lemma, where a part occurs with at most k edits, at least T = m - q + 1 - k * q of its q-grams
occur unchanged, on diagonals that lie within k of each other. Shared q-grams are counted in
overlapping bands of diagonals, so that some band holds all of an occurrence; bands with at least T
are retained and verified by a banded alignment. Items of fewer than `short` characters have no budget:
they must occur as they are, from one word's edge to another's, with q lowered to their length.

Items are broadcast in blocks of a fixed size, each to one scan of all documents, so a benchmark of
any size can be used.

Defined cases: null or empty texts contain nothing; null items and items without a character other than
white space are contained nowhere; texts of any length are read whole; a document that contains an item
twice is reported once for it, at its best place; repeated rows and rows with a null id are each judged;
empty tables give an empty table. Other columns are ignored by contained() and kept by clean().
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import wordhash
from treeloom.llm.scratch import Scratch, small_batches, worker_cache

Q = 10
RATE = 0.06
PART = 160
#: Items of fewer characters must occur exactly.
SHORT = 40
#: Items of a block, and characters of its items at most (an item that is longer alone is a block).
BLOCK_ITEMS, BLOCK_CHARS = 8192, 1_000_000
TABLE_BITS = 22
#: Blocks whose tables a worker remembers.
REMEMBERED = 2


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # few letters grow in lower case; they stay as they are
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (a == 32) | (a >= 9) & (a <= 13) | (a == 0xA0)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.flatnonzero(keep)
    return np.where(space, np.uint32(32), a)[place], place


def pieces(a: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of equal length, at most `most`, that overlap by half."""
    n = -(-len(a) // most)
    size = -(-len(a) // n)
    return [a[i : i + size] for i in np.linspace(0, len(a) - size, 2 * n - 1).round().astype(int)]


class Parts:
    """Parts of a block of items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, part: int = PART, short: int = SHORT):
        self.q, self.item, self.chars, self.budget, self.exact = q, [], [], [], Exact(q)
        grams, owner, offset = [], [], []
        for item, text in items:
            a, _ = normal(text.strip())
            if len(a) < max(short, q):
                self.exact.add(item, a)
                continue
            for piece in pieces(a, part):
                budget = min(int(rate * len(piece)), (len(piece) - q) // q)
                g = wordhash.runs(piece.astype(np.uint64), q)
                grams.append(g)
                owner.append(np.full(len(g), len(self.item), np.int32))
                offset.append(np.arange(len(g), dtype=np.int32))
                self.item.append(item)
                self.chars.append(piece)
                self.budget.append(max(0, budget))
        self.m = np.array([len(x) for x in self.chars], np.int64)
        self.k = np.array(self.budget, np.int64)
        self.needed = self.m - q + 1 - self.k * q
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.owner = np.concatenate(owner)[order] if grams else np.empty(0, np.int32)
        self.offset = np.concatenate(offset)[order] if grams else np.empty(0, np.int32)
        g = g[order]
        self.starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
        self.grams = g[self.starts] if len(g) else g
        self.counts = np.diff(np.r_[self.starts, len(g)])
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, first and last diagonal) of the bands that share enough q-grams with a text."""
        h = wordhash.runs(a.astype(np.uint64), self.q)
        p = np.flatnonzero(self.known[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(p) or not len(self.grams):
            return []
        at = np.searchsorted(self.grams, h[p])
        at[at == len(self.grams)] = 0
        same = self.grams[at] == h[p]
        p, at = p[same], at[same]
        if not len(p):
            return []
        n = self.counts[at]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        posting = np.repeat(self.starts[at], n) + step
        part, diagonal = self.owner[posting].astype(np.int64), np.repeat(p, n) - self.offset[posting]
        width = self.k[part] + 1
        band = np.floor_divide(diagonal, width)
        # band i holds diagonals of i and i + 1, so a hit counts for two bands
        part, band = np.concatenate([part, part]), np.concatenate([band, band - 1])
        key = part * (1 << 40) + band + (1 << 39)
        key, count = np.unique(key, return_counts=True)
        part, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 39)
        keep = count >= self.needed[part]
        part, band = part[keep], band[keep]
        low = band * (self.k[part] + 1)
        return list(zip(part.tolist(), low.tolist(), (low + 2 * self.k[part] + 1).tolist(), strict=True))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the item's best occurrence whose path keeps to the diagonals, if within the budget.

    Row i of the table holds text ends i + d for each diagonal d from low - budget to high + budget."""
    lo, hi = low - budget, high + budget
    d = np.arange(lo, hi + 1)
    far = 1 << 20
    # before the item begins, any text end is free
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    start = d.copy()
    for i in range(1, len(item) + 1):
        end = i + d
        inside = (end >= 1) & (end <= len(text))
        miss = np.ones(len(d), np.int64)
        miss[inside] = text[end[inside] - 1] != item[i - 1]
        new = np.where(inside, cost + miss, far)
        source = start.copy()
        up = np.r_[cost[1:] + 1, far]  # the item's character has no partner
        better = up < new
        new = np.where(better & (end >= 0) & (end <= len(text)), up, new)
        source = np.where(better, np.r_[start[1:], 0], source)
        # a text character has no partner: the cheapest end before it, one edit a step
        run = new - np.arange(len(d))
        low_so_far = np.minimum.accumulate(run)
        of = np.maximum.accumulate(np.where(run == low_so_far, np.arange(len(d)), 0))
        left = low_so_far + np.arange(len(d))
        source = np.where(left < new, source[of], source)
        cost = np.where((end >= 0) & (end <= len(text)), np.minimum(new, left), far)
        start = source
        if cost.min() > budget:
            return None
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(len(item) + d[best])


class Exact:
    """Short items, by the hash of their first q characters or of all they have."""

    def __init__(self, q: int):
        self.q, self.by_width = q, {}

    def add(self, item: int, a: np.ndarray) -> None:
        if len(a):
            width = min(self.q, len(a))
            first = int(wordhash.runs(a[:width].astype(np.uint64), width)[0])
            self.by_width.setdefault(width, {}).setdefault(first, []).append((item, a))

    def find(self, a: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """(0, start, end) of the first place of each item that occurs between edges of words."""
        out: dict[int, tuple[int, int, int]] = {}
        edge = None
        for width, known in self.by_width.items():
            h = wordhash.runs(a.astype(np.uint64), width)
            at = np.flatnonzero(np.isin(h, np.fromiter(known, np.uint64, len(known))))
            if not len(at):
                continue
            edge = edges(a) if edge is None else edge
            for p in at[edge[at]].tolist():
                for item, chars in known[int(h[p])]:
                    end = p + len(chars)
                    if item not in out and end <= len(a) and edge[end] and (a[p:end] == chars).all():
                        out[item] = (0, p, end)
        return out


def edges(a: np.ndarray) -> np.ndarray:
    """For each place, the end included, whether no word of letters and digits goes on over it."""
    kinds, of = np.unique(a, return_inverse=True)
    word = np.array([chr(x).isalnum() for x in kinds.tolist()], bool)[of]
    return np.r_[True, ~(word[1:] & word[:-1]), True] if len(a) else np.ones(1, bool)


def find(text: str | None, parts: Parts) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) for each item that a text contains; places in the text as it stands."""
    if not text:
        return []
    a, place = normal(text)
    out = parts.exact.find(a)
    for part, low, high in parts.bands(a) if len(a) >= parts.q else ():
        item = parts.item[part]
        if (got := out.get(item)) and got[0] == 0:
            continue
        hit = align(parts.chars[part], a, low, high, int(parts.k[part]))
        if hit and (item not in out or hit < out[item]):
            out[item] = hit
    return [(item, edits, int(place[min(max(start, 0), len(place) - 1)]), int(place[end - 1]) + 1) for item, (edits, start, end) in sorted(out.items())]


def blocks(items: DataFrame, key: str, text: str):
    """The benchmark in blocks of a fixed size, by id."""
    rows = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(text).alias("t"))
    after, last_text = None, None
    while True:
        page = rows if after is None else rows.where((F.col("i") > after) | (F.col("i") == after) & (F.col("t") > last_text))
        page = page.distinct().orderBy("i", "t").limit(BLOCK_ITEMS).collect()
        if not page:
            return
        held, chars = [], 0
        for r in page:
            if held and chars + len(r["t"]) > BLOCK_CHARS:
                yield held
                held, chars = [], 0
            held.append((r["i"], r["t"]))
            chars += len(r["t"])
        yield held
        after, last_text = page[-1]["i"], page[-1]["t"]
        if len(page) < BLOCK_ITEMS:
            return


def table_of(sent, name: str, q: int, rate: float) -> Parts:
    """A block's table, made once in each worker."""
    held = worker_cache().setdefault("decontam", {})
    key = (name, q, rate)
    if key not in held:
        while len(held) >= REMEMBERED:
            del held[next(iter(held))]
        held[key] = Parts(sent.value, q, rate)
    return held[key]


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, q: int = Q, rate: float = RATE) -> DataFrame:
    """key, item_id, edits, start and end (code points of the text, end exclusive)."""
    small_batches(spark)
    schema = f"`{key}` long, item_id long, edits int, start long, end long"
    found = None
    for block in blocks(items, item_key, item_text):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def read(batches, sent=sent, name=name):
            parts = table_of(sent, name, q, rate)
            for b in batches:
                rows = [(k, *hit) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in find(t, parts)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "item_id", "edits", "start", "end"])

        part = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(read, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, q: int = Q, rate: float = RATE) -> DataFrame:
    """docs without those that contain a benchmark item, decided where a document is read; columns as they were.

    What a block of items leaves is written before the next block reads it, so that a task holds one block's table."""
    small_batches(spark)
    out, before, scratch, where = docs, None, None, docs.columns.index(text)
    for i, block in enumerate(blocks(items, item_key, item_text)):
        if i:
            scratch = scratch or Scratch(spark, "clean")
            out = scratch.save(out, "left")
            if before is not None:
                scratch.drop(before)
            before = out
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def read(batches, sent=sent, name=name):
            parts = table_of(sent, name, q, rate)
            for b in batches:
                yield b.filter(pa.array([not find(t, parts) for t in b.column(where).to_pylist()], pa.bool_()))

        out = out.mapInArrow(read, docs.schema)
    return out
