"""Exact top-k by inner product with no random access.

Vectors become whole numbers, floor(scale * x). Within a block of candidates each dimension has a list
sorted by its component. A query reads each list from the end that its own component favours; what it
has read gives every candidate a lower bound (unread components at their worst) and an upper bound
(unread ones at the value where the list stands). Candidates whose upper bound stays below the k-th best
lower bound, or below the k-th best score of blocks that are done, can't qualify and are read no further.
Reading goes on, halving what is unread, until no more than k candidates are left or the lists end;
the scores of those that are left are then resolved from what their lists hold.

While most candidates are in question, one depth is a few matrix products over a block of queries and a
block of candidates; from then on each query adds what it newly reads of the rest to running sums.
Blocks grow from a small first one, which is read to its end and gives all later ones a bound to stop at.

Queries are taken in blocks of a fixed number of components, each broadcast to one scan of all candidates;
every task returns k rows a query, and those are merged by query.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors are
compared with those of their own length; components and scores beyond the range of a long are held at its
ends; ties go to the smaller id; fewer candidates than k give all; rows with equal vectors are separate
candidates; rows with the query's id are its own; of several query rows with one id the one with the
least vector asks; null ids take no part; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.scratch import Scratch

#: Queries and their components in one broadcast block: 4 MB.
QUERY_BLOCK, QUERY_CELLS = 8192, 1 << 19
#: Candidates whose lists are sorted together: first, and at most; queries that are bounded together.
FIRST_BLOCK, LIST_BLOCK, BOUND_BLOCK = 256, 4096, 512
#: Part of a block that must be in question for a depth to be read by matrix products.
DENSE = 0.25
#: Products and sums below this are exact in floating point.
EXACT = 2.0**53
RESULT = "query_id long, rank int, vec_id long, score long"


class Lists:
    """Sorted lists of a block of candidates, one a dimension."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[by_id], whole[by_id]
        self.x = self.whole.astype(np.float64)
        self.n, self.d = self.x.shape
        order = np.argsort(-self.x, axis=0, kind="stable")
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None] * np.ones((1, self.d), order.dtype), axis=0)
        self.sorted = np.take_along_axis(self.x, order, axis=0)

    def upper(self, up: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
        """Upper bounds of every query and candidate once `depth` entries of each list are read.

        up and down are the queries' positive and negative components: they read from the top and from the bottom."""
        top, low = self.place < depth, self.place >= self.n - depth
        return up @ np.where(top, self.x, self.sorted[depth - 1]).T + down @ np.where(low, self.x, self.sorted[self.n - depth]).T

    def lower(self, up: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
        """Lower bounds alike: what isn't read lies at the list's other end."""
        top, low = self.place < depth, self.place >= self.n - depth
        return up @ np.where(top, self.x, self.sorted[-1]).T + down @ np.where(low, self.x, self.sorted[0]).T


def deeper(depth: int, n: int) -> int:
    """Half of what is unread, and all of it once that is little."""
    return n if n - depth <= max(8, n // 16) else depth + (n - depth + 1) // 2


def held(score):
    """A bound on scores that are held at the ends of a long, where they tie."""
    score = np.minimum(score, 2.0**63)
    return np.where(score <= -(2.0**63), -np.inf, score)


def read_on(lists: Lists, q: np.ndarray, at: np.ndarray, depth: int, k: int, floor: float, slack: float) -> np.ndarray:
    """The places among `at` that can qualify, after reading on from `depth` until that is certain."""
    favours = q >= 0
    place = np.where(favours, lists.place[at], lists.n - 1 - lists.place[at])
    part = lists.x[at] * q
    worst = np.where(favours, lists.sorted[-1], lists.sorted[0]) * q
    read = place < depth
    seen, unread_worst = np.where(read, part, 0.0).sum(axis=1), np.where(read, 0.0, worst).sum(axis=1)
    while len(at) > k and depth < lists.n:
        before, depth = read, deeper(depth, lists.n)
        read = place < depth
        fresh = read & ~before
        seen = seen + np.where(fresh, part, 0.0).sum(axis=1)
        unread_worst = unread_worst - np.where(fresh, worst, 0.0).sum(axis=1)
        stands = np.where(favours, lists.sorted[depth - 1], lists.sorted[lists.n - depth]) * q
        kth = held(max(floor, np.partition(seen + unread_worst, -k)[-k]))
        keep = seen + np.where(read, 0.0, stands).sum(axis=1) >= kth - slack
        at, place, part, read, seen, unread_worst = (y[keep] for y in (at, place, part, read, seen, unread_worst))
    return at


def best(lists: Lists, whole: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray):
    """(query's place, id, score) of each query's k best in these lists that may be among its k best of all.

    floor: for each query, a score that at least k other candidates are known to reach; it is raised here."""
    queries = whole.astype(np.float64)
    most = np.abs(lists.x).max(initial=0.0) * np.abs(queries).max(initial=0.0) * max(1, lists.d)
    exact = most < EXACT
    slack = most * 2.0**-40 * (not exact) + (0.0 if exact else 1.0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = lists.ids[None, :] != query_ids[:, None]
    open_q, depth = np.arange(len(queries)), 0
    while len(open_q) and depth < lists.n:
        depth = deeper(depth, lists.n)
        upper = lists.upper(up[open_q], down[open_q], depth)
        kth = floor[open_q]
        new = np.flatnonzero(np.isneginf(kth))
        if len(new) and lists.n > k:  # nothing is known yet: lower bounds tell
            lower = np.where(alive[open_q[new]], lists.lower(up[open_q[new]], down[open_q[new]], depth), -np.inf)
            kth[new] = np.partition(lower, -k, axis=1)[:, -k]
        alive[open_q] &= upper >= (held(kth) - slack)[:, None]
        if alive[open_q].mean() <= DENSE:
            break
        open_q = open_q[alive[open_q].sum(axis=1) > k]
    out_q, out_id, out_s = [], [], []
    for q in range(len(queries)):
        at = np.flatnonzero(alive[q])
        if len(at) > k and depth < lists.n:
            at = read_on(lists, queries[q], at, depth, k, floor[q], slack)
        if exact:
            s = lists.x[at] @ queries[q]
            if len(s) > k:
                keep = np.flatnonzero(s >= np.partition(s, -k)[-k])
                keep = keep[np.lexsort((lists.ids[at[keep]], -s[keep]))[:k]]
                at, s = at[keep], s[keep]
            real, s = s, s.astype(np.int64)
        else:
            asked = whole[q].tolist()
            sums = [sum(a * b for a, b in zip(asked, row, strict=True)) for row in lists.whole[at].tolist()]
            sums = [min(max(x, -(2**63)), 2**63 - 1) for x in sums]
            order = sorted(range(len(at)), key=lambda i: (-sums[i], lists.ids[at[i]]))[:k]
            at, s = at[order], np.array([sums[i] for i in order], np.int64)
            real = s.astype(np.float64)
        out_q.append(np.full(len(at), q))
        out_id.append(lists.ids[at])
        out_s.append(s)
        if len(at) == k:
            floor[q] = max(floor[q], real.min())
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key and v, whole numbers; rows without a full finite vector go."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(sound & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of `queries` the k best other rows of `vectors`."""
    candidates = usable(vectors, key, vector, scale)
    asked = usable(queries, key, vector, scale).groupBy("_id").agg(F.min("v").alias("v"))
    widest = asked.agg(F.max(F.size("v"))).collect()[0][0]
    if widest is None:
        return spark.createDataFrame([], RESULT)
    page = min(QUERY_BLOCK, max(1, QUERY_CELLS // max(1, widest)))
    parts, after, scratch = [], None, None
    while True:  # blocks of queries by id: each is a broadcast of a fixed size and a scan of all candidates
        block = (asked if after is None else asked.where(F.col("_id") > after)).orderBy("_id").limit(page).collect()
        if not block:
            break
        after = block[-1]["_id"]
        part = merged(candidates, spark.sparkContext.broadcast(by_width(block)), k)
        if len(block) < page and not parts:
            return part
        scratch = scratch or Scratch(spark, "top-k")  # done blocks are written, so that plans don't grow with them
        parts.append(scratch.save(part, "block"))
        if len(block) < page:
            break
    return spark.read.schema(RESULT).parquet(*[p._scratch_path for p in parts])


def by_width(block: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Queries' ids and vectors by length."""
    out: dict[int, list] = {}
    for r in block:
        out.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64).reshape(len(rows), d)) for d, rows in out.items()}


def merged(candidates: DataFrame, sent, k: int) -> DataFrame:
    found = candidates.mapInArrow(reader(sent, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The best of all candidates of one length that a task has read, k a query."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.floor = np.full(len(queries), -np.inf)
        self.held: list = []
        self.ids, self.rows, self.n, self.block = [], [], 0, min(FIRST_BLOCK, LIST_BLOCK)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(rows)
        self.n += len(ids)
        while self.n >= self.block:
            ids, rows, n = np.concatenate(self.ids), np.concatenate(self.rows), self.block
            self.take(ids[:n], rows[:n])
            self.ids, self.rows, self.n = [ids[n:]], [rows[n:]], self.n - n
            self.block = min(2 * n, LIST_BLOCK)

    def take(self, ids: np.ndarray, rows: np.ndarray) -> None:
        lists = Lists(ids, rows)
        for i in range(0, len(self.queries), BOUND_BLOCK):
            part = slice(i, i + BOUND_BLOCK)
            qs, at, s = best(lists, self.queries[part], self.query_ids[part], self.k, self.floor[part])
            self.held.append((qs + i, at, s))
        qs, at, s = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((at, ~s, qs))  # ~s falls as s grows
        qs, at, s = qs[order], at[order], s[order]
        first = np.r_[True, qs[1:] != qs[:-1]]
        keep = np.arange(len(qs)) - np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0)) < self.k
        self.held = [(qs[keep], at[keep], s[keep])]

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if self.n:
            self.take(np.concatenate(self.ids), np.concatenate(self.rows))
        if not self.held:
            return None
        qs, at, s = self.held[0]
        return self.query_ids[qs], at, s


def reader(sent, k: int):
    """Reads candidates by blocks, those of each length apart, and returns what is best in a task."""

    def read(batches):
        of = {d: Best(ids, q, k) for d, (ids, q) in sent.value.items()}
        for b in batches:
            ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                if d in of:
                    mine = lengths == d
                    rows = v if mine.all() else v.filter(pa.array(mine))
                    of[d].add(ids[mine], rows.flatten().to_numpy(zero_copy_only=False).reshape(int(mine.sum()), d))
        for x in of.values():
            if (out := x.done()) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return read
