"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents with equal shingle sets count as one. Each set has a signature of least hashes; bands of it
put sets into buckets. Candidates of a bucket are compared batch by batch of their signatures: after
each batch the posterior probability that the similarity reaches the threshold, from a uniform prior,
is bounded, and a pair is dropped once it falls below the chosen miss probability. What survives is
verified exactly on the full shingle sets.

Only what can change a component is compared, and never all pairs of a bucket by joining it with
itself: first every member with its bucket's smallest member (one pair a member and bucket), by the
most frequent such pair before the others; then, in buckets that still hold different components,
members of different components, within tiles of bounded size that return links only. Signatures are
compared first; the sets move only of members that these leave in question. No bucket is capped.

A pair at the threshold has no common band with probability (1 - 0.8**4)**32 = 5e-8, and is dropped by
the posterior with at most about `miss` a batch.

Defined cases: a null or wordless text has no shingles and is linked with nothing; fewer words than a
shingle make one shingle of the whole sequence; texts of any length are read whole; repeated rows get
the same component; an empty table gives an empty table. Other columns are ignored; ids are whole
numbers, and rows with a null id are linked with nothing.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import wordhash
from treeloom.llm.idfilter import FILTER_BITS, id_filter, passing, split
from treeloom.llm.scratch import Scratch, release

HASHES, BAND = 128, 4
BATCH = 32
#: Members of a block of a large bucket; a tile holds two blocks at most.
BLOCK = 1024
#: Shingles hashed at once, so that a chunk stays in the CPU's cache.
CHUNK = 1 << 15
#: Rows whose sets are held at once.
ROWS = 512


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes: A-Z in lower case, words parted by ASCII white space."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    return np.unique(wordhash.runs(wordhash.hashes(w), min(words, len(w))) + np.uint64(min(words, len(w))))


def seeds() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, HASHES + 1, dtype=np.uint64)
    return wordhash.mix(at * wordhash.ODD) | np.uint64(1), wordhash.mix(at * wordhash.ODD2)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of the least of each of HASHES hashes of each non-empty set."""
    odd, flip = seeds()
    out = np.empty((len(sets), HASHES), np.uint16)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= CHUNK):
            n += len(sets[j])
            j += 1
        s = np.concatenate(sets[i:j])
        starts = np.r_[0, np.cumsum([len(x) for x in sets[i:j]])[:-1]]
        t = np.empty_like(s)
        for k in range(HASHES):
            np.bitwise_xor(s, flip[k], out=t)
            np.multiply(t, odd[k], out=t)
            out[i:j, k] = (np.minimum.reduceat(t, starts) >> np.uint64(16)).astype(np.uint16)
        i = j
    return out


def thresholds(percent: int, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches needed) after each batch.

    With a uniform prior, m of n matches leave a Beta(m + 1, n - m + 1) posterior; that the similarity
    is at least t has the probability that Bin(n + 1, t) is at most m."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while True:
            mass += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if mass >= miss:
                break
            m += 1
        out.append((n, m + 1))
    return out


def survivors(x: np.ndarray, y: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs of signatures that no batch rules out."""
    at = np.arange(len(x))
    matches, before = np.zeros(len(x), np.int64), 0
    for n, least in needed:
        matches = matches + (x[at, before:n] == y[at, before:n]).sum(axis=1)
        keep = matches >= least
        at, matches, before = at[keep], matches[keep], n
    return at


def sign(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """k, n (size of the set), g (digest of the set) and sig; g and sig are null for an empty set."""

    def read(batches):
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    digests[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["k", "n", "g", "sig"])

    return docs.select(F.col(key).cast("long").alias("k"), text).mapInArrow(read, "k long, n long, g binary, sig binary")


def banded(signed: DataFrame) -> DataFrame:
    """bucket, band and k for every band of every signature."""

    def read(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            bands = sig.shape[1]
            key = wordhash.mix(sig ^ wordhash.mix(np.arange(1, bands + 1, dtype=np.uint64) * wordhash.ODD))
            k = np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(k)], names=["bucket", "band", "k"])

    return signed.select("k", "sig").mapInArrow(read, "bucket long, band int, k long")


def sizes_fit(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def probable(pairs: DataFrame, signed: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs a, b that sequential comparison of their signatures doesn't rule out; other columns pass."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    for side in ("b", "a"):
        pairs = pairs.join(signed.select(F.col("k").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    needed = thresholds(percent, miss)

    def read(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            at = pa.array(survivors(x, y, needed), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("a", "b", *rest)], names=["a", "b", *rest])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b", *rest).schema)
    return pairs.where(sizes_fit("n_a", "n_b", percent)).select("a", "b", *rest, "sig_a", "sig_b").mapInArrow(read, kinds)


def texts_of(spark: SparkSession, docs: DataFrame, key: str, text: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """k and t of the wanted documents; a filter of a fixed size spares the others the shuffle."""
    sent = id_filter(spark, ids, bits)

    def read(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            if len(k):
                yield b.filter(pa.array(passing(sent, k, bits)))

    some = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null").mapInArrow(read, "k long, t string")

    return some.join(ids.hint("shuffle_hash"), "k", "left_semi")


def once(texts: DataFrame) -> DataFrame:
    """One row an id: rows that repeat meet in one partition of texts_of()."""

    def read(batches):
        seen = set()
        for b in batches:
            keep = [i for i, k in enumerate(b.column(0).to_pylist()) if not (k in seen or seen.add(k))]
            yield b.take(pa.array(keep, pa.int64()))

    return texts.mapInArrow(read, "k long, t string")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs a, b whose full shingle sets reach the threshold."""
    both = pairs.select("a", "b").join(texts.select(F.col("k").alias("b"), F.col("t").alias("t_b")), "b").join(texts.select(F.col("k").alias("a"), F.col("t").alias("t_a")), "a")

    def read(batches):
        last, of_last = None, None
        for b in batches:
            a_s, b_s, keep = b.column(0).to_pylist(), b.column(1), []
            for i, (a, t_a, t_b) in enumerate(zip(a_s, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if a != last:
                    last, of_last = a, shingles(t_a, words)
                y = shingles(t_b, words)
                common = len(np.intersect1d(of_last, y, assume_unique=True))
                if 100 * common >= percent * (len(of_last) + len(y) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b_s.take(at)], names=["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(read, "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """k and c, the smallest id reachable, for every id that has a link.

    Each round takes the least label among neighbours and then the label of one's label, until
    nothing changes: a number of rounds that grows with the logarithm of the longest path."""
    edges = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.save(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("k"), "c"), "labels")
    while True:
        near = edges.join(labels.select(F.col("k").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")).select(F.col("a").alias("k"), "m")
        lower = scratch.save(labels.join(near, "k").select("k", F.col("c").alias("was"), F.least("c", "m").alias("c")), "lower")
        jump = lower.select(F.col("k").alias("c"), F.col("c").alias("to"))
        new = scratch.save(lower.join(jump, "c").select("k", "was", F.col("to").alias("c")), "labels")
        scratch.drop(labels, lower)
        labels = new
        if labels.where("was != c").isEmpty():
            return labels.select("k", "c")


def set_rows(texts: DataFrame, words: int) -> DataFrame:
    """k and set, the sorted shingle hashes as bytes."""

    def read(batches):
        seen = set()  # rows that repeat meet in one partition of texts_of()
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            keep = [i for i, k in enumerate(b.column(0).to_pylist()) if not (k in seen or seen.add(k))]
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["k", "set"])

    return texts.mapInArrow(read, "k long, set binary")


def tiles(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members of buckets that hold several components, once for each tile that they are compared in.

    members: bucket, band, k, c (component) and first of the bucket. The members of a bucket's most frequent
    component aren't compared with each other, so a bucket of m members, o of which are in other components,
    takes o * m comparisons. Both kinds are cut into blocks; a block of the others makes a tile with
    each block of either kind, so that no task gathers a bucket."""
    counts = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("x"), F.sum("n").alias("m"))
    major = major.select(F.col("bucket").alias("at"), (-F.col("x.c")).alias("major"), F.col("x.n").alias("inside"), (F.col("m") - F.col("x.n")).alias("outside"))
    major = scratch.save(major, "major")  # a table of its own, so that the join can split a hot bucket's members
    n_out, n_in = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("outside", "inside"))
    is_major = F.col("c") == F.col("major")
    mine = F.when(is_major, n_out + F.pmod(F.xxhash64("k", F.lit(3)), n_in).cast("int")).otherwise(F.pmod(F.xxhash64("k", F.lit(3)), n_out).cast("int"))
    met = F.sequence(F.lit(0), F.when(is_major, n_out).otherwise(n_out + n_in) - 1)
    each = members.join(major, F.col("bucket") == F.col("at")).withColumn("mine", mine).withColumn("other", F.explode(met))
    return each.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "band", "k", "c", (F.col("k") == F.col("first")).alias("head"), "mine")


def crossing(tiled: DataFrame, signed: DataFrame, sets: DataFrame | None, percent: int, miss: float) -> DataFrame:
    """Links a, b between members of one bucket and different components: enough of them to join all that are linked.

    Without sets: the rows of `tiled` that signatures alone leave in question, as only their sets are needed.
    Within a tile, pairs are made in numpy and never become rows. A pair is judged in the first band that it
    shares, by posterior bounds and then exactly, unless links found in the tile have joined its
    components; a pair with the bucket's first member has been judged before."""
    whole = tiled.join(signed.select("k", "n", "sig"), "k")
    by_signature = sets is None
    whole = whole if by_signature else whole.join(sets, "k")
    needed = thresholds(percent, miss)

    def candidates(tile, band, c, head, mine, diagonal, n, sig):
        """Places of the pairs to be judged exactly; rows are sorted by tile."""
        bands = sig.view(np.uint64)
        xs, ys, step, at = [], [], 1, np.arange(len(tile))
        while True:
            at = at[at + step < len(tile)]
            at = at[tile[at] == tile[at + step]]
            if not len(at):
                break
            other = at + step
            ok = (c[at] != c[other]) & ~head[at] & ~head[other] & (diagonal[at] | (mine[at] != mine[other])) & (np.minimum(n[at], n[other]) * 100 >= np.maximum(n[at], n[other]) * percent)
            x, y = at[ok], other[ok]
            for i in range(0, len(x), 1 << 14):
                u, v = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
                here = (bands[u] == bands[v]).argmax(axis=1) == band[u]
                u, v = u[here], v[here]
                s = survivors(sig[u], sig[v], needed)
                xs.append(u[s])
                ys.append(v[s])
            step += 1
        return (np.concatenate(f) if f else np.empty(0, np.int64) for f in (xs, ys))

    def judge(tile, band, k, c, head, mine, diagonal, n, sig, held, rows):
        x, y = candidates(tile, band, c, head, mine, diagonal, n, sig)
        if by_signature:
            return rows.take(pa.array(np.unique(np.r_[x, y]), pa.int64()))
        root: dict = {}

        def find(i):
            while (up := root.get(i, i)) != i:
                i = up
            return i

        order = np.lexsort((y, x))
        found_a, found_b, last, of_last = [], [], -1, None
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            of_i, of_j = find(int(c[i])), find(int(c[j]))
            if of_i == of_j:
                continue
            if i != last:
                last, of_last = i, np.frombuffer(held[i], np.uint64)
            other = np.frombuffer(held[j], np.uint64)
            at = np.searchsorted(of_last, other)
            at[at == len(of_last)] = 0
            common = int((of_last[at] == other).sum())
            if 100 * common >= percent * (len(of_last) + len(other) - common):
                root[max(of_i, of_j)] = min(of_i, of_j)
                found_a.append(min(k[i], k[j]))
                found_b.append(max(k[i], k[j]))
        return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    names = ["bucket", "i", "j", "band", "k", "c", "head", "mine"]

    def tiles_of(rows):
        """Judges whole tiles."""
        bucket, i, j, band, k, c, head, mine, n = (rows.column(x).to_numpy(zero_copy_only=False) for x in (*names, "n"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(k), -1)
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        return judge(np.cumsum(new), band, k, c, head, mine, i == j, n, sig, None if by_signature else rows.column("set").to_pylist(), rows.select(names))

    def read(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if waiting is None else pa.concat_batches([waiting, batch])
            at = [rows.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "i", "j")]
            last = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in at], axis=0)])[-1]
            waiting = rows.slice(last)  # the last tile may go on in the next batch
            if last:
                yield tiles_of(rows.slice(0, last))
        if waiting is not None:
            yield tiles_of(waiting)

    schema = "a long, b long" if not by_signature else tiled.select(*names).schema
    return whole.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(read, schema)


def link(spark: SparkSession, docs: DataFrame, key: str, text: str, words: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest id reachable by links."""
    scratch = Scratch(spark, "near-dup")
    all_signed = scratch.save(sign(docs, key, text, words), "all")
    heads = scratch.save(all_signed.where("g is not null and k is not null").groupBy("g").agg(F.min("k").alias("k")), "heads")
    signed = scratch.save(all_signed.select("k", "n", "g", "sig").join(heads.select(F.col("g").alias("hg"), F.col("k").alias("hk")), (F.col("k") == F.col("hk")) & (F.col("g") == F.col("hg")), "left_semi").dropDuplicates(["k"]).select("k", "n", "sig"), "signed")
    first = scratch.save(banded(signed).groupBy("bucket").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("bucket", "at"), "first")
    members = scratch.save(banded(signed).join(first, F.col("bucket") == F.col("at")).select("bucket", "band", "k", "first", "m"), "members")
    scratch.drop(first)
    release(spark)
    pairs = members.where("k != first").groupBy(F.col("first").alias("a"), F.col("k").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    likely = scratch.save(probable(pairs, signed, percent, miss), "likely")
    texts = scratch.save(once(texts_of(spark, docs, key, text, likely.select(F.col("a").alias("k")).unionByName(likely.select(F.col("b").alias("k"))).distinct())), "texts")
    release(spark)
    # the pair that most bands propose for each member, then those pairs that still join components
    most = likely.groupBy("b").agg(F.max(F.struct(F.col("bands"), (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    links = scratch.save(verified(most, texts, words, percent), "links")
    joined = components(scratch, links)
    left = apart(likely.select("a", "b"), joined)
    more = scratch.save(verified(left, texts, words, percent), "links")
    links = links.unionByName(more)
    joined = components(scratch, links)
    # buckets of three and more that still hold several components
    labelled = members.where("m > 2").join(joined.withColumnRenamed("k", "jk"), F.col("k") == F.col("jk"), "left").select("bucket", "band", "k", "first", "m", F.coalesce("c", "k").alias("c"))
    labelled = scratch.save(labelled, "labelled")
    mixed = scratch.save(labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("bucket").alias("at")), "mixed")
    apart_still = scratch.save(labelled.join(mixed, F.col("bucket") == F.col("at"), "left_semi").select("bucket", "band", "k", "first", "c"), "apart")
    scratch.drop(labelled, mixed, members, texts)
    release(spark)
    doubtful = scratch.save(crossing(tiles(apart_still, scratch), signed, None, percent, miss), "doubtful")
    sets = scratch.save(set_rows(texts_of(spark, docs, key, text, doubtful.select("k").distinct()), words), "sets")
    rest = scratch.save(crossing(doubtful, signed, sets, percent, miss), "links")
    scratch.drop(sets, apart_still, doubtful)
    if not rest.isEmpty():
        links = links.unionByName(rest)
        joined = components(scratch, links)
    scratch.drop(signed, likely)
    release(spark)
    by_set = scratch.save(heads.join(joined.withColumnRenamed("k", "jk"), F.col("k") == F.col("jk"), "left").select(F.col("g").alias("hg"), F.coalesce("c", "k").alias("c")), "by-set")
    out = all_signed.select("k", "n", "g").join(by_set, F.col("g") == F.col("hg"), "left")
    out = scratch.save(out.select("k", "n", F.when(F.col("k").isNull(), F.col("k")).otherwise(F.coalesce("c", "k")).alias("c")), "linked")
    scratch.drop(all_signed, heads, by_set)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, the smallest id; columns as they were.

    Rows that repeat with their id are one document; rows without an id stay. Only rows that a filter of a
    fixed size lets pass move; all others stay where they are read."""
    scratch = Scratch(spark, "keep-one")
    linked = link(spark, docs, key, text, words, percent).select(F.col(key).alias("k"), F.col("component_id").alias("c")).where("k is not null")
    often = linked.groupBy("k").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"))
    touched = scratch.save(often.where("c < k or n > 1").select("k", (F.col("c") < F.col("k")).alias("gone")), "touched")
    others, moving = split(spark, docs, key, touched.select("k"))
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of the table
    gone = touched.where("gone").select(F.col("k").alias(f"{own}k"))
    moving = moving.withColumn(own, F.col(f"`{key}`").cast("long"))
    kept = moving.join(gone.hint("shuffle_hash"), F.col(own) == F.col(f"{own}k"), "left_anti").dropDuplicates([own])
    return others.unionByName(kept.drop(own))


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    for side in ("a", "b"):
        pairs = pairs.join(joined.select(F.col("k").alias(side), F.col("c").alias(f"c_{side}")), side, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def digest(linked: DataFrame) -> DataFrame:
    return linked.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
