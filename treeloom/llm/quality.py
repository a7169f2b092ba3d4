"""Quality classifier by co-training on two views of a document.

One view sees the text alone (marks of its characters, words and lines, and the words and pieces of
words that tell the classes apart), the other its metadata alone (language, source, length). Each is a logistic regression
fitted on labelled rows and calibrated on rows held out. Over rounds each view scores all unlabelled
rows, and what it is confident about becomes a pseudo-label for the other. At the end a logistic
regression over both calibrated views, fitted on the held-out rows, scores every document.

The labelled sample is bounded: at most `most_labelled` rows by hash of their id. Unlabelled rows aren't: their
features are written once, some 300 bytes a row, and in each round every task adds up the gradient and
Hessian of the rows that the other view is confident about. Only these sums, of a fixed size, come to the
driver, where they join the labelled rows' in a Newton step; pseudo-labels of a class weigh as much as its
labelled rows at most, however many they are.

A document is good if its label says quality and not toxic. Scoring reads all rows and whole texts.

Defined cases: a null text is the empty text, null metadata is a value of its own; labels that are
null or name no document are skipped; if the labels lack a class, every document is kept and scores
1; repeated rows get equal scores and teach as often as they occur, and rows with a null id are unlabelled;
an empty table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.scratch import Scratch

MOST_LABELLED = 12_000
PIECES, LEAST_ROWS, GRAM = 768, 4, 5
#: Words whose pieces a worker remembers at most, and pieces that a task counts before it passes them on.
MEMO_WORDS, HELD_PIECES = 250_000, 300_000
ROUNDS, CONFIDENT = 3, 0.97
META_BUCKETS = 64
KEEP = 0.5

PUNCTUATION = np.frombuffer(string.punctuation.encode(), np.uint8)
LETTERS = bytes(c if not (chr(c) in string.punctuation or chr(c).isdigit()) or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(LETTERS).split()


def pieces(word: bytes) -> set[bytes]:
    """A word and, behind a mark, its character grams: inflected words share them."""
    w = word.decode("utf-8", "replace")
    return {word, *(b"~" + w[i : i + GRAM].encode() for i in range(len(w) - GRAM + 1))}


class Index(dict):
    """For each word the places of its pieces among the features, worked out at first sight."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__()
        self.places = {p: i for i, p in enumerate(vocabulary)}

    def __missing__(self, word: bytes) -> tuple:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = tuple(self.places[p] for p in pieces(word) if p in self.places)
        return found


def marks(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Figures of a text's form."""
    n = max(1, len(raw))
    a = np.frombuffer(raw, np.uint8)
    count = np.bincount(a, minlength=256)
    punct = count[PUNCTUATION]
    is_punct = np.zeros(256, bool)
    is_punct[PUNCTUATION] = True
    p = is_punct[a]
    lines = raw.split(b"\n")
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        len(raw) / max(1, len(words)),
        distinct / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        len(lines) / n * 100,
        count[65:91].sum() / n,
        count[48:58].sum() / n,
        count[128:].sum() / n,
        punct.sum() / n,
        float((p[1:] & p[:-1]).sum()) / n,
        *np.sqrt(punct / n),
    ]


FIGURES = 11 + len(string.punctuation)


class Rows:
    """Features of rows: the figures of a text's form, a bit a piece, buckets of language and source, the length."""

    NAMES = ("figures", "bits", "lang", "source", "size")
    SCHEMA = "figures binary, bits binary, lang int, source int, size float"

    def __init__(self, figures: np.ndarray, bits: np.ndarray, lang: np.ndarray, source: np.ndarray, size: np.ndarray, pieces: int):
        self.figures, self.bits, self.lang, self.source, self.size, self.pieces = figures, bits, lang, source, size, pieces

    def __len__(self) -> int:
        return len(self.size)

    def take(self, at) -> Rows:
        return Rows(self.figures[at], self.bits[at], self.lang[at], self.source[at], self.size[at], self.pieces)

    def content(self) -> np.ndarray:
        return np.concatenate([self.figures, np.unpackbits(self.bits, axis=1, count=self.pieces).astype(np.float32)], axis=1)

    def side(self) -> np.ndarray:
        """One place a language and source by hash, and the length."""
        out = np.zeros((len(self), 2 * META_BUCKETS + 2), np.float32)
        at = np.arange(len(self))
        out[at, self.lang] = 1
        out[at, META_BUCKETS + self.source] = 1
        out[:, -2], out[:, -1] = self.size, self.size**2
        return out

    def arrays(self) -> list[pa.Array]:
        return [pa.array([x.tobytes() for x in self.figures], pa.binary()), pa.array([x.tobytes() for x in self.bits], pa.binary()), pa.array(self.lang, pa.int32()), pa.array(self.source, pa.int32()), pa.array(self.size, pa.float32())]

    @classmethod
    def of(cls, table, pieces: int) -> Rows:
        """From an Arrow batch or table that holds arrays()."""
        n = table.num_rows
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
        raw = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(n, -1)
        if not n:
            return cls(np.zeros((0, FIGURES), np.float32), np.zeros((0, -(-pieces // 8)), np.uint8), *(np.zeros(0, int),) * 2, np.zeros(0, np.float32), pieces)
        bits = raw("bits", np.uint8) if pieces else np.zeros((n, 0), np.uint8)
        return cls(raw("figures", np.float32), bits, column("lang"), column("source"), column("size"), pieces)

    @classmethod
    def read(cls, texts: list, langs: list, sources: list, index: Index) -> Rows:
        """Of texts and their metadata."""
        n, pieces = len(texts), len(index.places)
        figures, has = np.zeros((n, FIGURES), np.float32), np.zeros((n, pieces), bool)
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            words = words_of(raw)
            distinct = set(words)
            figures[i] = marks(raw, words, len(distinct))
            found: set[int] = set()
            found.update(*map(index.__getitem__, distinct))
            has[i, list(found)] = True
        bucket = lambda values: np.array([xxhash.xxh3_64_intdigest(repr(x)) % META_BUCKETS for x in values], np.int32)
        size = np.array([math.log1p(len(t or "")) for t in texts], np.float32)
        return cls(figures, np.packbits(has, axis=1), bucket(langs), bucket(sources), size, pieces)


class Logistic:
    """Ridge logistic regression over standardised columns, by Newton steps over chunks of rows."""

    CHUNK = 2048

    def __init__(self, chunks, y: np.ndarray, ridge: float = 1.0, steps: int = 8):
        """chunks(i, j): the columns of rows i to j."""
        self.chunks, self.y, n = chunks, y, len(y)
        total = square = 0.0
        for i in range(0, n, self.CHUNK):
            x = chunks(i, i + self.CHUNK).astype(np.float64)
            total, square = total + x.sum(axis=0), square + (x * x).sum(axis=0)
        self.mean = total / n
        self.scale = np.sqrt(np.maximum(0, square / n - self.mean**2))
        self.scale[self.scale < 1e-6] = 1.0
        self.w, self.keep = np.zeros(len(self.mean) + 1), np.full(len(self.mean) + 1, ridge)
        self.keep[-1] = 1e-6
        for _ in range(steps):
            if self.step() < 1e-4:
                break

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("chunks", "y")}

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32), -8, 8)
        return np.concatenate([z, np.ones((len(x), 1), np.float32)], axis=1)

    def sums(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of rows, given by their design."""
        p = sigmoid(np.clip(z @ self.w.astype(z.dtype), -30, 30))
        return z.T @ (p - y).astype(z.dtype), (z * (p * (1 - p) + 1e-6).astype(z.dtype)[:, None]).T @ z

    def step(self, more: tuple | None = None) -> float:
        """One Newton step over the rows and what `more` adds to their gradient and Hessian; the largest change."""
        g, h = self.keep * self.w, np.diag(self.keep)
        for i in range(0, len(self.y), self.CHUNK):
            dg, dh = self.sums(self.design(self.chunks(i, i + self.CHUNK)), self.y[i : i + self.CHUNK])
            g, h = g + dg, h + dh
        if more is not None:
            g, h = g + more[0], h + more[1]
        change = np.linalg.solve(h, g)
        self.w = self.w - change
        return float(np.abs(change).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        parts = [self.design(x[i : i + self.CHUNK]) @ self.w for i in range(0, len(x), self.CHUNK)]
        return np.clip(np.concatenate(parts) if parts else np.empty(0), -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class View:
    """A regression with its calibration: a logistic map of its logit, fitted on held-out rows. side: which features it sees."""

    def __init__(self, rows: Rows, y: np.ndarray, held: np.ndarray, side: bool):
        self.side, self.held = side, (rows.take(held), y[held])
        mine, own = rows.take(~held), y[~held]
        self.model = Logistic(lambda i, j: self.see(mine.take(slice(i, j))), own)
        self.labelled = [int((own == c).sum()) for c in (0, 1)]
        self.calibrate()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "held"}

    def see(self, rows: Rows) -> np.ndarray:
        return rows.side() if self.side else rows.content()

    def raw(self, rows: Rows) -> np.ndarray:
        return np.concatenate([self.model.logit(self.see(rows.take(slice(i, i + Logistic.CHUNK)))) for i in range(0, len(rows), Logistic.CHUNK)] or [np.empty(0)])

    def calibrate(self) -> None:
        rows, y = self.held
        z = self.raw(rows)[:, None]
        self.to = Logistic(lambda i, j: z[i:j], y, ridge=0.1)

    def logit(self, rows: Rows) -> np.ndarray:
        return self.to.logit(self.raw(rows)[:, None])


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the same ones in every run."""
    return df.orderBy(F.xxhash64(key, F.lit(17)), key).limit(most)


def telling_pieces(rows: DataFrame, most: int, least: int) -> list[bytes]:
    """The pieces whose presence tells the classes apart best, by the likelihood ratio. rows: t and good."""

    def count(batches):
        seen: dict[bytes, list[int]] = {}

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["w", "bad", "good"])
            seen.clear()
            return out

        for b in batches:
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[bytes] = set()
                found.update(*map(pieces, set(words_of((t or "").encode()))))
                for w in found:
                    seen.setdefault(w, [0, 0])[good] += 1
                if len(seen) > HELD_PIECES:
                    yield batch()
        yield batch()

    totals = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_bad, all_good = totals.get(0, 0), totals.get(1, 0)
    n = all_bad + all_good
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")

    def part(cell, row, column):
        return F.when((cell > 0) & (row > 0), cell * F.log(cell * n / (row * column))).otherwise(F.lit(0.0))

    ratio = part(bad, bad + good, all_bad) + part(good, bad + good, all_good) + part(all_bad - bad, n - bad - good, all_bad) + part(all_good - good, n - bad - good, all_good)
    counted = rows.select("t", "good").mapInArrow(count, "w binary, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = counted.where(F.col("bad") + F.col("good") >= least).select("w", ratio.alias("ratio")).where("ratio >= 4").orderBy(F.desc("ratio"), "w").limit(most)
    return [bytes(r["w"]) for r in best.collect()]


def features(rows: DataFrame, vocabulary: list[bytes], extra: list[str]) -> DataFrame:
    """extra columns and the columns of Rows; rows: t, lang, source."""

    def read(batches):
        index, n = Index(vocabulary), len(extra)
        for b in batches:
            made = Rows.read(*(b.column(n + i).to_pylist() for i in range(3)), index)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made.arrays()], names=[*extra, *Rows.NAMES])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*extra).schema)
    return rows.select(*extra, "t", "lang", "source").mapInArrow(read, kinds + Rows.SCHEMA)


class CoTrained:
    """Both views and their combination."""

    def __init__(self, vocabulary: list[bytes], content: View, side: View, both: Logistic | None = None):
        self.vocabulary, self.content, self.side, self.both = vocabulary, content, side, both

    def logits(self, rows: Rows) -> np.ndarray:
        return np.stack([self.content.logit(rows), self.side.logit(rows)], axis=1)


def taught(spark: SparkSession, pool: DataFrame, model: CoTrained) -> dict:
    """For each view (0 content, 1 side) and class: how many rows of the pool the other view is confident about,
    and the sums of their gradients and Hessians. pool: the columns of Rows."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    pieces = len(model.vocabulary)

    def add_up(batches):
        m = cloudpickle.loads(sent.value)
        views, sums = (m.content, m.side), {}
        for b in batches:
            for i in range(0, b.num_rows, Logistic.CHUNK):
                rows = Rows.of(b.slice(i, Logistic.CHUNK), pieces)
                p = [sigmoid(v.logit(rows)) for v in views]
                for view in (0, 1):
                    for c, sure in ((0, p[1 - view] <= 1 - CONFIDENT), (1, p[1 - view] >= CONFIDENT)):
                        if n := int(sure.sum()):
                            learner = views[view].model
                            g, h = learner.sums(learner.design(views[view].see(rows.take(sure))), np.full(n, float(c)))
                            n0, all0 = sums.get((view, c), (0, 0.0))
                            sums[view, c] = n0 + n, all0 + np.concatenate([g[None, :], h]).astype(np.float64)
        for (view, c), (n, total) in sums.items():
            out = [[view] * len(total), [c] * len(total), list(range(len(total))), [n] * len(total), [x.tobytes() for x in total]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["view", "c", "i", "n", "v"])

    def merge(batches):
        at, n, v = None, 0, None

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in at), pa.array([n], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["view", "c", "i", "n", "v"])

        for b in batches:
            for view, c, i, n0, v0 in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (view, c, i) != at:
                    if at is not None:
                        yield done()
                    at, n, v = (view, c, i), 0, 0.0
                n, v = n + n0, v + np.frombuffer(v0, np.float64)
        if at is not None:
            yield done()

    schema = "view int, c int, i int, n long, v binary"
    merged = pool.mapInArrow(add_up, schema).repartition("view", "c", "i").sortWithinPartitions("view", "c", "i").mapInArrow(merge, schema)
    out: dict = {}
    for b in merged.toArrow().to_batches():  # four matrices of a fixed size
        for view, c, i, n, v in zip(*(x.to_pylist() for x in b.columns), strict=True):
            out.setdefault((view, c), (n, {}))[1][i] = np.frombuffer(v, np.float64)
    return {k: (n, np.stack([rows[i] for i in range(len(rows))])) for k, (n, rows) in out.items()}


def co_train(spark: SparkSession, vocabulary: list[bytes], rows: Rows, y: np.ndarray, held: np.ndarray, own: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """rows and y: the labelled sample, of which `held` calibrates and `own` teaches; pool: all unlabelled rows."""
    both_y = np.concatenate([y[own], y[held]])
    order = np.concatenate([np.flatnonzero(own), np.flatnonzero(held)])
    is_held = np.r_[np.zeros(int(own.sum()), bool), np.ones(int(held.sum()), bool)]
    model = CoTrained(vocabulary, *(View(rows.take(order), both_y, is_held, side) for side in (False, True)))
    for _ in range(rounds):
        sums = taught(spark, pool, model)
        if not sums:
            break
        for view, learner in enumerate((model.content, model.side)):
            more = None
            for c in (0, 1):
                if (view, c) in sums:
                    n, total = sums[view, c]
                    total = total * min(1.0, max(1, learner.labelled[c]) / n)
                    more = total if more is None else more + total
            if more is not None:
                learner.model.step((more[0], more[1:]))
                learner.calibrate()
    logits = model.logits(rows.take(held))
    model.both = Logistic(lambda i, j: logits[i:j], y[held], ridge=0.1)
    return model


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", most_labelled: int = MOST_LABELLED) -> CoTrained | None:
    """The classifier; None if the labels lack a class."""
    scratch = Scratch(spark, "quality")
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).cast("long").alias("lk")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col("text").alias("t"), F.col("lang"), F.col("source"))
    ids = rows.select("k").where("k is not null").distinct()
    picked = scratch.save(bounded(ids.join(known, F.col("k") == F.col("lk")).select(F.col("k").alias("pk"), "good"), "pk", most_labelled), "picked")
    # at most a fixed number of ids: 16 bytes each
    told = scratch.save(rows.join(F.broadcast(picked), F.col("k") == F.col("pk")).dropDuplicates(["k"]).select("k", "t", "lang", "source", "good"), "told")
    if told.select("good").distinct().count() < 2:
        scratch.drop(picked, told)
        return None
    vocabulary = telling_pieces(told, PIECES, LEAST_ROWS)
    table = features(told, vocabulary, ["k", "good"]).orderBy("k").toArrow()  # a bounded sample, some 300 bytes a row
    y, sample = table.column("good").to_numpy().astype(float), Rows.of(table, len(vocabulary))
    held = np.array([xxhash.xxh3_64_intdigest(str(k)) % 4 == 0 for k in table.column("k").to_pylist()])
    own = ~held
    if len(set(y[held])) < 2 or len(set(y[own])) < 2:
        order = np.argsort(y, kind="stable")  # few labels: take turns
        held = (np.arange(len(y)) % 2 == 0)[np.argsort(order, kind="stable")]
        own = ~held
        if len(set(y[held])) < 2 or len(set(y[own])) < 2:
            held = own = np.ones(len(y), bool)
    unlabelled = rows.join(F.broadcast(picked.select("pk")), F.col("k") == F.col("pk"), "left_anti")
    pool = scratch.save(features(unlabelled, vocabulary, []), "pool")
    model = co_train(spark, vocabulary, sample, y, held, own, pool)
    scratch.drop(picked, told, pool)
    return model


def score(spark: SparkSession, docs: DataFrame, model: CoTrained | None, names: tuple[str, str, str] = ("content_score", "metadata_score", "score")) -> DataFrame:
    """docs with three columns: both views' and the combined probability of a good document. Columns of these names are replaced."""
    rest = [c for c in docs.columns if c not in names]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(1.0).alias(c) for c in names])
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))  # as bytes: its classes travel with it
    places = [rest.index(c) for c in ("text", "lang", "source")]

    def read(batches):
        m = cloudpickle.loads(sent.value)
        index = Index(m.vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                logits = m.logits(Rows.read(*(part.column(i).to_pylist() for i in places), index))
                p = sigmoid(m.both.logit(logits))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x.astype(np.float64)) for x in (sigmoid(logits[:, 0]), sigmoid(logits[:, 1]), p))], names=[*rest, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in rest)
    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(read, f"{kinds}, " + ", ".join(f"`{c}` double" for c in names))
