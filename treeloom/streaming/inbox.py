"""Incoming packs: staged files that a Structured Streaming query drains into a store.

A staged file is a header (reference, root, time) and a wire pack; its name is its body's digest, so
the same body arrives once. Each micro-batch parses its packs, appends the objects of sound ones and
keeps the others as rows of a quarantine table. Offsets live in the query's checkpoint, so a stopped
query goes on where it was."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import codec
from treeloom.scratch import small_batches

FILES = "path string, modificationTime timestamp, length long, content binary"


def stage(folder: str, ref: str, root: bytes, received_at_ns: int, body: bytes) -> tuple[str, bytes, int]:
    """(path, digest of the body, its length) of a staged file, not yet visible to the query."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
    with open(path, "wb") as f:
        f.write(codec.meta_header(ref, root, received_at_ns) + body)
    return path, codec.blake3(body), len(body)


def discard(path: str) -> None:
    os.unlink(path)


def commit(path: str, digest: bytes) -> bool:
    """Make a staged file visible; False if its body has come before."""
    final = os.path.join(os.path.dirname(path), f"{digest.hex()}.pack")
    if os.path.exists(final):
        discard(path)
        return False
    os.rename(path, final)
    return True


#: Bytes of packs that are opened together at most; a larger pack stands alone.
TOGETHER = 1 << 20


def opened_rows(files: list[tuple[str, bytes]], magic: bytes = codec.PACK_MAGIC) -> list[tuple]:
    """What opened() gives of some files, whose records and objects are checked together."""
    found = []  # path, ref, root, and the pack's body, then its records, or an error
    for path, data in files:
        try:
            ref, root, _, at = codec.read_meta_header(data)
            found.append([path, ref, root, data[at:]])
        except codec.Malformed as e:
            found.append([path, None, None, e])
    sound = [x for x in found if not isinstance(x[3], codec.Malformed)]
    for x, records in zip(sound, codec.read_packs([x[3] for x in sound], magic), strict=True):
        x[3] = records
    objects, errors = [], {}
    for i, x in enumerate(found):
        try:
            if isinstance(x[3], codec.Malformed):
                raise x[3]
            for r in x[3]:
                objects.append((i, r.key, codec.payload(r)))
        except codec.Malformed as e:
            errors[i] = str(e)
    bad = {}
    for (i, _, _), why in zip(objects, codec.verify_many([o[1:] for o in objects]), strict=True):
        if why:
            bad.setdefault(i, f"object {why}")
    errors |= bad  # a wrong object comes before the first payload that can't be decoded
    held = [[] for _ in found]
    for i, *o in objects:
        held[i].append(o)
    return [(*x[:3], *o, errors.get(i)) for i, x in enumerate(found) for o in (i not in errors and held[i] or [(None, None)])]


def opened(files: DataFrame, magic: bytes = codec.PACK_MAGIC) -> DataFrame:
    """path, ref, root, key, payload and error: objects of packs, or one row with the error of a bad one."""
    small_batches(files.sparkSession)

    def read(batches):
        names, kinds = ["path", "ref", "root", "key", "payload", "error"], (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string())
        for b in batches:
            for some in codec.together(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), lambda x: len(x[1]), TOGETHER):
                rows = opened_rows(some, magic)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(read, "path string, ref string, root binary, key binary, payload binary, error string")


def drain(spark: SparkSession, folder: str, checkpoint: str, quarantine: str, put: Callable[[DataFrame], object], done: str | None = None):
    """Start the query over what is there (and stop when that is drained); put gets the objects of each batch."""

    def batch(files: DataFrame, epoch: int) -> None:
        rows = opened(files).persist()
        put(rows.where("key is not null").select("key", "payload"))
        # a batch that is replayed writes over what it has written before
        rows.where("error is not null").select("path", "ref", "error").write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch}")
        if done:
            rows.select("path", F.hex("root").alias("root"), F.col("error").isNull().alias("sound")).distinct().write.mode("overwrite").parquet(f"{done}/epoch={epoch}")
        rows.unpersist()

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pack").load(folder)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(staged: DataFrame, done: DataFrame) -> DataFrame:
    """root and pending: packs of each root that no batch has taken; both: path, root."""
    return staged.join(done.select("path"), "path", "left_anti").groupBy("root").agg(F.count(F.lit(1)).alias("pending"))


def wait(query) -> None:
    """Until all that was there is drained."""
    query.awaitTermination()


def wait_for(query, root: str, staged: Callable[[], DataFrame], done: Callable[[], DataFrame], every: float = 0.2) -> None:
    """Until no staged pack of a root is pending, or the query has ended; staged and done give their tables as they stand."""
    while query.isActive and not pending(staged().where(F.col("root") == root), done()).isEmpty():
        query.awaitTermination(every)
