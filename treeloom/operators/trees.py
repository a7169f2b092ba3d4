"""Trees read in bulk: every level of all directories or files at once, by joins with the objects.

The number of Spark jobs grows with the depth of a tree and of its indexes, not with its objects."""

from __future__ import annotations

import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import codec, keys
from treeloom.scratch import Scratch

ENTRY = "name binary, mode long, uid long, gid long, mtime_ns long, content binary, target binary, major long, minor long, xattrs binary, xattrs_key binary"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


class Missing(KeyError):
    """A tree lacks an object."""


def is_kind(kind: int):
    return F.col("mode").bitwiseAND(F.lit(stat.S_IFMT(0xFFFF))) == kind


def entry_of(row) -> codec.Entry:
    """A row of ENTRY as an entry."""
    raw = {c: row[c] if row[c] is None or isinstance(row[c], int) else bytes(row[c]) for c in NAMES}
    major, minor = raw.pop("major"), raw.pop("minor")
    return codec.Entry(**raw, rdev=None if major is None else (major, minor))


def _opened(level: DataFrame, objects: DataFrame, leaf: bool) -> DataFrame:
    """at, ord, key and, of directory leaves, entries: what stands in each index node, in its place."""

    def read(batches):
        for b in batches:
            out = []
            for at, place, k, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if data is None:
                    out.append((at, place, k, "missing", *[None] * len(NAMES)))
                elif codec.key_type(k) == codec.DIR_LEAF and leaf:
                    for i, e in enumerate(codec.entries(data)):
                        major, minor = e.rdev or (None, None)
                        out.append((at, place + i.to_bytes(4, "big"), k, "entry", e.name, e.mode, e.uid, e.gid, e.mtime_ns, e.content, e.target, major, minor, e.xattrs, e.xattrs_key))
                else:
                    out.extend((at, place + i.to_bytes(4, "big"), c, "node", *[None] * len(NAMES)) for i, (_, c) in enumerate(codec.children(k, data)))
            columns = list(zip(*out, strict=True)) if out else [()] * (4 + len(NAMES))
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.string(), *(pa.int64() if " long" in c else pa.binary() for c in ENTRY.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["at", "ord", "key", "kind", *NAMES])

    joined = level.select("at", "ord", "key").join(objects.select("key", "payload"), "key", "left").select("at", "ord", "key", "payload")
    return joined.mapInArrow(read, f"at binary, ord binary, key binary, kind string, {ENTRY}")


def _whole(rows: DataFrame) -> None:
    if gone := rows.where("kind = 'missing'").select("key").head():
        raise Missing(bytes(gone["key"]).hex())


def entries(spark: SparkSession, objects: DataFrame, dirs: DataFrame, scratch: Scratch) -> DataFrame:
    """at, ord (by which a directory's entries are in order) and ENTRY; dirs: at, key."""
    level, found = dirs.select("at", F.lit(b"").alias("ord"), "key"), None
    while True:
        rows = scratch.save(_opened(level, objects, True), "entries")
        _whole(rows)
        here = rows.where("kind = 'entry'").drop("kind", "key")
        found = here if found is None else found.unionByName(here)
        level = rows.where("kind = 'node'")
        if level.isEmpty():
            return found


def walk(spark: SparkSession, objects: DataFrame, root: bytes) -> DataFrame:
    """path and ENTRY of everything below a directory, a shared subtree under each of its paths."""
    scratch = Scratch(spark, "walk")
    dirs, found = spark.createDataFrame([(b"", root)], "at binary, key binary"), None
    while True:
        here = entries(spark, objects, dirs, scratch)
        path = F.when(F.octet_length("at") == 0, F.col("name")).otherwise(F.concat("at", F.lit(b"/"), "name"))
        here = scratch.save(here.withColumn("path", path), "level")
        found = here if found is None else found.unionByName(here)
        dirs = here.where(is_kind(stat.S_IFDIR)).select(F.col("path").alias("at"), F.col("content").alias("key"))
        if dirs.isEmpty():
            return found


def contents(spark: SparkSession, objects: DataFrame, files: DataFrame) -> DataFrame:
    """at, ord and key of the blobs of files, whose order is that of ord; files: at, key (of a blob or a node)."""
    scratch = Scratch(spark, "contents")
    level, found = scratch.save(files.select("at", F.lit(b"").alias("ord"), "key"), "files"), None
    is_blob = keys.type_of(F.col("key")) == keys.BLOB
    nodes = objects.where(~is_blob)  # payloads of blobs aren't read on the way
    while True:
        blobs = level.where(is_blob)
        found = blobs if found is None else found.unionByName(blobs)
        inner = level.where(~is_blob)
        if inner.isEmpty():
            return found
        rows = scratch.save(_opened(inner, nodes, False).select("at", "ord", "key", "kind"), "nodes")
        _whole(rows)
        level = rows.select("at", "ord", "key")


def with_payload(blobs: DataFrame, objects: DataFrame) -> DataFrame:
    """blobs with their payload, null where it is missing."""
    return blobs.join(objects.select("key", "payload"), "key", "left")
