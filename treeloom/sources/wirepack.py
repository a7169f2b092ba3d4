"""Wire packs: streams of framed objects, as a source and a sink."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeloom.functions import codec
from treeloom.scratch import small_batches

#: Bytes of objects that are framed, or given as a batch, together at most.
TOGETHER = 1 << 20

SCHEMA = "path string, pos int, key binary, flags int, ulen long, slen long, record binary, payload binary, error string"


def rows_of(path: str, data: bytes, magic: bytes = codec.PACK_MAGIC, decode: bool = True) -> list[tuple]:
    """A pack's records; one that is malformed anywhere gives a single row with the error."""
    try:
        records = codec.read_pack(data, magic)
        return [(path, i, r.key, r.flags, r.ulen, r.slen, r.data, codec.payload(r) if decode else None, None) for i, r in enumerate(records)]
    except codec.Malformed as e:
        return [(path, None, None, None, None, None, None, None, str(e))]


def parse(packs: DataFrame, magic: bytes = codec.PACK_MAGIC, decode: bool = True) -> DataFrame:
    """Records of packs; packs: path and content. A pack is read whole by one task, few of them in a batch."""
    small_batches(packs.sparkSession)

    def read(batches):
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for rows in codec.together(rows_of(path, data, magic, decode), lambda r: len(r[6] or b"") + len(r[7] or b""), TOGETHER):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return packs.select("path", "content").mapInArrow(read, SCHEMA)


def read(spark: SparkSession, path: str, magic: bytes = codec.PACK_MAGIC, decode: bool = True) -> DataFrame:
    """Packs of a folder by Spark's binary files."""
    return parse(spark.read.format("binaryFile").load(path), magic, decode)


def packed(objects: DataFrame, magic: bytes = codec.PACK_MAGIC, most: int | None = None) -> DataFrame:
    """One pack a partition of objects (key, payload): content and the number of its objects. An empty partition is an empty pack.

    With `most`, a partition begins another pack where one would exceed so many bytes of records."""

    def write(batches):
        records, held = [], 0

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([codec.write_pack(records, magic)], pa.binary()), pa.array([len(records)], pa.int64())], names=["content", "objects"])

        for b in batches:
            for some in codec.together(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), lambda x: len(x[1]), TOGETHER):
                for r in codec.encode_records(some):
                    if most is not None and records and held + len(r) > most:
                        yield pack()
                        records, held = [], 0
                    records.append(r)
                    held += len(r)
        yield pack()

    return objects.select("key", "payload").mapInArrow(write, "content binary, objects long")


def write_files(objects: DataFrame, folder: str, magic: bytes = codec.PACK_MAGIC, most: int | None = None) -> int:
    """Packs as files of a folder that all executors mount, written where they are made; returns how many.

    A file is named by its content and appears whole, so a task that runs twice writes the same file."""

    def save(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for content in b.column(0).to_pylist():
                path = os.path.join(folder, f"{codec.blake3(content).hex()}.pack")
                with open(f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)
            yield pa.RecordBatch.from_arrays([b.column(1)], names=["objects"])

    return packed(objects, magic, most).mapInArrow(save, "objects long").count()
