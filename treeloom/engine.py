"""The store's API: objects in segments, references, trees in and out, garbage collection.

A store is a folder of Parquet tables: records of objects, partitioned by segment, a log of references and one
of garbage cycles. Writes are atomic commits by one writer; readers see whole commits. A record holds its
payload compressed where that is smaller, with the checksum of its frame. While a cycle runs, writes note
the keys that they meet, and the cycle keeps these."""

from __future__ import annotations

import itertools
import os
import stat
import tarfile
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom import scratch
from treeloom.functions import codec, display, keys
from treeloom.operators import build, cdc, closure, dedup, listing, refs, segments, trees
from treeloom.sources import archive

RECORD = "key binary, ulen long, slen long, flags int, crc long, data binary"
OBJECTS = f"{RECORD}, pos int, off long, written_ns long, segment_id long"
CYCLES = "started_ns long, finished_ns long, scanned long, compacted long, freed_bytes long, copied_records long, copied_bytes long, marked long, error string"
LOG = "seq long, op string, name string, key binary, user string, created_ns long, signature binary, public_key binary"


class NotFound(KeyError):
    """A key, name or path that isn't there."""


class NotADirectory(ValueError):
    """A directory was asked for."""


class Incomplete(ValueError):
    """A tree lacks objects."""


@dataclass
class WriteStats:
    stored: int
    deduped: int
    bytes_stored: int


@dataclass
class Options:
    segment_size: int = 256 << 20
    sizes: cdc.Sizes = cdc.Sizes(32 << 10, 128 << 10, 256 << 10)
    item_bits: int = build.ITEM_BITS
    inline_xattrs: int = build.INLINE_XATTRS
    #: Free bytes below which a cycle takes the stricter line; 0 asks for a twentieth of the file system.
    min_free: int = 0


def chunk_sizes(least: int | None, normal: int | None, most: int | None) -> cdc.Sizes | None:
    """All three sizes or none."""
    given = [x is not None for x in (least, normal, most)]
    if any(given) and not all(given):
        raise ValueError("give all three chunk sizes or none")
    return cdc.Sizes(least, normal, most) if all(given) else None


def edges_of(objects: DataFrame) -> DataFrame:
    """parent, ord, child, role; payloads of leaves are not read."""

    def read(batches):
        for b in batches:
            rows = [(k, i, c, role) for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (role, c) in enumerate(codec.children(k, data))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["parent", "ord", "child", "role"])

    inner = objects.where(keys.type_of(F.col("key")).between(1, 3)).select("key", "payload")
    return inner.mapInArrow(read, "parent binary, ord int, child binary, role string")


def encoded(objects: DataFrame) -> DataFrame:
    """Records of objects (key, payload), a batch at once."""

    def read(batches):
        for b in batches:
            frames = [codec.framed(x) for x in codec.encode_records(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))]
            rows = [(r.key, r.ulen, r.slen, r.flags, int.from_bytes(r.data[42:46], "big"), r.data[codec.RECORD_HEADER :]) for r in frames]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    return objects.select("key", "payload").mapInArrow(read, RECORD)


def decoded(records: DataFrame) -> DataFrame:
    """key and payload of records."""

    def read(batches):
        for b in batches:
            payloads = [codec.unpacked(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(payloads, pa.binary())], names=["key", "payload"])

    return records.select("key", "flags", "ulen", "data").mapInArrow(read, "key binary, payload binary")


def frame(r) -> bytes:
    """A stored row as the record that it holds."""
    return bytes([codec.TAG_RECORD]) + bytes(r["key"]) + bytes([r["flags"]]) + b"".join(int(r[c]).to_bytes(4, "big") for c in ("ulen", "slen", "crc")) + bytes(r["data"])


def faults(objects: DataFrame) -> DataFrame:
    """key and why of objects (key, payload) that don't fit their key, hashed a batch at once."""

    def read(batches):
        for b in batches:
            ks = b.column(0).to_pylist()
            bad = [(k, why) for k, why in zip(ks, codec.verify_many(list(zip(ks, b.column(1).to_pylist(), strict=True))), strict=True) if why]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in bad], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "why"])

    return objects.select("key", "payload").mapInArrow(read, "key binary, why string")


def broken(records: DataFrame) -> DataFrame:
    """key and why of stored records whose frame, checksum, compression or hash is wrong."""

    def read(batches):
        for b in batches:
            found, sound = [], []
            rows = b.to_pylist()
            sums = codec.crc32c_many([(x := frame(r))[:42] + bytes(4) + x[46:] for r in rows])
            for r, crc in zip(rows, sums, strict=True):
                try:
                    codec.framed(frame(r))
                    codec.check_key(r["key"])
                    if crc != r["crc"]:
                        raise codec.Malformed("record checksum")
                    sound.append((r["key"], codec.unpacked(r["flags"], r["ulen"], r["data"])))
                except codec.Malformed as e:
                    found.append((r["key"], str(e)))
            found += [(k, why) for (k, _), why in zip(sound, codec.verify_many(sound), strict=True) if why]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "why"])

    return records.select(*[c.split()[0] for c in RECORD.split(", ")]).mapInArrow(read, "key binary, why string")


class Engine:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()

    # --- objects ---------------------------------------------------------------------------

    def records(self) -> DataFrame:
        at = f"{self.path}/objects"
        if not scratch.exists(self.spark, at):
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).parquet(at)

    def objects(self, which: Column | None = None) -> DataFrame:
        """key and payload; `which` is a condition on keys, met before payloads are read."""
        records = self.records()
        return decoded(records if which is None else records.where(which))

    def index(self) -> DataFrame:
        return self.records().drop("data")

    def put(self, objects: DataFrame, verify: bool = False) -> WriteStats:
        """Store what isn't stored; objects: key, payload. In a batch the first of a key wins."""
        objects = objects.select("key", "payload")
        if verify and (bad := faults(objects).head()):
            raise codec.Malformed(f"{bytes(bad['key']).hex()}: {bad['why']}")
        self.observe(objects)
        counted = dedup.write_stats(objects.select("key", F.octet_length("payload").cast("long").alias("ulen")), self.index()).collect()[0]
        stats = WriteStats(counted["stored"], counted["deduped"], counted["bytes_stored"])
        if stats.stored:
            self._append(encoded(dedup.fresh(objects, self.index())))
        return stats

    def put_records(self, records: DataFrame) -> WriteStats:
        """Store records as they are framed (column record); one that is malformed refuses all."""

        def read(batches):
            for b in batches:
                rs = codec.checked([codec.framed(x) for x in b.column(0).to_pylist()])
                why = codec.verify_many([(r.key, codec.payload(r)) for r in rs])
                if bad := next((f"{r.key.hex()}: {w}" for r, w in zip(rs, why, strict=True) if w), None):
                    raise codec.Malformed(bad)
                rows = [(r.key, r.ulen, r.slen, r.flags, int.from_bytes(r.data[42:46], "big"), r.data[codec.RECORD_HEADER :]) for r in rs]
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

        s = scratch.Scratch(self.spark, "records")
        rows = s.save(records.select("record").mapInArrow(read, RECORD), "records")
        self.observe(rows)
        counted = dedup.write_stats(rows.select("key", "ulen"), self.index()).collect()[0]
        if counted["stored"]:
            self._append(dedup.fresh(rows, self.index()))
        s.drop(rows)
        return WriteStats(counted["stored"], counted["deduped"], counted["bytes_stored"])

    def _append(self, records: DataFrame) -> None:
        """Records in the order of their keys behind the active segment; sizes alone go through the fold."""
        s = scratch.Scratch(self.spark, "append")
        fresh = s.save(records.select(*[c.split()[0] for c in RECORD.split(", ")]), "fresh")
        numbered = fresh.select("key", "slen").sort("key").withColumn("n", F.monotonically_increasing_id())
        numbered = s.save(numbered, "numbered")
        last = self.index().agg(F.max("segment_id").alias("s")).collect()[0]["s"]
        first = 0 if last is None else last + 1  # a commit never extends a written segment
        placed = segments.assign(numbered, "n", "slen", self.options.segment_size, first)
        rows = fresh.join(placed.select("key", "segment_id", "pos", "off"), "key")
        out = rows.withColumn("written_ns", F.lit(time.time_ns())).select(*[c.split()[0] for c in OBJECTS.split(", ")])
        out.repartition("segment_id").sortWithinPartitions("segment_id", "pos").write.mode("append").option("parquet.bloom.filter.enabled#key", "true").partitionBy("segment_id").parquet(f"{self.path}/objects")
        s.drop(fresh, numbered)

    def _newest(self, key: bytes):
        rows = self.records().where(F.col("key") == F.lit(key)).orderBy(F.desc("segment_id"), F.desc("off")).limit(1).collect()
        if not rows:
            raise NotFound(key.hex())
        return rows[0]

    def get(self, key: bytes) -> bytes:
        r = self._newest(key)
        return codec.unpacked(r["flags"], r["ulen"], bytes(r["data"]))

    def get_many(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        """Payloads of many keys by one job; keys that aren't stored are left out."""
        asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(wanted)], "key binary")
        return {bytes(r["key"]): bytes(r["payload"]) for r in decoded(self.records().join(F.broadcast(asked), "key", "left_semi")).collect()}

    def get_record(self, key: bytes) -> bytes:
        """The newest record of a key, framed and as compressed as it is stored."""
        return frame(self._newest(key))

    def record_at(self, segment: int, off: int) -> bytes:
        """The record at a place that index() or sort_by_location() told."""
        rows = self.records().where((F.col("segment_id") == segment) & (F.col("off") == off)).limit(1).collect()
        if not rows:
            raise NotFound(f"{segment}:{off}")
        return frame(rows[0])

    def has(self, key: bytes) -> bool:
        return not self.index().where(F.col("key") == F.lit(key)).isEmpty()

    def missing(self, wanted: list[bytes]) -> list[bytes]:
        """Those that aren't stored, in order and as often as asked for."""
        asked = self.spark.createDataFrame(list(enumerate(wanted)), "ord long, key binary")
        return [bytes(r["key"]) for r in dedup.missing(asked, self.index()).collect()]

    def sort_by_location(self, wanted: list[bytes]) -> list[bytes]:
        asked = self.spark.createDataFrame(list(enumerate(wanted)), "ord long, key binary")
        return [bytes(r["key"]) for r in segments.by_location(asked, self.index()).collect()]

    def stored_size(self, key: bytes) -> int | None:
        row = self.index().where(F.col("key") == F.lit(key)).select("slen").head()
        return row and row[0]

    def verify(self) -> DataFrame:
        """key and why of every record whose frame, checksum, compression, hash or place is wrong."""
        behind = Window.partitionBy("segment_id").orderBy("pos")
        off = segments.SEGMENT_HEADER + F.coalesce(F.sum(segments.cost(F.col("slen"))).over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = self.index().withColumns({"_off": off, "_pos": F.row_number().over(behind) - 1})
        return broken(self.records()).unionByName(placed.where("off != _off or pos != _pos").select("key", F.lit("place").alias("why")))

    def edges(self) -> DataFrame:
        return edges_of(self.objects(keys.type_of(F.col("key")).between(1, 3)))

    def reachable(self, root: bytes) -> DataFrame:
        return closure.reachable(self.spark, self.edges(), self.spark.createDataFrame([(root,)], "key binary"))

    def check_complete(self, root: bytes) -> None:
        lacking = closure.incomplete(self.spark, self.edges(), self.spark.createDataFrame([(root,)], "key binary"), self.index())
        if row := lacking.head():
            raise Incomplete(bytes(row["key"]).hex())

    def wipe(self, objects: bool = True, references: bool = True) -> None:
        for what, name in ((objects, "objects"), (objects, "cycles"), (objects, "grey"), (references, "refs")):
            if what and scratch.exists(self.spark, f"{self.path}/{name}"):
                scratch.remove(self.spark, f"{self.path}/{name}")

    # --- references ------------------------------------------------------------------------

    def ref_log(self) -> DataFrame:
        at = f"{self.path}/refs"
        return self.spark.read.schema(LOG).parquet(at) if scratch.exists(self.spark, at) else self.spark.createDataFrame([], LOG)

    def refs(self) -> DataFrame:
        return refs.current(self.ref_log(), ["seq"])

    def _log(self, op: str, r: codec.Reference) -> None:
        row = [(time.time_ns(), op, r.name, r.key, r.user, r.created_at_ns, r.signature, r.public_key)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/refs")

    def ref_set(self, name: str, key: bytes, user: str = "", now_ns: int | None = None) -> None:
        """Point a name at a tree that is complete."""
        r = codec.Reference(name, key, user, time.time_ns() if now_ns is None else now_ns)
        r.check()
        self.check_complete(key)
        if self.capturing():
            self.observe(self.reachable(key))
        self._log("put", r)

    def ref_get(self, name: str) -> codec.Reference:
        row = self.refs().where(F.col("name") == name).head()
        if row is None:
            raise NotFound(name)
        return codec.Reference(name, bytes(row["key"]), row["user"], row["created_ns"], bytes(row["signature"]), bytes(row["public_key"]))

    def ref_rm(self, name: str) -> None:
        self._log("del", self.ref_get(name))

    def ref_list(self) -> list[str]:
        r = self.refs().select("name", keys.text(F.col("key")).alias("key"), F.timestamp_seconds(F.floor(F.col("created_ns") / 1_000_000_000)).alias("created"), "user")
        return [x["line"] for x in refs.list_lines(r).collect()]

    # --- trees -----------------------------------------------------------------------------

    def ingest(self, path: str, ref: str | None = None, user: str = "", use_ignore: bool = True, progress: Callable[[dict], None] | None = None) -> tuple[bytes, WriteStats]:
        """Store a file or a tree; returns its root. progress gets an event of each pass."""
        if ref is not None:
            codec.check_name(ref, False)
        o = self.options
        root, objects = build.distributed(self.spark, path, o.sizes, o.item_bits, o.inline_xattrs, use_ignore, progress)
        stats = self.put(objects)
        if progress:
            progress({"event": "stored", "stored": stats.stored, "deduped": stats.deduped, "bytes_stored": stats.bytes_stored})
        if ref is not None:
            self.ref_set(ref, root, user)
        return root, stats

    def _entries(self, root: bytes) -> DataFrame:
        """ord and the entries of a directory, of which each must come after the one before."""
        if codec.key_type(root) not in (codec.DIR_LEAF, codec.DIR_NODE):
            raise NotADirectory(root.hex())
        at = self.spark.createDataFrame([(b"", root)], "at binary, key binary")
        try:
            found = trees.entries(self.spark, self.objects(keys.type_of(F.col("key")).between(2, 3)), at, scratch.Scratch(self.spark, "entries"))
        except trees.Missing as e:
            raise NotFound(*e.args) from e
        if not listing.out_of_order(found.withColumnRenamed("at", "dir")).isEmpty():
            raise codec.Malformed("entries out of order")
        return found

    def collect_entries(self, root: bytes) -> list[codec.Entry]:
        """A directory's entries in order of their names; one job a level of its index."""
        return [trees.entry_of(r) for r in self._entries(root).orderBy("ord").collect()]

    def list_entries(self, root: bytes, after: bytes = b"", limit: int = 4096) -> tuple[list[codec.Entry], bool]:
        """A page of a directory and whether more follows; subtrees that end before it aren't read."""
        if limit <= 0:
            raise ValueError("a page's limit must be positive")
        if codec.key_type(root) not in (codec.DIR_LEAF, codec.DIR_NODE):
            raise NotADirectory(root.hex())
        out: list[codec.Entry] = []
        todo = [root]
        while todo and len(out) <= limit:
            k = todo.pop()
            data = self.get(k)
            if codec.key_type(k) == codec.DIR_NODE:
                todo.extend(c for sep, c in reversed(codec.loads(data)) if sep > after)
            else:
                out.extend(e for e in codec.entries(data) if e.name > after)
        return out[:limit], len(out) > limit

    def lookup(self, root: bytes, name: bytes) -> codec.Entry:
        """An entry by its name: the first separator that isn't below it leads down."""
        if codec.key_type(root) not in (codec.DIR_LEAF, codec.DIR_NODE):
            raise NotADirectory(root.hex())
        k = root
        while codec.key_type(k) == codec.DIR_NODE:
            k = next((c for sep, c in codec.loads(self.get(k)) if sep >= name), None)
            if k is None:
                raise NotFound(name.decode("utf-8", "replace"))
        for e in codec.entries(self.get(k)):
            if e.name == name:
                return e
        raise NotFound(name.decode("utf-8", "replace"))

    def resolve_entry(self, root: bytes, path: str) -> codec.Entry | None:
        """The entry at a path; None of the root itself."""
        parts = [p for p in path.split("/") if p not in ("", ".")]
        if ".." in parts:
            raise ValueError("a path may not lead up")
        e, k = None, root
        for i, p in enumerate(parts):
            e = self.lookup(k, p.encode("utf-8", "surrogateescape"))
            if i < len(parts) - 1:
                if stat.S_IFMT(e.mode) != stat.S_IFDIR:
                    raise NotADirectory(p)
                k = e.content
        return e

    def resolve_path(self, root: bytes, path: str) -> bytes:
        """The key of the directory at a path."""
        e = self.resolve_entry(root, path)
        if e is not None and stat.S_IFMT(e.mode) != stat.S_IFDIR:
            raise NotADirectory(path)
        return root if e is None else e.content

    def resolve_spec(self, spec: str) -> bytes:
        """The key of `KEY[/PATH]` or `ref:NAME[@PATH]`; dots are names here and files may end the path."""
        kind, name, path = (self.spark.range(1).select(listing.parse_spec(F.lit(spec)).alias("s")).collect()[0]["s"] or (None, None, None))
        if kind is None:
            raise ValueError(f"neither a key nor a reference: {spec}")
        k = self.ref_get(name).key if kind == "ref" else bytes.fromhex(name)
        codec.check_key(k)
        for p in filter(None, path.split("/")):
            e = self.lookup(k, p.encode("utf-8", "surrogateescape"))
            if not e.content:
                raise NotADirectory(p)
            k = e.content
        return k

    def ls(self, spec: str, show_keys: bool = False, now: str | None = None) -> list[str]:
        text = lambda c: F.decode(F.col(c), "UTF-8")
        key = F.col("content")
        size = display.entry_size(F.col("major"), F.col("minor"), F.when(key.isNotNull(), keys.length(key)), text("target"))
        rows = self._entries(self.resolve_spec(spec)).select(
            "ord", text("name").alias("name"), "mode", "uid", "gid", F.coalesce(text("target"), F.lit("")).alias("target"), keys.text(key).alias("key"), size.alias("size"), F.timestamp_seconds(F.floor(F.col("mtime_ns") / 1_000_000_000)).alias("mtime")
        )
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        return [r["line"] for r in listing.lines(rows, at, show_keys).orderBy("ord").select("line").collect()]

    def content(self, key: bytes) -> Iterator[bytes]:
        """A file's blobs in order; one job a level of its index, then one stream over the blobs."""
        if codec.key_type(key) not in (codec.BLOB, codec.FILE_NODE):
            raise ValueError("not a file")
        one = self.spark.createDataFrame([(b"", key)], "at binary, key binary")
        try:
            blobs = trees.contents(self.spark, self.objects(keys.type_of(F.col("key")) == keys.FILE_NODE), one)
        except trees.Missing as e:
            raise NotFound(*e.args) from e
        for r in trees.with_payload(blobs, self.objects(keys.type_of(F.col("key")) == keys.BLOB)).orderBy("ord").toLocalIterator():
            if r["payload"] is None:
                raise NotFound(bytes(r["key"]).hex())
            yield bytes(r["payload"])

    def members(self, root: bytes) -> Iterator[archive.Member]:
        """Everything below a directory in the order of a walk, from one sorted stream of entries and blobs.

        Jobs grow with the depth of the tree and its indexes alone."""
        blobs = self.objects(keys.type_of(F.col("key")) == keys.BLOB)
        try:
            found = trees.walk(self.spark, self.objects(keys.type_of(F.col("key")).between(2, 3)), root)
            files = found.where(trees.is_kind(stat.S_IFREG)).select(F.col("path").alias("at"), F.col("content").alias("key"))
            chunks = trees.contents(self.spark, self.objects(keys.type_of(F.col("key")) == keys.FILE_NODE), files)
        except trees.Missing as e:
            raise NotFound(*e.args) from e
        sets = self.objects(keys.type_of(F.col("key")) == codec.XATTR_SET).select(F.col("key").alias("xattrs_key"), F.col("payload").alias("xattrs_set"))
        heads = found.drop("at", "ord").join(sets, "xattrs_key", "left").withColumnRenamed("path", "at").withColumn("ord", F.lit(b""))
        rows = heads.unionByName(trees.with_payload(chunks, blobs).withColumn("ord", F.concat(F.lit(b"+"), "ord")), allowMissingColumns=True)

        def place(batches):  # parts of a path compare one by one: a slash comes before all that a name can hold
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.replace(b"/", b"\0") for x in b.column(b.schema.get_field_index("at")).to_pylist()], pa.binary())], names=[*b.schema.names, "place"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        ordered = rows.mapInArrow(place, f"{kinds}, place binary").orderBy("place", "ord")
        for path, group in itertools.groupby(ordered.toLocalIterator(), key=lambda r: bytes(r["at"])):
            head = next(group)
            e = trees.entry_of(head)
            if e.xattrs_key:
                if head["xattrs_set"] is None:
                    raise NotFound(e.xattrs_key.hex())
                e.xattrs = bytes(head["xattrs_set"])

            def pieces(group=group):
                for r in group:
                    if r["payload"] is None:
                        raise NotFound(bytes(r["key"]).hex())
                    yield bytes(r["payload"])

            yield os.fsdecode(path), e, pieces if stat.S_IFMT(e.mode) == stat.S_IFREG else None

    def _directory(self, spec: str) -> bytes:
        root = self.resolve_spec(spec)
        if codec.key_type(root) not in (codec.DIR_LEAF, codec.DIR_NODE):
            raise NotADirectory(spec)
        return root

    def export(self, spec: str, file: str) -> None:
        """A tar archive of a directory."""
        root = self._directory(spec)
        with open(file, "wb") as f:
            archive.write(f, self.members(root))

    def restore(self, spec: str, folder: str) -> None:
        """Write a directory's tree below a folder; the archive goes through a pipe and is stored nowhere."""
        root = self._directory(spec)
        reading, writing = os.pipe()
        failed: list[BaseException] = []

        def send():
            with open(writing, "wb") as f:
                try:
                    archive.write(f, self.members(root))
                except BaseException as e:  # noqa: BLE001  told to the reader's side
                    failed.append(e)

        sender = threading.Thread(target=send)
        sender.start()
        try:
            with open(reading, "rb") as f:
                archive.extract(f, folder)
        except tarfile.ReadError as e:
            failed.append(e)
        finally:
            sender.join()
        if failed:
            raise failed[0]

    # --- garbage ---------------------------------------------------------------------------

    def segment_table(self) -> DataFrame:
        """All written segments are sealed; a commit opens new ones."""
        i = self.index()
        bytes_of = (F.sum(segments.cost(F.col("slen"))) + segments.SEGMENT_HEADER).cast("long")
        return i.groupBy("segment_id").agg(F.lit(True).alias("sealed"), F.max("written_ns").alias("sealed_at"), bytes_of.alias("body_bytes"), F.count(F.lit(1)).alias("keys"), bytes_of.alias("file_bytes"))

    def live(self, grey: DataFrame | None = None) -> DataFrame:
        """Keys that references reach, and those that a write has seen meanwhile."""
        roots = self.refs().select("key").distinct()
        marked = closure.reachable(self.spark, self.edges(), roots).select("key")
        gone = marked.join(self.index().select("key"), "key", "left_anti").head()
        if gone:
            raise Incomplete(bytes(gone["key"]).hex())
        return marked if grey is None else marked.unionByName(grey.select("key")).distinct()

    def capturing(self) -> bool:
        return scratch.exists(self.spark, f"{self.path}/grey")

    def observe(self, keys_met: DataFrame) -> None:
        """While a cycle runs: note keys that a write has met, stored or not, as live for it."""
        if self.capturing():
            keys_met.select("key").distinct().write.mode("append").parquet(f"{self.path}/grey/keys")

    def begin_barrier(self) -> None:
        """From now on writes note the keys that they meet."""
        self.spark.createDataFrame([], "key binary").write.mode("append").parquet(f"{self.path}/grey/keys")

    def end_barrier(self) -> None:
        if self.capturing():
            scratch.remove(self.spark, f"{self.path}/grey")

    def grey(self) -> DataFrame:
        """The keys that writes have met since the barrier began."""
        if not self.capturing():
            return self.spark.createDataFrame([], "key binary")
        return self.spark.read.schema("key binary").parquet(f"{self.path}/grey/keys").distinct()

    def gc_status(self, grace_ns: int = 0) -> DataFrame:
        """By sealed segment: bytes, keys, live ones, the part that is garbage, and whether it was sealed before the grace."""
        table = self.segment_table()
        eligible = table.select("segment_id", (F.col("sealed_at") < F.lit(time.time_ns() - grace_ns)).alias("eligible"))
        return segments.status(segments.liveness(self.index(), self.live()), table).join(eligible, "segment_id")

    def gc_report(self, grace_ns: int = 0) -> dict:
        """Totals over all sealed segments, how many references and live objects there are, and the last cycle."""
        s = scratch.Scratch(self.spark, "report")
        live = s.save(self.live(), "live")
        total = segments.liveness(self.index(), live).agg(F.coalesce(F.sum("live_bytes"), F.lit(0)).alias("live_bytes"), F.coalesce(F.sum("dead_bytes"), F.lit(0)).alias("garbage_bytes"), F.count(F.lit(1)).alias("segments")).collect()[0].asDict()
        horizon = F.lit(time.time_ns() - grace_ns)
        out = total | {"eligible": self.segment_table().where(F.col("sealed_at") < horizon).count(), "refs": self.refs().count(), "marked": live.count(), "last": self.last_cycle()}
        s.drop(live)
        return out

    def last_cycle(self) -> dict | None:
        at = f"{self.path}/cycles"
        if not scratch.exists(self.spark, at):
            return None
        rows = self.spark.read.schema(CYCLES).parquet(at).orderBy(F.desc("started_ns")).limit(1).collect()
        return rows[0].asDict() if rows else None

    def gc_why(self, key: bytes) -> list[str]:
        found = closure.why(self.spark, self.edges(), self.refs().select("name", "key"), self.spark.createDataFrame([(key,)], "key binary"))
        return [r["name"] for r in found.collect()]

    def gc_run(self, garbage: float = -1, grace_ns: int = 0, grey: DataFrame | None = None, low_space: bool | None = None) -> dict:
        """Rewrite segments whose dead part reaches the line; new segments are written before old ones go.

        The policy's line (garbage below 0) is stricter where space is low, which is looked up unless it is told.

        Keys that writes meet meanwhile are kept, and so are those of `grey`. A cycle that another one overlaps is refused."""
        if self.capturing():
            raise RuntimeError("another cycle runs, or one was cut off: end_barrier() ends it")
        started, error, stats = time.time_ns(), None, {}
        self.begin_barrier()
        try:
            stats = self._cycle(garbage, grace_ns, grey, self.low_space() if low_space is None else low_space)
        except Exception as e:
            error = str(e)[:1000]
            raise
        finally:
            self.end_barrier()
            row = [(started, time.time_ns(), *(stats.get(c) for c in ("scanned", "compacted", "freed_bytes", "copied_records", "copied_bytes", "marked")), error)]
            self.spark.createDataFrame(row, CYCLES).coalesce(1).write.mode("append").parquet(f"{self.path}/cycles")
        return stats

    def _cycle(self, garbage: float, grace_ns: int, grey: DataFrame | None, low_space: bool) -> dict:
        s = scratch.Scratch(self.spark, "gc")
        index, live = s.save(self.index(), "index"), s.save(self.live(grey), "live")
        table = self.segment_table()
        horizon = F.lit(time.time_ns() - grace_ns + (1 if grace_ns == 0 else 0))
        chosen = s.save(segments.victims(segments.liveness(index, live), table, segments.threshold(garbage, low_space=low_space), horizon).select("segment_id"), "victims")
        moved = None
        while True:  # what writes meet while records are copied is copied too, until there is nothing more
            kept = live.select("key").unionByName(self.grey()).distinct()
            wanted = segments.copy_set(index, chosen, kept)
            wanted = s.save(wanted if moved is None else wanted.join(moved.select("key"), "key", "left_anti"), "copied")
            if wanted.isEmpty():
                break
            self._append(self.records().join(wanted.select("key", "segment_id", "off"), ["key", "segment_id", "off"], "left_semi"))
            moved = wanted if moved is None else moved.unionByName(wanted)
        moved = wanted if moved is None else moved
        stats = segments.compact_stats(index, table.where(F.col("sealed_at") < horizon), chosen, moved).collect()[0].asDict() | {"marked": live.count()}
        for r in chosen.toLocalIterator():
            self.remove_segment(r["segment_id"])
        return stats

    def remove_segment(self, segment: int) -> None:
        """Drop a sealed segment with all its records; readers that have listed it before fail and read again."""
        path = f"{self.path}/objects/segment_id={int(segment)}"
        if not scratch.exists(self.spark, path):
            raise NotFound(str(segment))
        scratch.remove(self.spark, path)

    def low_space(self) -> bool:
        """Whether the store's file system has less free than it should."""
        free, whole = scratch.space(self.spark, self.path)
        return free < (self.options.min_free or whole // 20)
