"""Trees from files: content-defined runs of children, level by level.

Runs: a run of items ends when it has MaxRun of them, or has MinRun and the low bits of the item's
digest are zero. A level's runs become nodes of the next level until one is left; a single open item at
the end of a level moves up as it is. Directories are built from the deepest level up, all of a level at
once: their entries are dealt into runs as one order, and a run, of a bounded size, is what a task holds.
Files are built by the tasks that read them."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import codec
from treeloom.operators import cdc
from treeloom.operators.runs import number
from treeloom.scratch import Scratch

ITEM_BITS, INLINE_XATTRS = 7, 256
OBJECTS = "key binary, payload binary"


class Runs:
    """Where runs of items end."""

    def __init__(self, bits: int = ITEM_BITS, digest: Callable[[bytes], bytes] = codec.blake3):
        average = 1 << bits
        self.least, self.most, self.mask, self.digest = max(average // 4, 2), average * 4, average - 1, digest

    def ends(self, item: bytes, run: int) -> bool:
        if run >= self.most:
            return True
        if run < self.least:
            return False
        return int.from_bytes(self.digest(item)[:8], "little") & self.mask == 0

    def split(self, items: list, encode: Callable) -> tuple[list[list], list]:
        """(closed runs, what is left open)."""
        closed, run = [], []
        for x in items:
            run.append(x)
            if self.ends(encode(x), len(run)):
                closed.append(run)
                run = []
        return closed, run


def index(items: list[tuple[bytes, bytes]], runs: Runs, is_dir: bool, emit: Callable) -> bytes:
    """The root over children (separator, key); emit gets each new object, children before parents."""
    if not items:
        raise ValueError("an index needs a child")
    encode = (lambda x: codec.dumps([x[0], x[1]])) if is_dir else (lambda x: x[1])
    level = items
    while True:
        closed, rest = runs.split(level, encode)
        if not closed and len(rest) == 1:
            return rest[0][1]
        up = []
        for run in closed + ([rest] if len(rest) > 1 else []):
            k, data = codec.dir_node(run, runs.digest) if is_dir else codec.file_node([c for _, c in run], runs.digest)
            emit(k, data)
            up.append((run[-1][0], k))
        level = up + (rest if len(rest) == 1 else [])
        if len(level) == 1:
            return level[0][1]


def file_objects(data: bytes, sizes: cdc.Sizes, runs: Runs) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """(key, objects) of a file's content; an empty file is one empty blob."""
    out = [codec.blob(c, runs.digest) for c in cdc.chunks(data, sizes) or [b""]]
    root = index([(b"", k) for k, _ in out], runs, False, lambda k, d: out.append((k, d)))
    return root, out


def files_objects(contents: list[bytes], sizes: cdc.Sizes, bits: int) -> list[tuple[bytes, list[tuple[bytes, bytes]]]]:
    """file_objects() of each content by BLAKE3; what stands on the same level of all files is hashed together."""
    runs = Runs(bits)
    parts = [cdc.chunks(x, sizes) or [b""] for x in contents]
    made = iter(codec.make_keys([(codec.BLOB, len(c), c) for p in parts for c in p]))
    out = [[(next(made), c) for c in p] for p in parts]
    levels = [[k for k, _ in o] for o in out]
    while todo := [i for i, level in enumerate(levels) if len(level) > 1]:
        keys = list(dict.fromkeys(k for i in todo for k in levels[i]))
        runs.digest = dict(zip(keys, codec.blake3_many(keys), strict=True)).__getitem__
        cut = []
        for i in todo:
            closed, rest = runs.split(levels[i], lambda k: k)
            cut.append((closed + ([rest] if len(rest) > 1 else []), rest if len(rest) == 1 else []))
        nodes = [(codec.FILE_NODE, sum(map(codec.key_length, run)), codec.dumps(run)) for closed, _ in cut for run in closed]
        made = iter(zip(codec.make_keys(nodes), (data for *_, data in nodes), strict=True))
        for i, (closed, rest) in zip(todo, cut, strict=True):
            up = [next(made) for _ in closed]
            out[i] += up
            levels[i] = [k for k, _ in up] + rest
    return [(level[0], o) for level, o in zip(levels, out, strict=True)]


def dir_objects(entries: Iterable[codec.Entry], runs: Runs) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """(key, objects) of a directory, whose entries are in order of their names."""
    closed, rest = runs.split(list(entries), lambda e: e.encoded())
    leaves, out = [], []
    for run in closed + ([rest] if rest or not closed else []):
        k, data = codec.dir_leaf(run, runs.digest)
        out.append((k, data))
        leaves.append((run[-1].name if run else b"", k))
    return index(leaves, runs, True, lambda k, d: out.append((k, d))), out


def entry(r: dict, content: bytes | None, inline: int, digest=codec.blake3) -> tuple[codec.Entry, list[tuple[bytes, bytes]]]:
    """An entry of a listed row with its one payload, and the object of attributes that don't fit inline."""
    kind, extra = stat.S_IFMT(r["mode"]), []
    e = codec.Entry(r["name"], r["mode"], r["uid"], r["gid"], r["mtime_ns"])
    if kind in (stat.S_IFREG, stat.S_IFDIR):
        e.content = content
    elif kind == stat.S_IFLNK:
        e.target = r["link_target"]
    elif kind in (stat.S_IFCHR, stat.S_IFBLK):
        e.rdev = (r["rdev"]["major"], r["rdev"]["minor"])
    if r["xattrs"] and kind != stat.S_IFLNK:
        raw = codec.encode_xattrs(dict(r["xattrs"]))
        if len(raw) <= inline:
            e.xattrs = raw
        else:
            e.xattrs_key, data = codec.xattr_set(dict(r["xattrs"]), digest)
            extra.append((e.xattrs_key, data))
    return e, extra


def sequential(root: str, sizes: cdc.Sizes, bits: int = ITEM_BITS, inline: int = INLINE_XATTRS, use_ignore: bool = True) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """The same tree by plain recursion in one process: what the distributed build must equal."""
    from treeloom.sources import filesystem as fs

    runs, out = Runs(bits), []

    def build(path: str) -> bytes:
        made = []
        for r in fs.list_dir(root, path, use_ignore):
            content = None
            if r["is_dir"]:
                content = build(r["path"])
            elif stat.S_ISREG(r["mode"]):
                with open(os.path.join(root, r["path"]), "rb") as f:
                    content, objects = file_objects(f.read(), sizes, runs)
                out.extend(objects)
            e, extra = entry(r, content, inline)
            out.extend(extra)
            made.append(e)
        k, objects = dir_objects(made, runs)
        out.extend(objects)
        return k

    if fs.admit(root):
        return build(""), out
    with open(root, "rb") as f:
        k, objects = file_objects(f.read(), sizes, runs)
    return k, objects


def _objects_of_files(files: DataFrame, root: str, sizes: cdc.Sizes, bits: int) -> DataFrame:
    """path, root (of the file) and every object of it."""

    def read(batches):
        def content(path):
            with open(os.path.join(root, path) if path else root, "rb") as f:
                return path, f.read()

        for b in batches:
            for some in codec.together(map(content, b.column(0).to_pylist()), lambda x: len(x[1])):
                rows = [(path, k, *o) for (path, _), (k, objects) in zip(some, files_objects([x for _, x in some], sizes, bits), strict=True) for o in objects]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.binary()] * 3), strict=True)], names=["path", "root", "key", "payload"])

    return files.select("path").mapInArrow(read, f"path string, root binary, {OBJECTS}")


def _entries(inside: DataFrame, inline: int) -> DataFrame:
    """dir, name and item (the encoded entry) of listed rows, and the object of attributes that don't fit inline."""

    def read(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                r["xattrs"] = dict(r["xattrs"] or {})
                e, extra = entry(r, r["content"], inline)
                out.append((r["parent"], e.name, e.encoded(), *(extra[0] if extra else (None, None))))
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["dir", "name", "item", "extra_key", "extra"])

    return inside.mapInArrow(read, "dir string, name binary, item binary, extra_key binary, extra binary")


def _closed(runs: list[list[dict]], leaf: bool) -> list[tuple[bytes, bytes]]:
    """(key, payload) of the leaf or index node over each run, hashed together."""
    parts = []
    for r in runs:
        if leaf:
            data = codec.head(4, len(r)) + b"".join(x["item"] for x in r)
            parts.append((codec.DIR_LEAF, len(data) + codec.below(data), data))
        else:
            data = codec.dumps([[x["name"], x["key"]] for x in r])
            parts.append((codec.DIR_NODE, len(data) + sum(codec.key_length(x["key"]) for x in r), data))
    return list(zip(codec.make_keys(parts), (data for *_, data in parts), strict=True))


def directories(spark: SparkSession, dirs: DataFrame, items: DataFrame, bits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(dir and key of each directory, its objects); dirs: dir; items: dir, name and item (an encoded entry).

    Level by level, all directories at once: items are dealt into runs, each run becomes an object, and these
    are the items of the next level, until a directory has one."""
    mask = (1 << bits) - 1
    empty = codec.dir_leaf([])
    lone = dirs.select("dir").join(items.select("dir").distinct(), "dir", "left_anti")
    roots = scratch.save(lone.select("dir", F.lit(empty[0]).alias("key")), "roots")
    objects = roots.limit(1).select("key", F.lit(empty[1]).alias("payload"))
    level, leaf = items.select("dir", "name", "item", F.lit(None).cast("binary").alias("key")), True
    while True:

        def hit(batches, leaf=leaf):
            for b in batches:
                whole = b.column(2).to_pylist() if leaf else [codec.dumps([n, k]) for n, k in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
                hits = [int.from_bytes(h[:8], "little") & mask == 0 for h in codec.blake3_many(whole)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.bool_())], names=[*b.schema.names, "hit"])

        def close(batches, leaf=leaf):
            for b in batches:
                dirs, runs = b.column(0).to_pylist(), b.column(1).to_pylist()
                made = iter(_closed([r for r in runs if leaf or len(r) > 1], leaf))
                # an item that is alone at the level's end is open: it moves up as it is
                out = [(d, r[-1]["name"], *(next(made) if leaf or len(r) > 1 else (r[0]["key"], None))) for d, r in zip(dirs, runs, strict=True)]
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["dir", "name", "key", "payload"])

        found = level.select("dir", "name", "item", "key").mapInArrow(hit, "dir string, name binary, item binary, key binary, hit boolean")
        numbered = number(found, "dir", "name", "hit", bits, ["item", "key"])
        grouped = numbered.groupBy("dir", "run").agg(F.array_sort(F.collect_list(F.struct("name", "item", "key"))).alias("listed")).select("dir", "listed")
        made = scratch.save(grouped.mapInArrow(close, "dir string, name binary, key binary, payload binary"), "level")
        objects = objects.unionByName(made.where("payload is not null").select("key", "payload"))
        left = made.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("one"))
        left = scratch.save(left, "left")
        roots = roots.unionByName(left.where("n = 1").select("dir", F.col("one").alias("key")))
        if left.where("n > 1").isEmpty():
            return roots, objects
        level = made.join(left.where("n > 1").select("dir"), "dir", "left_semi").select("dir", "name", F.lit(None).cast("binary").alias("item"), "key")
        leaf = False


def distributed(spark: SparkSession, root: str, sizes: cdc.Sizes, bits: int = ITEM_BITS, inline: int = INLINE_XATTRS, use_ignore: bool = True, progress: Callable[[dict], None] | None = None) -> tuple[bytes, DataFrame]:
    """(root key, objects) of a tree: one pass over files, then one over each level of directories.

    What a pass has made is written, so a lost executor costs no second reading. progress gets an event
    before and behind the pass over files: how many there are and have been chunked, and their bytes."""
    from treeloom.sources import filesystem as fs

    if not fs.admit(root):
        k, objects = sequential(root, sizes, bits, inline, use_ignore)
        return k, spark.createDataFrame(objects, OBJECTS)
    rows = fs.tree(spark, root, use_ignore).withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))
    scratch = Scratch(spark, "build")
    rows = scratch.save(rows, "rows")
    regular = F.col("mode").bitwiseAND(F.lit(0o170000)) == stat.S_IFREG
    if progress:
        progress({"event": "scanned"} | fs.totals(rows).collect()[0].asDict())
    seen = Observation()
    todo = rows.where(regular).observe(seen, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    files = scratch.save(_objects_of_files(todo, root, sizes, bits), "files")
    if progress:
        progress({"event": "chunked"} | seen.get)
    contents = files.select("path", F.col("root").alias("content")).distinct()
    objects = files.select("key", "payload")
    deepest = rows.agg(F.max("depth")).collect()[0][0]

    for depth in range(deepest, -1, -1):
        dirs = rows.where((F.col("depth") == depth) & F.col("is_dir")).select(F.col("path").alias("dir"))
        if dirs.isEmpty():
            continue
        inside = rows.where(F.col("depth") == depth + 1).join(contents, "path", "left").drop("path", "depth", "is_dir", "size")
        made = scratch.save(_entries(inside, inline), "entries")
        roots, nodes = directories(spark, dirs, made, bits, scratch)
        contents = contents.unionByName(roots.select(F.col("dir").alias("path"), F.col("key").alias("content")))
        extra = made.where("extra_key is not null").select(F.col("extra_key").alias("key"), F.col("extra").alias("payload"))
        objects = objects.unionByName(nodes).unionByName(extra)
    top = contents.where(F.col("path") == "").select("content").collect()[0][0]
    return bytes(top), objects
