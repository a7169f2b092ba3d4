"""The virtual store over the given tables: documents as files, their lines as chunks.

A document is the file /source/lang/<doc_id>. Keys use SHA-256, which SQL engines share; chunks are
lines, a stand-in for content-defined ones. Directories stand as one leaf each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import codec, keys
from treeloom.operators import build, cdc, segments
from treeloom.scratch import Scratch

THRESHOLD = 64 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, name, size, key (of the whole text as one blob)."""
    d = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    return d.select("doc_id", "source", "lang", F.col("doc_id").cast("string").alias("name"), size.alias("size"), keys.key(keys.BLOB, size, keys.digest(F.col("text"))).alias("key"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord (from 0), line, size and key of every line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    size = F.octet_length("line").cast("long")
    return d.select("doc_id", "ord", "line", size.alias("size"), keys.key(keys.BLOB, size, keys.digest(F.col("line"))).alias("key"))


def joined(order: str, item: Column) -> Column:
    """Items of a group as text, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda s: s["i"]), ",")


def nodes_of(lines: DataFrame) -> DataFrame:
    """doc_id and key of each document's node over its lines."""
    nodes = lines.groupBy("doc_id").agg(F.sum("size").alias("length"), joined("ord", keys.text(F.col("key"))).alias("body"))
    return nodes.select("doc_id", keys.key(keys.FILE_NODE, F.col("length"), keys.digest(F.col("body"))).alias("key"), "length")


def directory(entries: DataFrame, group: list[str], otype: int) -> DataFrame:
    """Keys of directories; entries: group, name, key, length."""
    item = F.concat("name", F.lit("="), keys.text(F.col("key")))
    d = entries.groupBy(*group).agg(F.sum("length").alias("below"), joined("name", item).alias("body"))
    length = F.octet_length("body") + F.col("below")
    return d.select(*group, keys.key(otype, length, keys.digest(F.col("body"))).alias("key"), length.cast("long").alias("length"))


class Tree:
    """Directories and edges of the virtual tree: root, sources, languages, files, lines."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        scratch = Scratch(spark, "tree")
        self.lines = scratch.save(lines(spark, sf_dir).select("doc_id", "ord", "size", "key"), "lines")
        self.nodes = scratch.save(nodes_of(self.lines), "nodes")
        where = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("doc_id").cast("string").alias("name"))
        self.files = where.join(self.nodes, "doc_id")
        self.langs = scratch.save(directory(self.files, ["source", "lang"], keys.DIR_LEAF), "langs")
        self.sources = scratch.save(directory(self.langs.withColumnRenamed("lang", "name"), ["source"], keys.DIR_LEAF), "sources")
        self.root = directory(self.sources.withColumnRenamed("source", "name").withColumn("all", F.lit(1)), ["all"], keys.DIR_LEAF).select("key", "length")

    def entries(self) -> DataFrame:
        """dir, name, key of every directory entry."""
        of = lambda df, d, on: df.join(d.select(*on, F.col("key").alias("dir")), on)
        a = of(self.files, self.langs, ["source", "lang"]).select("dir", "name", "key")
        b = of(self.langs, self.sources, ["source"]).select("dir", F.col("lang").alias("name"), "key")
        c = self.sources.crossJoin(F.broadcast(self.root.select(F.col("key").alias("dir")))).select("dir", F.col("source").alias("name"), "key")
        return a.unionByName(b).unionByName(c).distinct()

    def edges(self) -> DataFrame:
        """parent, child: each once."""
        below = self.lines.select("doc_id", F.col("key").alias("child")).join(self.nodes.select("doc_id", F.col("key").alias("parent")), "doc_id").select("parent", "child")
        return self.entries().select(F.col("dir").alias("parent"), F.col("key").alias("child")).unionByName(below).distinct()


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the distinct texts, appended in the order of their first document: segment_id, pos, off, key, slen, ord."""
    first = files(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("ord"), F.max("size").alias("slen"))
    return segments.assign(first, "ord", "slen", THRESHOLD)


def segment_table(index: DataFrame) -> DataFrame:
    """segment_id, sealed, body_bytes, keys, file_bytes; the last one is active."""
    s = index.groupBy("segment_id").agg((F.sum(segments.cost(F.col("slen"))) + segments.SEGMENT_HEADER).cast("long").alias("body_bytes"), F.count(F.lit(1)).alias("keys"))
    last = s.agg(F.max("segment_id").alias("_last"))
    return s.crossJoin(F.broadcast(last)).select("segment_id", (F.col("segment_id") < F.col("_last")).alias("sealed"), "body_bytes", "keys", (F.col("body_bytes") + F.col("keys") * 44).cast("long").alias("file_bytes"))


def ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, op, name and user from events: errors delete."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "del").otherwise("put")
    return e.select(F.col("event_id").alias("seq"), "ts", op.alias("op"), F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("user_id").cast("string").alias("user"), keys.key(keys.BLOB, F.col("event_id"), keys.digest(F.col("event_id").cast("string"))).alias("key"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys held by the references: documents of an even id."""
    return files(spark, sf_dir).where(F.col("doc_id") % 2 == 0).select("key").distinct()


class Built:
    """The same tree as the engine stores it: files chunked, directories in leaves and index nodes, keys by BLAKE3."""

    BITS, SIZES = 3, cdc.Sizes(256, 1024, 4096)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.scratch = spark, Scratch(spark, "built")
        self.documents = table(spark, sf_dir, "documents")

    def contents(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id and root of each document's text, all objects of them)."""

        bits, sizes = self.BITS, self.SIZES

        def read(batches):
            for b in batches:
                texts = ((doc, (t or "").encode()) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                for some in codec.together(texts, lambda x: len(x[1])):
                    rows = [(doc, k, *o) for (doc, _), (k, objects) in zip(some, build.files_objects([t for _, t in some], sizes, bits), strict=True) for o in objects]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["doc_id", "root", "key", "payload"])

        made = self.scratch.save(self.documents.select("doc_id", "text").mapInArrow(read, "doc_id long, root binary, key binary, payload binary"), "files")
        return made.select("doc_id", "root").distinct(), made.select("key", "payload").dropDuplicates(["key"])

    def directories(self) -> tuple[bytes, DataFrame]:
        """(root, objects) of the directories over documents as single blobs; even ids are readable by all, others by their owner."""
        mode = F.when(F.col("doc_id") % 2 == 0, 0o100644).otherwise(0o100600).cast("long")
        text = F.coalesce("text", F.lit(""))
        entries = self.documents.select(F.concat_ws("/", "source", "lang").alias("dir"), F.col("doc_id").cast("string").cast("binary").alias("name"), mode.alias("mode"), keys.key(keys.BLOB, F.octet_length(text).cast("long"), keys.digest(text)).alias("content"))
        objects = None
        while True:
            items = encoded_entries(entries)
            roots, made = build.directories(self.spark, entries.select("dir").distinct(), items, self.BITS, self.scratch)
            roots = self.scratch.save(roots, "roots")
            objects = made if objects is None else objects.unionByName(made)
            if (top := roots.where("dir = ''").head()) is not None:
                return bytes(top["key"]), objects.dropDuplicates(["key"])
            up = F.regexp_replace("dir", "/?[^/]*$", "")
            entries = roots.select(up.alias("dir"), F.regexp_extract("dir", "[^/]*$", 0).cast("binary").alias("name"), F.lit(0o040755).cast("long").alias("mode"), F.col("key").alias("content"))


def encoded_entries(entries: DataFrame) -> DataFrame:
    """dir, name and item; entries: dir, name, mode, content."""

    def read(batches):
        for b in batches:
            items = [codec.Entry(n, m, content=c).encoded() for n, m, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, pa.binary())], names=["dir", "name", "item"])

    return entries.select("dir", "name", "mode", "content").mapInArrow(read, "dir string, name binary, item binary")
