"""The registered queries of the library's operators over the given tables."""

from __future__ import annotations

import stat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import codec, display, keys, names
from treeloom.operators import cdc, closure, dedup, figures, listing, refs, runs, segments, trees
from treeloom.plans import store
from treeloom.scratch import Scratch, small_batches
from treeloom.sources import archive, filesystem, ignore, wirepack
from treeloom.streaming import inbox

NOW = "2024-01-01 00:00:00"
BITS = 3
RATIO = 0.3
PACK_BYTES = 4 << 20

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def hexed(df: DataFrame, *columns: str) -> DataFrame:
    """Keys as text."""
    return df.withColumns({c: keys.text(F.col(c)) for c in columns})


@query
def dedup_by_directory(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: entries, bytes, unique blobs and their bytes of every directory."""
    f = store.files(spark, d)
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    by_key = f.groupBy(path.alias("path"), "key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    out = by_key.groupBy("path").agg(F.sum("n").alias("entries"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count(F.lit(1)).alias("unique_blobs"), F.sum("size").alias("unique_bytes"))
    return out.withColumn("dedup_ratio", F.col("unique_bytes") / F.col("bytes")).orderBy("path")


@query
def key_build(spark, d):
    return hexed(store.files(spark, d).select("doc_id", "key"), "key")


@query
def key_fields(spark, d):
    k = F.col("key")
    return store.files(spark, d).select("doc_id", keys.type_of(k).alias("otype"), keys.type_name(keys.type_of(k)).alias("type_name"), keys.length_size(k).alias("length_size"), keys.length(k).alias("length"), keys.text(keys.hash_of(k)).alias("hash"))


@query
def key_validate(spark, d):
    n = store.table(spark, d, "nation").select("n_nationkey")
    base = keys.key(keys.BLOB, F.col("n_nationkey") + 1, keys.digest(F.col("n_nationkey").cast("string")))
    rest = F.substring(base, F.lit(2), F.lit(31))
    kind = F.col("n_nationkey") % 5
    bad = F.when(kind == 0, F.substring(base, F.lit(1), F.lit(20))).when(kind == 1, F.concat(F.unhex(F.lit("08")), rest)).when(kind == 2, F.concat(F.unhex(F.lit("70")), rest)).when(kind == 3, F.concat(F.unhex(F.lit("0100")), F.substring(base, F.lit(3), F.lit(30)))).otherwise(base)
    return n.select("n_nationkey", F.coalesce(keys.error(bad), F.lit("ok")).alias("verdict"))


@query
def blob_dedup_stats(spark, d):
    f = store.files(spark, d)
    return dedup.write_stats(f.select("key", F.col("size").alias("ulen")), f.where(F.col("doc_id") % 7 == 0).select("key"))


@query
def chunk_dedup_stats(spark, d):
    return dedup.write_stats(store.lines(spark, d).select("key", F.col("size").alias("ulen")), store.lines(spark, d).where(F.lit(False)).select("key"))


@query
def missing_keys_ordered(spark, d):
    f = store.files(spark, d)
    labelled = store.table(spark, d, "labels").select("doc_id")
    return hexed(dedup.missing(f.select(F.col("doc_id").alias("ord"), "key"), f.join(labelled, "doc_id", "left_semi")), "key").select("ord", "key")


@query
def has_semi(spark, d):
    f = store.files(spark, d)
    labelled = store.table(spark, d, "labels").select("doc_id")
    return dedup.has(f.select("doc_id", "key"), f.join(labelled, "doc_id", "left_semi")).select("doc_id")


@query
def has_outside_segment(spark, d):
    f = store.files(spark, d).select("doc_id", "key")
    return dedup.has_outside(f, store.index(spark, d), 0).select("doc_id")


@query
def dir_listing(spark, d):
    return hexed(store.files(spark, d).select("source", "lang", "name", "size", "key").orderBy("source", "lang", "name"), "key")


@query
def built_dir_listing(spark, d):
    """Entries of all directories, built into leaves and index nodes and read back from these in order."""
    b = store.Built(spark, d)
    root, objects = b.directories()
    found = trees.walk(spark, objects, root).where(trees.is_kind(stat.S_IFREG))
    part = lambda i: F.split(F.decode("path", "UTF-8"), "/")[i]
    return hexed(found.select(part(0).alias("source"), part(1).alias("lang"), part(2).alias("name"), keys.length(F.col("content")).alias("size"), F.col("content").alias("key")).orderBy("source", "lang", "name"), "key")


def _one_dir(spark, d):
    return store.files(spark, d).where((F.col("source") == "src0") & (F.col("lang") == "en")).select("name", "size")


@query
def dir_page_after(spark, d):
    return listing.page(_one_dir(spark, d), "3", 10).select("name", "size")


@query
def dir_page_more_flag(spark, d):
    return listing.page(_one_dir(spark, d), "", 5).select("name", "more")


@query
def lookup_entry(spark, d):
    f = store.files(spark, d)
    wanted = store.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"), F.lit("src1").alias("source"), F.lit("en").alias("lang"))
    return hexed(wanted.join(f, ["source", "lang", "name"]).select("name", "size", "key"), "key")


def _leaves(spark, d):
    """Directory leaves as item runs of the entries in order of name: dir, lo, hi, leaf."""
    n = _numbered(spark, d)
    leaves = n.groupBy("dir", "run").agg(F.max("name").alias("hi"), F.count(F.lit(1)).alias("n"))
    return leaves.withColumn("lo", F.lag("hi").over(Window.partitionBy("dir").orderBy("run")))


def _numbered(spark, d):
    f = store.files(spark, d).select(F.concat_ws("/", "source", "lang").alias("dir"), "name", runs.hit(keys.digest(F.col("name")), BITS).alias("hit"))
    return runs.number(f, "dir", "name", "hit", BITS)


@query
def separator_range_lookup(spark, d):
    f = store.files(spark, d)
    wanted = f.join(store.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.concat_ws("/", "source", "lang").alias("dir"), "name")
    return listing.by_separator(wanted, _leaves(spark, d)).select("dir", "name", "run")


@query
def resolve_paths(spark, d):
    t = store.Tree(spark, d)
    docs = store.table(spark, d, "documents")
    kind = F.col("doc_id") % 5
    path = F.concat(F.lit("/"), "source", F.when(kind == 1, "/./").otherwise("/"), "lang", F.lit("/"), F.when(kind == 2, "absent").when(kind == 3, "..").otherwise(F.col("doc_id").cast("string")), F.when(kind == 4, "/below").otherwise(""))
    out = closure.resolve(t.entries(), t.root, docs.select(F.col("doc_id").alias("id"), path.alias("path")), 4)
    return hexed(out.select("id", "key", "error"), "key")


@query
def parse_spec(spark, d):
    o = store.table(spark, d, "orders").select("o_orderkey")
    kind = F.col("o_orderkey") % 4
    name = F.concat(F.lit("n"), (F.col("o_orderkey") % 13).cast("string"))
    k = F.sha2(F.col("o_orderkey").cast("string"), 256)
    spec = F.when(kind == 0, F.concat(F.lit("ref:"), name)).when(kind == 1, F.concat(F.lit("ref:"), name, F.lit("@a/b@c"))).when(kind == 2, k).otherwise(F.concat(k, F.lit("/x/y")))
    return o.withColumn("s", listing.parse_spec(spec)).select("o_orderkey", "s.kind", "s.name", "s.path")


@query
def dir_footprint_rollup(spark, d):
    f = store.files(spark, d)
    levels = F.explode(F.array(F.lit("/"), F.concat(F.lit("/"), "source"), F.concat(F.lit("/"), "source", F.lit("/"), "lang")))
    return f.select(levels.alias("path"), "size").groupBy("path").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


@query
def file_size_from_key(spark, d):
    return store.files(spark, d).select("doc_id", keys.length(F.col("key")).alias("size"))


@query
def tree_edges(spark, d):
    return hexed(store.Tree(spark, d).edges(), "parent", "child")


def _two_roots(t):
    return t.sources.where(F.col("source").isin("src1", "src2")).select("key")


@query
def reachable_from_refs(spark, d):
    t = store.Tree(spark, d)
    return hexed(closure.reachable(spark, t.edges(), _two_roots(t)), "key")


@query
def check_complete_missing(spark, d):
    t = store.Tree(spark, d)
    held = keys.byte(F.col("child"), 32) % 16 != 0
    edges = t.edges()
    stored = edges.where(held).select(F.col("child").alias("key")).distinct().unionByName(_two_roots(t)).distinct()
    return hexed(closure.incomplete(spark, edges, _two_roots(t), stored), "key")


@query
def why_key(spark, d):
    t = store.Tree(spark, d)
    wanted = t.lines.where(F.col("doc_id") == 1).select("key").distinct()
    named = t.sources.select(F.concat(F.lit("ref/"), "source").alias("name"), "key")
    return closure.why(spark, t.edges(), named, wanted)


@query
def unreferenced_objects(spark, d):
    t = store.Tree(spark, d)
    edges = t.edges()
    return hexed(edges.select(F.col("child").alias("key")).distinct().join(closure.reachable(spark, edges, _two_roots(t)).select("key"), "key", "left_anti"), "key")


@query
def live_union_grey(spark, d):
    grey = store.files(spark, d).where(F.col("doc_id") % 9 == 1).select("key")
    return hexed(store.live(spark, d).unionByName(grey).distinct(), "key")


@query
def export_manifest(spark, d):
    """Members of a tar archive of the whole tree, as their headers tell."""
    import pyarrow as pa

    b = store.Built(spark, d)
    root, objects = b.directories()

    def read(batches):
        for b in batches:
            heads = [archive.header(r["path"].decode(), trees.entry_of(r)) for r in b.to_pylist()]
            rows = [(h.name + ("/" if h.isdir() else ""), h.size, h.mode, "dir" if h.isdir() else "file") for h in heads]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["path", "size", "mode", "kind"])

    found = trees.walk(spark, objects, root).where(~names.unsafe_entry(F.decode("name", "UTF-8")))
    return found.select("path", *trees.NAMES).mapInArrow(read, "path string, size long, mode int, kind string").orderBy("path")


@query
def file_content_concat(spark, d):
    """Documents cut into chunks under index nodes, and their blobs read in order."""
    roots, objects = store.Built(spark, d).contents()
    blobs = trees.contents(spark, objects, roots.select(F.col("doc_id").cast("string").cast("binary").alias("at"), F.col("root").alias("key")))
    each = trees.with_payload(blobs, objects).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("payload").alias("x")))).alias("parts"))
    whole = each.select(F.decode("at", "UTF-8").cast("long").alias("doc_id"), F.unhex(F.array_join(F.transform("parts", lambda s: s["x"]), "")).alias("content"))
    return whole.select("doc_id", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("bytes"))


@query
def store_readback(spark, d):
    """Documents put into a new store as records and read back: payloads decoded, and whether each frame is sound."""
    import hashlib

    import pyarrow as pa

    from treeloom import engine

    text = F.coalesce("text", F.lit(""))
    objects = store.table(spark, d, "documents").select(keys.key(keys.BLOB, F.octet_length(text).cast("long"), keys.digest(text)).alias("key"), text.cast("binary").alias("payload"))
    e = engine.Engine(spark, f"{Scratch(spark, 'readback').path}/store", engine.Options(segment_size=4 << 20))
    e.put(objects)

    def read(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                parsed = codec.parse_record(engine.frame(r))
                rows.append((r["key"], r["ulen"], parsed.key == r["key"] and parsed.slen == r["slen"], hashlib.sha256(codec.payload(parsed)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["key", "ulen", "sound", "sha"])

    return hexed(e.records().select("key", "ulen", "slen", "flags", "crc", "data").mapInArrow(read, "key binary, ulen long, sound boolean, sha string"), "key")


@query
def scrub_faults(spark, d):
    """Records of blobs, of which every thirteenth has a wrong checksum: the scrub finds these and no other."""
    import pyarrow as pa

    from treeloom import engine

    def name(batches):
        for b in batches:
            data = [f"{i} {t or ''}".encode() for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            made = [codec.blob(x, lambda _, h=h: h)[0] for x, h in zip(data, codec.blake3_many(data), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), pa.array(data, pa.binary())], names=["doc_id", "key", "payload"])

    small_batches(spark)
    objects = Scratch(spark, "scrub").save(store.table(spark, d, "documents").select("doc_id", "text").mapInArrow(name, "doc_id long, key binary, payload binary"), "objects")
    harmed = objects.select("key", (F.col("doc_id") % 13 == 0).alias("harm"), "doc_id")
    records = engine.encoded(objects).join(harmed, "key")
    records = records.withColumn("crc", F.when(F.col("harm"), (F.col("crc") + 1) % (1 << 32)).otherwise(F.col("crc")))
    return engine.broken(records).join(harmed, "key").select("doc_id", "why")


@query
def reference_roundtrip(spark, d):
    """References of the log in their canonical encoding, decoded again, and what a signature covers."""
    import pyarrow as pa

    log = store.ref_log(spark, d).select("seq", "name", "user", "key")

    def read(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                made = codec.Reference(r["name"], r["key"], r["user"], r["seq"], b"signature" if r["seq"] % 2 else b"", b"public")
                again = codec.Reference.decoded(made.encoded())
                rows.append((again.created_at_ns, again.name, again.user, again.key.hex(), again == made, (made.signed_bytes() == made.encoded()) == (r["seq"] % 2 == 0)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seq", "name", "user", "key", "same", "unsigned"])

    return log.mapInArrow(read, "seq long, name string, user string, key string, same boolean, unsigned boolean")


@query
def staged_header_roundtrip(spark, d):
    """Headers of staged packs and attribute sets, encoded and decoded again."""
    import pyarrow as pa

    turns = store.table(spark, d, "conversations").select("conv_id", "turn", "role")

    def read(batches):
        for b in batches:
            rows = []
            for conv, turn, role in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = codec.meta_header(f"conv/{conv}", bytes(32), turn)
                ref, root, at, body = codec.read_meta_header(head + b"body")
                attributes = {b"user.role": (role or "").encode(), b"user.turn": str(turn).encode()}
                rows.append((conv, turn, ref, int(at), body == len(head) and root == bytes(32), codec.decode_xattrs(codec.encode_xattrs(attributes))[b"user.role"].decode()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "ref", "at", "same", "role"])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role").mapInArrow(read, "conv_id long, turn long, ref string, at long, same boolean, role string")


@query
def refs_latest_wins(spark, d):
    return hexed(refs.current(store.ref_log(spark, d), ["ts", "seq"]).select("name", "seq", "user", "key"), "key")


@query
def refs_list_lines(spark, d):
    r = hexed(refs.current(store.ref_log(spark, d), ["ts", "seq"]), "key").withColumn("created", F.col("ts"))
    return refs.list_lines(r)


@query
def ref_name_validation(spark, d):
    c = store.table(spark, d, "customer").select("c_custkey", "c_name")
    kind = F.col("c_custkey") % 6
    name = F.when(kind == 0, "").when(kind == 1, F.concat("c_name", F.lit("@x"))).when(kind == 2, F.concat("c_name", F.chr(F.lit(7)))).when(kind == 3, F.repeat("c_name", F.lit(100))).when(kind == 4, F.concat(F.lit("a//"), "c_name")).otherwise(F.col("c_name"))
    return c.select("c_custkey", F.coalesce(names.reference_error(name), F.lit("ok")).alias("as_name"), F.coalesce(names.user_error(name), F.lit("ok")).alias("as_user"))


@query
def segment_assignment(spark, d):
    return hexed(store.index(spark, d).select("ord", "key", "segment_id", "pos", "off"), "key")


@query
def segment_liveness(spark, d):
    return segments.liveness(store.index(spark, d), store.live(spark, d))


@query
def gc_status(spark, d):
    index = store.index(spark, d)
    return segments.status(segments.liveness(index, store.live(spark, d)), store.segment_table(index))


def _victims(spark, d, index):
    return segments.victims(segments.liveness(index, store.live(spark, d)), store.segment_table(index), RATIO)


@query
def gc_victims(spark, d):
    return _victims(spark, d, store.index(spark, d)).select("segment_id", "dead_keys", "dead_bytes")


@query
def gc_copy_set(spark, d):
    index = store.index(spark, d)
    return hexed(segments.copy_set(index, _victims(spark, d, index), store.live(spark, d)).select("key", "segment_id", "off", "slen"), "key")


@query
def gc_cycle_stats(spark, d):
    index = store.index(spark, d)
    chosen = _victims(spark, d, index)
    return segments.compact_stats(index, store.segment_table(index), chosen, segments.copy_set(index, chosen, store.live(spark, d)))


@query
def index_order(spark, d):
    return hexed(segments.index_order(store.index(spark, d)).select("key", keys.byte(F.col("key"), 32).alias("last_byte")), "key")


@query
def index_fanout(spark, d):
    return segments.fanout(store.index(spark, d))


@query
def sort_by_location(spark, d):
    f = store.files(spark, d).select(F.col("doc_id").alias("ord"), "key")
    return hexed(segments.by_location(f, store.index(spark, d).where(F.col("segment_id") < 5)), "key")


@query
def stored_size(spark, d):
    f = store.files(spark, d).select(F.col("doc_id").alias("ord"), "key")
    return segments.stored_size(f, store.index(spark, d).where(F.col("segment_id") < 5)).select("ord", "slen")


@query
def item_runs(spark, d):
    x = store.lines(spark, d).select("doc_id", "ord", runs.hit(keys.digest(F.col("line")), BITS).alias("hit"))
    return runs.number(x, "doc_id", "ord", "hit", BITS)


@query
def dir_leaf_runs(spark, d):
    return _leaves(spark, d).select("dir", "run", "hi", "n")


@query
def index_levels(spark, d):
    """How many runs the leaves of a directory, as items, end in: the next level."""
    leaves = _leaves(spark, d).select("dir", "run", runs.hit(keys.digest(F.col("hi")), BITS).alias("hit"))
    up = runs.number(leaves.withColumnRenamed("run", "leaf"), "dir", "leaf", "hit", BITS)
    return up.groupBy("dir").agg(F.count(F.lit(1)).alias("leaves"), (F.max("run") + 1).alias("nodes"))


#: Ignore files of the virtual tree: the root's, and src1's, by directory.
IGNORE = {(): "*9\n!src*/\nfr/\n", ("src1",): "!*9\n"}


@query
def ignore_filter(spark, d):
    """Files that the ignore files of the root and of src1 leave, by the rules of sources.ignore."""
    files = store.files(spark, d).select("doc_id", F.concat_ws("/", "source", "lang", "name").alias("path"))
    return ignore.kept(files, "path", IGNORE)


@query
def scan_totals(spark, d):
    mode = F.when(F.col("doc_id") % 10 == 0, F.lit(0o040755)).otherwise(F.lit(0o100644)).cast("long")
    return filesystem.totals(store.files(spark, d).select(mode.alias("mode"), "size"))


@query
def mode_string(spark, d):
    types = [0o100000, 0o040000, 0o120000, 0o060000, 0o020000, 0o010000, 0o140000, 0]
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    mode = (kind + (F.col("o_orderkey") * 7) % 4096).cast("long")
    return store.table(spark, d, "orders").select("o_orderkey", display.mode_string(mode).alias("mode"))


def _sizes(spark, d):
    """Sizes as exact whole numbers: the product of large tables' keys exceeds a long."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    n = exact("l_orderkey") * exact("l_orderkey") * exact("l_partkey") * exact("l_linenumber")
    return store.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))


@query
def human_bytes(spark, d):
    return _sizes(spark, d).select("l_orderkey", "l_linenumber", display.human_bytes(F.col("n")).alias("shown"))


@query
def human_bytes2(spark, d):
    return _sizes(spark, d).select("l_orderkey", "l_linenumber", display.human_bytes2(F.col("n")).alias("shown"))


@query
def format_duration(spark, d):
    return store.table(spark, d, "orders").select("o_orderkey", display.duration(F.col("o_totalprice") - 1000).alias("shown"))


@query
def format_mtime(spark, d):
    now = F.lit("1998-01-15 12:00:00").cast("timestamp_ntz")
    return store.table(spark, d, "orders").select("o_orderkey", display.mtime(F.col("o_orderdate"), now).alias("shown"))


@query
def progress_bar(spark, d):
    return store.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", display.bar(F.col("l_quantity") * 2.5 - 10, 20).alias("bar"))


@query
def listing_lines(spark, d):
    e = store.files(spark, d)
    when = F.timestamp_seconds(F.lit(1_690_000_000) + F.col("doc_id") * 40_000)
    e = e.select("name", F.lit(0o100644).cast("long").alias("mode"), (F.col("doc_id") % 1200).alias("uid"), F.lit(100).cast("long").alias("gid"), F.col("size").cast("string").alias("size"), when.alias("mtime"), F.lit("").alias("target"), F.lit(None).cast("string").alias("key"))
    return listing.lines(e, F.lit(NOW).cast("timestamp")).select("name", "line")


@query
def percentile_element(spark, d):
    return figures.element_percentile(store.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95])


@query
def bench_windows(spark, d):
    return figures.windows(store.table(spark, d, "orders"), "o_orderkey", "o_totalprice", 100)


@query
def bench_classes(spark, d):
    kept = F.col("o_orderkey") % 10 < 3
    return store.table(spark, d, "orders").groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("refs"), F.sum(F.when(kept, 100).otherwise(30).cast("long")).alias("mib"))


@query
def throttle_owed(spark, d):
    x = store.table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", display.rate_owed(F.col("l_partkey") * 1_000_003, F.col("l_suppkey") + 1000).alias("ns"))


@query
def unsafe_names(spark, d):
    p = store.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, "..").when(F.col("p_partkey") % 5 == 1, F.concat_ws("/", "p_name", F.lit("x"))).otherwise(F.col("p_name"))
    path = F.concat(F.when(F.col("p_partkey") % 7 == 0, "/a/").when(F.col("p_partkey") % 7 == 1, "a/../").otherwise("a/"), "p_name")
    return p.select("p_partkey", names.unsafe_entry(name).alias("entry"), names.unsafe_path(path).alias("path"))


@query
def inbox_pending(spark, d):
    """Packs, one a conversation, that no batch has taken: those with labels are done."""
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    staged = store.table(spark, d, "conversations").select(path.alias("path"), (F.col("conv_id") % 10).alias("root")).distinct()
    done = store.table(spark, d, "conversations").where(F.col("conv_id") % 3 == 0).select(path.alias("path")).distinct()
    return inbox.pending(staged, done)


@query
def length_audit(spark, d):
    """Files whose key tells another length than their text has: every eleventh key is made wrong here."""
    text, size = F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    wrong = F.when(F.col("doc_id") % 11 == 0, size + 1).otherwise(size)
    objects = store.table(spark, d, "documents").select("doc_id", keys.key(keys.BLOB, wrong, keys.digest(text)).alias("key"), size.alias("size"))
    return objects.where(keys.length(F.col("key")) != F.col("size")).select("doc_id", keys.length(F.col("key")).alias("told"), "size")


@query
def record_roundtrip(spark, d):
    """Documents framed as records, compressed where that is smaller, and what parsing gives back."""
    import hashlib

    import pyarrow as pa

    def read(batches):
        for b in batches:
            rows = []
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            made = [codec.blob(x, lambda _, h=h: h)[0] for x, h in zip(texts, codec.blake3_many(texts), strict=True)]
            for doc, k, framed in zip(b.column(0).to_pylist(), made, codec.encode_records(list(zip(made, texts, strict=True))), strict=True):
                r = codec.parse_record(framed)
                data = codec.payload(r)
                rows.append((doc, r.ulen, r.slen <= r.ulen and r.key == k, hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["doc_id", "ulen", "same", "sha"])

    small_batches(spark)
    return store.table(spark, d, "documents").select("doc_id", "text").mapInArrow(read, "doc_id long, ulen long, same boolean, sha string")


@query
def blake3_keys(spark, d):
    import pyarrow as pa

    def read(batches):
        for b in batches:
            data = [(t or "").encode() for t in b.column(1).to_pylist()]
            made = [codec.make_key(codec.BLOB, len(x), b"", lambda _, h=h: h) for x, h in zip(data, codec.blake3_many(data), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.hex() for k in made], pa.string())], names=["doc_id", "key"])

    return store.table(spark, d, "documents").select("doc_id", "text").mapInArrow(read, "doc_id long, key string")


@query
def cdc_chunks(spark, d):
    chunks = cdc.split(store.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("html")), "page_id", "html", cdc.Sizes(256, 1024, 4096))
    return chunks.select("page_id", "ord", F.octet_length("chunk").alias("bytes"), F.sha2("chunk", 256).alias("sha"))


@query
def cdc_reassembled(spark, d):
    """Pages cut into chunks and put together again: bytes, digest, and whether all chunks keep to the sizes."""
    sizes = cdc.Sizes(256, 1024, 4096)
    chunks = cdc.split(store.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("html")), "page_id", "html", sizes)
    n = F.octet_length("chunk")
    whole = chunks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("chunk").alias("x")))).alias("parts"), F.sum(n).cast("long").alias("bytes"), F.max(n).alias("most"))
    return whole.select("page_id", "bytes", F.sha2(F.unhex(F.array_join(F.transform("parts", lambda s: s["x"]), "")), 256).alias("sha"), (F.col("most") <= sizes.most).alias("within"))


@query
def pack_stream(spark, d):
    """Documents written as wire packs of bounded size and read again."""
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    objects = store.table(spark, d, "documents").select(keys.key(keys.BLOB, F.octet_length(text).cast("long"), keys.digest(text)).alias("key"), text.cast("binary").alias("payload"))
    packs = wirepack.packed(objects, most=PACK_BYTES).select(F.lit("stream").alias("path"), "content")
    return hexed(wirepack.parse(packs).select("key", "ulen", F.sha2("payload", 256).alias("sha"), "error"), "key")


@query
def progress_lines(spark, d):
    """Progress of reading each order's pages: a line an order."""
    o = store.table(spark, d, "orders")
    done, total = F.col("o_orderkey") * 3000, F.lit(30_000_000).cast("long")
    line = display.progress(done, total, F.col("o_orderkey"), F.lit(10_000), (F.col("o_orderkey") / 8).cast("double"))
    return o.select("o_orderkey", line.alias("line"))


@query
def cbor_dirleaf_roundtrip(spark, d):
    """Leaves of eight documents each, encoded and decoded again: what a leaf's key says is below it, and its entries' names."""
    import pyarrow as pa

    small_batches(spark)
    f = store.files(spark, d).select((F.col("doc_id") / 8).cast("long").alias("leaf"), F.struct("name", "key").alias("e"))
    leaves = f.groupBy("leaf").agg(F.array_sort(F.collect_list("e")).alias("entries"))

    def read(batches):
        for b in batches:
            rows = []
            made = [[codec.Entry(e["name"].encode(), 0o100644, content=e["key"]) for e in listed] for listed in b.column(1).to_pylist()]
            encoded = codec.dir_leaves(made)
            for leaf, es, (k, data), why in zip(b.column(0).to_pylist(), made, encoded, codec.verify_many(encoded), strict=True):
                again = codec.entries(data)
                below = codec.key_length(k) - len(data)
                rows.append((leaf, below, again == es and why is None, ",".join(f"{e.name.decode()}={e.content.hex()}" for e in again)))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["leaf", "below", "same", "entries"])

    return leaves.mapInArrow(read, "leaf long, below long, same boolean, entries string")


@query
def inbox_stream(spark, d):
    """Conversations staged as packs (header and body in a column) and opened as the stream's batches are."""
    import pyarrow as pa

    turns = store.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))

    def stage(batches):
        for b in batches:
            texts = ((conv, [(t["text"] or "").encode() for t in listed]) for conv, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for some in codec.together(texts, lambda x: sum(map(len, x[1])), inbox.TOGETHER):
                flat = [x for _, listed in some for x in listed]
                made = codec.make_keys([(codec.BLOB, len(x), x) for x in flat])
                records = iter(zip(made, codec.encode_records(list(zip(made, flat, strict=True))), strict=True))
                rows = []
                for conv, listed in some:
                    framed = [next(records) for _ in listed]
                    body = codec.write_pack([r for _, r in framed])
                    rows.append((f"conv/{conv}", codec.meta_header(f"conv/{conv}", framed[0][0], conv) + (body[:-1] if conv % 10 == 3 else body)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])

    opened = inbox.opened(turns.mapInArrow(stage, "path string, content binary"))
    return opened.groupBy("path").agg(F.count("key").alias("objects"), F.max("error").alias("error"))
