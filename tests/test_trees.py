"""Ignore rules, chunking, tree building and the engine from end to end."""

import io
import os
import random
import stat
import tarfile

import pytest

from treeloom.engine import Engine, Incomplete, NotADirectory, NotFound, Options, chunk_sizes
from treeloom.functions import codec
from treeloom.operators import build, cdc
from treeloom.sources import archive, filesystem
from treeloom.sources.ignore import FILE_NAME, Matcher

SIZES = cdc.Sizes(64, 256, 1024)


def rules(text, *below):
    m = Matcher().descend(None, text)
    for name, more in below:
        m = m.descend(name, more)
    return m


def test_ignore_rules():
    m = rules("*.log\nbuild/\n!keep.log\r\n# note\n\n/top\n")
    assert m.ignored("a.log", False) and m.ignored("a.log", True) and not m.ignored("keep.log", False)
    assert m.ignored("build", True) and not m.ignored("build", False) and m.ignored("top", False)
    below = m.descend("sub", None)
    assert not below.ignored("top", False) and below.ignored("x.log", False)
    assert not m.descend("sub", "!x.log").ignored("x.log", False)
    assert rules("*.log", ("sub", "secret*")).ignored("secret1", False) and not m.descend("other", None).ignored("secret1", False)
    deep = rules("doc/**/junk", ("doc", None))
    assert deep.ignored("junk", False) and deep.descend("a", None).descend("b", None).ignored("junk", False)
    assert not rules("*").ignored(FILE_NAME, False) and rules("*").ignored(FILE_NAME, True)
    assert not Matcher().ignored("anything", False)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 200_000])
def test_chunks_reassemble(n):
    data = random.Random(n).randbytes(n)
    parts = cdc.chunks(data, SIZES)
    assert b"".join(parts) == data and parts == cdc.chunks(data, SIZES)
    assert all(SIZES.least <= len(x) <= SIZES.most for x in parts[:-1])
    assert cdc.chunks(b"\0" * n, SIZES) == [] or b"".join(cdc.chunks(b"\0" * n, SIZES)) == b"\0" * n


def test_chunks_follow_content():
    data = random.Random(1).randbytes(100_000)
    a, b = set(cdc.chunks(data, SIZES)), set(cdc.chunks(b"new" + data, SIZES))
    assert len(a & b) > 0.8 * len(a)
    assert chunk_sizes(None, None, None) is None
    with pytest.raises(ValueError):
        chunk_sizes(1, None, 2)


def test_index_of_runs():
    runs, out = build.Runs(3), []
    blobs = [codec.blob(str(i).encode())[0] for i in range(300)]
    assert build.index([(b"", blobs[0])], runs, False, lambda *x: out.append(x)) == blobs[0] and not out
    root = build.index([(b"", k) for k in blobs], runs, False, lambda *x: out.append(x))
    assert out[-1][0] == root and codec.key_length(root) == sum(map(codec.key_length, blobs))
    store = dict(out)

    def leaves(k):
        return [k] if k not in store else [x for _, c in codec.children(k, store[k]) for x in leaves(c)]

    assert leaves(root) == blobs
    assert all(len(codec.loads(d)) >= 2 for d in store.values())


def test_runs_closed_together_are_those_closed_alone(monkeypatch):
    keys = [codec.blob(str(i).encode())[0] for i in range(200)]
    items = [codec.Entry(str(i).encode(), 0o100644, content=k) for i, k in enumerate(keys)]
    rows = [{"name": e.name, "item": e.encoded(), "key": k} for e, k in zip(items, keys, strict=True)]
    cuts = [slice(i, i + n) for i, n in ((0, 1), (1, 9), (10, 30), *((40 + 2 * j, 2) for j in range(80)))]
    leaves, nodes = [codec.dir_leaf(items[c]) for c in cuts], [codec.dir_node([(r["name"], r["key"]) for r in rows[c]]) for c in cuts]
    calls, many = [], codec.blake3_many
    monkeypatch.setattr(codec, "blake3_many", lambda x: calls.append(len(x)) or many(x))
    assert build._closed([rows[c] for c in cuts], True) == leaves and build._closed([rows[c] for c in cuts], False) == nodes
    assert calls == [len(cuts)] * 2 and build._closed([], True) == []


def test_packs_come_in_batches_of_bounded_bytes(spark):
    import pyarrow as pa

    from treeloom.sources import wirepack

    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = {n: spark.conf.get(n) for n in names}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        spark.conf.set(names[0], "64m")
        packs = spark.range(24, numPartitions=1).selectExpr("cast(id as string) path", "cast(repeat('x', 1000000) as binary) content")
        assert wirepack.parse(packs).select("error").distinct().collect() == [("magic",)]
        assert max(r["n"] for r in packs.mapInArrow(sizes, "n long").collect()) <= 9
        spark.conf.set(names[0], "1m")  # a smaller setting stays
        wirepack.parse(packs)
        assert spark.conf.get(names[0]) == "1m"
    finally:
        for n, x in before.items():
            spark.conf.set(n, x)


def test_files_built_together_are_those_built_alone(monkeypatch):
    r, calls, many = random.Random(5), [], codec.blake3_many
    texts = [b"", b"x", *(r.randbytes(n) for n in (300, 5000, 5000, 90_000)), b"same" * 9000, b"same" * 9000] + [r.randbytes(2000) for _ in range(200)]
    want = [build.file_objects(x, SIZES, build.Runs(2)) for x in texts]
    monkeypatch.setattr(codec, "blake3_many", lambda x: calls.append(len(x)) or many(x))
    assert build.files_objects(texts, SIZES, 2) == want
    assert len(calls) < 40 and build.files_objects([], SIZES, 2) == []  # calls grow with the levels, not with files
    sizes = [len(x) for x in texts]
    cut = list(codec.together(texts, most=20_000))
    assert [x for some in cut for x in some] == texts and all(len(some) == 1 or sum(map(len, some)) <= 20_000 for some in cut) and max(sizes) > 20_000


def test_directories_built_together_are_those_built_alone(spark):
    from treeloom.scratch import Scratch

    r = random.Random(4)
    wanted = {"": 0, "one": 1, "few": 5, "many": 700, "more": 120}
    entries = {d: sorted((codec.Entry(b"%d" % r.randrange(10**9), 0o100644, content=codec.blob(r.randbytes(9))[0]) for _ in range(n)), key=lambda e: e.name) for d, n in wanted.items()}
    items = spark.createDataFrame([(d, e.name, e.encoded()) for d, es in entries.items() for e in es], "dir string, name binary, item binary").repartition(3)
    dirs = spark.createDataFrame([(d,) for d in wanted], "dir string")
    roots, objects = build.directories(spark, dirs, items, 2, Scratch(spark, "t"))
    plain = {d: build.dir_objects(es, build.Runs(2)) for d, es in entries.items()}
    assert {x["dir"]: bytes(x["key"]) for x in roots.collect()} == {d: k for d, (k, _) in plain.items()}
    assert {(bytes(x["key"]), bytes(x["payload"])) for x in objects.collect()} == {o for _, made in plain.values() for o in made}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("alpha")
    (root / "sub" / "b.txt").write_text("beta")
    (root / "sub" / "deep" / "big").write_bytes(random.Random(5).randbytes(30_000))
    (root / "empty").mkdir()
    (root / "none").write_text("")
    (root / "link").symlink_to("a.txt")
    (root / "x.log").write_text("log")
    (root / FILE_NAME).write_text("*.log\n")
    os.chmod(root / "sub" / "b.txt", 0o600)
    return str(root)


def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", Options(4096, SIZES, 3))


def test_distributed_build_equals_sequential(spark, tree):
    k, objects = build.distributed(spark, tree, SIZES, 3)
    want, plain = build.sequential(tree, SIZES, 3)
    assert k == want
    assert {(bytes(r["key"]), bytes(r["payload"])) for r in objects.collect()} == set(plain)
    assert filesystem.totals(filesystem.tree(spark, tree)).collect()[0].asDict() == {"files": 5, "bytes": 5 + 4 + 30_000 + 6}


def test_engine_end_to_end(spark, tree, tmp_path):
    e = engine(spark, tmp_path)
    root, stats = e.ingest(tree, "main/one", "me")
    assert stats.stored > 10 and e.ingest(tree)[1].stored == 0
    events: list = []
    e.ingest(tree, progress=events.append)
    assert [x["event"] for x in events] == ["scanned", "chunked", "stored"] and events[0]["files"] == events[1]["files"] == 5 and events[1]["bytes"] == 30_015
    assert e.ref_get("main/one").key == root and e.ref_list()[0].startswith(f"main/one {root.hex()}")
    lines = e.ls("ref:main/one", show_keys=True)
    assert [x.split()[6 if "  " in x[40:60] else 6] for x in lines] and len(lines) == 6
    assert any(x.startswith("lrwxrwxrwx") and "link -> a.txt" in x for x in lines)
    assert [x.split()[-1] for x in e.ls("ref:main/one@sub")] == ["b.txt", "deep"]
    with pytest.raises(NotADirectory):
        e.ls("ref:main/one@a.txt")
    with pytest.raises(NotFound):
        e.ls("ref:other")
    assert e.resolve_path(root, "/sub/./deep") == e.resolve_spec(f"{root.hex()}/sub/deep")
    with pytest.raises(ValueError):
        e.resolve_path(root, "sub/../a")
    with pytest.raises(NotFound):
        e.lookup(root, b"nope")
    page, more = e.list_entries(root, b"a.txt", 2)
    assert [x.name for x in page] == [b"empty", b"link"] and more
    assert e.verify().isEmpty()
    e.restore("ref:main/one", str(tmp_path / "out"))
    out = tmp_path / "out"
    assert (out / "sub" / "deep" / "big").read_bytes() == open(f"{tree}/sub/deep/big", "rb").read()
    assert os.readlink(out / "link") == "a.txt" and stat.S_IMODE(os.stat(out / "sub" / "b.txt").st_mode) == 0o600
    assert os.stat(out / "a.txt").st_mtime_ns == os.stat(f"{tree}/a.txt").st_mtime_ns and not (out / "x.log").exists()
    first = e.get(root)
    with pytest.raises(NotFound):
        e.get(codec.blob(b"absent")[0])
    assert e.missing([codec.blob(b"q")[0], root, codec.blob(b"q")[0]]) == [codec.blob(b"q")[0]] * 2
    with pytest.raises(Incomplete):
        e.ref_set("bad", codec.file_node([codec.blob(b"q")[0]])[0])
    # garbage: a second tree whose reference goes
    os.makedirs(tmp_path / "other")
    (tmp_path / "other" / "junk").write_bytes(random.Random(9).randbytes(20_000))
    other, _ = e.ingest(str(tmp_path / "other"), "junk")
    assert e.gc_why(other) == ["junk"]
    e.ref_rm("junk")
    with pytest.raises(NotFound):
        e.ref_rm("junk")
    assert e.gc_run(0, grace_ns=10**15)["compacted"] == 0
    swept = e.gc_run(0)
    assert swept["compacted"] > 0 and not e.has(other) and e.get(root) == first
    e.check_complete(e.ref_get("main/one").key)
    e.wipe()
    assert e.objects().isEmpty() and e.ref_list() == []


def test_grey_keys_survive(spark, tmp_path):
    e = engine(spark, tmp_path)
    objects = [codec.blob(bytes([i]) * 50) for i in range(6)]
    e.put(spark.createDataFrame(objects, "key binary, payload binary"), verify=True)
    grey = spark.createDataFrame([(objects[3][0],)], "key binary")
    e.gc_run(0, grey=grey)
    assert [e.has(k) for k, _ in objects] == [i == 3 for i in range(6)]
    with pytest.raises(codec.Malformed):
        e.put(spark.createDataFrame([(objects[0][0], b"other")], "key binary, payload binary"), verify=True)


def test_attributes_and_large_attribute_sets_come_back(spark, tmp_path):
    root = tmp_path / "marked"
    root.mkdir()
    (root / "a").write_text("a")
    (root / "b").write_text("b")
    try:
        os.setxattr(root / "a", "user.small", b"1")
        os.setxattr(root / "b", "user.large", b"2" * 600)
    except OSError:
        pytest.skip("no extended attributes here")
    e = engine(spark, tmp_path)
    k, _ = e.ingest(str(root), "m")
    found = {x.name: x for x in e.collect_entries(k)}
    assert codec.decode_xattrs(found[b"a"].xattrs) == {b"user.small": b"1"} and found[b"b"].xattrs is None and e.has(found[b"b"].xattrs_key)
    e.restore("ref:m", str(tmp_path / "again"))
    assert os.getxattr(tmp_path / "again" / "a", "user.small") == b"1" and os.getxattr(tmp_path / "again" / "b", "user.large") == b"2" * 600


def test_space_and_segments(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.put(spark.createDataFrame([codec.blob(b"x"), codec.blob(b"y")], "key binary, payload binary"))
    e.options.min_free = 1
    assert not e.low_space()
    e.options.min_free = 1 << 62
    assert e.low_space()
    with pytest.raises(NotFound):
        e.remove_segment(77)
    e.remove_segment(e.index().head()["segment_id"])
    assert e.index().isEmpty()


def test_records_as_stored(spark, tmp_path):
    e = engine(spark, tmp_path)
    objects = [codec.blob(b"word " * 900), codec.blob(random.Random(1).randbytes(700)), codec.blob(b"")]
    assert e.put(spark.createDataFrame(objects, "key binary, payload binary")).bytes_stored == 4500 + 700
    for k, data in objects:
        r = codec.parse_record(e.get_record(k))
        assert r.key == k and codec.payload(r) == data and e.stored_size(k) == r.slen and e.get(k) == data
        at = e.index().where(f"hex(key) = '{k.hex().upper()}'").head()
        assert e.record_at(at["segment_id"], at["off"]) == e.get_record(k)
    assert e.stored_size(objects[0][0]) < 200 and e.stored_size(objects[1][0]) == 700
    assert e.get_many([objects[2][0], objects[0][0], codec.blob(b"no")[0]]) == dict(objects[::2])
    with pytest.raises(NotFound):
        e.record_at(99, 8)
    other = Engine(spark, f"file://{tmp_path}/other", Options(4096, SIZES, 3))
    framed = spark.createDataFrame([(codec.encode_record(*x),) for x in objects], "record binary")
    assert other.put_records(framed).stored == 3 and other.put_records(framed).deduped == 3 and other.verify().isEmpty()
    assert sorted(other.get_record(k) for k, _ in objects) == sorted(e.get_record(k) for k, _ in objects)
    with pytest.raises(Exception, match="checksum"):
        other.put_records(spark.createDataFrame([(codec.encode_record(*objects[1])[:-1] + b"?",)], "record binary"))


def test_scrub_finds_each_fault(spark, tmp_path):
    from pyspark.sql import functions as F

    e = engine(spark, tmp_path)
    objects = sorted(codec.blob(bytes([65 + i]) * (30 + i)) for i in range(5))
    e.put(spark.createDataFrame(objects, "key binary, payload binary"))
    rows = e.records().where("key is not null")
    bad = lambda i: F.col("key") == F.lit(objects[i][0])
    harmed = rows.withColumn("data", F.when(bad(0), F.lit(b"other")).otherwise(F.col("data"))).withColumn("crc", F.when(bad(1), 7).otherwise(F.col("crc"))).withColumn("off", F.when(bad(2), 9).otherwise(F.col("off")))
    worse = Engine(spark, f"file://{tmp_path}/worse")
    harmed.write.partitionBy("segment_id").parquet(f"{worse.path}/objects")
    found = {bytes(r["key"]): r["why"] for r in worse.verify().collect()}
    assert set(found) == {objects[i][0] for i in range(3)} and found[objects[1][0]] == "record checksum" and found[objects[2][0]] == "place"


def test_writes_during_a_cycle_keep_what_they_meet(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path)
    objects = [codec.blob(bytes([i]) * 50) for i in range(6)]
    frame = lambda which: spark.createDataFrame([objects[i] for i in which], "key binary, payload binary")
    e.put(frame(range(6)))
    plain, calls = e.live, []

    def meanwhile(grey=None):
        out = plain(grey)
        if not calls:
            calls.append(e.put(frame([2, 4])).deduped)  # dead objects that a write finds stored
        return out

    monkeypatch.setattr(e, "live", meanwhile)
    stats = e.gc_run(0)
    assert calls == [2] and [e.has(k) for k, _ in objects] == [i in (2, 4) for i in range(6)]
    assert stats["copied_records"] == 2 and not e.capturing()
    last = e.gc_report()["last"]
    assert last["copied_records"] == 2 and last["error"] is None
    report = e.gc_report()
    assert report["refs"] == 0 and report["marked"] == 0 and report["live_bytes"] == 0 and report["garbage_bytes"] == 2 * (46 + e.stored_size(objects[2][0])) and report["eligible"] >= 1
    assert {r["eligible"] for r in e.gc_status(grace_ns=10**15).collect()} == {False}
    e.begin_barrier()
    with pytest.raises(RuntimeError):
        e.gc_run(0)
    e.end_barrier()


def test_jobs_grow_with_depth_and_not_with_objects(spark, tmp_path):
    def jobs(n):
        root = tmp_path / f"wide{n}"
        root.mkdir()
        for i in range(n):
            (root / f"f{i:03}").write_bytes(random.Random(i).randbytes(900))
        e = Engine(spark, f"file://{tmp_path}/wide-store{n}", Options(1 << 20, SIZES, 7))
        e.ingest(str(root), "w")
        group = f"count-{n}"
        spark.sparkContext.setJobGroup(group, group)
        listed = e.ls("ref:w")
        e.export("ref:w", str(tmp_path / f"{n}.tar"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        with tarfile.open(tmp_path / f"{n}.tar") as t:
            assert t.getnames() == [f"f{i:03}" for i in range(n)] and t.extractfile(f"f{n - 1:03}").read() == random.Random(n - 1).randbytes(900)
        assert len(listed) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(60) <= jobs(6) + 8


def test_archive_refuses(tmp_path):
    def tar(*members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, kind, link in members:
                h = tarfile.TarInfo(name)
                h.type, h.linkname = kind, link
                t.addfile(h, io.BytesIO(b""))
        out.seek(0)
        return out

    for i, bad in enumerate(([("../x", tarfile.REGTYPE, "")], [("l", tarfile.SYMTYPE, "/tmp"), ("l/x", tarfile.REGTYPE, "")])):
        with pytest.raises(ValueError):
            archive.extract(tar(*bad), str(tmp_path / str(i)))
    with pytest.raises(ValueError):
        archive.write(io.BytesIO(), iter([("x", codec.Entry(b"a/b", 0o100644), None)]))


def test_packs_are_written_by_the_tasks(spark, tmp_path):
    from treeloom.sources import wirepack

    objects = [codec.blob(bytes([i]) * (i + 1)) for i in range(40)]
    df = spark.createDataFrame(objects, "key binary, payload binary").repartition(3)
    folder = str(tmp_path / "packs")
    assert wirepack.write_files(df, folder, most=400) > 3
    assert wirepack.write_files(df, folder, most=400) == len(os.listdir(folder))  # the same again
    back = wirepack.read(spark, folder)
    assert sorted((bytes(r["key"]), bytes(r["payload"])) for r in back.collect()) == sorted(objects)


def test_a_replayed_batch_is_taken_once(spark, tmp_path):
    import shutil

    from treeloom.streaming import inbox

    folder, body = str(tmp_path / "in"), codec.write_pack([codec.encode_record(*codec.blob(b"x"))])
    inbox.commit(*inbox.stage(folder, "r", codec.blob(b"x")[0], 1, body)[:2])
    inbox.commit(*inbox.stage(folder, "r", codec.blob(b"x")[0], 1, body[:-1])[:2])
    e = engine(spark, tmp_path)
    for _ in range(2):  # the second time as after a loss of the checkpoint
        inbox.wait(inbox.drain(spark, folder, str(tmp_path / "cp"), str(tmp_path / "bad"), e.put, str(tmp_path / "done")))
        shutil.rmtree(tmp_path / "cp")
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert e.index().count() == 1


def test_inbox(spark, tmp_path):
    from treeloom.streaming import inbox

    e = engine(spark, tmp_path)
    folder = str(tmp_path / "in")
    objects = [codec.blob(b"one"), codec.blob(b"two" * 100)]
    body = codec.write_pack([codec.encode_record(k, d) for k, d in objects])
    path, digest, n = inbox.stage(folder, "r", objects[0][0], 1, body)
    assert n == len(body) and inbox.commit(path, digest)
    assert not inbox.commit(*inbox.stage(folder, "r", objects[0][0], 2, body)[:2])
    bad, digest, _ = inbox.stage(folder, "r", objects[0][0], 1, body[:-5])
    inbox.commit(bad, digest)
    args = (spark, folder, str(tmp_path / "checkpoint"), str(tmp_path / "failed"), e.put, str(tmp_path / "done"))
    inbox.wait(inbox.drain(*args))
    assert e.get(objects[1][0]) == objects[1][1]
    assert spark.read.parquet(str(tmp_path / "failed")).count() == 1
    inbox.wait(inbox.drain(*args))  # nothing is taken twice
    done = spark.read.parquet(str(tmp_path / "done"))
    assert done.count() == 2
    assert inbox.pending(done.select("path", "root"), done).isEmpty()
    other, digest, _ = inbox.stage(folder, "r", objects[1][0], 3, codec.write_pack([codec.encode_record(*codec.blob(b"more"))]))
    inbox.commit(other, digest)
    q = inbox.drain(*args)
    name = f"file:{folder}/{digest.hex()}.pack"
    staged = lambda: spark.createDataFrame([(name, objects[1][0].hex().upper())], "path string, root string")
    inbox.wait_for(q, objects[1][0].hex().upper(), staged, lambda: spark.read.parquet(str(tmp_path / "done")))
    inbox.wait(q)
    assert inbox.pending(staged(), spark.read.parquet(str(tmp_path / "done"))).isEmpty() and e.has(codec.blob(b"more")[0])
