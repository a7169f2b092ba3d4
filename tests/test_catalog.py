"""Every registered query against its SQL on the smallest tables."""

import hashlib

import duckdb
import pytest

from treeloom.plans import catalog
from treeloom.plans.catalog import QUERIES
from treeloom.plans.sql import SQL

D = "/root/testdata/sf0.001"
#: The cheaper ones here; the driver compares all.
SLOW = {"reachable_from_refs", "check_complete_missing", "why_key", "unreferenced_objects", "resolve_paths"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, tables, name):
    df = QUERIES[name](spark, D)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    want = tables.execute(SQL[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())


def test_records_and_packs_hold_whole_documents(spark, tmp_path, monkeypatch):
    texts = [None, "", "é", "short text", "same", "same", "word " * 40_000, "".join(chr(33 + i * i % 90) for i in range(30_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for t in texts]
    got = QUERIES["record_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ulen"], r["same"]) for r in got) == [(i, len(x), True) for i, x in enumerate(raw)]
    for most in (4 << 20, 100):  # in one pack and in many
        monkeypatch.setattr(catalog, "PACK_BYTES", most)
        got = QUERIES["pack_stream"](spark, str(tmp_path)).collect()
        assert sorted((r["ulen"], r["sha"], r["error"]) for r in got) == sorted((len(x), hashlib.sha256(x).hexdigest(), None) for x in raw)


#: Keys of large tables: their products lie on both sides of a long's greatest value.
LARGE = [(9_000_000, 1_200_000, 7), (9_000_000, 100_000, 1), (3_000_000_000, 1, 1), (2**40, 2**30, 7), (1, 1, 1), (31, 1, 1), (32, 1, 1), (181, 32, 1), (-5, 3, 1), (3, -5, 1), (9_000_000, -1_200_000, 7)]


def sizes_of_large_keys(spark, folder, name):
    spark.createDataFrame([(o, p, i, n) for i, (o, p, n) in enumerate(LARGE)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").repartition(2).write.parquet(f"{folder}/lineitem.parquet")
    got = QUERIES[name](spark, str(folder)).collect()
    shown = {o * o * p * n: None for o, p, n in LARGE}
    assert sorted((r["l_orderkey"], r["l_linenumber"]) for r in got) == sorted((o, n) for o, _, n in LARGE)
    return sorted(r["shown"] for r in got), list(shown)


def test_human_bytes_beyond_a_long(spark, tmp_path):
    def show(n):
        if n < 1024:
            return f"{n} B"
        power = next((p for p in range(1, 6) if n / 1024**p < 1023.95), 6)
        return f"{n / 1024**power:.1f} {'KMGTPE'[power - 1]}iB"

    got, sizes = sizes_of_large_keys(spark, tmp_path, "human_bytes")
    assert max(sizes) > 2**100 and min(sizes) < -(2**63) and got == sorted(map(show, sizes))


def test_human_bytes2_beyond_a_long(spark, tmp_path):
    def show(n):
        power = next((p for p in range(6, 0, -1) if n >= 1024**p), 0)
        return f"{n / 1024**power:.2f} {'KMGTPE'[power - 1]}iB" if power else f"{n} B"

    got, sizes = sizes_of_large_keys(spark, tmp_path, "human_bytes2")
    assert got == sorted(map(show, sizes))


def test_slow_queries_are_registered():
    assert set(SQL) >= SLOW
