"""Folds along an order over many parts against the same fold row by row."""

import random

import numpy as np
import pytest

from treeloom.operators import listing, runs, segments


def folded(sizes, threshold, first=0):
    out, segment, pos, size = [], first, 0, segments.SEGMENT_HEADER
    for n in sizes:
        out.append((segment, pos, size))
        size, pos = size + segments.RECORD_HEADER + n, pos + 1
        if size >= threshold:
            segment, pos, size = segment + 1, 0, segments.SEGMENT_HEADER
    return out


@pytest.mark.parametrize("threshold,parts", [(500, 7), (5000, 1), (5000, 13), (60, 3), (10**9, 5), (20_000, 40)])
def test_segments(spark, threshold, parts):
    r = random.Random(threshold)
    sizes = [r.choice([0, 1, 40, 300, 3000]) for _ in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(3 * i, n) for i, n in enumerate(sizes)], "o long, n long").repartition(4)
        got = [tuple(x)[2:] for x in segments.assign(df, "o", "n", threshold, 5).orderBy("o").collect()]
        assert segments.assign(df.limit(0), "o", "n", threshold).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == folded(sizes, threshold, 5)


def test_exits_are_those_of_every_entry():
    r = np.random.default_rng(1)
    for full in (1, 50, 400, 10**6):
        before = np.r_[0, np.cumsum(r.integers(46, 200, 80))][:-1]
        table = segments.exits(before, full)
        for i in range(len(before)):
            at, n = i, 0
            while (j := max(int(np.searchsorted(before, before[at] + full)), at + 1)) < len(before):
                at, n = j, n + 1
            row = table[np.searchsorted(table[:, 0], before[i])]
            assert row[1:].tolist() == [before[at], at, n]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_runs(spark, parts):
    r = random.Random(parts)
    rows = [(s, i, r.random() < p) for s, n, p in (("hot", 1500, 0.1), ("none", 300, 0.0), ("all", 90, 1.0), ("b", 1, 0.5), ("c", 40, 0.3)) for i in range(n)]
    least, most = runs.bounds(3)
    want, at = {}, None
    for s, i, hit in rows:
        if s != at:
            at, run, n = s, 0, 0
        want[s, i] = run
        n += 1
        if n >= most or n >= least and hit:
            run, n = run + 1, 0
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "s string, i int, hit boolean").repartition(3)
        got = {(x["s"], x["i"]): x["run"] for x in runs.number(df, "s", "i", "hit", 3).collect()}
        assert runs.number(df.limit(0), "s", "i", "hit", 3).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_separators(spark):
    leaves = spark.createDataFrame([("a", None, "f", 0), ("a", "f", "m", 1), ("b", None, "z", 7)], "dir string, lo string, hi string, run int")
    names = [("a", "a"), ("a", "f"), ("a", "g"), ("a", "m"), ("a", "n"), ("b", "q"), ("c", "q"), ("a", "a")]
    got = listing.by_separator(spark.createDataFrame(names, "dir string, name string"), leaves)
    assert sorted((x["dir"], x["name"], x["run"]) for x in got.collect()) == [("a", "a", 0), ("a", "a", 0), ("a", "f", 0), ("a", "g", 1), ("a", "m", 1), ("b", "q", 7)]
