"""The benchmark's phases at a small scale."""

import json

import numpy as np

from treeloom import phases


def test_noise_and_fill():
    a = phases.noise(5, 100_003)
    assert a == phases.noise(5, 100_003) and len(a) == 100_003 and a != phases.noise(6, 100_003)
    counts = np.bincount(np.frombuffer(a, np.uint8), minlength=256)
    assert counts.min() > 250 and counts.max() < 550
    assert phases.fill([5, 9, 3, 2], 10) == [0, 2, 3] and phases.fill([], 3) == []
    assert [phases.window(n) for n in (3, 30, 199, 200, 1000)] == [1, 6, 39, 100, 100]


def test_phases(spark, tmp_path):
    c = phases.Config(str(tmp_path / "bench"), refs=5, scale=0.01, segment=1 << 19)
    b = phases.Bench(spark, c)
    b.run(phases.PHASES[:2])
    r = phases.Bench(spark, c).run(phases.PHASES[2:])  # results are carried over
    assert r == json.load(open(b.results))
    assert len(r["ingest"]) == 5 and len(r["deletes"]) == 2
    assert sum(x["deduped"] for x in r["ingest"]) > 0 and sum(m["shared"] for m in r["manifests"]) > 0
    assert r["verify"]["complete"] == 3 and len(r["verify"]["restored"]) == 2 and r["verify"]["errors"] == []
    assert sum(x["compacted"] for x in r["cycles"]) > 0
    at = {s["label"]: s["bytes"] for s in r["snapshots"]}
    assert at["after forced gc"] <= at["after policy gc"] < at["after delete"]
    assert len(r["report"]) > 8 and any("reclaimed" in x for x in r["report"])
