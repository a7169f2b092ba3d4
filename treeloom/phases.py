"""A benchmark of the engine in phases: generate, ingest, delete, collect garbage, verify, report.

Trees are made from a seed. Of ten references three are kept and seven deleted; kept trees are larger, and each
tree copies about a third of its fresh bytes from the one before, so a quarter of what is ingested is there already.
Results are carried from phase to phase in one JSON file.

    python -m treeloom.phases FOLDER --refs 30 --scale 0.1 [--phase ingest]
"""

from __future__ import annotations

import argparse
import filecmp
import json
import os
import random
import shutil
import time
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import SparkSession

from treeloom.engine import Engine, Incomplete, NotFound, Options
from treeloom.operators import cdc

MIB = 1 << 20
# Fixed values of the data set: MiB of fresh bytes by class, sizes of files, and chunk sizes.
KEPT_MIB, DELETED_MIB = 100, 30
LEAST_FILE, MOST_FILE = 256 << 10, 4 << 20
SIZES = cdc.Sizes(32 << 10, 128 << 10, 256 << 10)
PHASES = ("gen", "ingest", "delete", "gc", "verify", "report")


@dataclass
class Config:
    folder: str
    refs: int = 1000
    scale: float = 1.0
    segment: int = 256 * MIB
    seed: int = 1


def kept(i: int) -> bool:
    return i % 10 < 3


def noise(seed: int, n: int, lanes: int = 512) -> bytes:
    """n bytes that don't compress: xorshift64* generators side by side, each from a seed of its own."""
    x = np.random.SeedSequence(seed).generate_state(lanes, np.uint64) | np.uint64(1)
    out = np.empty((-(-n // (8 * lanes)), lanes), np.uint64)
    for row in out:
        x ^= x >> np.uint64(12)
        x ^= x << np.uint64(25)
        x ^= x >> np.uint64(27)
        np.multiply(x, np.uint64(0x2545F4914F6CDD1D), out=row)
    return out.tobytes()[:n]


def fill(sizes: list[int], room: int) -> list[int]:
    """Places of the sizes that fit one after the other, none of which overshoots."""
    out = []
    for i, n in enumerate(sizes):
        if n <= room:
            out.append(i)
            room -= n
    return out


class Bench:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.c = spark, config
        self.engine = Engine(spark, f"file://{os.path.abspath(config.folder)}/store", Options(config.segment, SIZES))
        self.results = os.path.join(config.folder, "results.json")

    def load(self) -> dict:
        if not os.path.exists(self.results):
            return {"config": asdict(self.c)}
        with open(self.results) as f:
            return json.load(f)

    def tree(self, i: int) -> str:
        return os.path.join(self.c.folder, "data", f"ref-{i:04}")

    def run(self, phases=PHASES) -> dict:
        os.makedirs(self.c.folder, exist_ok=True)
        r = self.load()
        for p in phases:
            start = time.perf_counter()
            getattr(self, p)(r)
            r.setdefault("seconds", {})[p] = round(time.perf_counter() - start, 3)
            with open(self.results, "w") as f:
                json.dump(r, f)
        return r

    def gen(self, r: dict) -> None:
        before: list[tuple[str, int]] = []
        r["manifests"], smaller = [], min(1.0, 4 * self.c.scale)  # so that small trees have several files too
        for i in range(self.c.refs):
            g = random.Random(self.c.seed * 1_000_003 + i)
            os.makedirs(self.tree(i), exist_ok=True)
            left = fresh = int((KEPT_MIB if kept(i) else DELETED_MIB) * MIB * self.c.scale)
            files = []
            while left > 0:
                n = min(left, g.randint(int(LEAST_FILE * smaller), int(MOST_FILE * smaller)))
                path = os.path.join(self.tree(i), f"f{len(files):05}")
                with open(path, "wb") as f:
                    f.write(noise(g.getrandbits(62), n))
                files.append((path, n))
                left -= n
            g.shuffle(before)
            shared = 0
            for at in fill([n for _, n in before], fresh // 3):
                path, n = before[at]
                shutil.copyfile(path, os.path.join(self.tree(i), f"c{at:05}"))
                shared += n
            r["manifests"].append({"kept": kept(i), "files": len(os.listdir(self.tree(i))), "fresh": fresh, "shared": shared})
            before = files

    def ingest(self, r: dict) -> None:
        r["ingest"] = []
        for i in range(self.c.refs):
            t0 = time.perf_counter()
            root, stats = self.engine.ingest(self.tree(i))
            t1 = time.perf_counter()
            self.engine.ref_set(f"ref-{i:04}", root)
            r["ingest"].append({"root": root.hex(), "build": t1 - t0, "put": time.perf_counter() - t1, "stored": stats.stored, "deduped": stats.deduped, "bytes": stats.bytes_stored})
        self.snapshot(r, "after ingest")

    def delete(self, r: dict) -> None:
        took = []
        for i in range(self.c.refs):
            if not kept(i):
                t = time.perf_counter()
                self.engine.ref_rm(f"ref-{i:04}")
                took.append(time.perf_counter() - t)
        r["deletes"] = took
        self.snapshot(r, "after delete")

    def gc(self, r: dict) -> None:
        r["cycles"] = []
        for label, line in (("policy", -1), ("forced", 0)):
            t = time.perf_counter()
            stats = self.engine.gc_run(line)
            r["cycles"].append({"label": label, "seconds": time.perf_counter() - t} | stats)
            self.snapshot(r, f"after {label} gc")

    def snapshot(self, r: dict, label: str) -> None:
        top = os.path.join(self.c.folder, "store", "objects")
        used = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
        segments = self.engine.index().select("segment_id").distinct().count()
        r.setdefault("snapshots", []).append({"label": label, "bytes": used, "segments": segments})

    def verify(self, r: dict) -> None:
        complete, errors, same = 0, [], []
        which = [i for i in range(self.c.refs) if kept(i)]
        for i in range(self.c.refs):
            root = bytes.fromhex(r["ingest"][i]["root"])
            try:
                if kept(i):
                    self.engine.check_complete(root)
                    complete += 1
                else:
                    self.engine.ref_get(f"ref-{i:04}")
                    errors.append(f"ref-{i:04} is still there")
            except Incomplete as e:
                errors.append(f"ref-{i:04} lacks {e}")
            except NotFound:
                pass
        for i in dict.fromkeys((which[0], which[-1])):
            out = os.path.join(self.c.folder, f"restored-{i:04}")
            self.engine.restore(f"ref:ref-{i:04}", out)
            names = sorted(os.listdir(self.tree(i)))
            if sorted(os.listdir(out)) == names and filecmp.cmpfiles(self.tree(i), out, names, shallow=False)[0] == names:
                same.append(f"ref-{i:04}")
            else:
                errors.append(f"ref-{i:04} differs")
            shutil.rmtree(out)
        r["verify"] = {"complete": complete, "restored": same, "errors": errors}

    def report(self, r: dict) -> None:
        r["report"] = lines(r)


def element(values: list[float], part: float) -> float:
    """The element that many parts of the sorted values lie in front of."""
    v = sorted(values)
    return v[min(len(v) - 1, int(len(v) * part))]


def window(n: int) -> int:
    """References that one line of the report sums up: a fifth of fewer than 200."""
    return 100 if n >= 200 else max(1, n // 5)


def lines(r: dict) -> list[str]:
    m, x = r["manifests"], r["ingest"]
    logical = sum(a["fresh"] + a["shared"] for a in m)
    wall = sum(a["build"] + a["put"] for a in x)
    stored = sum(a["bytes"] for a in x)
    out = [
        f"data: {len(m)} references, {sum(a['files'] for a in m)} files, {logical / MIB:.1f} MiB, of which {100 * sum(a['shared'] for a in m) / logical:.1f} % copied",
        f"ingest: {logical / MIB / wall:.2f} MiB/s, new bytes {stored / MIB / wall:.2f} MiB/s, {len(x) / wall:.3f} references/s, {100 * (1 - stored / logical):.1f} % deduplicated",
    ]
    for name, which in (("kept", True), ("deleted", False)):
        took = [1000 * (a["build"] + a["put"]) for a, b in zip(x, m, strict=True) if b["kept"] == which]
        if took:
            out.append(f"per reference, {name}: median {element(took, 0.5):.0f} ms, p95 {element(took, 0.95):.0f} ms, most {max(took):.0f} ms")
    puts = [1000 * a["put"] for a in x]
    out.append(f"reference put: median {element(puts, 0.5):.0f} ms, p95 {element(puts, 0.95):.0f} ms, most {max(puts):.0f} ms; first 100 {element(puts[:100], 0.5):.0f} ms, last 100 {element(puts[-100:], 0.5):.0f} ms")
    size = window(len(x))
    for i in range(0, len(x), size):
        part = slice(i, i + size)
        took = sum(a["build"] + a["put"] for a in x[part])
        out.append(f"references {i} to {min(i + size, len(x)) - 1}: {sum(a['fresh'] + a['shared'] for a in m[part]) / MIB / took:.2f} MiB/s")
    if r.get("deletes"):
        out.append(f"delete: {1000 * sum(r['deletes']) / len(r['deletes']):.0f} ms a reference")
    for c in r.get("cycles", []):
        out.append(f"gc, {c['label']}: {c['seconds']:.1f} s, {c['compacted']} of {c['scanned']} segments, {c['copied_bytes'] / MIB:.1f} MiB copied, {c['freed_bytes'] / MIB:.1f} MiB freed")
    at = {s["label"]: s["bytes"] for s in r.get("snapshots", [])}
    nominal = sum(a["fresh"] for a in m if not a["kept"])
    for label in ("policy", "forced"):
        if f"after {label} gc" in at and nominal:
            freed = at["after delete"] - at[f"after {label} gc"]
            out.append(f"reclaimed by {label}: {freed / MIB:.1f} MiB, {100 * freed / nominal:.0f} % of the bytes that only deleted references held")
    v = r.get("verify")
    if v:
        out.append(f"verify: {v['complete']} of {sum(a['kept'] for a in m)} kept references complete, {len(v['restored'])} restored alike, {len(v['errors'])} errors")
    return out


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("folder")
    p.add_argument("--refs", type=int, default=1000)
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--phase", choices=PHASES, action="append")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    r = Bench(spark, Config(a.folder, a.refs, a.scale)).run(a.phase or PHASES)
    print("\n".join(r.get("report", [])))


if __name__ == "__main__":
    main()
