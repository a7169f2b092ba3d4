"""Item runs of many ordered sequences at once: where a run ends depends on its own start alone.

The counter of a run begins anew behind each end, so this is a fold along a sequence and no window. Rows are
sorted by sequence and order into parts; a sequence that goes on in the next part has a state of one
number, the items of its open run, so each part tells what becomes of every such number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators import chains
from treeloom.scratch import Scratch


def bounds(bits: int) -> tuple[int, int]:
    """MinRun and MaxRun of an average of 2**bits."""
    return max((1 << bits) // 4, 2), (1 << bits) * 4


def hit(digest: Column, bits: int) -> Column:
    """Whether the low bits of the digest's first 8 bytes, little-endian, are all zero."""
    low = F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int")
    high = F.conv(F.hex(F.substring(digest, 2, 1)), 16, 10).cast("int")
    return (low + high * 256).bitwiseAND(F.lit((1 << min(bits, 16)) - 1)) == 0


def ends(hits: np.ndarray, least: int, most: int, held: int) -> np.ndarray:
    """Places behind which a run ends, if `held` items of an open run come before these."""
    at, out, start = np.flatnonzero(hits), [], -held
    while True:
        i = int(np.searchsorted(at, max(0, start + least - 1), "left"))
        end = min(int(at[i]) if i < len(at) else start + most - 1, start + most - 1)
        if end >= len(hits):
            return np.array(out, np.int64)
        out.append(end)
        start = end + 1


def leaving(hits: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of items held in front: how many runs end among these, and how many items are held behind."""
    known: dict[int, tuple[int, int]] = {}  # from a run's first place: runs that end, and items left

    def follow(start: int) -> tuple[int, int]:
        way = []
        while start not in known:
            found = first_end(start)
            if found is None:
                known[start] = (0, len(hits) - start)
                break
            way.append(start)
            start = found + 1
        n, left = known[start]
        for x in reversed(way):
            n += 1
            known[x] = (n, left)
        return n, left

    at = np.flatnonzero(hits)

    def first_end(start: int) -> int | None:
        i = int(np.searchsorted(at, max(0, start + least - 1), "left"))
        end = min(int(at[i]) if i < len(at) else start + most - 1, start + most - 1)
        return end if end < len(hits) else None

    out = np.array([follow(-held) for held in range(most)], np.int64)
    return out[:, 0], out[:, 1]


def number(items: DataFrame, sequence: str, order: str, hits: str, bits: int, carry: list[str] = []) -> DataFrame:  # noqa: B006  not changed
    """sequence, order, run (from 0) and the carried columns of every item."""
    least, most = bounds(bits)
    spark = items.sparkSession
    numbered = chains.parts(items.select(sequence, order, hits, *carry), [sequence, order], Scratch(spark, "runs"))
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}

    def sequences(rows):
        """(sequence, hits, rows) of one sequence after the other."""
        table = pa.Table.from_batches(list(rows)).combine_chunks()
        s = table.column(0).combine_chunks()
        codes = s.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        h = table.column(2).to_numpy()
        for i, j in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
            yield s[int(i)].as_py(), h[i:j].astype(bool), table.slice(int(i), int(j - i))

    def tell(part, rows):
        found = [(s, h) for s, h, _ in sequences(rows)]
        n, left = leaving(found[0][1], least, most)
        last = ends(found[-1][1], least, most, 0)
        behind = len(found[-1][1]) - (int(last[-1]) + 1 if len(last) else 0)
        yield pa.RecordBatch.from_pylist([{"part": part, "first": found[0][0], "last": found[-1][0], "only": len(found) == 1, "n": n.tobytes(), "left": left.tobytes(), "runs": len(last), "behind": behind}], pa.schema([("part", pa.int32()), ("first", kind), ("last", kind), ("only", pa.bool_()), ("n", pa.binary()), ("left", pa.binary()), ("runs", pa.int64()), ("behind", pa.int64())]))

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(items.schema[sequence].dataType)
    schema = f"part int, first {kinds[sequence]}, last {kinds[sequence]}, only boolean, n binary, left binary, runs long, behind long"
    entries, before = {}, None  # before: the sequence that the part in front ended in, its runs so far, the items held
    for r in chains.each_part(numbered, [sequence, order], tell, schema).orderBy("part").toLocalIterator():
        run, held = before[1:] if before is not None and before[0] == r["first"] else (0, 0)
        entries[r["part"]] = (run, held)
        if r["only"]:
            before = (r["last"], run + int(np.frombuffer(r["n"], np.int64)[held]), int(np.frombuffer(r["left"], np.int64)[held]))
        else:
            before = (r["last"], r["runs"], r["behind"])
    sent = spark.sparkContext.broadcast(entries)  # two numbers a part

    def fold(part, rows):
        run, held = sent.value[part]
        for _, h, table in sequences(rows):
            closed = ends(h, least, most, held)
            runs = run + np.searchsorted(closed, np.arange(len(h)), "left")
            for b in table.select([0, 1, *range(3, 3 + len(carry))]).append_column("run", pa.array(runs, pa.int64())).to_batches():
                yield pa.RecordBatch.from_arrays(b.columns, names=[sequence, order, *carry, "run"])
            run = held = 0

    return chains.each_part(numbered, [sequence, order], fold, "".join(f"`{c}` {kinds[c]}, " for c in (sequence, order, *carry)) + "run long")
