"""Content-defined chunking of bytes.

The published UltraCDC algorithm: a window of eight bytes slides over the data, its Hamming distance
to a pattern decides where a chunk ends, and a run of equal windows ends one too. Boundaries follow
content, so an insertion moves few of them. Other implementations may place boundaries elsewhere."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the published algorithm.
PATTERN = 0xAA
MASK_BEFORE, MASK_BEHIND = 0x2F, 0x2C
LOW_ENTROPY_RUN = 64


@dataclass(frozen=True)
class Sizes:
    least: int = 2 << 10
    normal: int = 10 << 10
    most: int = 64 << 10

    def __post_init__(self):
        if not 8 <= self.least < self.normal < self.most:
            raise ValueError("sizes must be 8 <= least < normal < most")


DISTANCE = np.array([bin(x ^ PATTERN).count("1") for x in range(256)], np.uint8)
BLOCK = 1 << 17


def over_eight(x: np.ndarray, join: np.ufunc) -> np.ndarray:
    """Eight neighbours joined, from each place on."""
    for step in (1, 2, 4):
        x = join(x[:-step], x[step:])
    return x


class Cuts:
    """Where windows of some data end a chunk, worked out for all places at once."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.n = len(raw)
        before, behind, equal = [], [], []
        for i in range(0, max(0, self.n - 7), BLOCK):  # blocks that stay in the CPU's cache
            distance = over_eight(DISTANCE[raw[i : i + BLOCK + 7]], np.add)
            before.append(np.flatnonzero(distance & MASK_BEFORE == 0) + (i + 8))
            behind.append(np.flatnonzero(distance & MASK_BEHIND == 0) + (i + 8))
            later = raw[i + 8 : i + BLOCK + 15]
            equal.append(over_eight(later == raw[i : i + len(later)], np.logical_and))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        #: Ends of the windows whose distance ends a chunk, before and behind the normal size.
        self.before, self.behind = join(before, np.int64), join(behind, np.int64)
        #: Whether the eight bytes from place i + 8 equal the eight before.
        self.equal = join(equal, bool)

    def end(self, start: int, sizes: Sizes) -> int:
        """Where the chunk that starts at `start` ends.

        Places are looked at in steps of eight from the least size on; a step whose bytes equal the step's before
        counts as low entropy and ends nothing, unless so many of them follow each other."""
        n = min(self.n - start, sizes.most)
        first = sizes.least + 8
        steps = (n - first) // 8  # as many whole steps as fit behind the first window
        if n <= sizes.least or steps <= 0:
            return start + n
        base = start + first
        equal = self.equal[base - 8 : base - 8 + 8 * steps : 8]
        last = steps
        if equal.any():
            run = np.flatnonzero(np.convolve(equal, np.ones(LOW_ENTROPY_RUN, np.int64), "valid") == LOW_ENTROPY_RUN) if steps >= LOW_ENTROPY_RUN else ()
            last = int(run[0]) + LOW_ENTROPY_RUN - 1 if len(run) else steps
        normal = min(max(0, -(-(min(n, sizes.normal) - first) // 8)), last)  # steps that begin before the normal size
        for places, lo, hi in ((self.before, 0, normal), (self.behind, normal, last)):
            i, j = np.searchsorted(places, (base + 8 * lo, base + 8 * hi))
            found = places[i:j]
            if len(found) and equal.any():
                found = found[~equal[(found - base) // 8]]
            if len(found):
                return int(found[0])
        return base + 8 * last + 8 if last < steps else start + n


def chunks(data: bytes, sizes: Sizes = Sizes()) -> list[bytes]:  # noqa: B008  frozen
    """The chunks of data in order; none of empty data."""
    out, at, cuts = [], 0, Cuts(data)
    while at < len(data):
        end = cuts.end(at, sizes)
        out.append(data[at:end])
        at = end
    return out


def split(contents: DataFrame, key: str, content: str, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """key, ord, chunk: every content's chunks."""

    def read(batches):
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for k, data in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                parts = chunks(bytes(data or b""), sizes)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(parts), kind), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=[key, "ord", "chunk"])

    return contents.select(key, content).mapInArrow(read, f"`{key}` {contents.schema[key].dataType.simpleString()}, ord int, chunk binary")
