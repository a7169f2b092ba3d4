"""Per-worker caches and skew-safe ranks used by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.scratch import Scratch, exists, release, remove, root, small_batches

__all__ = ["Scratch", "exists", "rank", "release", "remove", "root", "small_batches", "worker_cache"]


def worker_cache() -> dict:
    """A dict that lives as long as a Python worker, over all tasks that it runs."""
    return sys.modules.setdefault("_treeloom_worker_cache", types.ModuleType("_treeloom_worker_cache")).__dict__


#: Chunks into which rank() deals each group; no task sorts more than a chunk of a group.
RANK_CHUNKS = 256


def rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, name: str, chunks: int = RANK_CHUNKS, then: Column | None = None) -> DataFrame:
    """Add `name`: a gapless number from 0 within each group, without gathering a group in one task.

    Rows are ordered by `order`, a few columns of bounded variety (may be empty), then by chunk of
    `spread`'s hash, then by `spread` and `then`. Chunk sizes are counted first (map-side combined) and turned
    into offsets by a window over at most chunks * variety rows per group; each chunk is then
    numbered on its own."""
    keys = [f"_o{i}" for i in range(len(order))]
    d = df.withColumns({k: c for k, c in zip(keys, order, strict=True)} | {"_chunk": F.pmod(F.xxhash64(spread, F.lit(11)), F.lit(chunks)).cast("int"), "_spread": spread, "_then": spread if then is None else then})
    at = [*group, *keys, "_chunk"]
    sizes = d.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy(*keys, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = d.withColumn("_at", F.row_number().over(Window.partitionBy(*at).orderBy("_spread", "_then")) - 1)
    starts = starts.select(*[F.col(c).alias(f"_s{c}") for c in at], "_start")
    on = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in at]
    joined = numbered.join(starts, on)
    return joined.withColumn(name, (F.col("_at") + F.col("_start")).cast("long")).select(*df.columns, name)
