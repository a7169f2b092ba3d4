"""A broadcast filter of ids, of a fixed size whatever the number of ids: no wanted id is missed, few others pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import wordhash
from treeloom.llm.scratch import small_batches

#: Cells of the filter: one bit each.
FILTER_BITS = 26


def id_filter(spark: SparkSession, ids: DataFrame, bits: int = FILTER_BITS):
    """A broadcast of 2**bits bits: set for each id (column k), and for few others."""
    low_bits = min(16, bits)

    def mark(batches):
        for b in batches:
            if b.num_rows:
                at = np.unique(filter_cells(b.column(0).to_numpy(zero_copy_only=False), bits))
                block = at >> low_bits
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                low = (at & ((1 << low_bits) - 1)).astype("<u2")
                parts = [low[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(at)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(parts, pa.binary())], names=["block", "cells"])

    def merge(batches):
        at, dense = None, None
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(dense).tobytes()], pa.binary())], names=["block", "cells"])
                    at, dense = block, np.zeros(1 << low_bits, bool)
                dense[np.frombuffer(part, "<u2")] = True
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(dense).tobytes()], pa.binary())], names=["block", "cells"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << low_bits) // 8
    merged = ids.select("k").mapInArrow(mark, "block int, cells binary").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, cells binary")
    for b in merged.toArrow().to_batches():  # a bit a cell: 8 MB
        for block, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            out[block * size : (block + 1) * size] = np.frombuffer(part, np.uint8)
    return spark.sparkContext.broadcast(out)


def filter_cells(ids: np.ndarray, bits: int) -> np.ndarray:
    return (wordhash.mix(ids.astype(np.int64).view(np.uint64) * wordhash.ODD) >> np.uint64(64 - bits)).astype(np.int64)


def passing(sent, ids: np.ndarray, bits: int) -> np.ndarray:
    """Where ids may be among those that the broadcast filter was made of."""
    at = filter_cells(ids, bits)
    return (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def split(spark: SparkSession, docs: DataFrame, key: str, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """docs without the rows whose key may be among ids (column k), and these rows: only they need to move.

    Rows with a null key are among the first."""
    small_batches(spark)
    sent, at = id_filter(spark, ids, bits), len(docs.columns)
    # a column of its own at the end, whatever type and name the key has
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{key}`").cast("long").alias("_" * (1 + max(map(len, docs.columns)))))

    def part(wanted: bool) -> DataFrame:
        def read(batches):
            for b in batches:
                k = b.column(at)
                may = np.zeros(b.num_rows, bool)
                may[k.is_valid().to_numpy(zero_copy_only=False)] = passing(sent, k.drop_null().to_numpy(), bits)
                yield pa.RecordBatch.from_arrays(b.columns[:at], names=b.schema.names[:at]).filter(pa.array(may == wanted))

        return rows.mapInArrow(read, docs.schema)

    return part(False), part(True)
