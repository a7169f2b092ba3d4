"""Folds along an order in which each step depends on the one before, without one task for the whole order.

Rows are sorted once into parts that follow each other. Each part tells, for any state in which it might be
entered, the state that it would be left in; these answers are small, and going through them part by part gives
every part its real state. Then all parts fold their rows at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from treeloom.scratch import Scratch

PART = "_part"


def parts(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """df with _part, the number of the range that a row lies in; ranges follow the order. Written, so that they stay."""

    def number(batches):
        n = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n] * b.num_rows, pa.int32())], names=[*b.schema.names, PART])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return scratch.save(df.repartitionByRange(*order).mapInArrow(number, f"{kinds}, {PART} int"), "parts")


def each_part(numbered: DataFrame, order: list[str], fold: Callable, schema: str) -> DataFrame:
    """fold(part, rows as Arrow batches) over every part in order; yields batches."""

    def read(batches):
        def of(part, first):
            nonlocal ahead
            yield first
            for b in batches:
                ids = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                n = int((ids == part).sum())  # sorted by part
                if n:
                    yield b.slice(0, n)
                if n < b.num_rows:
                    ahead = b.slice(n)
                    return
            ahead = None

        ahead = next((b for b in batches if b.num_rows), None)
        while ahead is not None:
            ids = ahead.column(ahead.num_columns - 1).to_numpy(zero_copy_only=False)
            part, n = int(ids[0]), int((ids == ids[0]).sum())
            if n < ahead.num_rows:
                first, ahead = ahead.slice(0, n), ahead.slice(n)
                yield from fold(part, iter([first]))
            else:
                yield from fold(part, of(part, ahead))

    columns = [c for c in numbered.columns if c != PART]
    return numbered.repartition(PART).sortWithinPartitions(PART, *order).select(*columns, PART).mapInArrow(read, schema)
