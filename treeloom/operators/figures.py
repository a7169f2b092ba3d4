"""Figures of a benchmark report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_percentile(rows: DataFrame, group: list[str], value: str, parts: list[float]) -> DataFrame:
    """For each part q the element min(n - 1, floor(n * q)) of the sorted values, without interpolation.

    Values are counted first, so a group is as many rows as it has distinct values."""
    from pyspark.sql import Window

    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    up = F.sum("_n").over(Window.partitionBy(*group).orderBy(value))
    total = F.sum("_n").over(Window.partitionBy(*group))
    placed = counted.withColumn("_up", up).withColumn("_total", total)
    place = lambda q: F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(q)))
    return placed.groupBy(*group).agg(*[F.min(F.when(F.col("_up") > place(q), F.col(value))).alias(f"p{round(q * 100)}") for q in parts])


def windows(rows: DataFrame, place: str, value: str, size: Column | int = 100) -> DataFrame:
    """Means over consecutive groups of `size` rows by their place."""
    size = F.lit(size) if isinstance(size, int) else size
    return rows.groupBy(F.floor(F.col(place) / size).cast("long").alias("window")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
