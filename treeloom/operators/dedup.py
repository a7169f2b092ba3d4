"""Writes that skip what is stored, and membership of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """The objects to append: one a key, none that is stored. Keys are compared before payloads are touched."""
    return objects.join(stored.select("key"), "key", "left_anti").dropDuplicates(["key"])


def write_stats(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """stored, deduped and bytes_stored (uncompressed) of such a write; objects: key, ulen."""
    known = stored.select("key").distinct().withColumn("known", F.lit(True))
    keys = objects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ulen").alias("ulen")).join(known, "key", "left")
    new = F.col("known").isNull()
    return keys.agg(F.count_if(new).alias("stored"), (F.sum("n") - F.count_if(new)).cast("long").alias("deduped"), F.coalesce(F.sum(F.when(new, F.col("ulen"))), F.lit(0)).cast("long").alias("bytes_stored"))


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted keys that aren't stored, in their order and as often as asked for; wanted: ord, key."""
    return wanted.join(stored.select("key"), "key", "left_anti").orderBy("ord")


def has(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("key"), "key", "left_semi")


def has_outside(wanted: DataFrame, index: DataFrame, segment: int) -> DataFrame:
    """Wanted keys that another segment than the given one holds."""
    return wanted.join(index.where(F.col("segment_id") != segment).select("key"), "key", "left_semi")


def first_of_each(objects: DataFrame, order: str) -> DataFrame:
    """The first row of every key, with `dup`: how many more there are."""
    w = Window.partitionBy("key")
    return objects.withColumn("_first", F.min(order).over(w)).withColumn("dup", F.count(F.lit(1)).over(w) - 1).where(F.col(order) == F.col("_first")).drop("_first")
