"""Reachability over edges(parent, child): rounds of joins until nothing new is found.

Each round's frontier and visited set are written to shared scratch, so plans stay short and a lost
executor costs a round at most. There are as many rounds as the tree is deep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.scratch import Scratch


def reachable(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """key and depth: every key that a root reaches, roots included, each once at its least depth."""
    scratch = Scratch(spark, "closure")
    edges = scratch.save(edges.select("parent", "child"), "edges")  # narrow, and read in every round
    frontier = scratch.save(roots.select("key").distinct().withColumn("depth", F.lit(0)), "seen")
    seen = frontier
    while not frontier.isEmpty():
        depth = F.max("depth") + 1
        below = frontier.join(edges.select(F.col("parent").alias("key"), "child"), "key").groupBy(F.col("child").alias("key")).agg(depth.alias("depth"))
        frontier = scratch.save(below.join(seen, "key", "left_anti"), "seen")
        seen = seen.unionByName(frontier)
    return seen


def reaching(spark: SparkSession, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key from which one of `keys` is reached."""
    return reachable(spark, edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), keys)


def incomplete(spark: SparkSession, edges: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """Keys that roots reach and that aren't stored. Nothing lies below a missing object."""
    stored = edges.join(objects.select(F.col("key").alias("parent")), "parent", "left_semi")
    return reachable(spark, stored, roots).join(objects.select("key"), "key", "left_anti").select("key")


def why(spark: SparkSession, edges: DataFrame, refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Names of the references whose tree holds one of the keys, in order."""
    return refs.join(reaching(spark, edges, keys).select("key"), "key", "left_semi").select("name").orderBy("name")


def resolve(entries: DataFrame, root: DataFrame, paths: DataFrame, depth: int, literal_dots: bool = False) -> DataFrame:
    """id, path, key and error of paths below a root by one join a component, at most `depth` of them.

    Empty components are skipped, and single dots too unless dots are literal names; then a parent
    component is refused as well."""
    entries = Scratch(paths.sparkSession, "resolve").save(entries.select("dir", "name", "key"), "entries")
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (F.lit(literal_dots) | (p != ".")))
    at = paths.withColumn("_parts", parts).crossJoin(F.broadcast(root.select(F.col("key").alias("_at")).limit(1)))
    refused = F.lit(not literal_dots) & F.array_contains("_parts", "..")
    at = at.withColumn("error", F.when(refused, "invalid path").when(F.size("_parts") > depth, "not found"))
    e = entries.select(F.col("dir").alias("_dir"), F.col("name").alias("_name"), F.col("key").alias("_next"))
    dirs = entries.select(F.col("dir").alias("_isdir")).distinct()
    for i in range(depth):
        todo = F.col("error").isNull() & (F.size("_parts") > i)
        name = F.when(todo, F.try_element_at("_parts", F.lit(i + 1)))
        at = at.withColumn("_want", name).join(e, (F.col("_at") == F.col("_dir")) & (F.col("_want") == F.col("_name")), "left").join(dirs, F.col("_at") == F.col("_isdir"), "left")
        error = F.when(F.col("_want").isNotNull() & F.col("_isdir").isNull(), "not a directory").when(F.col("_want").isNotNull() & F.col("_next").isNull(), "not found")
        at = at.withColumn("error", F.coalesce("error", error)).withColumn("_at", F.when(F.col("_want").isNotNull(), F.col("_next")).otherwise(F.col("_at"))).drop("_want", "_dir", "_name", "_next", "_isdir")
    return at.select("id", "path", F.when(F.col("error").isNull(), F.col("_at")).alias("key"), "error")
