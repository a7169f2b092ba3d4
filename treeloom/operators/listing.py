"""Directory pages, point lookups and specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import display


def page(entries: DataFrame, after: str, limit: int) -> DataFrame:
    """The first entries of a directory behind a name, in order, with `more`: whether others follow."""
    if limit <= 0:
        raise ValueError("a page's limit must be positive")
    ahead = entries.where(F.col("name") > after).orderBy("name").limit(limit + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    numbered = ahead.withColumn("_n", n).withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")))
    return numbered.where(F.col("_at") <= limit).withColumn("more", F.col("_n") > limit).drop("_n", "_at")


def out_of_order(entries: DataFrame) -> DataFrame:
    """Entries whose name doesn't come after the one before; entries: dir, ord, name."""
    before = F.lag("name").over(Window.partitionBy("dir").orderBy("ord"))
    return entries.withColumn("before", before).where(F.col("name") <= F.col("before"))


def by_separator(wanted: DataFrame, leaves: DataFrame) -> DataFrame:
    """The leaf that may hold each wanted name: the first whose greatest name isn't below it.

    leaves: dir, lo (greatest name of the leaf before, null of the first), hi and key. Names and leaves of a
    directory are read once together, from the last name to the first, with the leaf behind at hand."""
    inside = [c for c in leaves.columns if c != "dir"]
    asked = [c for c in wanted.columns if c != "dir"]
    leaf, ask = F.struct(*inside).alias("_leaf"), F.struct(*asked).alias("_ask")
    both = leaves.select("dir", F.col("hi").alias("_at"), leaf).unionByName(wanted.select("dir", F.col("name").alias("_at"), ask), allowMissingColumns=True)
    behind = Window.partitionBy("dir").orderBy(F.desc("_at"), F.col("_leaf").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_leaf", ignorenulls=True).over(behind)).where(F.col("_ask").isNotNull() & F.col("_found").isNotNull())
    return found.select("dir", "_ask.*", "_found.*")


def parse_spec(spec: Column) -> Column:
    """struct(kind, name, path) of `KEY[/PATH]` or `ref:NAME[@PATH]`; kind is null of what is neither."""
    ref = spec.startswith("ref:")
    body = F.substr(spec, F.lit(5))
    key = F.lower(F.regexp_extract(spec, r"^([0-9a-fA-F]{64})(?:/|$)", 1))
    at = F.instr(body, "@")
    name = F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body)
    path = F.when(at > 0, F.substr(body, at + 1)).otherwise("")
    return F.when(ref, F.struct(F.lit("ref").alias("kind"), name.alias("name"), path.alias("path"))).when(key != "", F.struct(F.lit("key").alias("kind"), key.alias("name"), F.substr(spec, F.lit(66)).alias("path")))


def lines(entries: DataFrame, now: Column, keys: bool = False) -> DataFrame:
    """Listing lines: mode, uid, gid, size, mtime and name, numbers right-aligned over the listing.

    entries: name, mode, uid, gid, size (text), mtime (timestamp), target and key (hex), both nullable. The widths
    are one row for the whole listing, broadcast to all lines; other columns pass."""
    width = entries.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(f"_{c}") for c in ("uid", "gid", "size")])
    padded = {c: F.lpad(F.col(c).cast("string"), F.col(f"_{c}"), F.lit(" ")) for c in ("uid", "gid", "size")}
    name = F.concat("name", F.when(F.length("target") > 0, F.concat(F.lit(" -> "), "target")).otherwise(""))
    if keys:
        name = F.concat(name, F.when(F.col("key").isNotNull(), F.concat(F.lit(" "), "key")).otherwise(""))
    line = F.concat_ws(" ", display.mode_string(F.col("mode")), padded["uid"], padded["gid"], padded["size"], display.mtime(F.col("mtime"), now), name)
    return entries.crossJoin(F.broadcast(width)).withColumn("line", line).drop("_uid", "_gid", "_size")
