"""Sharding by balanced label propagation.

Every document starts in a shard of its own hash. In each round a join brings the shards of linked
documents to a document; it wants the shard that most of them are in. Documents whose id is smaller
than all they are linked with are anchors. They and the others never move in the same round, so labels
flow outward and don't swap; an anchor moves only where its followers weren't let in. A shard takes no
more than its quota has room for: applicants are ranked by how much they gain and by whom they follow. As many
as want to go from one shard to another as from there to here change places; the others are let in while
there is room, and those beyond it stay and ask again in the next round.

At the end the least attached documents beyond a quota and all documents without links fill the
shards up, so that under the law `rows` counts differ by one at most.

Links must have a bounded degree: link_groups() joins equal documents by a tree of hubs, not by all
pairs or one star.

Defined cases: digest() takes a null text as the empty text, and numbers rows, so that repeated rows and
null ids are rows like others; shard() takes ids that are unique, and null ids have no links; no links
leave an even deal by hash; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.scratch import Scratch, rank

#: Hubs that a group of equal documents is dealt to; each is linked to the group's first document.
HUBS = 1024


def link_groups(docs: DataFrame, key: str, group: str, hubs: int = HUBS) -> DataFrame:
    """Links a, b that join all documents of a group by a tree of depth two.

    Each document is linked to the smallest of its hash part of the group, and each of these to the
    smallest of all, so no document has more links than its part's size plus the number of parts."""
    part = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(hubs))
    d = docs.select(F.col(key).alias("_id"), F.col(group).alias("_g"), part.alias("_p")).where(F.col("_id").isNotNull() & F.col("_g").isNotNull())
    hub = d.groupBy("_g", "_p").agg(F.min("_id").alias("_hub"), F.count(F.lit(1)).alias("_n"))
    first = hub.groupBy("_g").agg(F.min("_hub").alias("_first"), F.sum("_n").alias("_n")).where("_n > 1").select("_g", "_first")
    up = hub.select("_g", "_hub").join(first, "_g").where(F.col("_hub") != F.col("_first")).select(F.col("_hub").alias("a"), F.col("_first").alias("b"))
    leaf = d.join(hub.where("_n > 1").select("_g", "_p", "_hub"), ["_g", "_p"]).where(F.col("_id") != F.col("_hub")).select(F.col("_id").alias("a"), F.col("_hub").alias("b"))
    return up.unionByName(leaf)


def shard(spark: SparkSession, docs: DataFrame, links: DataFrame, key: str, shards: int, rounds: int = 6) -> DataFrame:
    """key, shard and slot of every row of docs; links has a and b, ids of linked documents."""
    scratch = Scratch(spark, "shards")
    ids = scratch.save(docs.select(F.col(key).alias("_id")), "ids")
    edges = links.where(F.col("a") != F.col("b"))
    edges = scratch.save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = ids.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked = edges.select(F.col("a").alias("_id")).distinct()
    start = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(shards)).cast("int")
    labels = scratch.save(linked.select("_id", start.alias("shard"), F.lit(0).cast("long").alias("kept"), F.lit(None).cast("int").alias("denied"), F.col("_id").alias("hub")), "labels")
    quotas = spark.createDataFrame(list(enumerate(quota)), "want int, quota long")
    for round_ in range(rounds):
        anchors = round_ >= 2 and round_ % 2 == 0
        # what neighbours hold, counted by document and shard
        votes = edges.join(labels.select(F.col("_id").alias("b"), F.col("shard").alias("want")), "b").groupBy("a", "want").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))
        here = labels.select(F.col("_id").alias("a"), "shard")
        top = votes.join(here, "a").groupBy("a", "shard").agg(
            F.max(F.struct(F.col("n"), (F.col("want") == F.col("shard")).alias("stay"), (-F.col("least")).alias("low"), F.col("want"))).alias("top"),
            F.sum(F.when(F.col("want") == F.col("shard"), F.col("n")).otherwise(0)).alias("kept"),
            F.min("least").alias("least"),
        )
        wish = scratch.save(top.select(F.col("a").alias("_id"), "shard", "kept", F.col("top.want").alias("want"), F.col("top.n").alias("n"), "least"), "wish")
        moving = wish.where((F.col("want") != F.col("shard")) & (F.col("n") > F.col("kept")) & ((F.col("least") > F.col("_id")) if anchors else (F.col("least") < F.col("_id"))))
        held = wish.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
        gain = F.least(F.col("n") - F.col("kept"), F.lit(3)).cast("int")
        asking = rank(moving.select("_id", "shard", "want", gain.alias("gain"), "least"), ["shard", "want"], [-F.col("gain")], F.col("least"), "pair", then=F.col("_id"))
        asking = scratch.save(asking, "asking")
        # as many as want to go the other way change places, whatever room there is
        way = asking.groupBy("shard", "want").agg(F.count(F.lit(1)).alias("n"))
        back = way.select(F.col("want").alias("shard"), F.col("shard").alias("want"), F.col("n").alias("back"))
        change = way.join(back, ["shard", "want"]).select("shard", "want", F.least("n", "back").alias("change"))  # a row two shards at most
        judged = asking.join(F.broadcast(change), ["shard", "want"], "left").withColumn("swaps", F.col("pair") < F.coalesce("change", F.lit(0)))
        queue = rank(judged.where("not swaps").select("_id", "want", "gain", "least"), ["want"], [-F.col("gain")], F.col("least"), "place", then=F.col("_id"))
        room = quotas.join(held.withColumnRenamed("shard", "want"), "want", "left").select("want", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
        let_in = queue.join(F.broadcast(room), "want").where(F.col("place") < F.col("room")).select("_id", F.col("want").alias("to"))
        granted = judged.where("swaps").select("_id", F.col("want").alias("to")).unionByName(let_in)
        alone = F.col("to").isNull() & (F.col("kept") == 0) & (F.col("want") != F.col("shard"))
        moved = wish.join(granted, "_id", "left").select(
            "_id", F.coalesce("to", "shard").alias("shard"), F.when(F.col("to").isNull(), F.col("kept")).otherwise(F.col("n")).alias("kept"), F.when(alone, F.col("want")).alias("denied"), F.least("least", "_id").alias("hub")
        )
        before, labels = labels, scratch.save(moved, "labels")
        scratch.drop(before, wish, asking)
    return settle(spark, scratch, ids, labels, quota)


def settle(spark: SparkSession, scratch: Scratch, ids: DataFrame, labels: DataFrame, quota: list[int]) -> DataFrame:
    """Exact counts: what a full shard kept away from all its links, what exceeds a quota (least attached
    first) and what has no links fill the shards up, linked documents by their hub and largest gaps first."""
    shards = len(quota)
    placed = rank(labels.where("denied is null"), ["shard"], [-F.least(F.col("kept"), F.lit(3)).cast("int")], F.col("hub"), "place", then=F.col("_id"))
    limits = spark.createDataFrame(list(enumerate(quota)), "shard int, quota long")
    stays = scratch.save(placed.join(F.broadcast(limits), "shard").where(F.col("place") < F.col("quota")).select("_id", "shard"), "stays")
    held = {r["shard"]: r["n"] for r in stays.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    starts, at = [], 0
    for lack, s in sorted(((quota[s] - held.get(s, 0), s) for s in range(shards)), reverse=True):
        starts.append((s, at, at + lack))
        at += lack
    pool = ids.join(stays, "_id", "left_anti").join(labels.select("_id", "denied", "hub"), "_id", "left")
    rest = rank(pool, [], [F.coalesce("denied", F.lit(shards))], F.coalesce("hub", "_id"), "place", then=F.col("_id"))
    gaps = spark.createDataFrame(starts, "shard int, lo long, hi long")
    filled = rest.join(F.broadcast(gaps), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("_id", "shard")
    return rank(stays.unionByName(filled), ["shard"], [], F.col("_id"), "slot")


def digest(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """The shards of rows whose equal texts are linked, under the law of rows.

    Rows are numbered when they are written down once; shards are dealt to these numbers, so rows that
    repeat or have no id have a shard and a slot each."""
    content = F.coalesce("text", F.lit(""))
    scratch = Scratch(spark, "sharded")
    narrow = docs.select("doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.unhex(F.md5(content.cast("binary"))).alias("group"))
    narrow = scratch.save(narrow.withColumn("row", F.monotonically_increasing_id()), "narrow")
    placed = shard(spark, narrow, link_groups(narrow, "row", "group"), "row", shards)
    out = narrow.drop("group").join(placed.withColumnRenamed("_id", "row"), "row")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
