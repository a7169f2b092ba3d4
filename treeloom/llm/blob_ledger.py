"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed by the SHA-256 of its bytes. The ledger is a
table of (blob, rules) pairs that have been scanned, with what was found. A scan takes only the pairs
that the ledger lacks, appends them, and joins all findings of the wanted rule versions back to every
path that holds the blob.

A pair that two scans store at once, or one scan twice after a failure, counts once.

Defined cases: a null text is the empty text; a version without findings has an empty array; rows
that repeat are kept as often as they occur; an empty table gives an empty table; null paths stay
null. Other columns of the input are passed through only as `keys` names them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import scratch

# The three base kinds, in their order, and kinds that the ledger adds behind them.
BASE_KINDS = ("assign", "access", "hex")
RULES: dict[str, tuple[str, bool, int, int]] = {
    # kind: pattern, letters in either case, group whose length counts, least length of it
    "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", False, 0, 18),
    "hex": (r"[0-9a-f]+", False, 0, 16),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    "google": (r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 24),
    "stripe": (r"[rs]k_live_[A-Za-z0-9]+", False, 0, 32),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
}
FOUND = "array<struct<kind:string,start:int,end:int>>"


def compiled(rules: dict) -> list[tuple]:
    """(kind, pattern, group, least length) for scanning.

    A pattern that is one repeated class can ask for its least length at once: its runs are maximal,
    so the matches that pass are the same, and short runs cost no match object."""
    out = []
    for kind, (pattern, either, group, least) in rules.items():
        if m := re.fullmatch(r"(\[[^\]]+\])\+", pattern):
            pattern = f"{m[1]}{{{least},}}"
        out.append((kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if either else 0)), group, least))
    return out


def spans_of(text: str, scanners: list[tuple]) -> list[dict]:
    """All spans of one text by start, then by the order of the rules; code points, end exclusive."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(scanners):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end(), kind))
    found.sort()
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in found]


def rule_version(rules: dict) -> str:
    """Names a rule set by its content, so that a changed rule is a new version."""
    import hashlib

    return hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]


def ledger_frame(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; an unwritten ledger is empty."""
    schema = f"blob binary, rules string, found {FOUND}"
    if not scratch.exists(spark, ledger):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def scan(spark: SparkSession, versions: DataFrame, keys: list[str], text: str, ledger: str, rules: dict = RULES) -> DataFrame:
    """Scan what is unseen in `versions` and return keys, blob and found for every version.

    `ledger` is the folder of the ledger table, which grows by this call. The text of a blob moves
    once: one version of each unseen blob is chosen on narrow rows, the rest only by their address.
    """
    scratch.small_batches(spark)
    version = rule_version(rules)
    content = F.coalesce(F.col(text), F.lit(""))
    addressed = versions.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], content.alias("_text")).withColumn("blob", F.unhex(F.sha2("_text", 256)))
    seen = ledger_frame(spark, ledger).where(F.col("rules") == version).select("blob")
    # the shortest way to one text for each blob: the smallest key among its versions
    whole = F.struct(*[f"_k{i}" for i in range(len(keys))])
    least = F.min("_k0") if len(keys) == 1 else F.min(whole)  # of a plain column, a hash aggregate
    chosen = addressed.groupBy("blob").agg(least.alias("_k"))
    unseen = chosen.join(seen, "blob", "left_anti")
    picked = unseen.select(F.col("blob").alias("_b"), *[F.col("_k" if len(keys) == 1 else f"_k._k{i}").alias(f"_c{i}") for i in range(len(keys))])
    same = F.col("blob") == F.col("_b")
    for i in range(len(keys)):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_c{i}"))
    texts = addressed.join(picked.hint("shuffle_hash"), same, "left_semi").select("blob", "_text")

    def look(batches):
        scanners = compiled(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        seen_here = set()  # rows that repeat in every column meet in one partition
        for b in batches:
            keep, found = [], []
            for i, (blob, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if blob not in seen_here:
                    seen_here.add(blob)
                    keep.append(i)
                    found.append(spans_of(t, scanners))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(found, kind)], names=["blob", "found"])

    fresh = texts.mapInArrow(look, f"blob binary, found {FOUND}").withColumn("rules", F.lit(version))
    fresh.select("blob", "rules", "found").write.mode("append").parquet(ledger)
    # a scan that ran twice, or beside another, may have stored a pair twice: both hold the same
    known = ledger_frame(spark, ledger).where(F.col("rules") == version).where(F.size("found") > 0).dropDuplicates(["blob"])
    return join_back(addressed.drop("_text"), known, keys)


def join_back(addressed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of each blob at each of its paths."""
    at = addressed.join(known.select(F.col("blob").alias("_b"), "found"), F.col("blob") == F.col("_b"), "left")
    return at.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def digest(found: DataFrame, key: str) -> DataFrame:
    """Counts, the base spans' hash and all spans as text, from scan()'s result."""
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(key, *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", word), ",").alias("spans"))
