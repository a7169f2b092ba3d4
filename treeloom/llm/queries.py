"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import blob_ledger, decontam, extract, lines, near_dup, pack, quality, scratch, shards, substring, topk

SHARDS = 16
END_ID = 2
LONGEST = 4096
TOP = 5


def tokenizer_path() -> str:
    """The public tokenizer's file; it is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 16 shards under the law of rows, equal texts linked."""
    return shards.digest(spark, table(spark, sf_dir, "documents"), SHARDS)


def op2_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.digest(extract.extract(table(spark, sf_dir, "pages"), "html"))


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each a path with one version, by a new ledger."""
    ledger = f"{scratch.Scratch(spark, 'ledger').path}/ledger"
    return blob_ledger.digest(blob_ledger.scan(spark, table(spark, sf_dir, "documents"), ["doc_id"], "text", ledger), "doc_id")


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: four words a shingle, similarity 0.8."""
    return near_dup.digest(near_dup.link(spark, table(spark, sf_dir, "documents"), "doc_id", "text", words=4, percent=80))


def op5_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; the digest needs no ids beside their checksum."""
    docs = table(spark, sf_dir, "documents")
    return pack.pack(docs, "doc_id", "text", tokenizer_path(), END_ID, LONGEST, ids=False).drop("ids")


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the co-trained classifier."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(spark, docs, quality.fit(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "content_score", "metadata_score", "score", (F.col("score") >= quality.KEEP).alias("kept"))


def op7_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain, with edits and place."""
    return decontam.contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op9_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of runs of three lines, or of 13 words, or more."""
    docs = table(spark, sf_dir, "documents")
    return lines.dedup(spark, docs.select("doc_id", "text"), "doc_id", "text")


def op8_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of windows of 13 that start in an earlier document too."""
    return substring.digest(substring.dedup(spark, table(spark, sf_dir, "documents"), "doc_id", "text", 13))


def op10_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other rows for each row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", TOP)


QUERIES = {f.__name__: f for f in (op1_label_propagation, op2_tree_scoring, op3_blob_ledger, op4_minhash_bayes, op5_power_of_two, op6_co_training, op7_qgram_bands, op8_count_min, op9_winnowed_lines, op10_no_random_access)}
