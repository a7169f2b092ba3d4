"""The corpus pipeline: quality classifier, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. run() applies them in order, each written as Parquet in the
shared scratch folder and read again by the next. SQL can't express the classifier, so there is no
ORACLE_SQL; tests compare the other stages with brute force and the classifier with held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontam, lines, near_dup, pack, quality, queries
from treeloom.llm.scratch import Scratch

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores below the bound go.

    A null text is the empty text; equal rows get equal scores, so ties and repeats stay or go together; all
    stay if the labels lack a class; an empty table gives an empty table. All columns are kept, whatever
    their names."""
    model = quality.fit(spark, docs, queries.table(spark, sf_dir, "labels"))
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of the table
    scored = quality.score(spark, docs, model, (f"{own}content", f"{own}side", f"{own}score"))
    return scored.where(F.col(f"{own}score") >= quality.KEEP).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines, or of 13 words, or more go, and documents that this empties.

    Null and empty texts stay as they are; of equal runs the one with the smallest id, then line, stays; rows
    that repeat with their id are judged alike; rows without an id stay whole; n_chars is that of the new
    text; an empty table gives an empty table. All columns are kept, whatever their names."""
    out = lines.dedup(spark, docs, "doc_id", "text")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id. Five words, similarity 0.8.

    Texts that are null or without a word are near nothing and stay; rows that repeat with their id are one
    document; rows without an id stay; an empty table gives an empty table. All columns are kept, whatever
    their names."""
    return near_dup.keep_one(spark, docs, "doc_id", "text", words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage within its edit budget go.

    Null and empty texts contain none and stay; repeated rows and rows without an id are each judged; an empty
    table gives an empty table, and an empty benchmark leaves all. All columns are kept, whatever their names."""
    return decontam.clean(spark, docs, queries.table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids.

    A null text is the empty text, of which one piece with the end id is left; repeated rows are packed as often
    as they occur; an empty table gives an empty table. Other columns than doc_id and text are ignored."""
    return pack.pack(docs, "doc_id", "text", queries.tokenizer_path(), queries.END_ID, queries.LONGEST)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", lines_stage),
    ("minhash_near_dedup", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes once the next one is written."""
    docs, scratch, before = queries.table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
