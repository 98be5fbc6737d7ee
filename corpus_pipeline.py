"""A corpus from raw documents to packed sequences, in stages.

Each stage takes what its predecessor kept, written as Parquet and read again, so a
stage that is lost is run anew from its predecessor's files alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.common import passing, scratch, table
from wayfarer.llm.near_text import near_text
from wayfarer.llm.packing import pack
from wayfarer.llm.quality import good_rows
from wayfarer.llm.queries import vocabulary
from wayfarer.llm.substring import without_repeats
from wayfarer.llm.toxicity import not_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity reaches 0.3 go.

    Each row is judged by its own text, so of rows that share an id only toxic ones
    go. Null, empty and blank texts get the share of toxic labels as their score, and
    rows with a null id are judged like all others. No rows give no rows.
    """
    return not_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality lies under 0.7 go.

    Each row is judged by its own text, so of rows that share an id only poor ones
    go. Null, empty and blank texts get the share of good labels as their score, and
    rows with a null id are judged like all others. No rows give no rows.
    """
    return good_rows(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies only rows with the smallest doc_id stay.

    Null, empty and blank texts are in no group and stay; so do rows with a null id,
    and all rows that repeat the smallest id. No rows give no rows.
    """
    gone = near_text(docs).where("not kept").select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_rejected"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller doc_id has are cut; every row stays.

    Null texts stay null. Rows with a null id lose nothing and take nothing; repeated
    rows lose the same words each. No rows give no rows.
    """
    return without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece and its place in a sequence of 1024 tokens.

    Null and empty texts are one piece with the end id alone. Rows with null or
    repeated ids are packed like all others. No rows give no pieces.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage writes for itself goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with passing(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
