"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.sources.shared import clean_scratch, passing, scratch
from wayfarer.sources.shared import settled as staged

__all__ = ["clean_scratch", "held_out", "passing", "scratch", "staged", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Just the id and the text, a null text as an empty one.

    Other columns, whatever their names, never meet the operators' own columns.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def held_out(doc_id: Column | str) -> Column:
    """Rows kept for evaluation: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
