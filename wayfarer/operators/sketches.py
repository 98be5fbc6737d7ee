"""Percentiles from sketches of bounded size that merge, in place of sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of the largest level of a sketch. The rank of what it gives is off by more than ``rank_error`` once in a hundred times.
K = 800


def rank_error(k: int = K) -> float:
    """How far the rank of a percentile may be off, as a share of all values, with 99 % confidence."""
    return 2.296 / k**0.9723


def sketched(df: DataFrame, groups: list[str], value: str, k: int = K) -> DataFrame:
    """(groups, sketch, n): a few kilobytes for each group, however many its values are.

    Tasks sketch their own rows and only sketches are shuffled. Null and NaN values are
    left out; a group without any other has no row.
    """
    v = F.col(value).cast("double")
    made = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups)
    return made.agg(F.kll_sketch_agg_double(v, k).alias("sketch"), F.count("*").alias("n"))


def merged(sketches: DataFrame, groups: list[str], k: int = K) -> DataFrame:
    """Sketches of finer groups, or of earlier and later rows, as those of coarser groups."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def percentile(share: float) -> Column:
    """The value below which about this share of a sketch's values lies."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def percentiles(sketches: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(groups, n, share, value): one row for each group and share."""
    rows = F.array(*[F.struct(F.lit(s).alias("share"), percentile(s).alias("value")) for s in shares])
    return sketches.select(*groups, "n", F.explode(rows).alias("p")).select(*groups, "n", "p.*")
