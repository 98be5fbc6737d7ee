"""Vectors as arrays: scalar functions that stay in the JVM, and grouped means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Of length 1; a vector shorter than 1e-12 is divided by that."""
    # The length is an array of one, so that it is computed once and not for each element.
    length = F.array(F.greatest(norm(a), F.lit(1e-12)))
    return F.flatten(F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def clamped(x: Column) -> Column:
    """Within 0 and 1; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def match_score(a: Column, b: Column) -> Column:
    """1 minus cosine distance, within 0 and 1."""
    return clamped(cosine(a, b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(a, lambda x: F.exp(x - top) / total)


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == i).cast("double"))


def linear(a: Column, weights: list[list[float]], bias: list[float]) -> Column:
    return F.array(*[dot(a, F.array(*map(F.lit, row))) + F.lit(b) for row, b in zip(weights, bias, strict=True)])


def attended(scores: Column, values: Column, n: Column) -> Column:
    """The mean of the first ``n`` values, weighted by the softmax of their scores; later steps are masked."""
    weights = softmax(F.slice(scores, 1, n))
    return F.aggregate(F.zip_with(weights, F.slice(values, 1, n), lambda w, v: w * v), F.lit(0.0), lambda s, x: s + x)


def last_valid(values: Column, n: Column) -> Column:
    """The last step that isn't masked; null if there is none."""
    return F.when(n > 0, F.try_element_at(values, n))


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def mean_vectors(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """The mean of ``vec`` for each key, or the weighted one; as ``mean``.

    Sums are formed for each key and place, partially before the shuffle, so a key
    with very many vectors never meets in one task. Negative weights count as none,
    and a total weight below 1e-6 as that.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    long = df.select(*keys, w.alias("w"), F.posexplode(vec).alias("place", "x"))
    sums = long.groupBy(*keys, "place").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"), F.sum("w").alias("w"))
    each = sums.select(*keys, F.struct("place", (F.col("s") / F.greatest("w", F.lit(1e-6))).alias("x")).alias("e"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]).alias("mean"))


def mean_or_zero(df: DataFrame, owners: DataFrame, keys: list[str], vec: str, width: int) -> DataFrame:
    """Means for all owners; a zero vector for those without any."""
    zero = F.array_repeat(F.lit(0.0), width)
    return owners.join(mean_vectors(df, keys, vec), keys, "left").withColumn("mean", F.coalesce("mean", zero))
