"""Joins that enrich work histories from a catalogue of occupations.

The catalogue has uri, label, alternatives (an array), description, code and an
``order`` that says which of two rows came later. Lookups are small tables with one row
a key, made with maxima and minima, so that no left join ever multiplies a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.text import strip


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row; rows without a key go."""
    rest = [c for c in df.columns if c not in (key, order)]
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("t"))
    return top.select(key, *[F.col(f"t.{c}").alias(c) for c in rest])


def with_last(left: DataFrame, right: DataFrame, left_key: str, key: str, order: str) -> DataFrame:
    """Left rows with the last right row of their key, or nulls."""
    found = last_rows(right, key, order).withColumnRenamed(key, "_key")
    return left.join(found, F.col(left_key) == F.col("_key"), "left").drop("_key")


def descriptions_by_title(catalogue: DataFrame) -> DataFrame:
    """(title, description) by preferred and alternative names.

    Any alternative beats a preferred name, and of each kind the later row wins.
    Alternatives are taken as they are written, blank ends included.
    """
    own = catalogue.select(F.col("label").alias("title"), F.struct(F.lit(0).alias("kind"), "order").alias("at"), "description")
    others = catalogue.select(F.explode("alternatives").alias("title"), F.struct(F.lit(1).alias("kind"), "order").alias("at"), "description")
    both = own.union(others).where("title is not null")
    return both.groupBy("title").agg(F.max_by("description", "at").alias("description"))


def with_description(rows: DataFrame, catalogue: DataFrame, uri: str, title: str) -> DataFrame:
    """``description`` of each row: by its uri, else by its title, else empty."""
    by_uri = last_rows(catalogue.select("uri", "order", "description"), "uri", "order").select(F.col("uri").alias("_uri"), F.col("description").alias("_by_uri"))
    by_title = descriptions_by_title(catalogue).select(F.col("title").alias("_title"), F.col("description").alias("_by_title"))
    both = rows.join(by_uri, F.col(uri) == F.col("_uri"), "left").join(by_title, F.col(title) == F.col("_title"), "left")
    return both.withColumn("description", F.coalesce("_by_uri", "_by_title", F.lit(""))).drop("_uri", "_by_uri", "_title", "_by_title")


def _named(catalogue: DataFrame) -> DataFrame:
    """Rows that have alternatives, stripped and without blank ones, and these as one text."""
    bare = F.filter(F.transform("alternatives", strip), lambda x: x != "")
    return catalogue.withColumn("alternatives", bare).where(F.size("alternatives") > 0).withColumn("names", F.array_join("alternatives", ", "))


def names_by_title(catalogue: DataFrame) -> DataFrame:
    """(title, names): all alternative names of the occupation that a title stands for.

    A preferred name beats an alternative one. Among preferred names the later row
    wins, among alternatives the earlier.
    """
    named = _named(catalogue)
    own = named.select(F.col("label").alias("title"), F.struct(F.lit(1).alias("kind"), F.col("order").alias("at")).alias("rank"), "names")
    others = named.select(F.explode("alternatives").alias("title"), F.struct(F.lit(0).alias("kind"), (-F.col("order")).alias("at")).alias("rank"), "names")
    return own.union(others).where("title is not null").groupBy("title").agg(F.max_by("names", "rank").alias("names"))


def with_names(rows: DataFrame, catalogue: DataFrame, uri: str, title: str) -> DataFrame:
    """``names`` of each row: by its uri, else by its title, else empty."""
    by_uri = last_rows(_named(catalogue).select("uri", "order", "names"), "uri", "order").select(F.col("uri").alias("_uri"), F.col("names").alias("_by_uri"))
    by_title = names_by_title(catalogue).select(F.col("title").alias("_title"), F.col("names").alias("_by_title"))
    both = rows.join(by_uri, F.col(uri) == F.col("_uri"), "left").join(by_title, F.col(title) == F.col("_title"), "left")
    return both.withColumn("names", F.coalesce("_by_uri", "_by_title", F.lit(""))).drop("_uri", "_by_uri", "_title", "_by_title")


def code_prefix(code: Column, n: int) -> Column:
    """The first ``n`` characters; null where there are fewer."""
    return F.when(F.length(strip(code)) >= n, F.substring(strip(code), 1, n))


def with_prefix(rows: DataFrame, catalogue: DataFrame, uri: str, n: int = 2) -> DataFrame:
    """``prefix`` of the code of each row's occupation."""
    codes = last_rows(catalogue.select("uri", "order", "code"), "uri", "order").select(F.col("uri").alias("_uri"), code_prefix(F.col("code"), n).alias("prefix"))
    return rows.join(codes, F.col(uri) == F.col("_uri"), "left").drop("_uri")


def with_category(rows: DataFrame, catalogue: DataFrame, uri: str, n: int = 3) -> DataFrame:
    """``category`` of each row: its code prefix's place among all prefixes in code point
    order, or their number where the uri is unknown or has no code."""
    short = F.substring("code", 1, n)
    known = catalogue.where("code is not null").select(short.alias("p")).distinct()
    # There are no more prefixes than n characters can spell, so they fit in one array.
    all_ = known.agg(F.sort_array(F.collect_set("p")).alias("all"))
    codes = last_rows(catalogue.select("uri", "order", "code"), "uri", "order").select(F.col("uri").alias("_uri"), short.alias("_p"))
    both = rows.join(codes, F.col(uri) == F.col("_uri"), "left").crossJoin(F.broadcast(all_))
    place = F.nullif(F.array_position("all", F.col("_p")), F.lit(0)) - 1
    return both.withColumn("category", F.coalesce(place, F.size("all")).cast("int")).drop("_uri", "_p", "all")


def last_summary(prefix: Column, field: str) -> Column:
    """A field of the prefix's last row; empty where it is null or the prefix is empty."""
    return F.coalesce(F.when(F.size(prefix) > 0, F.element_at(prefix, -1)[field]), F.lit(""))
