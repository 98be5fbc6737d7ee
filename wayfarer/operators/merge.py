"""Latest-state tables, patches and merges, as joins and windows over plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.arrays import merged_ignoring_case
from wayfarer.functions.text import blank_to_null


def latest(events: DataFrame, key: str, offset: str) -> DataFrame:
    """The event of each key with the greatest offset (then all columns, for ties).

    It is a maximum, so each map task sends one row a key: a key with very many
    events doesn't gather in one task.
    """
    rest = [c for c in events.columns if c not in (key, offset)]
    top = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(offset, *rest)).alias("t"))
    return top.select(key, F.col(f"t.{offset}").alias(offset), *[F.col(f"t.{c}").alias(c) for c in rest])


def applied(current: DataFrame, events: DataFrame, key: str, offset: str, deleted: Column) -> DataFrame:
    """``current`` after upserts and deletes; of a key only its last event counts."""
    last = latest(events, key, offset)
    kept = current.join(last.select(key), key, "left_anti")
    fresh = last.where(~deleted)
    return kept.unionByName(fresh.select(*current.columns))


def cascade(parents: DataFrame, key: str, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """Children that are left when ``parents`` are deleted; each level names its
    foreign key and its own key, and the deletion goes on down the chain."""
    gone, left = parents.select(F.col(key).alias("_k")).distinct(), []
    for child, foreign, own in children:
        on = child[foreign] == gone["_k"]
        left.append(child.join(gone, on, "left_anti"))
        gone = child.join(gone, on, "left_semi").select(F.col(own).alias("_k")).distinct()
    return left


def patched(current: DataFrame, patch: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """Fields that ``patch.set_fields`` names are taken from the patch, nulls included.

    Of several patches of a key the last one by ``order`` (else the greatest by all
    columns) counts alone, so no row is ever multiplied.
    """
    rank = [order] if order else []
    p = patch.groupBy(key).agg(F.max(F.struct(*rank, "set_fields", *fields)).alias("_p"))
    both = current.join(p, key, "left")
    chosen = [F.when(F.array_contains("_p.set_fields", f), F.col(f"_p.{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in current.columns]
    return both.select(*chosen)


def relevant_change(set_fields: Column, watched: list[str]) -> Column:
    return F.arrays_overlap(set_fields, F.array(*map(F.lit, watched)))


def filled(current: Column, new: Column) -> Column:
    """The new value only where the current one is blank."""
    return F.coalesce(blank_to_null(current), new)


def merged_profile(current: DataFrame, parsed: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Scalars fill what is blank, lists are united ignoring case.

    Of several parsed rows of a key the greatest by all columns counts alone.
    """
    p = parsed.groupBy(key).agg(F.max(F.struct(*scalars, *lists)).alias("_p"))
    both = current.join(p, key, "left")
    new = {c: filled(F.col(c), F.col(f"_p.{c}")) for c in scalars} | {c: merged_ignoring_case(F.col(c), F.col(f"_p.{c}")) for c in lists}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in current.columns])


def appended(current: DataFrame, new: DataFrame, owner: str, title: str, rest: list[Column], position: str, order: str) -> DataFrame:
    """Rows that the owner lacks by title, ignoring case, and ``rest`` are appended,
    numbered on from its last. Blank titles go; a null in ``rest`` is like an empty text,
    so replaying the same rows appends nothing."""
    identity = [F.lower(F.trim(F.col(title))), *[F.coalesce(c.cast("string"), F.lit("")) for c in rest]]
    names = [f"_i{n}" for n in range(len(identity))]
    mark = lambda df: df.select("*", *[c.alias(n) for n, c in zip(names, identity, strict=True)])
    once = mark(new.where(blank_to_null(F.col(title)).isNotNull())).withColumn("_r", F.row_number().over(Window.partitionBy(owner, *names).orderBy(order))).where("_r = 1")
    fresh = once.join(mark(current).select(owner, *names).where(f"{names[0]} is not null").distinct(), [owner, *names], "left_anti")
    last = current.groupBy(owner).agg(F.max(position).alias("_last"))
    number = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    fresh = fresh.withColumn("_n", number).join(last, owner, "left").withColumn(position, (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("int"))
    return current.unionByName(fresh.select(*current.columns))


def get_or_create(current: DataFrame, wanted: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """All of ``current``, and a default row for each wanted key that it lacks."""
    absent = wanted.select(key).distinct().join(current.select(key), key, "left_anti")
    kinds = dict(current.dtypes)
    return current.unionByName(absent.select(key, *[defaults.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in current.columns if c != key]))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that break a unique constraint, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def replaced_children(current: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Each owner in ``new`` has exactly its new rows; the others keep theirs."""
    return current.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def remaining(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that no checkpoint row names."""
    return units.join(done.select(*keys).distinct(), keys, "left_anti")
