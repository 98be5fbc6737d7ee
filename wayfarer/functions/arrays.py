"""Array and JSON rules as Column expressions; no explode, so no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_ignoring_case(c: Column) -> Column:
    """Trimmed values in order, the first spelling of each; blanks and nulls go."""
    bare = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    low = F.transform(bare, F.lower)
    return F.filter(bare, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def merged_ignoring_case(a: Column, b: Column) -> Column:
    """All of ``a``, then what ``b`` has that ``a`` lacks."""
    empty = F.array().cast("array<string>")
    return distinct_ignoring_case(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def last(c: Column, n: int) -> Column:
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


def first(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def json_or_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.to_json(c))


def exact_distinct(c: Column) -> Column:
    """Distinct values in order, by their exact spelling."""
    return F.array_distinct(c)


def ids_asked(c: Column, most: int = 200) -> Column:
    """Order-preserving distinct ids, at most so many."""
    return F.slice(F.array_distinct(c), 1, most)


def field_or(json: Column, name: str, fallback: Column) -> Column:
    """A JSON field as text; the fallback only where the key is absent, not where it is null."""
    here = F.array_contains(F.json_object_keys(json), name)
    return F.when(F.coalesce(here, F.lit(False)), F.get_json_object(json, f"$.{name}")).otherwise(fallback)


def texts_only(json: Column) -> Column:
    """The non-blank strings of a JSON array of anything."""
    return F.filter(F.from_json(json, "array<string>"), lambda x: x.isNotNull() & (F.trim(x) != ""))


def percent_of_best(score: Column, best: Column) -> Column:
    return F.when(best > 0, F.round(score / best * 100)).otherwise(F.lit(0.0))


def bar_width(percent: Column) -> Column:
    return F.greatest(percent, F.lit(2.0))
