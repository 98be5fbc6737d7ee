"""Text rules for career data as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def cut(c: Column, n: int) -> Column:
    return F.substring(strip(c), 1, n)


def collapse(c: Column) -> Column:
    """Runs of blanks become one space, line breaks lose the space around them."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def skill_chunks(c: Column) -> Column:
    """Parts between commas and bullets, if there are any; else between ; and lines."""
    marks = "[,•◦▪●·]"
    return F.when(c.rlike(marks), F.split(c, marks)).otherwise(F.split(c, r"[;\n]+"))


def clean_skills(chunks: Column) -> Column:
    """Lower-case skills without leading bullets; empty ones go."""
    bare = F.transform(chunks, lambda x: F.lower(strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[•◦▪●·*\-]+\s*", ""), r"\s+", " "))))
    return F.filter(bare, lambda x: x != "")


def lines(c: Column) -> Column:
    """The non-empty lines of a text that lists values one a line."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def role_text(title: Column, description: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit("role: "), F.coalesce(title, empty), F.lit(" \n description: "), F.coalesce(description, empty))


def occupation_text(title: Column, description: Column, names: Column | None = None) -> Column:
    """With a line of alternative names only where there are any."""
    parts = [F.concat(F.lit("esco role: "), F.coalesce(title, F.lit("")))]
    if names is not None:
        parts.append(F.when(names != "", F.concat(F.lit(" alt labels: "), names)))
    parts.append(F.concat(F.lit(" description: "), F.coalesce(description, F.lit(""))))
    return F.concat_ws(" \n", *parts)


def label_name(c: Column) -> Column:
    """The name in the first line of an occupation's text."""
    return strip(F.regexp_replace(F.split(c, "\n")[0], "^esco role:", ""))


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def without_summary_mark(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"(?i)^summary:\s*", ""))


def email(c: Column) -> Column:
    """Normalised address, or null if it isn't one."""
    found = F.lower(F.trim(c))
    return F.when(found.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), found)


def replaced(title: Column, names: dict[str, str]) -> Column:
    """Trimmed and lower-cased, then swapped if it is among the names."""
    low = F.lower(strip(title))
    if not names:
        return low
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(pairs, low), low)


def profile_context(summary: Column, experiences: Column, skills: Column) -> Column:
    """What surrounds a skill: summary, six experiences, 25 other skills, 1000 characters."""
    about = F.when(strip(summary) != "", F.concat(F.lit("Summary: "), F.substring(strip(summary), 1, 250)))
    jobs = F.transform(F.slice(experiences, 1, 6), lambda e: F.concat_ws(": ", e["title"], F.substring(e["description"], 1, 100)))
    return F.substring(F.concat_ws(". ", about, F.array_join(jobs, ". "), F.array_join(F.slice(skills, 1, 25), ", ")), 1, 1000)


def prompt(**parts: Column) -> Column:
    """One line for each part that isn't null, named as given."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name.replace('_', ' ')}: "), value) for name, value in parts.items()])


def cache_key(*columns: Column) -> Column:
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16)


def chat_title(title: Column, label: Column) -> Column:
    return F.substring(F.coalesce(blank_to_null(title), F.concat(F.lit("About "), label), F.lit("New chat")), 1, 255)
