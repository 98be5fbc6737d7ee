"""How far each source's words are from those of the other sources of its language.

Every kept term has, in a group (a language and one of its sources), the share
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, and two groups differ at a term by
``floor((p - q)**2 / (p + q))``. Most terms occur in few groups, so nothing is computed
for a term and a pair where neither group has it:

1. Tasks count terms by group before anything is shuffled, so a source that holds a
   third of all rows is a few sums more.
2. A pair starts at V times the difference of two groups that both lack a term.
3. The postings of the inverted index correct that. Those of one group alone depend on
   the other group only by its share of a missing term, so all postings with one count
   are one correction. Where both groups have the term, the index joined with itself
   emits the correction of that pair; corrections of zero are not emitted. All are
   summed in the tasks that emit them, one row a pair.
4. Windows rank the pairs, and the terms of each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import staged
from wayfarer.llm.words import bytes_of, numbered, strings, word_chunks

LETTERS = bytes_of((0x41, 0x5A), (0x61, 0x7A))
#: Bytes of text that a task counts at once.
COUNTED = 4 << 20
UNIT = 1_000_000_000
#: Parts that the groups of one language are dealt to where they meet each other.
PARTS = 32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = pa.StructArray.from_arrays(batch.select(["lang", "source"]).columns, ["lang", "source"])
        names: dict[tuple, int] = {}
        group_of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
        lang, source = (pa.array([n[k] for n in names], pa.string()) for k in (0, 1))
        for i, j, words in word_chunks(batch.column("text"), lower=True, most=COUNTED, inside=LETTERS):
            if not len(words.start):
                continue
            term, first = numbered(words)
            # Terms of each document, then of each group.
            doc = np.repeat(np.arange(j - i), np.diff(words.first))
            of_doc, times = np.unique(doc * len(first) + term, return_counts=True)
            of_group, which = np.unique(group_of[i:j][of_doc // len(first)] * len(first) + of_doc % len(first), return_inverse=True)
            n, docs = np.bincount(which, weights=times), np.bincount(which)
            group, at = pa.array(of_group // len(first)), first[of_group % len(first)]
            yield pa.RecordBatch.from_arrays(
                [lang.take(group), source.take(group), strings(words.data, words.start[at], words.end[at]).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that have it)."""
    found = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p, exactly; null where no term is kept."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = F.when(terms > 0, total + 2 * terms).cast("decimal(20,0)")
    return F.call_function("div", top, below) + 1


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank for every group of ``docs``.

    Terms are runs of A-Z (lower-cased), a-z and characters beyond ASCII; each
    language keeps those that at least ``least_docs`` of its rows have. Part ``pair``
    holds each other source of the language and the sum of their differences over all
    kept terms (0 if none is kept); part ``term`` the ``top`` terms by which the group
    differs most from its language, of those it has and has more often. Ranks count
    from 1 by falling value, then by ascending item in bytes.

    Null languages, sources and texts are empty ones. Empty texts make a group all the
    same. Repeated rows, and rows that share an id, count each. Columns other than
    text, lang and source are ignored. No rows give no rows.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = staged(term_counts(plain), "terms")
    vocabulary = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_n")
    postings = staged(counted.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "postings")
    of_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = plain.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")))
    groups = staged(groups.withColumn("none", share(zero, F.col("total"), F.col("terms"))), "groups")

    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shares = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).select("lang", "source", "term", "n", "p", "q", "none")
    shares = staged(shares, "shares")

    # What one group alone brings: the start, and all its postings by count.
    alone = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("times")).withColumn("start", F.lit(False))
    begun = groups.select("lang", "source", F.col("none").alias("p"), "none", F.col("terms").alias("times"), F.lit(True).alias("start"))
    alone = alone.unionByName(begun).withColumn("part", F.pmod(F.xxhash64("source", "p"), F.lit(PARTS)))
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    met = alone.join(others, ["lang", "part"]).where("source != item")
    begun, moved = F.col("times") * difference("none", "other"), F.col("times") * (difference("p", "other") - difference("none", "other"))
    met = met.groupBy("lang", "source", "item").agg(F.sum(F.when(F.col("start"), begun).otherwise(moved)).alias("here"), F.sum(F.when(~F.col("start"), moved)).alias("there"))
    sides = F.array(F.struct("source", "item", F.col("here").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("there").alias("value")))
    met = met.select("lang", F.explode(sides).alias("side")).select("lang", "side.*")

    # What two groups bring that both have a term.
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("none").alias("none2"))
    both = shares.select("lang", "term", "source", "p", "none").join(right, ["lang", "term"]).where("source < item")
    both = both.withColumn("value", difference("p", "p2") - difference("p", "none2") - difference("none", "p2") + difference("none", "none2")).where("value != 0")
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("side"), "value")
    pairs = met.unionByName(both.select("lang", "side.*", "value")).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), zero).alias("value"))

    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).select(columns)
        .unionByName(terms.withColumn("part", F.lit("term")).withColumn("rank", place).where(F.col("rank") <= top).select(columns))
    )
