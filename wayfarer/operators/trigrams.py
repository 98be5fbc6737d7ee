"""Search for a part of a label through an index of its 3-grams.

The index is two written tables. ``postings`` has, sorted by gram, the ids of the labels
that hold a gram, cut into parts of bounded length, so that a frequent gram is many rows
and not one long one; a search for some grams reads only the row groups whose range
holds them. ``grams`` says how frequent each gram is. ``labels`` has the texts to verify,
sorted by id.

A needle's wildcards (% and _) cut it into pieces; every 3-gram of a piece must be in a
matching label. The rarest of them are looked up and intersected, and what is left is
verified with ILIKE. Needles without any 3-gram are held against all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.sources.shared import scratch, settled

GRAM = 3
#: Ids of a row of the index at most, and pairs of a gram and an id that a task gathers at once.
PART, HELD = 4096, 2_000_000
#: Grams of a needle that are looked up: its rarest ones.
ASKED = 4
#: Rows of a row group of the index; few, so that a lookup reads little beside its own.
GROUP_ROWS = 20_000


def grams(text: Column) -> Column:
    """The distinct 3-grams of a piece of a needle, in the case that ILIKE compares in."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1)), lambda i: F.substring(low, i, GRAM)))


def _lists(most: int, at_once: int):
    """(gram, part, ids) of stretches of rows: ids meet under their gram before anything is shuffled."""

    def cut(held: dict[str, list[int]]) -> pa.RecordBatch:
        names, ids = [], []
        for gram in sorted(held):
            all_ids = np.unique(np.array(held[gram], np.int64))
            for at in range(0, len(all_ids), most):
                names.append(gram)
                ids.append(all_ids[at : at + most])
        ends = np.cumsum([0, *map(len, ids)])
        # Parts of one gram are told apart by their first id, which spreads a frequent gram over tasks.
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x[0] % 1024 for x in ids], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], names=["gram", "part", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, texts in zip(part.column("id").to_pylist(), part.column("texts").to_pylist(), strict=True):
                    found = {t[k : k + GRAM] for t in texts if t is not None for k in range(len(t) - GRAM + 1)}
                    n += len(found)
                    for gram in found:
                        held.setdefault(gram, []).append(i)
                if n >= at_once:
                    yield cut(held)
                    held, n = {}, 0
        if held:
            yield cut(held)

    return run


def _safe(text: Column) -> Column:
    """No grams at all of null and of texts under three characters."""
    return F.when(F.char_length(F.lower(text)) >= GRAM, grams(text)).otherwise(F.array().cast("array<string>"))


def needle_grams(needle: Column) -> Column:
    """The 3-grams that a label must have to match; an escaped character or a backslash ends a piece."""
    pieces = F.split(needle, r"[%_\\]")
    return F.array_distinct(F.flatten(F.transform(pieces, _safe)))


@dataclass(frozen=True)
class TrigramIndex:
    postings: DataFrame
    grams: DataFrame
    labels: DataFrame


def build(rows: DataFrame, key: str, label: str, alternatives: str | None = None, folder: str | None = None) -> TrigramIndex:
    """The index of a table's labels and alternative labels, written to ``folder``.

    Null labels have no gram, and a null among the alternatives counts for nothing. Ids
    may repeat; a search then finds all their rows. A task gathers the ids of some
    ``HELD`` pairs at a time and cuts those of a gram to parts, so no task holds all of
    a frequent gram's, and no row a gram and an id is shuffled.
    """
    spark = rows.sparkSession
    folder = folder or scratch(spark, "trigrams")
    others = F.col(alternatives) if alternatives else F.array().cast("array<string>")
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(others, F.array().cast("array<string>")).alias("alternatives"))
    # A stated number, as few bytes of text are much work.
    held.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "id").sortWithinPartitions("id").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/labels")
    labels = spark.read.schema(held.schema).parquet(f"{folder}/labels")
    low = F.transform(F.concat(F.array("label"), "alternatives"), lambda x: F.lower(x))
    made = labels.where("id is not null").select("id", low.alias("texts")).mapInArrow(_lists(PART, HELD), "gram string, part int, ids array<bigint>")
    # Written, as a range partitioning reads its input twice.
    postings = settled(made, "lists")
    counts = postings.groupBy("gram").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    counts.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/grams")
    counts = spark.read.schema(counts.schema).parquet(f"{folder}/grams")
    writer = postings.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.mode("overwrite")
    writer.option("compression", "zstd").option("parquet.block.row.count.limit", str(GROUP_ROWS)).parquet(f"{folder}/postings")
    return TrigramIndex(spark.read.schema(postings.schema).parquet(f"{folder}/postings"), counts, labels)


def opened(spark: SparkSession, folder: str) -> TrigramIndex:
    """An index that was built before."""
    return TrigramIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "grams", "labels")))


def candidates(index: TrigramIndex, needles: DataFrame) -> DataFrame:
    """(needle, id): ids whose labels hold the rarest grams of a needle, all of them."""
    asked = needles.select("needle", F.explode(needle_grams(F.col("needle"))).alias("gram"))
    # A gram that no label has keeps its place with a count of 0, so its needle finds nothing.
    known = asked.join(index.grams, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.withColumn("_r", F.row_number().over(Window.partitionBy("needle").orderBy("n", "gram"))).where(F.col("_r") <= ASKED)
    rarest = rarest.withColumn("must", F.max("_r").over(Window.partitionBy("needle"))).select("needle", "gram", "must")
    found = rarest.join(index.postings, "gram").select("needle", "must", "gram", F.explode("ids").alias("id"))
    return found.groupBy("needle", "must", "id").agg(F.count_distinct("gram").alias("n")).where("n = must").select("needle", "id")


def found(index: TrigramIndex, needles: DataFrame) -> DataFrame:
    """(needle, id, in_label): all labels that ILIKE ``%needle%``, or one of whose alternatives does.

    ``needles`` has the column needle; each is trimmed, blank and null ones find
    nothing, and of equal ones one counts. % and _ in it are wildcards, a backslash
    takes the next character as it is.
    """
    asked = needles.select(F.trim(F.col("needle").cast("string")).alias("needle")).where("needle != ''").distinct()
    # A lone backslash at the end would escape the closing wildcard.
    asked = asked.where(F.length(F.regexp_extract("needle", r"(\\*)$", 1)) % 2 == 0)
    long = asked.where(F.size(needle_grams(F.col("needle"))) > 0)
    short = asked.join(long, "needle", "left_anti")
    pairs = candidates(index, long).join(index.labels, "id")
    # The stated needles against all labels: one pass, with the short needles alone on the other side.
    pairs = pairs.select("needle", "id", "label", "alternatives").unionByName(index.labels.crossJoin(short).select("needle", "id", "label", "alternatives"))
    # A needle without wildcards is looked for as it is; ILIKE would make a pattern for each row.
    pattern, plain = F.concat(F.lit("%"), F.col("needle"), F.lit("%")), ~F.col("needle").rlike(r"[%_\\]")
    like = lambda c: F.when(plain, F.contains(F.lower(c), F.lower(F.col("needle")))).otherwise(F.ilike(c, pattern))
    told = pairs.select("needle", "id", "alternatives", F.coalesce(like(F.col("label")), F.lit(False)).alias("in_label"))
    hit = F.col("in_label") | F.coalesce(F.exists("alternatives", like), F.lit(False))
    return told.where(hit).select("needle", "id", "in_label")


def share_read(index: TrigramIndex, needle: str) -> float:
    """Of the ids in the index, the share that a search for one needle looks at."""
    spark = index.labels.sparkSession
    asked = spark.range(1).select(F.explode(needle_grams(F.lit(needle))).alias("gram"))
    read = asked.join(index.grams, "gram").orderBy("n", "gram").limit(ASKED).agg(F.sum("n")).first()[0] or 0
    whole = index.grams.agg(F.sum("n")).first()[0] or 1
    return read / whole
