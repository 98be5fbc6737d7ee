"""Queries over indexes: labels by their 3-grams, vectors by graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.vectors import normalised
from wayfarer.operators import graph_search, ranking, trigrams
from wayfarer.operators.registry import query, table
from wayfarer.plans.vectors import _E, _vectors
from wayfarer.sources.shared import settled

# Needles from the table itself: parts of names, with and without wildcards, two characters alone, and one that nothing matches.
_NEEDLES = """
    needles AS (
        SELECT DISTINCT trim(CASE p_partkey % 5 WHEN 0 THEN substr(p_name, 2, 6) WHEN 1 THEN upper(substr(p_name, 3, 3)) || '%' || substr(p_name, 7, 3)
            WHEN 2 THEN substr(p_name, 1, 3) || '_' || substr(p_name, 5, 4) WHEN 3 THEN right(p_name, 2) ELSE substr(p_brand, 3, 5) || 'x' END) AS needle FROM part)"""


def _needles(parts: DataFrame) -> DataFrame:
    name, turn = F.col("p_name"), F.col("p_partkey") % 5
    cut = lambda a, n: F.substring(name, a, n)
    needle = (
        F.when(turn == 0, cut(2, 6)).when(turn == 1, F.concat(F.upper(cut(3, 3)), F.lit("%"), cut(7, 3))).when(turn == 2, F.concat(cut(1, 3), F.lit("_"), cut(5, 4)))
        .when(turn == 3, F.substring(name, -2, 2)).otherwise(F.concat(F.substring("p_brand", 3, 5), F.lit("x")))
    )
    return parts.select(needle.alias("needle"))


@query(
    f"""WITH {_NEEDLES}
    SELECT needle, p_partkey AS id, p_name ILIKE '%' || needle || '%' AS in_label FROM part JOIN needles
    ON needle <> '' AND (p_name ILIKE '%' || needle || '%' OR p_brand ILIKE '%' || needle || '%' OR p_type ILIKE '%' || needle || '%')"""
)
def labels_by_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name, brand or type matches any of many needles, through the index."""
    parts = table(spark, sf_dir, "part")
    index = trigrams.build(parts.withColumn("others", F.array("p_brand", "p_type")), "p_partkey", "p_name", "others")
    return trigrams.found(index, _needles(parts))


@query(
    """SELECT b.item_id, d.doc_id AS id FROM documents d JOIN (SELECT item_id, trim(substr(text, 40, 25)) AS needle FROM benchmark) b ON needle <> '' AND d.text ILIKE '%' || needle || '%'"""
)
def passages_by_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that hold a stretch of a benchmark text, letter case aside."""
    index = trigrams.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.substring("text", 40, 25)).alias("needle"))
    return asked.join(trigrams.found(index, asked), "needle").select("item_id", "id")


def _filters() -> dict[str, Column]:
    """Filters that about all, half, a tenth and a hundredth of the rows pass."""
    return {"all": F.lit(True), "half": F.col("label") < 5, "tenth": F.col("label") == 3, "few": F.col("id") % 97 == 5}


def _searched(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    bank = _vectors(spark, sf_dir)
    index = graph_search.build(bank)
    asked = settled(bank.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), "asked")
    found = [graph_search.search(index, asked, k, fine).withColumn("filter", F.lit(name)) for name, fine in _filters().items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query()
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest cosine under each filter, for every 50th row, by walks through graphs; and how many rows each search saw."""
    return _searched(spark, sf_dir).select("filter", "query", "rank", "id", F.round("score", 6).alias("score"), "seen")


@query(
    f"""WITH {_E}, f AS (SELECT 'all' AS filter, vec_id FROM e UNION ALL SELECT 'half', vec_id FROM e WHERE label < 5 UNION ALL SELECT 'tenth', vec_id FROM e WHERE label = 3 UNION ALL SELECT 'few', vec_id FROM e WHERE vec_id % 97 = 5)
    SELECT filter, (SELECT count(*) FROM e WHERE vec_id % 50 = 0) AS queries, (SELECT count(*) FROM e WHERE vec_id % 50 = 0) * least(20, count(*)) AS answers, true AS found FROM f GROUP BY filter"""
)
def filtered_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search against exact neighbours: as many answers as rows pass, and nine in ten of them at least as near as the last exact one.

    Of equally near rows any is right. Both sides compare by cosine; the index holds single precision.
    """
    got = settled(_searched(spark, sf_dir), "searched")
    bank = _vectors(spark, sf_dir).withColumn("vec", normalised(F.col("vec")))
    asked = bank.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    exact = None
    for name, fine in _filters().items():
        some = settled(bank.where(fine), "passing")
        best = ranking.nearest(asked, some, 20, some.count()).groupBy("query").agg(F.min("score").alias("last")).select(F.lit(name).alias("filter"), "query", "last")
        exact = best if exact is None else exact.unionByName(best)
    right = (F.col("score") >= F.col("last") - 1e-6).cast("long")
    counts = got.join(exact, ["filter", "query"], "left").groupBy("filter").agg(F.countDistinct("query").alias("queries"), F.count("*").alias("answers"), F.sum(right).alias("right"))
    return counts.select("filter", "queries", "answers", (F.coalesce("right", F.lit(0)) >= 0.9 * F.col("answers")).alias("found"))
