"""Ranking, search and bridge queries.

Vectors stand for occupations, customers' columns for what they are filtered by, and
parts for skills that suppliers (through line items) ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.operators.ranking import RankSpec, page_items, rank_page, scores_for, search
from wayfarer.operators.registry import query, table

_ITEMS = """
    items AS (
        SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS vec, c.c_mktsegment AS education,
            CASE WHEN c.c_acctbal > 3000 THEN c.c_acctbal END AS salary, c.c_nationkey AS vacancies
        FROM embeddings e LEFT JOIN customer c ON c.c_custkey = e.vec_id),
    u AS (SELECT embedding::DOUBLE[] AS uvec FROM embeddings WHERE vec_id = 7),
    scored AS (
        SELECT id, education, salary, vacancies, greatest(0, least(1, list_inner_product(vec, uvec))) AS score
        FROM items, u)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, c = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "customer")
    items = e.join(c, e["vec_id"] == c["c_custkey"], "left").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vec"),
        F.col("c_mktsegment").alias("education"),
        F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal")).alias("salary"),
        F.col("c_nationkey").alias("vacancies"),
    )
    return items, e.where("vec_id = 7").select(F.col("embedding").alias("vec"))


def _page(spark: SparkSession, sf_dir: str, spec: RankSpec) -> DataFrame:
    return page_items(rank_page(*_items(spark, sf_dir), spec)).withColumn("score", F.round("score", 6))


def _page_sql(where: str, order: str, offset: int, n: int) -> str:
    return f"""
        WITH {_ITEMS}, f AS (SELECT * FROM scored WHERE {where}),
        p AS (SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, * FROM (SELECT * FROM f ORDER BY {order} LIMIT {n} OFFSET {offset}))
        SELECT p.place, id, education, salary, vacancies, round(score, 6) AS score, t.total
        FROM (SELECT count(*) AS total FROM f) t LEFT JOIN p ON true"""


@query(_page_sql("true", "score DESC, id", 0, 20))
def rank_score_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, RankSpec())


@query(_page_sql("true", "salary ASC NULLS LAST, score DESC, id", 0, 20))
def rank_salary_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, RankSpec(sort="salary", order="asc"))


@query(_page_sql("lower(education) = 'building' AND vacancies >= 5", "score ASC, id", 10, 10))
def rank_filtered_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, RankSpec(education=" Building ", least=(("vacancies", 5), ("salary", None)), order="asc", page=2, page_size=10))


@query(_page_sql("salary >= 5000", "salary DESC NULLS LAST, score DESC, id", 100_000_000, 20))
def rank_past_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, RankSpec(least=(("salary", 5000),), sort="salary", page=5_000_001))


@query(f"WITH {_ITEMS} SELECT id, round(score, 6) AS score FROM scored WHERE id IN (3, 11, 7, 20, 499)")
def scores_for_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_for(*_items(spark, sf_dir), [3, 11, 3, 7, 20, 499]).withColumn("score", F.round("score", 6))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("alternatives", F.array("p_brand", "p_type"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%d_r%' OR p_brand ILIKE '%d_r%' OR p_type ILIKE '%d_r%'")
def search_label_or_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_parts(spark, sf_dir), " D_R ", "p_name", "alternatives")[0].select("p_partkey", "p_name")


@query(
    """SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ed%' OR p_brand ILIKE '%ed%' OR p_type ILIKE '%ed%'
       ORDER BY CASE WHEN p_name ILIKE '%ed%' THEN 0 ELSE 1 END, p_name, p_partkey LIMIT 20 OFFSET 20"""
)
def search_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, order = search(_parts(spark, sf_dir), "ed", "p_name", "alternatives")
    return found.orderBy(*order, "p_partkey").offset(20).limit(20).select("p_partkey", "p_name")


@query(
    """
    SELECT l_suppkey, l_orderkey, l_linenumber, p_name,
        CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 9 END, lower(p_name), l_orderkey, l_linenumber) AS INTEGER) AS place
    FROM lineitem JOIN part ON p_partkey = l_partkey"""
)
def bridge_skills_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of each profession, the essential ones first; relations without a skill go."""
    bridge = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(9)
    order = Window.partitionBy("l_suppkey").orderBy(rank, F.lower("p_name"), "l_orderkey", "l_linenumber")
    return bridge.select("l_suppkey", "l_orderkey", "l_linenumber", "p_name", F.row_number().over(order).alias("place"))


@query(
    """
    WITH mine AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1),
    names AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM mine)),
    asked AS (SELECT DISTINCT l_suppkey, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')
    SELECT l_suppkey, p_partkey, (p_partkey IN (SELECT l_partkey FROM mine) OR lower(p_name) IN (SELECT name FROM names)) AS has_skill
    FROM asked"""
)
def skill_gap_essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essential skills of all professions, and whether a user has them by id or by name."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders").where("o_custkey = 1")
    mine = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("mine")).distinct()
    names = parts.join(mine, F.col("p_partkey") == F.col("mine"), "left_semi").select(F.lower("p_name").alias("my_name")).distinct()
    asked = lines.where("l_returnflag = 'R'").join(parts, F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "p_partkey", "p_name").distinct()
    # Two equi-joins in place of one on "id or name", which could only be a nested loop.
    both = asked.join(mine, F.col("p_partkey") == F.col("mine"), "left").join(names, F.lower("p_name") == F.col("my_name"), "left")
    return both.select("l_suppkey", "p_partkey", (F.col("mine").isNotNull() | F.col("my_name").isNotNull()).alias("has_skill"))


@query(
    """
    SELECT c_custkey, c_name, o.best, CAST(row_number() OVER (ORDER BY o.best DESC NULLS LAST, c_custkey) AS INTEGER) AS place
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
    ORDER BY place LIMIT 50"""
)
def page_resorted_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left-joined score map; what has no score comes last."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    customers = table(spark, sf_dir, "customer")
    top = customers.join(best, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy(F.col("best").desc_nulls_last(), "c_custkey").limit(50)
    order = Window.orderBy(F.col("best").desc_nulls_last(), "c_custkey")  # over the page's 50 rows
    return top.select("c_custkey", "c_name", "best", F.row_number().over(order).alias("place"))


@query(
    """SELECT c_nationkey, c_custkey, c_acctbal, CAST(place AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 10"""
)
def first_rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfarer.operators.career import first_rows

    top = first_rows(table(spark, sf_dir, "customer"), "c_nationkey", 10, F.desc("c_acctbal"), "c_custkey")
    return top.select("c_nationkey", "c_custkey", "c_acctbal", F.col("row").alias("place"))


@query(
    """SELECT p_partkey, p_retailprice >= 1000 AS dear, nullif(p_type, 'PROMO') AS kind, substr(coalesce(nullif(trim(nullif(p_name, 'red ring')), ''), 'About ' || p_brand), 1, 255) AS title
       FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL"""
)
def part_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-drop, invalid values as null, and a default title."""
    from wayfarer.functions.text import chat_title

    parts = table(spark, sf_dir, "part").na.drop(subset=["p_name", "p_type"])
    title = chat_title(F.when(F.col("p_name") != "red ring", F.col("p_name")), F.col("p_brand"))
    return parts.select("p_partkey", (F.col("p_retailprice") >= 1000).alias("dear"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("kind"), title.alias("title"))
