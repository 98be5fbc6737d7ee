"""Timeline queries: a customer's orders, in time, stand for a person's jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions.dates import month_index, months_research, months_runtime, months_service
from wayfarer.operators import career
from wayfarer.operators.ranking import ranking_metrics
from wayfarer.operators.registry import query, table

_T = """
    t AS (
        SELECT o_custkey AS person, row_number() OVER w - 1 AS n, o_custkey % 3 AS split,
            strftime(o_orderdate, '%-m/%Y') AS starts, o_orderdate AS day,
            coalesce(strftime(lead(o_orderdate) OVER w, '%-m/%Y'), 'current') AS ends,
            lead(o_orderdate) OVER w AS next_day,
            o_orderpriority AS uri, substr(o_orderpriority, 1, 1) AS code, nullif(o_orderstatus, 'P') AS industry
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_FIRST = "(year(day) * 12 + month(day))"
_NEXT = "(year(next_day) * 12 + month(next_day))"
_RESEARCH = f"CASE WHEN next_day IS NULL THEN least({_FIRST} + 12, 2021 * 12 + 8) ELSE {_NEXT} END - {_FIRST}"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    starts = F.date_format("o_orderdate", "M/yyyy")
    return orders.select(
        F.col("o_custkey").alias("person"),
        (F.row_number().over(order) - 1).cast("long").alias("n"),
        (F.col("o_custkey") % 3).alias("split"),
        starts.alias("starts"),
        F.coalesce(F.lead(starts).over(order), F.lit("current")).alias("ends"),
        F.col("o_orderpriority").alias("uri"),
        F.substring("o_orderpriority", 1, 1).alias("code"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("industry"),
    )


@query(f"WITH {_T} SELECT person, n, uri, coalesce(industry, '<unk>') AS industry FROM t WHERE n < 17")
def explode_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one wide row a person, of 17 slots, back to a row for each job."""
    slots = range(17)
    long = timeline(spark, sf_dir).where("n < 17")
    wide = long.groupBy("person").agg(
        F.count("*").alias("jobs"),
        *[F.max(F.when(F.col("n") == i, F.col("uri"))).alias(f"uri_{i}") for i in slots],
        *[F.max(F.when(F.col("n") == i, F.col("industry"))).alias(f"industry_{i}") for i in slots],
    )
    back = career.unpivot(wide, ["person"], ["uri", "industry"], 17, "jobs")
    return back.select("person", F.col("experience_number").cast("long").alias("n"), "uri", F.coalesce("industry", F.lit("<unk>")).alias("industry"))


@query(f"WITH {_T} SELECT person, n, CAST({_RESEARCH} AS INTEGER) AS months FROM t")
def months_in_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).select("person", "n", months_research(F.col("starts"), F.col("ends")).alias("months"))


@query(f"WITH {_T} SELECT person, n, CASE WHEN n = 3 THEN 5.0 ELSE CAST({_RESEARCH} AS DOUBLE) END AS months FROM t")
def months_at_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("n") == 3, F.lit(5))
    return timeline(spark, sf_dir).select("person", "n", months_runtime(F.col("starts"), F.col("ends"), given).alias("months"))


@query(f"WITH {_T} SELECT person, n, CAST(greatest(coalesce({_NEXT}, 1997 * 12 + 6) - {_FIRST}, 0) AS INTEGER) AS months FROM t")
def months_in_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_date(F.lit("1997-06-15"))
    return timeline(spark, sf_dir).select("person", "n", months_service(F.col("starts"), F.col("ends"), as_of).alias("months"))


@query(f"WITH {_T}, m AS (SELECT *, {_RESEARCH} AS months FROM t) SELECT split, person, n FROM m WHERE person NOT IN (SELECT person FROM m WHERE months <= 0)")
def without_bad_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("months", months_research(F.col("starts"), F.col("ends")))
    return career.without_people(rows, ["split", "person"], F.col("months") <= 0).select("split", "person", "n")


@query(
    f"""WITH {_T}, m AS (SELECT *, {_RESEARCH} AS months FROM t)
        SELECT split, count(*) FILTER (months <= 0) AS bad_rows, count(DISTINCT person) FILTER (months <= 0) AS bad_people, count(*) FILTER (ends LIKE '%/1997') AS ended_1997
        FROM m GROUP BY split"""
)
def bad_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("bad", months_research(F.col("starts"), F.col("ends")) <= 0)
    return rows.groupBy("split").agg(F.count_if("bad").alias("bad_rows"), F.count_distinct(F.when(F.col("bad"), F.col("person"))).alias("bad_people"), F.count_if(F.col("ends").endswith("/1997")).alias("ended_1997"))


@query("SELECT o_custkey % 3 AS split, strftime(min(o_orderdate), '%-m/%Y') AS first_date, strftime(max(o_orderdate), '%-m/%Y') AS last_date FROM orders GROUP BY ROLLUP (o_custkey % 3)")
def date_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.date_extremes(timeline(spark, sf_dir), ["split"], "starts", month_index(F.col("starts")))


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT p_name || ' ' || p_brand AS value FROM part UNION SELECT '<unk>')")
def vocabulary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("label"))
    return career.vocabulary(parts, "label", unknown="<unk>")


_SPANS = f"""
    {_T}, s AS (SELECT person, list(uri ORDER BY n) AS steps, count(*) AS n FROM t GROUP BY person),
    l AS (SELECT person, steps, n, unnest(generate_series(greatest(2, n - 5), n)) AS length FROM s WHERE n >= 2),
    p AS (SELECT person, steps, n, length, unnest(generate_series(0, n - length)) AS start FROM l),
    spans AS (
        SELECT person, CAST(length AS INTEGER) AS length, CAST(start AS INTEGER) AS start, steps[start + 1 : start + length - 1] AS prefix, steps[start + length] AS target
        FROM p QUALIFY row_number() OVER (PARTITION BY person ORDER BY length DESC, start DESC) <= 16)"""
_RECENCY = """
    r AS (SELECT *, list_position(list_reverse(prefix), target) AS place FROM spans),
    ranked AS (SELECT *, CASE WHEN place > 0 THEN len(list_distinct(list_reverse(prefix)[1 : place])) END AS rank FROM r)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.sub_paths(timeline(spark, sf_dir), "person", "n", F.col("uri"))


@query(f"WITH {_SPANS} SELECT person, length, start, array_to_string(prefix, '>') AS prefix, target FROM spans")
def sub_paths_last16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).withColumn("prefix", F.array_join("prefix", ">"))


@query(f"WITH {_SPANS}, {_RECENCY} SELECT person, length, start, CAST(rank AS BIGINT) AS rank FROM ranked")
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = career.recency_rank(F.col("prefix"), F.col("target")).cast("long")
    return _spans(spark, sf_dir).select("person", "length", "start", rank.alias("rank"))


@query(
    f"""WITH {_SPANS}, {_RECENCY}, b AS (SELECT rank, CASE WHEN length = 2 THEN '1' ELSE '>=2' END AS bucket FROM ranked)
        SELECT bucket, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, count(*) AS n
        FROM b GROUP BY ROLLUP (bucket)"""
)
def recency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.size("prefix") == 1, "1").otherwise(">=2")
    rows = _spans(spark, sf_dir).select(bucket.alias("bucket"), career.recency_rank(F.col("prefix"), F.col("target")).alias("rank"))
    return _rounded(ranking_metrics(rows, F.col("rank"), None, ["bucket"]), "mrr", "r1", "r5", "r10")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    f"""WITH {_T}, f AS (SELECT *, coalesce(lead(code) OVER (PARTITION BY person ORDER BY n) = code, false) AS follows FROM t),
        a AS (SELECT *, min(CASE WHEN NOT follows THEN n END) OVER (PARTITION BY person ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS anchor FROM f)
        SELECT a.person, a.n, b.industry AS carried FROM a JOIN t b ON b.person = a.person AND b.n = a.anchor"""
)
def industry_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.carried_back(timeline(spark, sf_dir), "person", "n", "code", F.col("industry")).select("person", "n", "carried")


@query(
    f"""WITH {_T}, b AS (SELECT person, n, CASE WHEN industry IS NULL THEN '' ELSE uri || ' ' || industry END AS block FROM t)
        SELECT person, n, md5(substr(coalesce(string_agg(nullif(block, ''), chr(10) || chr(10)) OVER (PARTITION BY person ORDER BY n DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ''), 1, 12000)) AS digest FROM b"""
)
def cumulative_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.when(F.col("industry").isNull(), "").otherwise(F.concat_ws(" ", "uri", "industry"))
    return career.texts_so_far(timeline(spark, sf_dir), "person", "n", block).select("person", "n", F.md5("so_far").alias("digest"))


@query(
    """SELECT conv_id, turn, role FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 AND role IN ('user', 'assistant')"""
)
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return career.last_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", 4, ["user", "assistant"]).select("conv_id", "turn", "role")


@query(
    f"""WITH {_T}, s AS (SELECT person, count(*) AS n FROM t GROUP BY person)
        SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, sum(greatest(n - 5, 0))::BIGINT AS beyond FROM s"""
)
def history_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = timeline(spark, sf_dir).groupBy("person").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.sum(F.greatest(F.col("n") - 5, F.lit(0))).alias("beyond"))
