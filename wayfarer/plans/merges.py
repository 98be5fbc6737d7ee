"""Latest-state, merge and set queries: events are an upsert log keyed by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.arrays import merged_ignoring_case
from wayfarer.operators import merge
from wayfarer.operators.registry import query, table
from wayfarer.streaming.views import drained_state

_LAST = "last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state"), "value")


@query(f"WITH {_LAST} SELECT user_id, event_id, event_type AS state, value FROM last WHERE event_type <> 'error'")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each key; a key whose last event is a deletion is gone."""
    return merge.latest(_log(spark, sf_dir), "user_id", "event_id").where("state != 'error'")


@query(
    f"""WITH {_LAST}
        SELECT c_custkey AS user_id, -1::BIGINT AS event_id, c_mktsegment AS state, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last)
        UNION ALL SELECT user_id, event_id, event_type, value FROM last WHERE event_type <> 'error'"""
)
def upserts_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.col("c_mktsegment").alias("state"), F.col("c_acctbal").alias("value"))
    return merge.applied(current, _log(spark, sf_dir), "user_id", "event_id", F.col("state") == "error")


@query(f"WITH {_LAST} SELECT user_id, event_id, event_type AS state, value FROM last WHERE event_type <> 'error'")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state, kept by a stream that merges one micro-batch after another."""
    events = table(spark, sf_dir, "events")
    # A stream's path may name a single file only as a pattern.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/[e]vents.parquet")
    log = stream.select("user_id", "event_id", F.col("event_type").alias("state"), "value")
    return drained_state(log, "user_id", "event_id", F.col("state") == "error")


@query(
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (
        SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)"""
)
def cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    _, lines = merge.cascade(gone, "c_custkey", (table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))
    return lines.select("l_orderkey", "l_linenumber")


@query(
    """WITH p AS (SELECT p_partkey, [p_name, upper(p_type), ' ', p_type, upper(p_name), p_brand] AS l FROM part),
       b AS (SELECT p_partkey, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS l FROM p)
       SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS merged FROM b"""
)
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists united ignoring case; the first spelling stays, blanks go."""
    own = F.array("p_name", F.upper("p_type"), F.lit(" "))
    new = F.array("p_type", F.upper("p_name"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged_ignoring_case(own, new), "|").alias("merged"))


@query(
    """SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_nationkey < 12 THEN ' ' ELSE c_mktsegment END), ''), s_name) AS segment
       FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""
)
def blanks_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 12, " ").otherwise(F.col("c_mktsegment")).alias("segment"), F.array().cast("array<string>").alias("skills"))
    parsed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("segment"), F.array("s_name").alias("skills"))
    return merge.merged_profile(current, parsed, "c_custkey", ["segment"], ["skills"]).select("c_custkey", "segment")


@query("SELECT c_custkey, CASE WHEN s_suppkey % 2 = 0 THEN nullif(s_acctbal, 73.0) ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def patched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch sets only the fields that it names, be it to null."""
    supplier = table(spark, sf_dir, "supplier")
    named = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("c_acctbal"))).otherwise(F.array(F.lit("c_name")))
    patch = supplier.select(F.col("s_suppkey").alias("c_custkey"), named.alias("set_fields"), F.when(F.col("s_acctbal") != 73.0, F.col("s_acctbal")).alias("c_acctbal"))
    return merge.patched(table(spark, sf_dir, "customer"), patch, "c_custkey", ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def broken_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.duplicates(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT DISTINCT user_id, 'NEW' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def rows_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the log has a row; those without one get a default."""
    wanted = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return merge.get_or_create(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), wanted, "c_custkey", {"c_mktsegment": F.lit("NEW")})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def work_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.remaining(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query(
    """SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 0) AS positive,
        max(coalesce(try_cast(props ->> '$.k' AS INTEGER), 0)) AS most, bool_and(event_type <> 'broken') AS ok FROM events"""
)
def enrichment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 0).alias("positive"), F.max(F.coalesce(number, F.lit(0))).alias("most"), F.bool_and(F.col("event_type") != "broken").alias("ok")
    )
