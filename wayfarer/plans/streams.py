"""Queries over the events as streams of several files: state that resumes, routing, sessions, and streams that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions import arrays
from wayfarer.operators.registry import query, table
from wayfarer.sources import files
from wayfarer.sources.shared import scratch
from wayfarer.streaming import views, windows

FILES = 5


def _written(df: DataFrame, part: Column, path: str, parts: range) -> None:
    """One file after another, as a stream reads files by their age."""
    for n in parts:
        df.where(part == n).coalesce(1).write.mode("append").parquet(path)


def _by_days(ts: str) -> Column:
    """Six days a file, in order; the last file has all days after those."""
    return F.least(F.lit(FILES - 1), F.greatest(F.lit(0), F.floor(F.datediff(ts, F.lit("2024-01-01")) / 6)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """SELECT user_id, event_id, event_type AS state, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
       WHERE n = 1 AND event_type <> 'error'"""
)
def stream_state_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, after a stream that stopped half way, went on, and saw two files twice."""
    path, folder = scratch(spark, "log"), scratch(spark, "resumed")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("state"), "value")
    part = F.pmod(F.xxhash64("event_id"), F.lit(FILES))
    _written(events, part, path, range(3))
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    views.drained_state(log, "user_id", "event_id", F.col("state") == "error", folder)
    _written(events, part, path, range(3, FILES))
    _written(events, part, path, range(2))  # replayed
    return views.drained_state(log, "user_id", "event_id", F.col("state") == "error", folder)


# Rows of the first days come in the last file, when their sessions have long ended.
_LATE = "(event_id % 40 = 7 AND ts < TIMESTAMP '2024-01-10')"


@query(
    f"""WITH e AS (SELECT user_id, ts FROM events WHERE NOT {_LATE}),
        b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS begins FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM b)
        SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 4 HOUR AS ends, count(*) AS n FROM s GROUP BY user_id, session
        HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user from a stream, without rows that came too late."""
    path, events = scratch(spark, "timed"), _events(spark, sf_dir)
    part = F.when(F.expr(_LATE), FILES - 1).otherwise(_by_days("ts"))
    _written(events, part, path, range(FILES))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = windows.drained(windows.sessions(stream, "user_id", "ts", "4 hours", "1 day"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts", "ends")})


@query(
    """SELECT c.user_id, c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
       WHERE c.event_type = 'click' AND p.event_type = 'purchase'"""
)
def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of clicks and one of purchases, each in several files, joined within six hours."""
    events, streams = _events(spark, sf_dir), {}
    for kind in ("click", "purchase"):
        path = scratch(spark, kind)
        made = events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(kind), F.col("ts").alias(f"{kind}_at"))
        _written(made, _by_days(f"{kind}_at"), path, range(FILES))
        streams[kind] = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(path)
    joined = windows.met(streams["click"], streams["purchase"], "user_id", "click_at", "purchase_at", "6 hours", "7 days")
    return windows.drained(joined.select("user_id", "click", "purchase"))


@query(
    """SELECT CASE WHEN event_id % 11 IN (3, 5) THEN 'dead' WHEN event_type IN ('click', 'view') THEN event_type END AS route, CASE WHEN event_id % 11 NOT IN (3, 5) THEN user_id END AS user_id,
        count(*) AS n, sum(CASE WHEN event_id % 11 NOT IN (3, 5) THEN round(value * 100)::BIGINT END)::BIGINT AS cents FROM events
       WHERE event_id % 11 IN (3, 5) AND (event_id % 11 = 3 OR event_type IN ('click', 'view')) OR event_id % 11 NOT IN (3, 5) AND event_type IN ('click', 'view') GROUP BY ALL"""
)
def events_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of messages by kind, with those that can't be read or lack their key beside them."""
    turn = F.col("event_id") % 11
    message = F.to_json(F.struct(F.col("event_type").alias("event"), F.when(turn != 5, F.col("user_id")).alias("user_id"), F.round(F.col("value") * 100).cast("long").alias("cents")))
    path = scratch(spark, "messages")
    table(spark, sf_dir, "events").select(F.when(turn == 3, F.concat(F.lit("{"), "event_type")).otherwise(message).alias("value")).write.text(path)
    messages = windows.drained(spark.readStream.text(path))
    parts, dead = views.routed(messages, {"click": "cents long", "view": "cents long"})
    out = dead.select(F.lit("dead").alias("route"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("cents"))
    for name, part in parts.items():
        out = out.unionByName(part.select(F.lit(name).alias("route"), "user_id", F.col("payload.cents").alias("cents")))
    return out.groupBy("route", "user_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(
    """SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN '[' || k || ']' END AS orders FROM customer LEFT JOIN (
        SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_totalprice > 100000) AS k FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"""
)
def arrays_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as JSON texts; empty and missing ones are null."""
    keys = F.array_sort(F.collect_list(F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey"))))
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(keys.alias("k"))
    rows = table(spark, sf_dir, "customer").join(lists, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", arrays.json_or_null(F.col("k")).alias("orders"))


@query("SELECT o_orderkey, 'order.upserted' AS event, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS occurred_at, o_orderstatus AS status FROM orders")
def events_at_their_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as events of a fixed time, written and read back as lines."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), scratch(spark, "timed-events")
    at = F.to_date("o_orderdate").cast("timestamp")
    files.upsert_events(orders, "o_orderkey", "order.upserted", "order", at).select("value").write.text(path)
    field = lambda name: F.get_json_object("line", f"$.{name}")
    return files.read_lines(spark, path).select(
        field("o_orderkey").cast("long").alias("o_orderkey"), field("event").alias("event"), field("occurred_at").alias("occurred_at"), field("order.o_orderstatus").alias("status")
    )
