"""Event time: sessions of a key, and two streams that meet within an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.sources.shared import scratch


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, starts, ends, n): runs of a key's events less than ``gap`` apart.

    A stream gives a session once its end lies ``late`` behind the latest event seen,
    and drops rows whose own session had ended by then; a batch drops none and gives
    all.
    """
    made = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def met(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, late: str) -> DataFrame:
    """Rows of both sides with the same key, the right one at most ``within`` after the left one.

    Both sides are bounded by their watermarks, so a stream forgets rows that nothing
    can meet any more. Columns other than ``key`` must have different names.
    """
    after = right.withWatermark(right_ts, late).withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return left.withWatermark(left_ts, late).join(after, on).drop("_key")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream gives for all that is available; rows are written once each.

    With a ``folder`` of its own a later call goes on where this one ended, and gives
    the rows of both.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, "drained")
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
