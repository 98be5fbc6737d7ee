"""Streams of keyed events: routing, the state that they leave, and events that answer events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.arrays import distinct_ignoring_case
from wayfarer.functions.text import blank_to_null
from wayfarer.operators.merge import latest, merged_profile
from wayfarer.sources.shared import scratch
from wayfarer.streaming.log_table import LogTable, current


def routed(events: DataFrame, kinds: dict[str, str], key: str = "user_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Parsed events of each known kind, and the dead letters of the whole stream.

    ``events`` has a JSON text ``value``; ``kinds`` maps each event name to the DDL of
    its fields. Unknown events are ignored; those whose key is absent or no number are
    dead letters, and so is what isn't JSON. One bad message loses no other.
    """
    read = events.withColumn("event", F.get_json_object("value", "$.event")).withColumn(key, F.get_json_object("value", f"$.{key}").try_cast("long"))
    known = read.where(F.col("event").isin(*kinds))
    parts = {name: known.where((F.col("event") == name) & F.col(key).isNotNull()).withColumn("payload", F.from_json("value", ddl)) for name, ddl in kinds.items()}
    return parts, read.where(F.col("event").isNull() | (F.col("event").isin(*kinds) & F.col(key).isNull())).select("value")


def _drained(log: DataFrame, folder: str, each: Callable[[DataFrame, int], None]) -> None:
    """Handle all that is available in a stream, batch by batch, from where the folder's progress ends."""
    run = log.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()


def drained_state(log: DataFrame, key: str, offset: str, gone: Column, folder: str | None = None) -> DataFrame:
    """What all events available in a stream leave as state: reads up to now, then stops.

    With a ``folder`` of its own a later call reads on where this one ended.
    """
    spark = log.sparkSession
    folder = folder or scratch(spark, "state")
    table = LogTable(spark, f"{folder}/state", key, offset)
    _drained(log, folder, table.merge)
    found = current(table, gone)
    return spark.createDataFrame([], latest_schema(log, key, offset)) if found is None else found


def latest_schema(log: DataFrame, key: str, offset: str):
    """Columns as ``latest`` orders them."""
    rest = [c for c in log.columns if c not in (key, offset)]
    return log.select(key, offset, *rest).schema


#: Events about people, and what they tell.
PARSED, UPDATED, MAPPED = "user.profile.parsed", "user.profile.updated", "user.esco_skills.mapped"


def reactions(batch: DataFrame, profiles: DataFrame, mapper: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, skills, emitted): what a batch of events changes, and the events that answer it.

    ``batch`` has user_id, event_id, event, summary, skills (texts) and mapped (structs
    of uri and label); ``profiles`` user_id, summary and skills; ``mapper`` makes
    (user_id, mapped) of (user_id, skills).

    A parsed résumé is merged into its user's profile, which is announced as updated;
    of one without a profile nothing comes. An updated profile is answered with its
    mapped skills. Mapped skills replace the user's set and are answered with nothing,
    or each mapping would call for the next. A batch answers a user once for each
    kind, with the state after all of the batch.
    """
    parsed = batch.where(F.col("event") == PARSED)
    order = F.array_sort(F.collect_list(F.struct("event_id", "summary", "skills")))
    each = parsed.groupBy("user_id").agg(order.alias("e"))
    filled = F.filter(F.transform("e", lambda e: blank_to_null(e["summary"])), lambda x: x.isNotNull())
    texts = F.flatten(F.transform("e", lambda e: F.coalesce(e["skills"], F.array().cast("array<string>"))))
    told = each.select("user_id", F.try_element_at(filled, F.lit(1)).alias("summary"), distinct_ignoring_case(texts).alias("skills"))
    after = merged_profile(profiles, told, "user_id", ["summary"], ["skills"])
    announced = after.join(told.select("user_id"), "user_id", "left_semi").select("user_id", F.lit(UPDATED).alias("event"), F.to_json(F.struct("summary", "skills")).alias("payload"))

    last = latest(batch.where(F.col("event") == UPDATED).select("user_id", "event_id", "skills"), "user_id", "event_id")
    answers = mapper(last.select("user_id", "skills")).select("user_id", F.lit(MAPPED).alias("event"), F.to_json(F.struct(F.col("mapped").alias("esco_skills"))).alias("payload"))

    told_skills = latest(batch.where(F.col("event") == MAPPED).select("user_id", "event_id", "mapped"), "user_id", "event_id")
    fine = F.filter(F.transform("mapped", lambda m: F.struct(F.trim(m["uri"]).alias("uri"), F.trim(m["label"]).alias("label"))), lambda m: (m["uri"] != "") & (m["label"] != ""))
    return after, told_skills.select("user_id", fine.alias("mapped")), announced.union(answers)


def drained_reactions(log: DataFrame, profiles: DataFrame, mapper: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, skills, emitted) after all events available in a stream.

    What a batch emits is written under its number, so a batch that runs again
    overwrites its own answers and no other's. A batch looks at its own users'
    profiles alone: the rows of ``profiles`` and of the state are joined with them
    before anything else. With a ``folder`` of its own a later call reads on.
    """
    spark = log.sparkSession
    folder = folder or scratch(spark, "reactions")
    kept, sets = LogTable(spark, f"{folder}/profiles", "user_id", "event_id"), LogTable(spark, f"{folder}/skills", "user_id", "event_id")
    first = profiles.select("user_id", F.lit(-1).cast("long").alias("event_id"), "summary", "skills")

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        users = batch.select("user_id").distinct()
        here, old = first.join(users, "user_id", "left_semi"), kept.before(number, users)
        if old is not None:
            here = latest(here.unionByName(old), "user_id", "event_id")
        after, told, emitted = reactions(batch, here.select("user_id", "summary", "skills"), mapper)
        at = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        emitted.write.mode("overwrite").json(f"{folder}/out/b{number}")
        kept.merge(after.join(at, "user_id").select("user_id", "event_id", "summary", "skills"), number)
        sets.merge(told.join(at, "user_id").select("user_id", "event_id", "mapped"), number)
        batch.unpersist()

    _drained(log, folder, each)
    state, told = kept.state(), sets.state()
    now = first if state is None else latest(first.unionByName(state), "user_id", "event_id")
    if state is None:
        emitted = spark.createDataFrame([], "user_id long, event string, payload string")
    else:
        emitted = spark.read.schema("user_id long, event string, payload string").json(f"{folder}/out/*")
    skills = spark.createDataFrame([], "user_id long, mapped array<struct<uri:string,label:string>>") if told is None else told.select("user_id", "mapped")
    return now.select("user_id", "summary", "skills"), skills, emitted


def windowed_counts(events: DataFrame, ts: str, group: str, width: str, late: str) -> DataFrame:
    """Events of each group in tumbling windows; later ones than ``late`` are dropped by a stream."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), group).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("starts"), group, "n")

