"""Files as sources and sinks: CSV, JSON lines, Parquet tables, raw bytes, message queues."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.sources.shared import exists

#: Characters of the longest field that a CSV reader takes.
FIELD_MOST = 10_000_000


def read_csv(spark: SparkSession, path: str, schema: str, breaks: bool = True) -> DataFrame:
    """A CSV file with a header, quoted fields and doubled quotes.

    With ``breaks`` fields may hold line breaks, and a file is one task; without, large
    files are cut at any line. Columns go by the schema, which is never inferred; a field that doesn't fit its
    type is null. Only the columns that a query needs are converted.
    """
    options = {"header": True, "multiLine": breaks, "quote": '"', "escape": '"', "maxCharsPerColumn": FIELD_MOST, "mode": "PERMISSIVE", "enforceSchema": False}
    return spark.read.options(**options).schema(schema).csv(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str, breaks: bool = True) -> DataFrame:
    """Several CSV files as one table with their names in ``split``."""
    parts = [read_csv(spark, path, schema, breaks).withColumn("split", F.lit(name)) for name, path in paths.items()]
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    return all_


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place): the lines of text files, and what sorts them: files by name, lines as they stand."""
    found = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"))
    # Ids rise within a block, which one task reads from its start to its end.
    return found.select("line", F.struct("block", F.monotonically_increasing_id().alias("n")).alias("place"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, i, summary) of a JSON-lines checkpoint, in which the last line of a key wins.

    Left out are blank lines, what isn't JSON, records without an identifier, those
    whose ``i`` is no integer, and those whose summary is blank or no text: they are
    to be tried again.
    """
    lines = read_lines(spark, path).where(F.trim("line") != "")
    text = F.from_json("line", "identifier string, i string, summary string", {"mode": "PERMISSIVE"})
    # Whether a value was a number or a text is told by the raw JSON.
    i_is_whole = F.regexp_like("line", F.lit(r'"i"\s*:\s*-?\d+\s*[,}]'))
    is_text = F.regexp_like("line", F.lit(r'"summary"\s*:\s*"'))
    read = lines.select("place", i_is_whole.alias("whole"), is_text.alias("text"), text.alias("r")).select("place", "whole", "text", "r.*")
    fine = read.where(F.col("whole") & F.col("text") & F.col("identifier").isNotNull() & (F.trim("summary") != ""))
    return fine.groupBy("identifier", F.col("i").try_cast("int").alias("i")).agg(F.max_by("summary", "place").alias("summary"))


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines: each call adds a folder whose name sorts behind those before."""
    df.write.mode("error").json(f"{path}/{time.time_ns():020d}")


def write_csv(df: DataFrame, path: str) -> None:
    """A new CSV folder that ``read_csv`` reads back; a path that exists is an error."""
    df.write.mode("error").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Scores or predictions as JSON, in a new folder."""
    df.write.mode("error").json(path)


def insert(df: DataFrame, path: str) -> None:
    """Bulk insert of rows into a Parquet table."""
    df.write.mode("append").parquet(path)


def seed(df: DataFrame, path: str) -> bool:
    """Fill a table only if it isn't there or has no row; whether it was filled."""
    spark = df.sparkSession
    if exists(spark, path) and not spark.read.schema(df.schema).parquet(path).isEmpty():
        return False
    insert(df, path)
    return True


def upsert_events(df: DataFrame, key: str, event: str, payload: str, at: Column | None = None) -> DataFrame:
    """Every row as the event that would have announced it: key and JSON value, in order of key.

    It occurred at ``at``, by default now. Order holds within a partition of the
    written topic, as it does for live events.
    """
    rest = F.struct(*[c for c in df.columns if c != key])
    now = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("occurred_at")
    value = F.to_json(F.struct(F.lit(event).alias("event"), F.col(key), now, rest.alias(payload)), {"ignoreNullFields": "false"})
    return df.select(F.col(key), value.alias("value")).repartitionByRange(key).sortWithinPartitions(key)


def read_queue(spark: SparkSession, servers: str, topic: str, most: int = 64) -> DataFrame:
    """(key, value, offset) of a message-queue topic from its start, ``most`` records a batch.

    It needs Spark's Kafka connector on the class path.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": most}
    found = spark.readStream.format("kafka").options(**options).load()
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "offset")


def write_queue(events: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of (key, value), keyed, acknowledged by all replicas and without repeats by retries."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
    events.select(F.col("key").cast("string").alias("key"), "value").write.format("kafka").options(**options).save()


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of objects in a store."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def is_pdf_upload(content: Column, most: int = 10 * 1024 * 1024) -> Column:
    """Not empty, not over ``most`` bytes, and a PDF by its first bytes; null content is none of it."""
    n = F.length(content)
    return F.coalesce((n > 0) & (n <= most) & (F.substring(content, 1, 4) == F.lit(b"%PDF")), F.lit(False))


def photo_keys(items: DataFrame, listing: DataFrame, key: str, explicit: str, folder: str, default: str, endings: tuple[str, ...] = ("jpg", "png", "webp")) -> DataFrame:
    """``items`` with ``photo``: the explicit key if that object exists, else the first that
    does of the ones named after the item, else the default.

    ``listing`` has the store's ``object`` names. One join finds all candidates of an
    item; the best one is a minimum over their places.
    """
    candidates = F.array(F.col(explicit), *[F.concat(F.lit(f"{folder}/"), F.col(key).cast("string"), F.lit(f".{e}")) for e in endings])
    asked = items.select(key, F.posexplode(candidates).alias("place", "object")).where("object is not null")
    best = asked.join(listing.select("object").distinct(), "object").groupBy(key).agg(F.min_by("object", "place").alias("photo"))
    return items.join(best, key, "left").withColumn("photo", F.coalesce("photo", F.lit(default)))
