"""Source and sink queries: files are written from the tables and read back by the rules of each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators.registry import query, table
from wayfarer.sources import files
from wayfarer.sources.shared import scratch


@query("""SELECT p_partkey, p_name || chr(10) || '"' || p_brand || '", ' || p_type AS note, p_retailprice FROM part""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas and line breaks in fields; of five columns three are read."""
    part = table(spark, sf_dir, "part")
    note = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type")
    path = scratch(spark, "csv")
    files.write_csv(part.select("p_partkey", note.alias("note"), "p_size", "p_brand", "p_retailprice"), path)
    return files.read_csv(spark, path, "p_partkey long, note string, p_size int, p_brand string, p_retailprice double").select("p_partkey", "note", "p_retailprice")


@query("SELECT CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(DISTINCT o_custkey) AS people FROM orders GROUP BY ALL")
def splits_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, paths = table(spark, sf_dir, "orders"), {}
    for i, name in enumerate(("train", "validation", "test")):
        paths[name] = scratch(spark, name)
        files.write_csv(orders.where(F.col("o_custkey") % 3 == i).select("o_orderkey", "o_custkey"), paths[name])
    all_ = files.read_splits(spark, paths, "o_orderkey long, o_custkey long")
    return all_.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_custkey").alias("people"))


@query(
    """WITH l AS (SELECT event_id, user_id::VARCHAR AS identifier, CAST(event_id % 4 AS INTEGER) AS i, event_type || ' ' || event_id AS summary FROM events WHERE event_type IN ('click', 'view'))
       SELECT identifier, i, summary FROM l QUALIFY row_number() OVER (PARTITION BY identifier, i ORDER BY event_id DESC) = 1"""
)
def progress_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint file in which blank, broken and incomplete lines stand between the good ones."""
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("user_id").alias("identifier"), (F.col("event_id") % 4).cast("int").alias("i"), F.concat_ws(" ", "event_type", "event_id").alias("summary")))
    line = (
        F.when(F.col("event_type").isin("click", "view"), good)
        .when(F.col("event_type") == "error", F.lit('{"identifier": "7", "i": 1, "summ'))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"identifier": '), F.col("user_id"), F.lit(', "i": "1", "summary": "i is a text"}')))
        .when(F.col("event_id") % 3 == 0, F.lit("  "))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"identifier": '), F.col("user_id"), F.lit(', "i": 2, "summary": "  "}')))
        .otherwise(F.lit('{"identifier": null, "i": 2, "summary": "nobody"}'))
    )
    path = scratch(spark, "progress")
    e.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return files.read_progress(spark, path)


@query("SELECT o_orderkey, max(o_totalprice + (o_orderkey % 2) * 1000) AS price FROM orders GROUP BY o_orderkey")
def lines_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of JSON lines; the later one's record of a key wins."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), scratch(spark, "lines")
    files.append_lines(orders, path)
    files.append_lines(orders.where("o_orderkey % 2 = 1").withColumn("price", F.col("price") + 1000), path)
    read = files.read_lines(spark, path).select("place", F.from_json("line", "o_orderkey long, price double").alias("r"))
    return read.groupBy("r.o_orderkey").agg(F.max_by("r.price", "place").alias("price"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def seeded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding fills an empty table and leaves one with rows alone; inserts add to it."""
    nation, path = table(spark, sf_dir, "nation"), scratch(spark, "seeded")
    files.seed(nation.limit(0), path)
    files.seed(nation, path)
    files.seed(nation.withColumn("n_name", F.lit("again")), path)
    files.insert(nation.withColumn("n_nationkey", F.col("n_nationkey") + 100), path)
    return spark.read.schema(nation.schema).parquet(path)


@query("SELECT p_partkey, 'part.upserted' AS event, p_name AS name, p_retailprice AS price, CASE WHEN p_size > 25 THEN 'null' ELSE p_size::VARCHAR END AS size FROM part")
def events_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as an upsert event, in order of its key; null fields are spelled out."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("p_size"))
    path = scratch(spark, "events")
    files.upsert_events(part, "p_partkey", "part.upserted", "part").select("value").write.text(path)
    field = lambda name: F.get_json_object("line", f"$.{name}")
    size = F.regexp_extract("line", r'"p_size":([^,}]+)', 1)
    return files.read_lines(spark, path).select(
        field("p_partkey").cast("long").alias("p_partkey"), field("event").alias("event"), field("part.p_name").alias("name"), field("part.p_retailprice").cast("double").alias("price"), size.alias("size")
    )


@query("SELECT p_brand AS name, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY ALL")
def scores_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "scores")
    files.write_json(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")), path)
    return spark.read.schema("name string, n long, mean double").json(path)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 <> 0 THEN false ELSE strlen(text) + 5 <= 3000 END AS fine FROM documents")
def uploads_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that begin like a PDF and are neither none nor too many."""
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit(b""))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"%PDF-"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return d.select("doc_id", files.is_pdf_upload(content, 3000).alias("fine"))


@query("SELECT s_suppkey, s_name FROM supplier")
def objects_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a store as bytes, and their text."""
    path = scratch(spark, "objects")
    table(spark, sf_dir, "supplier").select(F.concat_ws("|", "s_suppkey", "s_name").alias("value")).write.text(path)
    text = files.read_bytes(spark, path).where("length > 0").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line != ''")
    return text.select(F.split("line", "[|]")[0].cast("long").alias("s_suppkey"), F.split("line", "[|]")[1].alias("s_name"))


@query(
    """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'own/' || p_partkey % 40 END AS own FROM part)
       SELECT p_partkey, CASE WHEN own IS NOT NULL AND p_partkey % 40 < 20 THEN own WHEN p_partkey % 6 = 1 THEN 'parts/' || p_partkey || '.jpg' WHEN p_partkey % 3 = 1 THEN 'parts/' || p_partkey || '.png'
           WHEN p_partkey % 5 = 2 THEN 'parts/' || p_partkey || '.webp' ELSE 'parts/none.png' END AS photo FROM c"""
)
def photos_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    named = lambda ending: F.concat(F.lit("parts/"), key, F.lit(f".{ending}"))
    listing = spark.range(20).select(F.concat(F.lit("own/"), F.col("id")).alias("object"))
    for ending, on in (("jpg", key % 6 == 1), ("png", key % 3 == 1), ("webp", key % 5 == 2)):
        listing = listing.union(part.where(on).select(named(ending)))
    items = part.select("p_partkey", F.when(key % 4 == 0, F.concat(F.lit("own/"), key % 40)).alias("own"))
    return files.photo_keys(items, listing, "p_partkey", "own", "parts", "parts/none.png").select("p_partkey", "photo")
