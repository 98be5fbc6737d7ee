"""Queries from texts to vectors, and from these to concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators import ranking, skills, training
from wayfarer.operators.career import vocabulary
from wayfarer.operators.embedders import HashedNgrams, embedded
from wayfarer.operators.registry import query, table
from wayfarer.sources.shared import settled

EMBEDDER = HashedNgrams()


def _vectors_sql(of: str) -> str:
    """(text, bucket, value) of the distinct texts of a relation, by the same features and md5 buckets."""
    return f"""
    tw AS (SELECT text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT text FROM {of} WHERE text IS NOT NULL)),
    tf AS (
        SELECT text, 'w:' || unnest(ws) AS feature, 1.0::DOUBLE AS weight FROM tw
        UNION ALL SELECT text, 'p:' || ws[i] || ' ' || ws[i + 1], 0.5 FROM (SELECT text, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM tw)
        UNION ALL SELECT text, 'c:' || substr(w, i, n), 0.4 FROM (SELECT text, w, n, unnest(generate_series(1, length(w) - n + 1)) AS i
            FROM (SELECT text, '<' || unnest(ws) || '>' AS w FROM tw), (SELECT unnest([3, 4]) AS n))),
    tb AS (
        SELECT text, ('0x' || substr(md5(feature), 1, 8))::BIGINT % 256 AS bucket, sum(CASE WHEN substr(md5(feature), 9, 1) < '8' THEN 1 ELSE -1 END * weight * root) AS value
        FROM (SELECT text, feature, weight, sqrt(count(*)) AS root FROM tf GROUP BY ALL) GROUP BY ALL),
    tv AS (SELECT text, bucket, value / sqrt(sum(value * value) OVER (PARTITION BY text)) AS value FROM tb)"""


@query(f"WITH texts AS (SELECT text FROM conversations UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM benchmark), {_vectors_sql('texts')} SELECT text, bucket, round(value, 6) + 0.0 AS value FROM tb")
def text_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole turns, names and passages leave in the buckets of a hashed vector."""
    texts = table(spark, sf_dir, "conversations").select("text").union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "benchmark").select("text"))
    made = EMBEDDER.sparse(texts.where("text is not null").distinct(), "text", "text")
    return made.select(F.col("key").alias("text"), "bucket", (F.round("value", 6) + F.lit(0.0)).alias("value"))


_CATALOGUE = """
    names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS concept FROM (SELECT DISTINCT p_name FROM part)),
    labels AS (
        SELECT concept, 2 * concept AS id, p_name || ' making' AS text FROM names
        UNION ALL SELECT concept, 2 * concept + 1, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' work' FROM names),
    asked AS (
        SELECT s_nationkey AS "user", min(l_orderkey * 10 + l_linenumber) AS position, skill FROM (
            SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN 'working with ' || p_name WHEN 2 THEN upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) ELSE p_brand END AS skill
            FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY ALL)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, labels, skills) as texts alone."""
    parts = table(spark, sf_dir, "part")
    name, word = F.col("p_name"), lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    names = settled(vocabulary(parts, "p_name").select(F.col("value").alias("p_name"), (F.col("id") + 1).alias("concept")), "names")
    labels = names.select("concept", (2 * F.col("concept")).alias("id"), F.concat(name, F.lit(" making")).alias("label"))
    labels = labels.unionByName(names.select("concept", (2 * F.col("concept") + 1).alias("id"), F.concat(word(2), F.lit(" "), word(1), F.lit(" work")).alias("label")))
    turn = F.col("p_partkey") % 4
    skill = F.when(turn == 0, F.concat(name, F.lit("s"))).when(turn == 1, F.concat(F.lit("working with "), name)).when(turn == 2, F.concat(F.upper(word(2)), F.lit(", "), word(1))).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    asked = rows.groupBy(F.col("s_nationkey").alias("user"), skill.alias("skill")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return names, labels, asked


@query(
    rf"""WITH {_CATALOGUE}, texts AS (SELECT p_name AS text FROM names UNION ALL SELECT text FROM labels UNION ALL SELECT skill FROM asked), {_vectors_sql("texts")},
        pairs AS (SELECT a.text AS skill, b.text AS other, sum(a.value * b.value) AS score FROM tv a JOIN tv b USING (bucket) WHERE a.text IN (SELECT skill FROM asked) GROUP BY ALL),
        by_label AS (SELECT skill, concept, max(score) AS score FROM (SELECT s.skill, l.concept, coalesce(p.score, 0) AS score FROM (SELECT DISTINCT skill FROM asked) s CROSS JOIN labels l LEFT JOIN pairs p ON p.skill = s.skill AND p.other = l.text) GROUP BY ALL),
        mixed AS (SELECT b.skill, b.concept, n.p_name, 0.85 * b.score + 0.15 * coalesce(p.score, 0) AS score FROM by_label b JOIN names n USING (concept) LEFT JOIN pairs p ON p.skill = b.skill AND p.other = n.p_name),
        top AS (SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY skill ORDER BY score DESC, concept) = 1),
        done AS (SELECT a."user", a.position, a.skill, 'c/' || concept AS uri, p_name AS label FROM asked a JOIN top USING (skill) WHERE score >= 0.6)
        SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY "user", uri ORDER BY position) = 1"""
)
def skills_mapped_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills and a catalogue that are texts alone: embedded, and mapped by their vectors."""
    names, labels, asked = _catalogue(spark, sf_dir)
    concepts = embedded(EMBEDDER, names, "p_name").select("concept", "vec", F.concat(F.lit("c/"), "concept").alias("uri"), F.col("p_name").alias("name"))
    labels = settled(embedded(EMBEDDER, labels, "label"), "labels")
    asked = embedded(EMBEDDER, asked, "skill", side="queries").withColumn("context", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "name string, uri string")
    return skills.mapped_skills(asked, labels, settled(concepts, "concepts"), none, []).select("user", "position", "skill", "uri", "label")


@query(
    f"""WITH kinds AS (SELECT DISTINCT role AS text FROM conversations UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT event_type FROM events),
        labels AS (SELECT text, row_number() OVER (ORDER BY text) AS id FROM kinds),
        asked AS (SELECT DISTINCT text FROM (SELECT lower(p_type) || 's for ' || p_name AS text FROM part UNION ALL SELECT event_type || ' events' FROM events)),
        texts AS (SELECT text FROM labels UNION ALL SELECT text FROM asked), {_vectors_sql("texts")},
        s AS (SELECT a.text, l.text AS label, l.id, coalesce(sum(x.value * y.value), 0) AS score FROM asked a CROSS JOIN labels l LEFT JOIN tv x ON x.text = a.text LEFT JOIN tv y ON y.text = l.text AND y.bucket = x.bucket GROUP BY ALL)
        SELECT text, label, round(score, 6) + 0.0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, id) = 1"""
)
def nearest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free texts and the category whose name is nearest, by the vectors of both."""
    parts, events = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    kinds = table(spark, sf_dir, "conversations").select(F.col("role").alias("text")).union(parts.select("p_type")).union(events.select("event_type"))
    labels = vocabulary(kinds, "text").withColumnRenamed("value", "text")
    asked = parts.select(F.concat(F.lower("p_type"), F.lit("s for "), "p_name").alias("text")).union(events.select(F.concat("event_type", F.lit(" events")))).distinct()
    bank = settled(embedded(EMBEDDER, labels, "text"), "categories")
    queries = settled(embedded(EMBEDDER, asked, "text", side="queries").withColumn("query", F.xxhash64("text")), "asked")
    best = ranking.nearest(queries.select("query", "vec"), bank, 1, bank.count()).join(queries.select("query", "text"), "query")
    return best.join(bank.select("id", F.col("text").alias("label")), "id").select("text", "label", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query("SELECT 3 AS members, true AS learns, true AS better")
def contrastive_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeds learn which language's name a whole text leads to: losses that fall, and, on
    texts held out, a mean reciprocal rank of members and ensemble above that of the vectors as they are."""
    embedder = HashedNgrams(size=96, longest=3, pairs=0.0)
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    names = vocabulary(docs, "lang").select("id", F.col("value").alias("lang"), F.concat(F.lit("language "), "value").alias("name"))
    bank = settled(embedded(embedder, names, "name").select("id", "lang", "vec", F.col("id").alias("place")), "languages")
    texts = embedder.queries(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id", "text")
    rows = docs.select("doc_id", "lang").dropDuplicates(["doc_id"]).join(texts, "doc_id").join(bank.select("lang", F.col("vec").alias("target"), F.col("id").alias("own")), "lang")
    rows = settled(rows.where("vec is not null").select(F.col("doc_id").alias("query"), "vec", "target", "own"), "pairs")
    weights, losses = training.trained(rows.where("query % 5 != 0"), bank, [1, 2, 3], rounds=30, rate=0.03, negatives=256)
    asked = rows.where("query % 5 = 0")
    plain = asked.select(F.lit("plain").alias("member"), "query", "vec")
    made = training.predicted(asked, weights).withColumn("member", F.coalesce("member", F.lit("all")))
    both = settled(made.unionByName(plain).join(asked.select("query", "own"), "query").withColumn("ask", F.xxhash64("member", "query")), "predicted")
    ranks = ranking.against_bank(both.select(F.col("ask").alias("query"), "vec", "own"), bank, bank.count()).select(F.col("query").alias("ask"), (F.col("above") + F.col("ties") + 1).alias("rank"))
    mrr = {r["member"]: r["mrr"] for r in ranks.join(both.select("ask", "member"), "ask").groupBy("member").agg(F.avg(1 / F.col("rank")).alias("mrr")).collect()}
    falls = all(b < a for a, b in zip(losses[0], losses[-1], strict=True))
    members = [m for m in mrr if m not in ("plain", "all")]
    return spark.createDataFrame([(len(members), falls, all(mrr[m] > mrr["plain"] for m in mrr if m != "plain"))], "members int, learns boolean, better boolean")
