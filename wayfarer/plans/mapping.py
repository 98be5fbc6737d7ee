"""Skill mapping and evaluation queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.vectors import cosine, mean_vectors, normalised
from wayfarer.operators import career, merge, ranking, skills
from wayfarer.operators.registry import query, table
from wayfarer.plans.careers import _rounded
from wayfarer.plans.vectors import _E, _MEAN, _centroids, _vectors

# What stands for skills, labels and contexts, in both forms.
_SKILLS = """
    sk AS (
        SELECT vec_id // 4 AS "user", vec_id % 4 AS position, vec_id,
            trim(CASE vec_id % 10 WHEN 0 THEN ' Team-Based' WHEN 1 THEN 'expert ' WHEN 2 THEN ' SQL ' WHEN 3 THEN '  ' WHEN 4 THEN 'tool ' || vec_id % 3 ELSE 'skill ' || vec_id % 50 END) AS skill,
            CASE vec_id % 3 WHEN 0 THEN 'the ward''s Nurse at sea' WHEN 1 THEN 'a case worker; nurses' END AS context, v
        FROM e),
    lab AS (
        SELECT vec_id AS id, label AS concept, v,
            CASE vec_id % 7 WHEN 0 THEN 'leadership in  nursing' WHEN 1 THEN 'plan for the social  work' WHEN 2 THEN 'Sail IN A maritime world' WHEN 3 THEN 'nursing management for hotels' ELSE 'label ' || vec_id END AS name FROM e)"""


def _skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    name = (
        F.when(i % 10 == 0, " Team-Based").when(i % 10 == 1, "expert ").when(i % 10 == 2, " SQL ").when(i % 10 == 3, "  ").when(i % 10 == 4, F.concat(F.lit("tool "), i % 3)).otherwise(F.concat(F.lit("skill "), i % 50))
    )
    context = F.when(i % 3 == 0, "the ward's Nurse at sea").when(i % 3 == 1, "a case worker; nurses")
    return table(spark, sf_dir, "embeddings").select(F.floor(i / 4).alias("user"), (i % 4).alias("position"), name.alias("skill"), context.alias("context"), F.col("embedding").alias("vec"))


def _label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    name = F.when(i % 7 == 0, "leadership in  nursing").when(i % 7 == 1, "plan for the social  work").when(i % 7 == 2, "Sail IN A maritime world").when(i % 7 == 3, "nursing management for hotels").otherwise(F.concat(F.lit("label "), i))
    return table(spark, sf_dir, "embeddings").select(i.alias("id"), F.col("label").alias("concept"), F.col("embedding").alias("vec"), name.alias("label"))


_BORNE = """(CASE WHEN name LIKE 'leadership%' THEN context LIKE '%Nurse%' WHEN name LIKE 'plan%' THEN context LIKE '%case worker%' WHEN name LIKE 'Sail%' THEN false ELSE true END)"""


@query(f"WITH {_E}, {_SKILLS} SELECT l.id, k.vec_id AS skill_id, coalesce({_BORNE}, false) AS fine FROM lab l JOIN sk k ON k.vec_id = (l.id * 7) % (SELECT count(*) FROM e)")
def domains_borne_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels bound to a domain need a word of it in the context."""
    asked = _skill_rows(spark, sf_dir).select((F.col("user") * 4 + F.col("position")).alias("skill_id"), "context")
    labels = _label_rows(spark, sf_dir)
    rows = labels.select("id", F.col("label").alias("name"), (F.col("id") * 7 % labels.count()).alias("skill_id"))
    return rows.join(asked, "skill_id").select("id", "skill_id", skills.borne_out(F.col("name"), F.col("context")).alias("fine"))


@query(f"WITH {_E}, {_SKILLS} SELECT vec_id AS id, lower(skill) IN ('expert', 'team-based') AS modifier FROM sk")
def modifiers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skill_rows(spark, sf_dir).select((F.col("user") * 4 + F.col("position")).alias("id"), skills.is_modifier(F.col("skill")).alias("modifier"))


@query(
    f"""WITH {_E}, {_SKILLS}, {_MEAN},
        once AS (SELECT * FROM sk WHERE skill <> '' AND lower(skill) NOT IN ('expert', 'team-based') QUALIFY row_number() OVER (PARTITION BY "user", skill ORDER BY position) = 1),
        s AS (SELECT k.vec_id, l.concept, l.id AS label_id, l.name, list_inner_product(k.v, l.v) AS score FROM once k, lab l WHERE lower(skill) <> 'sql' AND l.concept <> 4),
        h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, concept ORDER BY score DESC, label_id) = 1),
        y AS (SELECT h.vec_id, h.concept, h.name, CASE WHEN k.skill = 'tool 1' THEN h.score ELSE 0.85 * h.score + 0.15 * c.score END AS hybrid
            FROM h JOIN once k USING (vec_id) JOIN scores c ON c.vec_id = h.vec_id AND c.id = h.concept),
        fine AS (SELECT y.* FROM y JOIN once k USING (vec_id) WHERE coalesce({_BORNE}, false)),
        top AS (SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY hybrid DESC, concept) = 1),
        done AS (SELECT k."user", k.position, k.skill, CASE WHEN lower(k.skill) = 'sql' THEN 'c/2' WHEN t.hybrid >= 0.6 THEN 'c/' || t.concept END AS uri FROM once k LEFT JOIN top t USING (vec_id))
        SELECT "user", position, skill, uri, 'concept ' || substr(uri, 3) AS label FROM done WHERE uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "user", uri ORDER BY position) = 1"""
)
def skills_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' free-text skills as concepts: cleaned, some given, the others by vectors and context."""
    labels = _label_rows(spark, sf_dir)
    name = F.concat(F.lit("c/"), "concept")
    concepts = _centroids(spark, sf_dir).select(F.col("id").alias("concept"), "vec").withColumn("uri", F.when(F.col("concept") == 4, F.lit(f"c/{skills.NEVER[0]}")).otherwise(name)).withColumn("name", F.concat(F.lit("concept "), "concept"))
    given = spark.createDataFrame([(" Sql", "c/2")], "name string, uri string")
    return skills.mapped_skills(_skill_rows(spark, sf_dir), labels, concepts, given, ["Tool 1"]).select("user", "position", "skill", "uri", "label")


@query(
    f"""WITH {_E}, {_MEAN}, p AS (SELECT vec_id, label, vec_id // 10 AS person, vec_id % 10 AS n, v FROM e),
        last AS (SELECT a.vec_id, a.label, b.v AS q FROM p a JOIN p b ON b.person = a.person AND b.n = a.n - 1),
        z AS (SELECT a.vec_id, a.label, generate_subscripts(b.v, 1) AS place, unnest(b.v) AS x FROM p a JOIN p b ON b.person = a.person AND b.n < a.n),
        pool AS (SELECT vec_id, label, list(x ORDER BY place) AS q FROM (SELECT vec_id, label, place, avg(x) AS x FROM z GROUP BY ALL) GROUP BY ALL),
        both_ AS (SELECT 'last' AS pool, * FROM last UNION ALL SELECT 'mean', * FROM pool),
        s AS (SELECT b.pool, b.vec_id, b.label, m.label AS id, round(list_inner_product(b.q, m.c), 12) AS score FROM both_ b, m),
        r AS (SELECT pool, vec_id, 1 + count(*) FILTER (score > t) AS rank FROM (SELECT *, max(score) FILTER (id = label) OVER (PARTITION BY pool, vec_id) AS t FROM s) GROUP BY ALL)
        SELECT pool, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5,
            round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, count(*) AS n FROM r GROUP BY ROLLUP (pool)"""
)
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two baselines against the whole bank: the last vector of a history, and the mean of all."""
    rows = _vectors(spark, sf_dir).select("id", "vec", "label", F.floor(F.col("id") / 10).alias("person"), (F.col("id") % 10).alias("n"))
    pairs = rows.select("id", "label", "person", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), "n").where("n > 0 and at < n")
    past = pairs.join(rows.select("person", F.col("n").alias("at"), "vec"), ["person", "at"])
    last = past.where("at = n - 1").select("id", "label", "vec", F.lit("last").alias("pool"))
    mean = mean_vectors(past, ["id", "label"], "vec").select("id", "label", F.col("mean").alias("vec"), F.lit("mean").alias("pool"))
    made = last.select("id", "label", "pool", F.transform("vec", lambda x: x.cast("double")).alias("vec")).unionByName(mean)
    asked = made.withColumn("query", F.col("id") * 2 + (F.col("pool") == "mean").cast("int"))
    bank = _centroids(spark, sf_dir)
    found = ranking.against_bank(asked.select("query", "vec", F.col("label").cast("long").alias("own")), bank, bank.count())
    ranks = found.select((F.col("above") + 1).alias("rank"), F.when(F.col("query") % 2 == 1, "mean").otherwise("last").alias("pool"))
    return _rounded(ranking.ranking_metrics(ranks, F.col("rank"), None, ["pool"]), "mrr", "r1", "r5", "r10")


@query(
    f"""WITH {_E}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_inner_product(a.v, b.v) AS score, a.v AS va, b.v AS vb, o.v AS vo, o.vec_id AS own
            FROM e a JOIN e o ON o.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e) CROSS JOIN e b)
        SELECT query, round(ln(sum(exp(score / 0.05)) FILTER (id = own OR list_inner_product(vo, vb) <= 0.6)) - max(score / 0.05) FILTER (id = own), 4) AS loss FROM s GROUP BY query"""
)
def masked_contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the bank too like the true one don't count as wrong."""
    rows = _vectors(spark, sf_dir)
    n = rows.count()
    asked = rows.select("id", "vec", ((F.col("id") + 1) % n).alias("own"))
    return ranking.masked_losses(asked, 0.05, 0.6).select("query", F.round("loss", 4).alias("loss"))


@query(f"WITH {_E} SELECT a.label, round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) AS loss FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 GROUP BY a.label")
def cosine_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    target = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("target"))
    return rows.join(target, "id").groupBy("label").agg(F.round(1 - F.avg(cosine(F.col("vec"), F.col("target"))), 6).alias("loss"))


@query(
    f"""WITH {_E}, n AS (SELECT vec_id // 3 AS pair, generate_subscripts(v, 1) - 1 AS place, unnest(v) / sqrt(list_inner_product(v, v)) AS x FROM e),
        m AS (SELECT pair, place, avg(x) AS x FROM n GROUP BY ALL), l AS (SELECT pair, sqrt(sum(x * x)) AS norm FROM m GROUP BY pair)
        SELECT pair, place, round(x / norm, 6) AS x FROM m JOIN l USING (pair)"""
)
def ensemble_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of members' vectors of length 1, again of length 1."""
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("id") / 3).alias("pair"), normalised(F.col("vec")).alias("vec"))
    made = mean_vectors(rows, ["pair"], "vec").select("pair", F.posexplode(normalised(F.col("mean"))).alias("place", "x"))
    return _rounded(made.withColumn("place", F.col("place").cast("long")), "x")


@query(f"WITH {_E}, {_MEAN} SELECT vec_id AS query, CAST(id AS BIGINT) AS by_likeness, CAST(label AS BIGINT) AS by_name FROM (SELECT s.*, e.label FROM scores s JOIN e USING (vec_id)) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) = 1".replace("SELECT s.*, e.label", "SELECT s.vec_id, s.id, s.score, e.label"))
def true_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true row of a bank by what is most alike, and by name."""
    rows, bank = _vectors(spark, sf_dir), _centroids(spark, sf_dir)
    best = ranking.nearest(rows.select(F.col("id").alias("query"), "vec"), bank, 1, bank.count())
    return best.select("query", F.col("id").alias("by_likeness")).join(rows.select(F.col("id").alias("query"), F.col("label").cast("long").alias("by_name")), "query")


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT p_name AS value FROM part UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer)")
def label_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits' distinct target texts, numbered in code point order."""
    part = table(spark, sf_dir, "part")
    texts = part.select(F.col("p_name").alias("t")).union(part.select("p_type")).union(table(spark, sf_dir, "customer").select("c_mktsegment"))
    return career.vocabulary(texts, "t")


@query(
    """WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT range AS draw, ('0x' || substr(md5('5:' || range), 1, 8))::BIGINT % n AS place FROM range(256), n)
       SELECT draw, vec_id AS id FROM d JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) USING (place)"""
)
def negatives_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded draw of bank rows with replacement."""
    ids = career.vocabulary(table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 20, "0").alias("key")), "key")
    return ranking.drawn(ids.select(F.col("value").cast("long").alias("id"), F.col("id").alias("place")).withColumnRenamed("id", "vec_id"), 256, 5).select("draw", F.col("vec_id").alias("id"))


@query("SELECT vec_id AS id FROM embeddings ORDER BY md5('9:' || vec_id), vec_id LIMIT 64")
def permutation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a seeded shuffle, without replacement."""
    return ranking.shuffled(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", 9, 64)


@query("SELECT c_custkey AS id, vec_id IS NOT NULL AS ready, CASE WHEN vec_id IS NULL THEN 'pending' ELSE 'ready' END AS status FROM customer LEFT JOIN embeddings ON vec_id = c_custkey * 2")
def vectors_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"))
    both = table(spark, sf_dir, "customer").join(vecs, F.col("v") == F.col("c_custkey") * 2, "left")
    ready = F.col("v").isNotNull()
    return both.select(F.col("c_custkey").alias("id"), ready.alias("ready"), F.when(ready, "ready").otherwise("pending").alias("status"))


@query(
    """WITH c AS (SELECT c_custkey AS u, c_name || '!' AS t0 FROM customer WHERE c_custkey % 2 = 0),
        n AS (SELECT o_custkey AS u, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE upper(o_orderpriority) END AS title, nullif(o_orderstatus, 'P') AS start FROM orders),
        cur AS (SELECT c_custkey AS u, lower(o_orderpriority) AS title, nullif(o_orderstatus, 'P') AS start, 0 AS pos FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) = 1),
        once AS (SELECT * FROM n WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY u, lower(title), coalesce(start, '') ORDER BY k) = 1),
        fresh AS (SELECT o.* FROM once o WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.u = o.u AND cur.title = lower(o.title) AND coalesce(cur.start, '') = coalesce(o.start, '')))
        SELECT u, title, start, pos FROM cur UNION ALL
        SELECT u, title, start, CAST(coalesce((SELECT max(pos) FROM cur WHERE cur.u = fresh.u), -1) + row_number() OVER (PARTITION BY u ORDER BY k) AS INTEGER) FROM fresh"""
)
def experiences_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed jobs that a profile lacks are appended; run twice, the second run adds nothing."""
    o = table(spark, sf_dir, "orders")
    start = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    new = o.select(F.col("o_custkey").alias("u"), "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.upper("o_orderpriority")).alias("title"), start.alias("start"), F.lit(0).alias("pos"))
    first = o.groupBy(F.col("o_custkey").alias("u")).agg(F.min_by(F.struct(F.lower("o_orderpriority").alias("title"), start.alias("start")), "o_orderkey").alias("f"))
    current = first.select("u", F.col("f.title").alias("title"), F.col("f.start").alias("start"), F.lit(0).alias("pos"))
    once = merge.appended(current, new, "u", "title", [F.col("start")], "pos", "o_orderkey")
    return merge.appended(once, new, "u", "title", [F.col("start")], "pos", "o_orderkey")


@query(
    f"""WITH {_E}, h AS (SELECT generate_subscripts(v, 1) AS place, unnest(v) AS x FROM e WHERE vec_id // 10 = 3), q AS (SELECT list(x ORDER BY place) AS q FROM (SELECT place, avg(x) AS x FROM h GROUP BY place))
        SELECT CAST(row_number() OVER (ORDER BY list_inner_product(q, v) DESC, vec_id) AS INTEGER) AS rank, vec_id AS id, round(list_inner_product(q, v), 6) AS score FROM e, q ORDER BY rank LIMIT 10"""
)
def next_steps_of_one_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole history points to: the ten bank rows nearest to its mean."""
    rows = _vectors(spark, sf_dir)
    mine = mean_vectors(rows.where("floor(id / 10) = 3").withColumn("query", F.lit(0).cast("long")), ["query"], "vec").select("query", F.col("mean").alias("vec"))
    return _rounded(ranking.nearest(mine, rows.select("id", "vec"), 10, rows.count()).select("rank", "id", "score"), "score")


@query(
    """WITH last AS (SELECT o_custkey, o_orderkey, o_orderdate, o_custkey % 3 AS split FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
       SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place, o_orderkey FROM last QUALIFY row_number() OVER (PARTITION BY split ORDER BY o_orderdate, o_orderkey) <= 10"""
)
def earliest_last_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split, the ten people whose last job began first."""
    last = merge.latest(table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at")), "o_custkey", "at")
    rows = last.select((F.col("o_custkey") % 3).alias("split"), "at.o_orderdate", "at.o_orderkey")
    return career.first_rows(rows, "split", 10, "o_orderdate", "o_orderkey").select("split", F.col("row").alias("place"), "o_orderkey")
