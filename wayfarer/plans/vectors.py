"""Vector retrieval, pooling and ranking-metric queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.vectors import mean_vectors, normalised
from wayfarer.operators import ranking, recurrent, sketches, skills
from wayfarer.operators.registry import query, table
from wayfarer.plans.careers import _rounded
from wayfarer.sources.shared import settled

THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
PERCENTS = [10, 25, 50, 75, 90, 95, 99]
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_MEAN = """
    long AS (SELECT label, generate_subscripts(v, 1) - 1 AS place, unnest(v) AS x, vec_id FROM e),
    m AS (SELECT label, list(x ORDER BY place) AS c FROM (SELECT label, place, avg(x) AS x FROM long GROUP BY label, place) GROUP BY label),
    scores AS (SELECT vec_id, e.label, m.label AS id, list_inner_product(v, c) AS score FROM e, m)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = mean_vectors(_vectors(spark, sf_dir), ["label"], "vec")
    return settled(means.select(F.col("label").cast("long").alias("id"), F.col("mean").alias("vec")), "bank")


def _against_centroids(spark: SparkSession, sf_dir: str, temperature: float = 1.0) -> DataFrame:
    """(query, above, ties, loss, label) of every vector against the labels' means."""
    rows, bank = _vectors(spark, sf_dir), _centroids(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query"), "vec", F.col("label").cast("long").alias("own"))
    return ranking.against_bank(asked, bank, bank.count(), temperature).join(rows.select(F.col("id").alias("query"), "label"), "query")


@query(
    f"""WITH {_E} SELECT a.vec_id AS query, b.vec_id AS id, round(list_inner_product(a.v, b.v), 6) AS score, CAST(row_number() OVER w AS INTEGER) AS rank
        FROM e a, e b WINDOW w AS (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) QUALIFY row_number() OVER w <= 10"""
)
def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _rounded(ranking.nearest(rows.select(F.col("id").alias("query"), "vec"), rows.select("id", "vec"), 10, rows.count()), "score")


@query(
    f"""WITH {_E}, {_MEAN}, t AS (SELECT vec_id, score AS best FROM scores WHERE id = label),
        r AS (SELECT label, 1 + count(*) FILTER (score > best) AS rank FROM scores JOIN t USING (vec_id) GROUP BY vec_id, label)
        SELECT label, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, count(*) AS n
        FROM r GROUP BY ROLLUP (label)"""
)
def full_bank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _against_centroids(spark, sf_dir).withColumn("rank", F.col("above") + 1)
    return _rounded(ranking.ranking_metrics(ranks, F.col("rank"), None, ["label"]), "mrr", "r1", "r5", "r10")


@query(
    f"""WITH {_E}, {_MEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS rank FROM scores QUALIFY id = label),
        b AS (SELECT CASE WHEN label < 5 THEN '1' ELSE '>=2' END AS bucket, rank FROM r)
        SELECT bucket, round(avg(CASE WHEN rank <= 3 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, count(*) AS n
        FROM b GROUP BY ROLLUP (bucket)"""
)
def bucketed_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings cut off at 3, by bucket and over all in one pass."""
    own = _against_centroids(spark, sf_dir).withColumn("rank", F.col("above") + F.col("ties") + 1)
    own = own.withColumn("bucket", F.when(F.col("label") < 5, "1").otherwise(">=2"))
    return _rounded(ranking.ranking_metrics(own, F.col("rank"), 3, ["bucket"]), "mrr", "r1", "r5", "r10")


@query(f"WITH {_E}, {_MEAN} SELECT vec_id AS query, round(ln(sum(exp(score / 0.05))) - max(score / 0.05) FILTER (id = label), 5) AS loss FROM scores GROUP BY vec_id")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of the true label among all, at temperature 0.05."""
    return _against_centroids(spark, sf_dir, 0.05).select("query", F.round("loss", 5).alias("loss"))


@query(f"WITH {_E}, {_MEAN} SELECT label, place, round(avg(x), 6) AS x FROM long GROUP BY label, place")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = mean_vectors(_vectors(spark, sf_dir), ["label"], "vec")
    return _rounded(means.select("label", F.posexplode("mean").alias("place", "x")).withColumn("place", F.col("place").cast("long")), "x")


@query(f"WITH {_E}, {_MEAN} SELECT label, place, round(sum(greatest(vec_id % 7 - 1, 0) * x) / greatest(sum(greatest(vec_id % 7 - 1, 0)), 1e-6), 6) AS x FROM long GROUP BY label, place")
def weighted_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("w", F.col("id") % 7 - 1)
    means = mean_vectors(rows, ["label"], "vec", "w")
    return _rounded(means.select("label", F.posexplode("mean").alias("place", "x")).withColumn("place", F.col("place").cast("long")), "x")


@query(f"WITH {_E} SELECT vec_id AS id, round(list_aggregate(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), 'sum'), 6) AS total FROM e")
def normalised_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(normalised(F.col("vec")), F.lit(0.0), lambda s, x: s + x)
    return _vectors(spark, sf_dir).select("id", F.round(total, 6).alias("total"))


@query(
    f"""WITH {_E}, p AS (SELECT list_inner_product(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
        SELECT t AS threshold, count(*) FILTER (s > t) AS n, round(100.0 * count(*) FILTER (s > t) / count(*), 6) AS percent
        FROM p, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) GROUP BY t"""
)
def bank_similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.similarity_histogram(_vectors(spark, sf_dir), THRESHOLDS), "percent")


@query(
    f"""WITH {_E} SELECT a.vec_id AS u, b.vec_id AS v, round(list_inner_product(a.v, b.v), 6) AS score
        FROM e a JOIN e b ON a.vec_id < b.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, u, v LIMIT 30"""
)
def most_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.top_pairs(_vectors(spark, sf_dir), 30), "score")


@query(
    f"""WITH {_E}, n AS (SELECT a.vec_id, max(list_inner_product(a.v, b.v)) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)
        SELECT round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most, {", ".join(f"round(quantile_cont(s, {p / 100}), 6) AS p{p}" for p in PERCENTS)} FROM n"""
)
def neighbour_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles are exact, so all values of the nearest similarity (one a row) meet sorted in one aggregate."""
    rows = _vectors(spark, sf_dir)
    near = ranking.nearest(rows.select(F.col("id").alias("query"), "vec"), rows.select("id", "vec"), 2, rows.count())
    s = near.where("query != id").groupBy("query").agg(F.max("score").alias("s"))
    shares = F.percentile("s", F.array(*[F.lit(p / 100) for p in PERCENTS])).alias("p")
    found = s.agg(F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"), shares)
    return _rounded(found.select("mean", "least", "most", *[F.col("p")[i].alias(f"p{p}") for i, p in enumerate(PERCENTS)]), "mean", "least", "most", *[f"p{p}" for p in PERCENTS])


@query(
    f"""WITH {_E}, s AS (SELECT q.vec_id AS query, b.label AS concept, list_inner_product(q.v, b.v) AS score, b.vec_id AS label_id FROM e q, e b WHERE q.vec_id % 50 = 0),
        h AS (SELECT query, concept, max(score) AS score FROM s GROUP BY query, concept), {_MEAN},
        y AS (SELECT h.query, concept, CASE WHEN h.query % 100 = 0 THEN h.score ELSE 0.85 * h.score + 0.15 * c.score END AS hybrid FROM h JOIN scores c ON c.vec_id = h.query AND c.id = concept)
        SELECT query, concept, round(hybrid, 6) AS hybrid FROM y QUALIFY row_number() OVER (PARTITION BY query ORDER BY hybrid DESC, concept) = 1"""
)
def hybrid_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best concept of each query: its best label's score, mixed with its own."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query"), "vec", (F.col("id") % 100 == 0).alias("concrete"))
    labels = rows.withColumnRenamed("label", "concept")
    found = skills.best_concepts(asked, labels, _centroids(spark, sf_dir).withColumnRenamed("id", "concept"), 1, rows.count())
    return found.select("query", F.col("concept").cast("int").alias("concept"), F.round("score", 6).alias("hybrid"))


@query("SELECT round(avg(quality), 4) AS mean, round(stddev_samp(quality), 4) AS deviation FROM labels HAVING count(*) >= 2")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation, where there are two values at least."""
    found = table(spark, sf_dir, "labels").agg(F.count("quality").alias("n"), F.round(F.avg("quality"), 4).alias("mean"), F.round(F.stddev_samp("quality"), 4).alias("deviation"))
    return found.where("n >= 2").select("mean", "deviation")


_SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query(f"SELECT l_returnflag, share, count(*) AS n, true AS within FROM lineitem, (SELECT unnest({_SHARES}::DOUBLE[]) AS share) GROUP BY ALL")
def price_percentiles_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of prices by sketches of each month that are merged, and whether their true ranks lie within the bound."""
    lines = table(spark, sf_dir, "lineitem")
    monthly = settled(sketches.sketched(lines.withColumn("month", F.trunc("l_shipdate", "month")), ["l_returnflag", "month"], "l_extendedprice"), "sketches")
    found = settled(sketches.percentiles(sketches.merged(monthly, ["l_returnflag"]), ["l_returnflag"], _SHARES), "percentiles")
    # Ranks are counted in one pass beside the few percentiles.
    flag = found.select(F.col("l_returnflag").alias("flag"), "share", "value", "n")
    price = F.col("l_extendedprice").cast("double")
    ranks = lines.join(F.broadcast(flag), F.col("l_returnflag") == F.col("flag")).groupBy("flag", "share", "n").agg(F.sum((price < F.col("value")).cast("long")).alias("below"), F.sum((price <= F.col("value")).cast("long")).alias("upto"))
    off = F.greatest(F.col("below") / F.col("n") - F.col("share"), F.col("share") - F.col("upto") / F.col("n"))
    return ranks.select(F.col("flag").alias("l_returnflag"), "share", "n", (off <= sketches.rank_error()).alias("within"))


@query()
def careers_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as histories, in order, encoded by a seeded recurrent model; weights are beyond SQL."""
    vecs = _vectors(spark, sf_dir)
    width = vecs.select(F.size("vec").alias("n")).first()["n"]
    n = vecs.count()
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    # With few vectors the narrow rows are dealt by their history, and no vector is shuffled.
    if n <= min(20_000, ranking.BROADCAST_BYTES // (8 * width)):
        orders, vecs = orders.repartition(4 * spark.sparkContext.defaultParallelism, "o_custkey"), F.broadcast(vecs)
    rows = orders.join(vecs, F.col("id") == F.col("o_orderkey") % n)
    step = F.struct("vec", F.log1p(F.col("o_totalprice") / 10_000).alias("months"), (F.col("label") % 5).alias("industry"))
    lists = rows.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", step.alias("s")))), lambda x: x["s"]).alias("steps"))
    none = F.lit(None).cast("array<double>")
    model = recurrent.as_table(spark, recurrent.drawn_weights(width, 24, 16, seed=3, industries=5, industry=3))
    return recurrent.encoded(lists.select("id", "steps", none.alias("summary"), none.alias("skills")), model).select("id", F.posexplode("vec").alias("place", "x"))
