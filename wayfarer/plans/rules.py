"""Queries over the small rules: predicates, texts, arrays, vectors, and events that answer events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions import arrays, dates, text, vectors
from wayfarer.operators import career, merge
from wayfarer.operators.registry import query, table
from wayfarer.plans.careers import _rounded
from wayfarer.streaming import views

_LF = "chr(10)"


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) < 1996 AND o_custkey <> 7")
def date_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from before a year, without one person known to be wrong."""
    return table(spark, sf_dir, "orders").where((F.year("o_orderdate") < 1996) & (F.col("o_custkey") != 7)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE trim(p_type) = 'PROMO' AND trim(p_name) <> '' AND trim(p_brand) <> ''")
def released_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status that matches after trimming, with neither id nor label empty."""
    return table(spark, sf_dir, "part").where((F.trim("p_type") == "PROMO") & (F.trim("p_name") != "") & (F.trim("p_brand") != "")).select("p_partkey")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 12 AND conv_id % 7 = 5")
def owned_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat, if it is its asker's own."""
    return table(spark, sf_dir, "conversations").where((F.col("conv_id") == 12) & (F.col("conv_id") % 7 == 5)).select("conv_id", "turn", "text")


@query("SELECT conv_id, CAST(row_number() OVER (ORDER BY last DESC, conv_id DESC) AS INTEGER) AS place FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) ORDER BY place LIMIT 20")
def chats_by_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("last"), F.desc("conv_id")).limit(20)
    return top.select("conv_id", F.row_number().over(Window.orderBy(F.desc("last"), F.desc("conv_id"))).alias("place"))  # over the page's 20 rows


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders WHERE o_custkey = 4")
def uploads_of_one_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner's rows, the newest first."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_custkey = 4").select("o_orderkey", F.row_number().over(order).alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_name)) = 'customer#000000009' LIMIT 1")
def found_by_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.lower(F.trim("c_name")) == "customer#000000009").limit(1).select("c_custkey", "c_name")


@query(
    """SELECT c_custkey, coalesce(o.steps, '') AS steps, coalesce(e.kinds, '') AS kinds FROM customer
       LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority || ':' || o_orderkey, ',' ORDER BY o_orderkey) AS steps FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
       LEFT JOIN (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id) e ON user_id = c_custkey"""
)
def profiles_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner once, with the rows of both children as ordered lists."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    both = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(e, F.col("user_id") == F.col("c_custkey"), "left")
    steps = F.array_join(F.transform("s", lambda x: F.concat(x["o_orderpriority"], F.lit(":"), x["o_orderkey"])), ",")
    return both.select("c_custkey", F.coalesce(steps, F.lit("")).alias("steps"), F.coalesce(F.array_join("k", ","), F.lit("")).alias("kinds"))


@query(
    """WITH mine AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1)
       SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM mine)"""
)
def skills_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essential skills of every profession that a user doesn't have."""
    lines = table(spark, sf_dir, "lineitem")
    mine = lines.join(table(spark, sf_dir, "orders").where("o_custkey = 1"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_partkey")
    return lines.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey").distinct().join(mine, "l_partkey", "left_anti").select("l_suppkey", "l_partkey")


@query(
    rf"""SELECT p_partkey, substr(trim(p_name || '  '), 1, 5) AS cut, p_brand || {_LF} || p_type AS collapsed, p_brand || '|' || p_type AS lines, p_name AS label, 'b' || p_partkey AS segment, lower(p_type) || p_partkey AS unmarked,
        CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || '@x.org' END AS email, CASE lower(p_type) WHEN 'promo' THEN 'offer' ELSE lower(p_type) END AS renamed, 'steel|' || lower(p_name) || '|tin can' AS skills,
        'name: ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN {_LF} || 'kind of thing: ' || p_type ELSE '' END AS prompt FROM part"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, brand, kind = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type"))
    lit = F.lit
    return table(spark, sf_dir, "part").select(
        k,
        text.cut(F.concat(lit(" \t"), name, lit("  ")), 5).alias("cut"),
        text.collapse(F.concat(lit(" "), brand, lit(" \t\n\n  "), kind)).alias("collapsed"),
        F.array_join(text.lines(F.concat(brand, lit("\n \n"), kind, lit(" \n"))), "|").alias("lines"),
        text.label_name(F.concat(lit("esco role: "), name, lit(" \n description: x"))).alias("label"),
        text.last_segment(F.concat(lit("http://a/b"), k)).alias("segment"),
        text.without_summary_mark(F.concat(lit(" SUMMARY:  "), F.lower(kind), k)).alias("unmarked"),
        text.email(F.when(k % 2 == 0, F.concat(lit(" "), brand, lit("@X.org"))).otherwise(F.concat(brand, lit("@x")))).alias("email"),
        text.replaced(F.concat(lit(" "), kind), {"promo": "offer"}).alias("renamed"),
        F.array_join(text.clean_skills(text.skill_chunks(F.concat(lit("- Steel •"), F.upper(name), lit(",  Tin   can ,")))), "|").alias("skills"),
        text.prompt(name=name, kind_of_thing=F.when(k % 3 == 0, kind)).alias("prompt"),
    )


@query(
    """WITH j AS (SELECT o_custkey AS id, o_orderpriority || ': ' || substr(o_orderstatus || repeat('x', 120), 1, 100) AS job, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        a AS (SELECT id, string_agg(job, '. ' ORDER BY n) FILTER (n <= 6) AS jobs, list('s' || n ORDER BY n) AS s FROM j GROUP BY id)
       SELECT c_custkey AS id, substr('Summary: ' || substr(c_name || repeat(' y', 200), 1, 250) || '. ' || jobs || '. ' || array_to_string(s[1:25], ', '), 1, 1000) AS context,
        substr(sha1('{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}'), 1, 16) AS key FROM customer JOIN a ON a.id = c_custkey"""
)
def skill_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds a skill: summary, six jobs, other skills, cut at 1000 characters; and its cache key."""
    job = F.struct("o_orderkey", F.struct(F.col("o_orderpriority").alias("title"), F.concat("o_orderstatus", F.repeat(F.lit("x"), 120)).alias("description")).alias("e"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(job)), lambda x: x["e"]).alias("jobs"))
    both = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"))
    names = F.transform(F.sequence(F.lit(1), F.size("jobs")), lambda i: F.concat(F.lit("s"), i))
    about = F.concat("c_name", F.repeat(F.lit(" y"), 200))
    return both.select(F.col("c_custkey").alias("id"), text.profile_context(about, F.col("jobs"), names).alias("context"), text.cache_key(F.col("c_name"), F.col("c_nationkey")).alias("key"))


@query(
    """WITH s AS (SELECT o_custkey AS id, list(o_orderpriority ORDER BY o_orderkey) AS p, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY o_custkey),
        d AS (SELECT id, string_agg(x, '|' ORDER BY nth) AS distinct_ FROM (SELECT id, x, min(nth) AS nth FROM (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) AS nth FROM s) GROUP BY id, x) GROUP BY id)
       SELECT s.id, distinct_, array_to_string(p[1:3], '|') AS first, array_to_string(p[greatest(len(p) - 1, 1):], '|') AS last, array_to_string(k[1:4], '|') AS asked,
        array_to_string(list_transform(generate_series(1, len(p)), lambda i: p[i] || k[i]), '|') AS zipped, CASE WHEN id % 2 = 0 THEN '1' ELSE 'none' END AS field, 'x|y' AS texts,
        CASE WHEN len(p) > 4 THEN 100.0 * 4 // len(p) ELSE 0.0 END * 0 + round(4.0 / len(p) * 100) AS percent, greatest(round(4.0 / len(p) * 100), 2.0) AS bar FROM s JOIN d USING (id)"""
)
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    rows = o.select("id", F.transform("s", lambda x: x["o_orderpriority"]).alias("p"), F.transform("s", lambda x: x["o_orderkey"]).alias("k"))
    joined = lambda c: F.array_join(c, "|")
    json = F.when(F.col("id") % 2 == 0, F.lit('{"a": 1}')).otherwise(F.lit('{"b": 1}'))
    percent = arrays.percent_of_best(F.lit(4.0), F.size("p").cast("double"))
    return rows.select(
        "id",
        joined(arrays.exact_distinct(F.col("p"))).alias("distinct_"),
        joined(arrays.first(F.col("p"), 3)).alias("first"),
        joined(arrays.last(F.col("p"), 2)).alias("last"),
        joined(F.transform(arrays.ids_asked(F.concat("k", "k"), 4), lambda x: x.cast("string"))).alias("asked"),
        joined(F.transform(F.arrays_zip("p", "k"), lambda z: F.concat(z["p"], z["k"]))).alias("zipped"),
        arrays.field_or(json, "a", F.lit("none")).alias("field"),
        joined(arrays.texts_only(F.lit('["x", " ", null, "y"]'))).alias("texts"),
        percent.alias("percent"),
        arrays.bar_width(percent).alias("bar"),
    )


@query(
    """WITH e AS (SELECT vec_id AS id, embedding[1:4]::DOUBLE[] AS v FROM embeddings)
       SELECT id, round(1 / (1 + exp(-v[1])), 9) AS sigmoid, round(tanh(v[1]), 9) AS tanh, greatest(v[2], 0) AS relu, round(exp(v[3]) / (exp(v[1]) + exp(v[2]) + exp(v[3]) + exp(v[4])), 9) AS softmax,
        CASE WHEN id % 4 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS hot, round(2 * v[1] - v[4] + 0.5, 9) AS linear, round(ln(exp(v[1]) + exp(v[2]) + exp(v[3]) + exp(v[4])), 9) AS lse, round(ln(1 + id), 9) AS log1p, round(exp(ln(1 + id)) - 1, 6) AS expm1,
        round(CASE WHEN id % 3 = 0 THEN v[1] ELSE (exp(v[1]) * v[1] + exp(v[2]) * v[2]) / (exp(v[1]) + exp(v[2])) END, 9) AS attended, CASE WHEN id % 3 = 0 THEN v[1] ELSE v[2] END AS last FROM e"""
)
def vector_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions of neural layers, and attention over the valid steps of a masked sequence."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v")).withColumn("n", F.when(F.col("id") % 3 == 0, 1).otherwise(2))
    at = lambda i: F.col("v")[i]
    return e.select(
        "id",
        F.round(vectors.sigmoid(at(0)), 9).alias("sigmoid"),
        F.round(F.tanh(at(0)), 9).alias("tanh"),
        vectors.relu(at(1)).alias("relu"),
        F.round(vectors.softmax(F.col("v"))[2], 9).alias("softmax"),
        vectors.one_hot(F.col("id") % 4, 4)[2].alias("hot"),
        F.round(vectors.linear(F.col("v"), [[2.0, 0.0, 0.0, -1.0]], [0.5])[0], 9).alias("linear"),
        F.round(vectors.log_sum_exp(F.col("v")), 9).alias("lse"),
        F.round(F.log1p("id"), 9).alias("log1p"),
        F.round(F.expm1(F.log1p("id")), 6).alias("expm1"),
        F.round(vectors.attended(F.col("v"), F.col("v"), F.col("n")), 9).alias("attended"),
        vectors.last_valid(F.col("v"), F.col("n")).alias("last"),
    )


@query(
    """WITH l AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, place, avg(x) AS x FROM l GROUP BY ALL)
       SELECT c_nationkey AS owner, r AS place, round(coalesce(x, 0), 6) AS x FROM (SELECT DISTINCT c_nationkey FROM customer), range(64) t(r) LEFT JOIN m ON label = c_nationkey AND m.place = r"""
)
def mean_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners without vectors get a zero vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("owner"), F.col("embedding").alias("vec"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner")).distinct()
    made = vectors.mean_or_zero(rows, owners, ["owner"], "vec", 64).select("owner", F.posexplode("mean").alias("place", "x"))
    return _rounded(made.withColumn("place", F.col("place").cast("long")), "x")


@query(
    """WITH s AS (SELECT o_custkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE month(o_orderdate) || '/' || year(o_orderdate) END AS day, o_orderkey % 4 = 0 AS undated, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders)
       SELECT id, string_agg(k::VARCHAR, ',' ORDER BY undated, CASE WHEN NOT undated THEN m END, k) AS ordered FROM s GROUP BY id"""
)
def chronological_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries by month, undated ones behind them as they stood."""
    day = F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise(F.concat_ws("/", F.month("o_orderdate"), F.year("o_orderdate")))
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", day.alias("day")))).alias("s"))
    made = career.chronological(F.col("s"), lambda e: dates.month_index(e["day"]))
    return s.select("id", F.array_join(F.transform(made, lambda e: e["o_orderkey"].cast("string")), ",").alias("ordered"))


@query(
    """WITH p AS (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
       SELECT n.conv_id, coalesce((SELECT string_agg(role || '=' || md5(text), '|' ORDER BY turn) || '|' FROM p WHERE p.conv_id = n.conv_id AND role IN ('user', 'assistant')), '') || 'user=' || md5('new ' || n.conv_id) AS messages
       FROM (SELECT DISTINCT conv_id FROM conversations UNION SELECT -1) n"""
)
def conversations_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages of each chat with the new turn behind them, also in a chat without any."""
    c = table(spark, sf_dir, "conversations")
    new = c.select("conv_id").distinct().union(spark.createDataFrame([(-1,)], "conv_id long")).withColumn("text", F.concat_ws(" ", F.lit("new"), "conv_id"))
    made = career.conversation(c, new, "conv_id", "turn", 3, ["user", "assistant"])
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), F.md5(m["text"]))), "|").alias("messages"))


@query(
    """SELECT o_custkey AS owner, o_orderpriority AS skill FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)
       UNION ALL SELECT DISTINCT user_id, event_type FROM events"""
)
def child_sets_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("skill"))
    return merge.replaced_children(current, table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("skill")).distinct(), "owner")


@query("SELECT event_id, event_type IN ('view', 'click') AS relevant, CASE WHEN event_type IN ('view', 'click', 'error') THEN event_type END AS kind FROM events")
def relevant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a change touches a watched field; kinds outside the vocabulary are null."""
    e = table(spark, sf_dir, "events")
    vocabulary = spark.createDataFrame([("VIEW",), ("CLICK",), ("ERROR",)], "kind string")
    known = vocabulary.select(F.lower("kind").alias("kind"))
    return e.join(F.broadcast(known), F.col("event_type") == F.col("kind"), "left").select("event_id", merge.relevant_change(F.array("event_type", F.lit("name")), ["view", "click"]).alias("relevant"), "kind")


_ANSWERS = """
    ev AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'about ' || event_id END AS summary, value FROM events),
    prof AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS summary FROM customer WHERE c_custkey % 5 <> 0),
    parsed AS (SELECT user_id, arg_min(summary, event_id) FILTER (trim(summary) <> '') AS summary, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY user_id)"""


def _reactions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/[e]vents.parquet")
    kind = F.when(F.col("event_type") == "purchase", views.PARSED).when(F.col("event_type") == "view", views.UPDATED).when(F.col("event_type") == "click", views.MAPPED)
    log = stream.select(
        "user_id", "event_id", kind.alias("event"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat_ws(" ", F.lit("about"), "event_id")).alias("summary"),
        F.array(F.concat(F.lit("s"), F.col("event_id") % 2), F.lit("S0")).alias("skills"), F.array(F.struct(F.concat(F.lit(" u"), "event_id").alias("uri"), F.lit("l ").alias("label")), F.struct(F.lit(" ").alias("uri"), F.lit("x").alias("label"))).alias("mapped"),
    )
    profiles = table(spark, sf_dir, "customer").where("c_custkey % 5 != 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("summary"), F.array(F.lit("own")).alias("skills"))
    mapper = lambda df: df.select("user_id", F.transform("skills", lambda s: F.struct(F.concat(F.lit("c/"), s).alias("uri"), s.alias("label"))).alias("mapped"))
    return views.drained_reactions(log, profiles, mapper)


@query(
    f"""WITH {_ANSWERS}
        SELECT p.user_id, 'user.profile.updated' AS event, coalesce(p.summary, q.summary) AS told FROM prof p JOIN parsed q USING (user_id)
        UNION ALL SELECT user_id, 'user.esco_skills.mapped', 'c/s' || max(event_id) % 2 FROM ev WHERE event_type = 'view' GROUP BY user_id"""
)
def events_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of profile events emits: updates for parsed résumés, mapped skills
    for updates, and nothing for mapped skills."""
    emitted = _reactions(spark, sf_dir)[2]
    told = F.when(F.col("event") == views.UPDATED, F.get_json_object("payload", "$.summary")).otherwise(F.get_json_object("payload", "$.esco_skills[0].uri"))
    return emitted.select("user_id", "event", told.alias("told"))


@query(
    f"""WITH {_ANSWERS}
        SELECT p.user_id, coalesce(p.summary, q.summary) AS summary, CASE WHEN q.user_id IS NULL THEN 1 ELSE 0 END AS untouched,
            (SELECT 'u' || max(event_id) FROM ev WHERE event_type = 'click' AND ev.user_id = p.user_id) AS uri FROM prof p LEFT JOIN parsed q USING (user_id)"""
)
def profiles_after_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles and skill sets after the same stream."""
    profiles, mapped, _ = _reactions(spark, sf_dir)
    uri = mapped.select(F.col("user_id").alias("u"), F.col("mapped")[0]["uri"].alias("uri"))
    return profiles.join(uri, F.col("u") == F.col("user_id"), "left").select("user_id", "summary", (F.size("skills") == 1).cast("int").alias("untouched"), "uri")


@query("SELECT date_trunc('day', ts) AS starts, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of a day; on a batch no row is late."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return views.windowed_counts(e, "ts", "event_type", "1 day", "2 days").withColumn("starts", F.col("starts").cast("timestamp_ntz"))
