"""Enrichment queries: parts stand for a catalogue of occupations, customers for work histories' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.text import occupation_text, role_text
from wayfarer.operators import career, enrich, resume
from wayfarer.operators.ranking import nearest
from wayfarer.operators.registry import query, table
from wayfarer.plans.vectors import _E, _MEAN, _centroids

_CATALOGUE = """
    cat AS (
        SELECT p_partkey AS "order", 'u/' || p_partkey % 900 AS uri, p_name || ' ' || p_size AS label,
            CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE [p_name || ' ' || (p_size + 1) % 50, ' ' || p_brand, ' '] END AS alternatives,
            p_type || ' ' || p_partkey AS description, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '7' ELSE (p_partkey * 37 % 10000)::VARCHAR END AS code
        FROM part),
    history AS (
        SELECT c_custkey AS id, 'u/' || c_custkey % 1300 AS uri,
            CASE c_custkey % 4 WHEN 0 THEN p_name || ' ' || p_size WHEN 1 THEN ' ' || p_brand WHEN 2 THEN p_brand ELSE 'nothing' END AS title
        FROM customer LEFT JOIN part ON p_partkey = c_custkey),
    last_by_uri AS (SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY uri ORDER BY "order" DESC) = 1)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    others = F.array(F.concat_ws(" ", "p_name", (F.col("p_size") + 1) % 50), F.concat(F.lit(" "), "p_brand"), F.lit(" "))
    return table(spark, sf_dir, "part").select(
        k.alias("order"),
        F.concat(F.lit("u/"), k % 900).alias("uri"),
        F.concat_ws(" ", "p_name", "p_size").alias("label"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(others).alias("alternatives"),
        F.concat_ws(" ", "p_type", k).alias("description"),
        F.when(k % 11 == 0, None).when(k % 7 == 0, "7").otherwise((k * 37 % 10000).cast("string")).alias("code"),
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit(" "), "p_size")).when(k % 4 == 1, F.concat(F.lit(" "), "p_brand")).when(k % 4 == 2, F.col("p_brand")).otherwise("nothing")
    return c.join(p, F.col("p_partkey") == k, "left").select(k.alias("id"), F.concat(F.lit("u/"), k % 1300).alias("uri"), title.alias("title"))


_TITLES = """
    keyed AS (SELECT label AS title, 0 AS kind, "order", description FROM cat UNION ALL SELECT unnest(alternatives), 1, "order", description FROM cat),
    by_title AS (SELECT title, description FROM keyed QUALIFY row_number() OVER (PARTITION BY title ORDER BY kind DESC, "order" DESC) = 1)"""
_NAMES = """
    named AS (SELECT * REPLACE (list_filter(list_transform(alternatives, lambda x: trim(x)), lambda x: x <> '') AS alternatives) FROM cat WHERE len(list_filter(alternatives, lambda x: trim(x) <> '')) > 0),
    n_uri AS (SELECT uri, array_to_string(alternatives, ', ') AS names FROM named QUALIFY row_number() OVER (PARTITION BY uri ORDER BY "order" DESC) = 1),
    n_keyed AS (
        SELECT label AS title, 1 AS kind, "order" AS nth, array_to_string(alternatives, ', ') AS names FROM named
        UNION ALL SELECT unnest(alternatives), 0, -"order", array_to_string(alternatives, ', ') FROM named),
    n_title AS (SELECT title, names FROM n_keyed QUALIFY row_number() OVER (PARTITION BY title ORDER BY kind DESC, nth DESC) = 1)"""


@query(
    f"""WITH {_CATALOGUE}, {_TITLES} SELECT id, coalesce(u.description, t.description, '') AS description
        FROM history h LEFT JOIN last_by_uri u ON u.uri = h.uri LEFT JOIN by_title t ON t.title = h.title"""
)
def described_by_uri_or_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_description(_history(spark, sf_dir), _catalogue(spark, sf_dir), "uri", "title").select("id", "description")


@query(f"WITH {_CATALOGUE}, {_NAMES} SELECT id, coalesce(u.names, t.names, '') AS names FROM history h LEFT JOIN n_uri u ON u.uri = h.uri LEFT JOIN n_title t ON t.title = h.title")
def alternative_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_names(_history(spark, sf_dir), _catalogue(spark, sf_dir), "uri", "title").select("id", "names")


@query(
    f"""WITH {_CATALOGUE}, {_TITLES}, {_NAMES}
        SELECT id, 'role: ' || coalesce(h.title, '') || ' ' || chr(10) || ' description: ' || coalesce(u.description, t.description, '') AS role,
            'esco role: ' || coalesce(h.title, '') || ' ' || chr(10) || CASE WHEN coalesce(nu.names, nt.names, '') <> '' THEN ' alt labels: ' || coalesce(nu.names, nt.names) || ' ' || chr(10) ELSE '' END
                || ' description: ' || coalesce(u.description, t.description, '') AS occupation
        FROM history h LEFT JOIN last_by_uri u ON u.uri = h.uri LEFT JOIN by_title t ON t.title = h.title LEFT JOIN n_uri nu ON nu.uri = h.uri LEFT JOIN n_title nt ON nt.title = h.title"""
)
def role_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text templates over enriched rows."""
    catalogue = _catalogue(spark, sf_dir)
    rows = enrich.with_names(enrich.with_description(_history(spark, sf_dir), catalogue, "uri", "title"), catalogue, "uri", "title")
    return rows.select("id", role_text(F.col("title"), F.col("description")).alias("role"), occupation_text(F.col("title"), F.col("description"), F.col("names")).alias("occupation"))


@query(f"WITH {_CATALOGUE} SELECT id, CASE WHEN length(code) >= 2 THEN substr(code, 1, 2) END AS prefix FROM history h LEFT JOIN last_by_uri u ON u.uri = h.uri")
def code_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_prefix(_history(spark, sf_dir), _catalogue(spark, sf_dir), "uri").select("id", "prefix")


@query(
    f"""WITH {_CATALOGUE}, p AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS category FROM (SELECT DISTINCT substr(code, 1, 3) AS p FROM cat WHERE code IS NOT NULL))
        SELECT id, CAST(coalesce(category, (SELECT count(*) FROM p)) AS INTEGER) AS category FROM history h LEFT JOIN last_by_uri u ON u.uri = h.uri LEFT JOIN p ON p.p = substr(u.code, 1, 3)"""
)
def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_category(_history(spark, sf_dir), _catalogue(spark, sf_dir), "uri").select("id", "category")


@query(
    """WITH r AS (SELECT event_id, user_id, event_type || event_id AS summary FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
       SELECT c_custkey, summary FROM customer LEFT JOIN r ON user_id = c_custkey"""
)
def joined_to_last_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that share an id the last one counts, and no left row is multiplied."""
    found = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", "event_id").alias("summary"))
    return enrich.with_last(table(spark, sf_dir, "customer"), found, "c_custkey", "user_id", "event_id").select("c_custkey", "summary")


@query(
    """WITH s AS (SELECT o_custkey AS person, list(nullif(o_orderstatus, 'P') ORDER BY o_orderdate, o_orderkey) AS steps FROM orders GROUP BY o_custkey)
       SELECT person, coalesce(steps[len(steps) - 1], '') AS summary FROM s WHERE len(steps) >= 2"""
)
def prefix_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the last row before a target; null ones are empty."""
    o = table(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey", F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("summary")).alias("e"))
    steps = o.groupBy(F.col("o_custkey").alias("person")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("steps")).where("size(steps) >= 2")
    return steps.select("person", enrich.last_summary(F.slice("steps", 1, F.size("steps") - 1), "summary").alias("summary"))


@query(
    f"""WITH {_E}, {_MEAN},
        r AS (SELECT vec_id, vec_id // 6 AS person, vec_id % 6 AS n, CASE WHEN vec_id % 4 <> 0 THEN label % 3 END AS code, v,
            vec_id % 5 = 0 AS blank, 'industry ' || label AS own, lead(vec_id % 4 <> 0) OVER w AS next_known, lead(label % 3) OVER w AS next_code FROM e WINDOW w AS (PARTITION BY vec_id // 6 ORDER BY vec_id)),
        best AS (SELECT vec_id, id FROM scores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) = 1),
        a AS (SELECT r.*, coalesce(code IS NOT NULL AND next_known AND next_code = code, false) AS follows, CASE WHEN next_known IS NULL THEN own WHEN NOT blank THEN 'near ' || id END AS mine FROM r JOIN best USING (vec_id)),
        k AS (SELECT *, min(CASE WHEN NOT follows THEN n END) OVER (PARTITION BY person ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS anchor FROM a)
        SELECT k.person, k.n, a.mine AS industry FROM k JOIN a ON a.person = k.person AND a.n = k.anchor"""
)
def industry_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last job has its own industry; one with the next one's code takes the next
    one's; any other the category nearest to its text, or null if it has no text."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.floor(F.col("vec_id") / 6).alias("person"), (F.col("vec_id") % 6).alias("n"), F.when(F.col("vec_id") % 4 != 0, F.col("label") % 3).alias("code"), "vec_id", F.col("embedding").alias("vec"), (F.col("vec_id") % 5 == 0).alias("blank"),
        F.concat(F.lit("industry "), "label").alias("own"),
    )
    bank = _centroids(spark, sf_dir)
    return career.industries(rows, "person", "n", "code", "own", "blank", bank, bank.count()).select("person", "n", F.regexp_replace("industry", "^bank ", "near ").alias("industry"))


_RESUME = """
    r AS (
        SELECT c_custkey AS id, c_name AS about, c_mktsegment AS segment, n_name AS school
        FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(
    f"""WITH {_RESUME} SELECT id,
        CASE WHEN id % 3 = 0 THEN about || chr(10) || 'Sql, Team ' || segment ELSE about END AS summary,
        CASE WHEN id % 2 = 0 THEN school || chr(10) || 'Certified ' || school END AS education,
        CASE WHEN id % 5 = 0 THEN 'likes ' || school END AS additional_info,
        array_to_string(list_concat(['python', lower(segment), 'go', 'go'], CASE WHEN id % 3 = 0 THEN ['sql', 'team ' || lower(segment)] ELSE []::VARCHAR[] END), '|') AS skills
        FROM r"""
)
def resumes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumés made of the customers' rows, read section by section."""
    # A million customers may lie in one row group, which is one task; the narrow rows are dealt out before they become pages.
    c, n = table(spark, sf_dir, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey"), table(spark, sf_dir, "nation")
    i, seg, school = F.col("c_custkey"), F.col("c_mktsegment"), F.col("n_name")
    part = lambda section_id, heading, body: F.concat(F.lit(f'<div class="section x" id="SECTION_{section_id}9"><div class="heading"><div class="sectiontitle"> {heading} </div></div>'), *body, F.lit("</div>"))
    html = F.concat(
        F.lit("<html><body>"),
        part("SUMM", "Professional Summary", [F.lit("<p>"), "c_name", F.lit("</p>")]),
        part("SUMM", "Overview", [F.lit("<p>a second summary</p>")]),
        part("SUMM", "Position Applying", [F.lit("<p>not a summary</p>")]),
        F.when(i % 2 == 0, F.concat(part("XX", "Education", [F.lit("stray<p>"), school, F.lit("</p>")]), F.lit('<div class="section" id="SECTION_CERT1"><p>Certified '), school, F.lit("</p></div>"))).otherwise(""),
        F.when(i % 5 == 0, part("INTR", "Interests", [F.lit("<p>likes  <b>"), school, F.lit("</b></p>")])).otherwise(""),
        part("HILT", "Skills", [F.lit("<ul><li>Python</li><li>- "), seg, F.lit("</li></ul>")]),
        part("SKLL", "Technical Skills", [F.lit("<table><tr><td>Go; go</td></tr></table>")]),
        F.when(i % 3 == 0, part("HILT", "Summary of Qualifications", [F.lit("<p>Sql, Team  "), seg, F.lit("</p>")])).otherwise(""),
        F.lit("</body></html>"),
    )
    pages = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(i.alias("id"), html.alias("html"))
    return resume.parsed(pages, "id", "html").withColumn("skills", F.array_join("skills", "|"))
