"""Hand-made rows for the cases that tables don't hold."""

import datetime
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import arrays, dates, text, vectors
from wayfarer.operators import career, merge, ranking, resume, skills
from wayfarer.plans import catalogue, enriched
from wayfarer.sources import files, shared
from wayfarer.streaming import log_table, views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_months_differ_by_rule(spark):
    rows = [("1/2020", "3/2021"), ("5/2021", "current"), ("1/2020", "current"), ("6/2020", "1/2020"), (None, "1/2020"), ("1/2020", None), ("13/2020", "1/2021")]
    df = spark.createDataFrame(rows, "s string, e string")
    s, e, now = F.col("s"), F.col("e"), F.lit(datetime.date(2021, 3, 9))
    got = df.select(dates.months_research(s, e), dates.months_runtime(s, e), dates.months_service(s, e, now)).collect()
    assert [tuple(r) for r in got] == [(14, 14.0, 14), (3, 3.0, 0), (12, 12.0, 14), (-5, -5.0, 0), (None, 0.0, None), (None, 0.0, 14), (0, 0.0, None)]


@pytest.mark.parametrize(("n", "keep"), [(1, 16), (2, 16), (6, 16), (7, 16), (17, 16), (9, 1), (9, 2), (9, 15), (9, 21), (9, 400), (3, 2)])
def test_last_sub_paths(spark, n, keep):
    df = spark.createDataFrame([(1, i, f"s{i}") for i in range(n)], "p long, n long, v string")
    got = [(r["length"], r["start"], r["target"]) for r in career.sub_paths(df, "p", "n", F.col("v"), keep).collect()]
    every = [(length, j, f"s{j + length - 1}") for length in range(2, n + 1) for j in range(n - length + 1)]
    assert sorted(got) == sorted(every[-keep:])
    assert career.sub_paths(df, "p", "n", F.col("v"), keep=None).count() == len(every)


def test_carry_takes_nulls_too(spark):
    rows = [(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "a", None), (1, 3, None, "z"), (2, 0, "b", "p"), (2, 1, "c", "q")]
    df = spark.createDataFrame(rows, "p long, n long, g string, own string")
    got = {(r["p"], r["n"]): r["carried"] for r in career.carried_back(df, "p", "n", "g", F.col("own")).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): None, (1, 3): "z", (2, 0): "p", (2, 1): "q"}


def test_skill_chunks_and_cleaning(spark):
    assert one(spark, text.clean_skills(text.skill_chunks(F.lit("- SQL,  Team  Work •Excel; x")))) == ["sql", "team work", "excel; x"]
    assert one(spark, text.clean_skills(text.skill_chunks(F.lit("A;b\n\n * C ")))) == ["a", "b", "c"]


def test_texts(spark):
    assert one(spark, text.collapse(F.lit("a \t b \n\n c "))) == "a b\nc"
    assert one(spark, text.email(F.lit(" A@B.co "))) == "a@b.co"
    assert one(spark, text.email(F.lit("a@b"))) is None
    assert one(spark, text.without_summary_mark(F.lit(" SUMMARY: x "))) == "x"
    assert one(spark, text.chat_title(F.lit(" "), F.lit("nurse"))) == "About nurse"
    assert one(spark, text.chat_title(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "New chat"
    assert one(spark, text.occupation_text(F.lit("t"), F.lit("d"), F.lit(""))) == "esco role: t \n description: d"
    assert one(spark, text.occupation_text(F.lit("t"), F.lit("d"), F.lit("a, b"))) == "esco role: t \n alt labels: a, b \n description: d"
    assert one(spark, text.label_name(F.lit("esco role: cook \nx"))) == "cook"
    assert one(spark, text.last_segment(F.lit("a/b/c"))) == "c"
    assert one(spark, text.replaced(F.lit(" Dev "), {"dev": "developer"})) == "developer"


@pytest.mark.parametrize(
    ("label", "context", "fine"),
    [
        ("leadership in nursing", "a nurse", True), ("leadership in nursing", "nurses", False), ("Leadership for the  Nursing", "Nursing!", True), ("nursing management for hotels", "", True), ("plan in an outdoor setting", "camping", True),
        ("plan in an outdoor setting", None, False), ("care of social  work", "caseworkers", False), ("care of social  work", "a case workers' hall", True), ("chart in nursingly", "", True), ("skin of maritime", "ship's", False), ("skin of maritime", "the ship", True),
    ],
)
def test_domain_needs_its_context(spark, label, context, fine):
    assert one(spark, skills.borne_out(F.lit(label), F.lit(context).cast("string"))) is fine


def test_modifiers(spark):
    assert [one(spark, skills.is_modifier(F.lit(x))) for x in (" Expert ", "web-based", "based", "expertise")] == [True, True, False, False]


def test_score_at_the_threshold_and_a_look_at_twenty(spark):
    """A score of exactly 0.6 counts; a fit one behind 20 misfits isn't seen."""
    vec = lambda x: [x, (1 - x * x) ** 0.5]
    skill = [("a", 0, "x", "", [1.0, 0.0])]
    rows = [(i, i, "leadership in nursing", vec(0.9)) for i in range(20)] + [(30, 30, "fine", vec(0.8))]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    one_skill = df(skill, "user string, position int, skill string, context string, vec array<double>")
    run = lambda rows: skills.mapped_skills(one_skill, df(rows, "id long, concept long, label string, vec array<double>"), df([(c, f"u/{c}", f"n{c}", v) for _, c, _, v in rows], "concept long, uri string, name string, vec array<double>"), df([], "name string, uri string"), ["X"]).collect()
    assert run(rows) == [] and [r["uri"] for r in run(rows[1:])] == ["u/30"]
    assert [r["uri"] for r in run([(1, 1, "fine", [0.6, 0.8])])] == ["u/1"] and run([(1, 1, "fine", [0.59, 0.8])]) == []


def test_best_concepts_in_blocks(spark):
    rng = [((i * 37) % 19 / 19, (i * 11) % 7 / 7) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 13, list(v)) for i, v in enumerate(rng)], "id long, concept long, vec array<double>")
    concepts = spark.createDataFrame([(c, [c / 13, 1 - c / 13]) for c in range(13)], "concept long, vec array<double>")
    asked = spark.createDataFrame([(q, [q / 9, 1 - q / 5], q % 2 == 0) for q in range(9)], "query long, vec array<double>, concrete boolean")
    whole = sorted(skills.best_concepts(asked, labels, concepts, 3, 90).collect())
    assert whole == sorted(skills.best_concepts(asked, labels, concepts, 3, 90, most=4).collect()) and len(whole) == 27


def test_against_bank_in_blocks(spark):
    bank = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(50)], "id long, vec array<double>")
    asked = spark.createDataFrame([(q, [1.0, q / 3], q % 50) for q in range(12)], "query long, vec array<double>, own long")
    rows = lambda most: {r["query"]: (r["above"], r["ties"], pytest.approx(r["loss"])) for r in ranking.against_bank(asked, bank, 50, 0.5, 3.0, most).collect()}
    assert rows(20_000) == {q: (a, t, x.expected) for q, (a, t, x) in rows(6).items()}


@pytest.mark.parametrize(("own", "mask", "longest"), [(lambda i: (i + 1) % 90, 0.6, 1.0), (lambda i: 7, 0.2, 1.0), (lambda i: i * 7 % 90, -0.5, 1.0), (lambda i: i * 3, 0.6, 1.0), (lambda i: (i + 1) % 90, 30.0, 9.0)])
def test_masked_losses_in_blocks(spark, own, mask, longest):
    """Few and many masked rows, true rows near, shared or not there, and exponents beyond a double's range."""
    v = np.random.default_rng(5).normal(size=(90, 4))
    v *= longest / np.linalg.norm(v, axis=1)[:, None]
    bank = spark.createDataFrame([(i, x.tolist(), own(i)) for i, x in enumerate(v)], "id long, vec array<double>, own long")
    want = {r["query"]: pytest.approx(r["loss"]) for r in ranking.against_bank(bank.withColumnRenamed("id", "query"), bank.select("id", "vec"), 90, 0.05, mask).collect()}
    for most in (2_000, 40):
        assert {r["query"]: r["loss"] for r in ranking.masked_losses(bank, 0.05, mask, most).collect()} == want


def test_masked_losses_make_each_product_once(monkeypatch):
    """Of two blocks, a product serves the row that asks, the one asked, and the masks of both: not four are made."""
    n = 2 * ranking.MET
    v = np.random.default_rng(5).normal(size=(2 * n, 8))
    made = []

    def counted(a, b, out):
        made.append(len(a) * b.shape[1])
        return np.dot(a, b, out=out)

    def block(ids):
        own, kinds = (ids + 1) % (2 * n), pa.list_(pa.float64())
        far = [None if o in ids else v[o].tolist() for o in own]
        return pa.table({"id": ids, "vec": pa.array(v[ids].tolist(), kinds), "own": own, "far": pa.array(far, kinds)})

    monkeypatch.setattr(np, "matmul", counted)
    found = ranking._masked(block(np.arange(n)), block(np.arange(n, 2 * n)), 0.5, 0.6)
    monkeypatch.undo()
    rest = np.where(np.roll(v, -1, axis=0) @ v.T <= 0.6, np.exp(v @ v.T / 0.5), 0.0)
    rest[np.arange(2 * n), (np.arange(2 * n) + 1) % (2 * n)] = 0.0
    assert found.column("rest").to_numpy() == pytest.approx(np.append(rest[:n, n:].sum(axis=1), rest[n:, :n].sum(axis=1)))
    assert sum(made) < 1.1 * n * n


def test_masked_contrastive_loss_without_vectors(spark, tmp_path):
    """Rows without a vector or an id, as SQL takes them."""
    rows = [(i if i != 17 else None, None if i in (3, 9, 10) else [float(i % 5) / 4, float(i % 3) / 2, 0.5], i % 4) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.execute(catalogue.SQL["masked_contrastive_loss"]).fetchall())
    got = {r["query"]: r["loss"] for r in catalogue.QUERIES["masked_contrastive_loss"](spark, str(tmp_path)).collect()}
    assert got == want and sum(x is None for x in want.values()) == 5


def test_arrays(spark):
    a, b = F.array(F.lit("SQL"), F.lit(" "), F.lit(None)), F.array(F.lit("sql"), F.lit("Go "))
    assert one(spark, arrays.merged_ignoring_case(a, b)) == ["SQL", "Go"]
    assert one(spark, arrays.last(F.array(F.lit(1), F.lit(2)), 16)) == [1, 2]
    assert one(spark, arrays.json_or_null(F.array())) is None
    assert one(spark, arrays.field_or(F.lit('{"a": null}'), "a", F.lit("x"))) is None
    assert one(spark, arrays.field_or(F.lit('{"b": 1}'), "a", F.lit("x"))) == "x"
    assert one(spark, arrays.percent_of_best(F.lit(3), F.lit(4))) == 75.0


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.normalised(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.normalised(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vectors.match_score(v, F.array(F.lit(-3.0), F.lit(-4.0)))) == 0.0
    assert sum(one(spark, vectors.softmax(v))) == pytest.approx(1)
    assert one(spark, vectors.one_hot(F.lit(1), 3)) == [0.0, 1.0, 0.0]
    assert one(spark, vectors.linear(v, [[1.0, 2.0]], [0.5])) == [11.5]


def test_ranking_of_nulls_and_missing_user(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], 5.0), (2, [0.0, 1.0], None), (3, [-1.0, 0.0], 7.0)], "id long, vec array<double>, salary double")
    user = spark.createDataFrame([([1.0, 0.0],)], "vec array<double>")
    ids = lambda spec: [r["id"] for r in ranking.rank_page(items, user, spec).first()["items"]]
    assert ids(ranking.RankSpec()) == [1, 2, 3]
    assert ids(ranking.RankSpec(sort="salary", order="asc")) == [1, 3, 2]
    assert ids(ranking.RankSpec(sort="salary")) == [3, 1, 2]
    assert ids(ranking.RankSpec(sort="nothing", order="up", page=0, page_size=1)) == [1]
    assert ids(ranking.RankSpec(least=(("salary", 6.0),))) == [3]
    assert tuple(ranking.rank_page(items, user.limit(0), ranking.RankSpec()).first()) == ([], 0)
    assert tuple(ranking.rank_page(items, user, ranking.RankSpec(page=9)).first()) == ([], 3)


def test_metrics_by_cutoff(spark):
    df = spark.createDataFrame([(1,), (10,), (11,), (None,)], "r int")
    full = ranking.ranking_metrics(df.withColumn("g", F.lit(1)), F.col("r"), None, ["g"]).where("g is null").first()
    cut = ranking.ranking_metrics(df.withColumn("g", F.lit(1)), F.col("r"), 10, ["g"]).where("g is null").first()
    assert full["mrr"] == pytest.approx((1 + 0.1 + 1 / 11) / 4) and cut["mrr"] == pytest.approx(1.1 / 4)
    assert (full["r5"], full["r10"], full["n"]) == (0.25, 0.5, 4)


def test_nearest_in_blocks_is_the_same(spark):
    rows = [(i, [float((i * 7) % 11), float(i % 3), 1.0]) for i in range(60)]
    bank = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = bank.where("id < 9").withColumnRenamed("id", "query")
    whole = ranking.nearest(asked, bank, 4, 60).select("query", "id", "rank").collect()
    blocks = ranking.nearest(asked, bank, 4, 60, most=16).select("query", "id", "rank").collect()
    assert sorted(whole) == sorted(blocks)


def test_pair_blocks(spark):
    bank = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(40)], "id long, vec array<double>")
    assert sorted(ranking.similarity_histogram(bank, [1.5, 3.0], most=7).collect()) == sorted(ranking.similarity_histogram(bank, [1.5, 3.0]).collect())
    assert ranking.top_pairs(bank, 5, most=7).collect() == ranking.top_pairs(bank, 5).collect()
    assert ranking.top_pairs(bank, 1).first()[:2] == (38, 39)


def test_upsert_delete_upsert(spark):
    log = spark.createDataFrame([(1, 1, "up", "a"), (1, 2, "del", None), (1, 3, "up", "b"), (2, 4, "up", "c"), (2, 5, "del", None), (None, 6, "up", "z")], "k long, o long, kind string, v string")
    current = spark.createDataFrame([(2, 0, "up", "old"), (3, 0, "up", "kept")], "k long, o long, kind string, v string")
    got = {r["k"]: r["v"] for r in merge.applied(current, log, "k", "o", F.col("kind") == "del").collect()}
    assert got == {1: "b", 3: "kept"}


def test_append_unless_present(spark):
    current = spark.createDataFrame([(1, "Cook", None, 0)], "u long, title string, start string, pos int")
    new = spark.createDataFrame([(1, "cook", None, 0), (1, "Nurse", None, 1), (1, "NURSE", None, 2), (1, "Nurse", "1/2020", 3), (1, " ", None, 4), (1, None, None, 5), (2, "Smith", "x", 0)], current.schema)
    once = merge.appended(current, new, "u", "title", [F.col("start")], "pos", "pos")
    want = [(1, "Cook", None, 0), (1, "Nurse", None, 1), (1, "Nurse", "1/2020", 2), (2, "Smith", "x", 0)]
    assert sorted((tuple(r) for r in once.collect()), key=repr) == sorted(want, key=repr)
    again = merge.appended(once, new, "u", "title", [F.col("start")], "pos", "pos")
    assert sorted((tuple(r) for r in again.collect()), key=repr) == sorted(want, key=repr)


def test_patches_of_one_key_do_not_multiply_it(spark):
    current = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k long, x string, y string")
    patch = spark.createDataFrame([(1, 1, ["x"], "p", None), (1, 2, ["y"], "q", None)], "k long, o long, set_fields array<string>, x string, y string")
    assert sorted(tuple(r) for r in merge.patched(current, patch, "k", ["x", "y"], "o").collect()) == [(1, "a", None), (2, "c", "d")]


def test_events_are_routed(spark):
    lines = ['{"event": "up", "user_id": "7", "x": 1}', '{"event": "up", "user_id": "x"}', '{"event": "other"}', "junk", '{"event": "del", "user_id": 8}']
    parts, dead = views.routed(spark.createDataFrame([(x,) for x in lines], "value string"), {"up": "x int", "del": "x int"})
    assert [(r["user_id"], r["payload"]["x"]) for r in parts["up"].collect()] == [(7, 1)]
    assert [r["user_id"] for r in parts["del"].collect()] == [8]
    assert sorted(r["value"] for r in dead.collect()) == sorted([lines[1], "junk"])


def test_stream_in_several_batches(spark, tmp_path):
    schema = "k long, o long, kind string"
    for i, rows in enumerate([[(1, 1, "up"), (2, 2, "up")], [(1, 3, "del")], [(2, 4, "up"), (3, 5, "up")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = views.drained_state(log, "k", "o", F.col("kind") == "del").collect()
    assert sorted((r["k"], r["o"]) for r in got) == [(2, 4), (3, 5)]


def _bytes(folder: Path, number: int) -> int:
    return sum(p.stat().st_size for d in folder.glob(f"segments/{number:012d}-*") for p in d.glob("*.parquet"))


def test_log_table_merges_by_size_and_runs_again(spark, tmp_path):
    folder = tmp_path / "s"
    made = log_table.LogTable(spark, f"file://{folder}", "k", "o")
    schema = "k long, o long, v string"
    for number in range(20):
        batch = spark.createDataFrame([(number % 3, number, f"v{number}"), (7, 100 + number, "x"), (None, 1, "lost")], schema)
        made.merge(batch, number)
        made.merge(batch, number)  # the same batch again gives the same state
        assert {r["k"]: r["o"] for r in made.state(number).collect()}[7] == 100 + number
        assert max(Counter(level for _, level in made.segments(number)).values()) < log_table.FAN
    fresh = log_table.LogTable(spark, f"file://{folder}", "k", "o")
    assert sorted(tuple(r) for r in fresh.state().collect()) == [(0, 18, "v18"), (1, 19, "v19"), (2, 17, "v17"), (7, 119, "x")]
    assert sorted(tuple(r) for r in fresh.before(19, spark.createDataFrame([(1,), (7,), (50,), (None,)], "k long")).collect()) == [(1, 16, "v16"), (7, 118, "x")]
    needed = {n for b in (18, 19) for n, _ in fresh.segments(b)}
    assert {p.name for p in (folder / "segments").iterdir() if list(p.glob("*.parquet"))} == needed and fresh.numbers() == [18, 19]


def test_a_small_batch_writes_little_beside_a_large_state(spark, tmp_path):
    made = log_table.LogTable(spark, f"file://{tmp_path}", "k", "o")
    made.merge(spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("o"), F.sha1(F.col("id").cast("string")).alias("v")), 0)
    made.merge(spark.createDataFrame([(k * 999, 10**6, "new") for k in range(64)], "k long, o long, v string"), 1)
    assert _bytes(tmp_path, 1) < _bytes(tmp_path, 0) / 100
    assert made.state().count() == 200_000 and made.state().where("v = 'new'").count() == 64


def test_reactions_go_on_where_they_stopped(spark, tmp_path):
    schema = "user_id long, event_id long, event string, summary string, skills array<string>, mapped array<struct<uri:string,label:string>>"
    profiles = spark.createDataFrame([(1, None, ["own"]), (2, "mine", [])], "user_id long, summary string, skills array<string>")
    mapper = lambda df: df.select("user_id", F.transform("skills", lambda s: F.struct(F.concat(F.lit("c/"), s).alias("uri"), s.alias("label"))).alias("mapped"))
    found = []
    for rows in ([(1, 1, views.PARSED, "told", ["a"], None)], [(1, 2, views.PARSED, "later", ["B", "own"], None), (2, 3, views.MAPPED, None, None, [("u", "l")])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        after, told, emitted = views.drained_reactions(log, profiles, mapper, f"file://{tmp_path}/work")
        found.append(({r["user_id"]: (r["summary"], r["skills"]) for r in after.collect()}, {r["user_id"] for r in told.collect()}, emitted.count()))
    assert found == [({1: ("told", ["own", "a"]), 2: ("mine", [])}, set(), 1), ({1: ("told", ["own", "a", "B"]), 2: ("mine", [])}, {2}, 2)]


def test_progress_in_one_file_of_odd_lines(spark, tmp_path):
    lines = ['{"identifier": "7", "i": 1, "summary": "old"}', "", "junk", '{"identifier": 7, "i": 1, "summary": "new"}', '{"identifier": "7", "i": 1, "summary": null}', '{"identifier": "7", "i": 1.5, "summary": "x"}', '{"identifier": "7", "i": true, "summary": "x"}', '{"identifier": "8", "i": 2, "summary": 5}', '{"i": 2, "summary": "x"}', '[1]', '{"summary": " s ", "i": -3, "identifier": "é"}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines), encoding="utf8")
    assert sorted(tuple(r) for r in files.read_progress(spark, f"file://{tmp_path}/p.jsonl").collect()) == [("7", 1, "new"), ("é", -3, " s ")]


def test_csv_with_bad_fields_and_a_long_one(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x ""y""\nz, w"\nn,""\n3,' + "q" * 300_000 + "\n", encoding="utf8")
    got = [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/x.csv", "a int, b string").collect()]
    assert got[0] == (1, 'x "y"\nz, w') and got[1][0] is None and got[2] == (3, "q" * 300_000)
    with pytest.raises(Exception):
        files.write_csv(spark.range(3), f"file://{tmp_path}/x.csv")


def test_seed_leaves_filled_tables_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert [files.seed(spark.range(n), path) for n in (0, 3, 5)] == [True, True, False]
    assert spark.read.parquet(path).count() == 3


def test_what_is_written_while_passing_goes(spark):
    with shared.passing(spark):
        path = shared.scratch(spark, "x")
        spark.range(3).write.parquet(path)
        assert shared.exists(spark, path)
    assert not shared.exists(spark, path)


RESUME = """<div class="section" id="SECTION_SUMM1"><div class="heading"><div class="sectiontitle"> {0} </div></div>loose<p>First  part</p> <p>second &amp; last</p></div>"""


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (RESUME.format("Summary"), ("First part second & last", None, None, [])),
        (RESUME.format("Position Applying"), (None, None, None, [])),  # an unknown heading counts
        (RESUME.format(""), ("First part second & last", None, None, [])),  # none: the id decides
        ('<div class="section" id="SECTION_CERT1">plain <b>x</b></div><div class="section" id="SECTION_EDUC1">y</div>', (None, None, "plain x\ny", [])),
        (RESUME.format("Profile") + RESUME.format("About").replace("First", "Third"), ("First part second & last", None, None, [])),  # the first one only
        (RESUME.format("Summary of Qualifications"), ("First part second & last", None, None, ["first part", "second & last"])),  # highlights, both as text and as skills
        ('<div class="section"><div class="sectiontitle">Skills</div><ul><li>SQL, Excel</li><li>* Word</li></ul></div>', (None, None, None, ["sql", "excel", "word"])),
        ('<div class="section"><div class="heading"><div class="sectiontitle">skills</div></div><table><tr><td>a;b</td><td>a</td></tr></table></div>', (None, None, None, ["a", "b", "a"])),
        ('<div class="section"><div class="heading"><div class="sectiontitle">Skills</div></div><p>Go• Rust</p></div><div class="section" id="SECTION_HILT2"><ul><li>rust</li><li>C</li></ul></div>', ("rust C", None, None, ["go", "rust", "c"])),
        ('<div class="section" id="SECTION_INTR1"></div>', (None, None, None, [])),
        (None, (None, None, None, [])),
        ("<div class=section id=SECTION_ADDI1>open<p>end", (None, "open end", None, [])),
    ],
)
def test_resume_sections(spark, html, want):
    df = spark.createDataFrame([(1, html)], "id long, html string")
    got = resume.parsed(df, "id", "html").first()
    assert (got["summary"], got["additional_info"], got["education"], got["skills"]) == want


def test_resume_pages_are_read_alike_as_tokens_and_by_the_parser(spark, monkeypatch):
    plain = '<DIV CLASS="section" ID="SECTION_SKLL1"><ul><li>a &amp; b<br/>c</li><li>d&nbsp;e</ul></div></p>tail &am'
    odd = ["<!-- x -->" + plain, plain + "<script>'<p>'</script>", "<p class=a>" + plain, plain + "<", "a < b" + plain, '<p class="a&amp;b">' + plain]
    token, fed = resume._TOKEN, []
    feed = resume._Tree.feed
    monkeypatch.setattr(resume._Tree, "feed", lambda self, x: (fed.append(x), feed(self, x))[1])
    got = [resume._sections(h) for h in [plain, *odd]]
    assert fed == odd
    monkeypatch.setattr(resume, "_TOKEN", resume.re.compile("()()()()()(.?)", resume.re.DOTALL))
    assert got == [resume._sections(h) for h in [plain, *odd]] and len(fed) == len(odd) + len([plain, *odd])
    assert got[0][0]["chunks"] == ["a & b\nc", "d\xa0e"] and token.groups == 6


def test_resumes_are_read_by_all_cores(spark, sf_dir, monkeypatch):
    """Customers of one row group come in one task; their pages don't stay there."""
    seen = []
    monkeypatch.setattr(enriched.resume, "parsed", lambda pages, key, html: (seen.append(pages), pages.select(key, F.array().alias("skills")))[1])
    enriched.resumes_parsed(spark, sf_dir)
    held = [r["n"] for r in seen[0].groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) >= 2 * spark.sparkContext.defaultParallelism and max(held) <= sum(held) / 4


def test_highlights_may_leave_skills_alone(spark):
    df = spark.createDataFrame([(1, RESUME.format("Highlights"))], "id long, html string")
    assert resume.parsed(df, "id", "html", highlights_add_skills=False).first()["skills"] == []
