"""Indexes against scans of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import graph_search, trigrams

LABELS = "id long, label string, alternatives array<string>"


def scanned(rows: list, needles: list) -> set:
    """By a plain matcher of % and _ over lower-cased texts."""
    import re

    out = set()
    for needle in {(n or "").strip(" ") for n in needles} - {""}:
        parts = ["." if c == "_" else ".*" if c == "%" else re.escape(c) for c in needle.lower()]
        pattern = re.compile("".join(parts), re.DOTALL)
        for i, label, others in rows:
            inside = [bool(t is not None and pattern.search(t.lower())) for t in [label, *(others or [])]]
            if any(inside):
                out.add((needle, i, inside[0]))
    return out


@pytest.mark.parametrize("part", [trigrams.PART, 3])
def test_same_rows_as_a_scan(spark, monkeypatch, part):
    """Also where the ids of nearly every gram are cut into parts."""
    monkeypatch.setattr(trigrams, "PART", part)
    rng = np.random.default_rng(1)
    words = ["Nurse", "nursing", "Sea", "Élève", "SAILOR", "a", "of", "100%", "x_y", "Straße", "東京都", "manager of nursing homes", "İstanbul"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 4)))), [str(x) for x in rng.choice(words, int(rng.integers(0, 3)))]) for i in range(150)]
    rows += [(200, None, None), (201, "", []), (202, "ab", [None, "abc"]), (203, None, ["Nurse"]), (204, "line\nbreak nurse", []), (205, "z" * 20_000 + "needle", [])]
    needles = ["nurs", "NURSING", "sea", "n%g", "n_rs", "of%ho_es", "100%", "x_y", "é", "ÉLÈ", "a", "ab", "東京", "東京都", "traß", "nothing here", "  sea ", "", " ", None, "%", "___", "zzzneedle", "e n", "needle", "man%xx", "_ur"]
    index = trigrams.build(spark.createDataFrame(rows, LABELS).withColumn("gram", F.lit("x")), "id", "label", "alternatives")
    got = trigrams.found(index, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert len(got) == len({(r["needle"], r["id"]) for r in got})
    assert {(r["needle"], r["id"], r["in_label"]) for r in got} == scanned(rows, needles)


def test_escaped_wildcards_and_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "100% sure", None), (2, "100 sure", None), (3, "100% sure", None), (3, "other", None)], LABELS)
    index = trigrams.build(rows, "id", "label")
    got = trigrams.found(index, spark.createDataFrame([("100\\% s",), ("sure",), ("bad\\",)], "needle string"))
    assert sorted((r["needle"], r["id"]) for r in got.collect()) == [("100\\% s", 1), ("100\\% s", 3), ("sure", 1), ("sure", 2), ("sure", 3)]


def test_a_lookup_reads_little_and_an_index_is_opened_again(spark, tmp_path):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(words, 4)), None) for i in range(3000)], LABELS)
    trigrams.build(rows, "id", "label", folder=f"{tmp_path}/i")
    index = trigrams.opened(spark, f"{tmp_path}/i")
    assert trigrams.share_read(index, "bal kes") < 0.03
    ids = {r["id"] for r in trigrams.found(index, spark.createDataFrame([("bal kes",)], "needle string")).collect()}
    assert ids == {r["id"] for r in rows.where("label ILIKE '%bal kes%'").collect()}
    sizes = index.postings.agg(F.max(F.size("ids"))).first()[0]
    assert sizes <= 2 * trigrams.PART


def test_ids_meet_under_their_gram_before_they_are_shuffled(spark, monkeypatch):
    """Rows of the index are far fewer than pairs of a gram and an id, and repeated ids in two stretches count once."""
    df = spark.createDataFrame([(i % 150, f"same words here {i % 3}", None) for i in range(300)], LABELS)
    index = trigrams.build(df, "id", "label")
    rows = index.postings.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    assert rows["n"] < rows["ids"] / 3
    monkeypatch.setattr(trigrams, "HELD", 40)
    got = trigrams.found(trigrams.build(df, "id", "label"), spark.createDataFrame([("words here 1",), ("zords",)], "needle string")).collect()
    assert sorted(r["id"] for r in got) == sorted(2 * [i for i in range(150) if i % 3 == 1])


def test_empty_labels(spark):
    index = trigrams.build(spark.createDataFrame([], LABELS), "id", "label", "alternatives")
    for needles in ([("abc",), ("a",)], []):
        assert trigrams.found(index, spark.createDataFrame(needles, "needle string")).count() == 0


VECTORS = "id long, vec array<double>, kind string, links long"


def clustered(rng, n: int, d: int) -> np.ndarray:
    x = rng.standard_normal((n // 10, d))[rng.integers(0, n // 10, n)] + 0.3 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("made", ["drawn", "clustered", "equal"])
def test_recall_under_filters(spark, made):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000, 16) if made == "clustered" else rng.standard_normal((3000, 16))
    if made == "equal":
        x[:1200] = x[0]
    rows = [(i, v.tolist(), f"k{i % 10}", i) for i, v in enumerate(x)]
    bank = spark.createDataFrame(rows, VECTORS).repartition(4)
    asked = bank.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    index = graph_search.build(bank, most=1000)
    assert index.shards == 3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for where, fine in ((None, np.ones(3000, bool)), (F.col("kind") < "k6", np.arange(3000) % 10 < 6), (F.col("kind") == "k3", np.arange(3000) % 10 == 3), (F.col("links") < 5, np.arange(3000) < 5), (F.col("kind") == "none", np.zeros(3000, bool))):
        got = graph_search.search(index, asked, 20, where).collect()
        scores = np.where(fine, unit[::50] @ unit.T, -np.inf)
        k = min(20, int(fine.sum()))
        assert len(got) == 60 * k  # never fewer than asked for, while enough pass
        assert all(fine[r["id"]] for r in got)
        # The right answers: as near as the k-th, up to rounding of the last digit that single precision holds.
        worst = np.sort(scores, axis=1)[:, -k] if k else np.zeros(60)
        assert sum(r["score"] >= worst[r["query"] // 50] - 1e-6 for r in got) >= 0.95 * len(got)
        assert [r["score"] for r in got] == pytest.approx([float(scores[r["query"] // 50, r["id"]]) for r in got], abs=1e-5)
        assert all(r["seen"] <= 3000 for r in got)


def test_a_walk_sees_few_rows_of_a_large_shard():
    x = clustered(np.random.default_rng(5), 8000, 12)
    links = graph_search.linked(x)
    rows, _, seen = graph_search.walked(x, links, np.ones(8000, bool), x[::100], 10, 24)
    true = np.argsort(-(x[::100] @ x.T), axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows, true, strict=True)]) >= 0.95
    assert seen.mean() < 0.15 * 8000


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (2, [0.0, 2.0], "b", 1), (3, None, "a", 1), (4, [0.0, 0.0], "a", 1), (5, [float("nan"), 1.0], "a", 1), (6, [1.0], "a", 1), (7, [1.0, None], "a", 1), (None, [1.0, 1.0], "a", 1), (1, [1.0, 0.0], "a", 1), (9, [3.0, 3.0], None, None)]
    index = graph_search.build(spark.createDataFrame(rows, VECTORS))
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query long, vec array<double>")
    ids = lambda **o: [(r["query"], r["id"], r["rank"]) for r in graph_search.search(index, asked, 5, **o).orderBy("query", "rank").collect()]
    assert ids() == [(1, 1, 1), (1, 9, 2), (1, 2, 3)]
    assert ids(itself=False) == [(1, 9, 1), (1, 2, 2)]
    assert ids(where=F.col("kind") == "a") == [(1, 1, 1)]
    none = graph_search.build(spark.createDataFrame([], VECTORS))
    assert graph_search.search(none, asked, 5).count() == 0


def test_rows_are_compared_one_by_one_where_walks_find_too_little():
    """Queries that are no rows of the shard lie far from all; a narrow walk finds too few."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, fine, asked = graph_search.linked(x), np.ones(6000, bool), rng.standard_normal((60, 64))
    last = np.sort(asked @ x.T, axis=1)[:, -20]
    found = lambda width: (graph_search.walked(x, links, fine, asked, 20, width)[1] >= last[:, None] - 1e-9).mean()
    wide = graph_search.wide_enough(x, links, fine, asked, 20, 20)
    assert found(20) < 0.95 <= found(wide) and wide > 20
    assert graph_search.wide_enough(x, links, np.arange(6000) < 50, asked, 20, 20) == 20
