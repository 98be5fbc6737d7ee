"""Hashed n-gram vectors against a plain version of the same features."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayfarer.operators.embedders import HashedNgrams, embedded


def plain(e: HashedNgrams, text: str) -> np.ndarray | None:
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = [(f"w:{w}", e.words) for w in words] + [(f"p:{a} {b}", e.pairs) for a, b in zip(words, words[1:])]  # noqa: B905
    for w in words:
        m = f"<{w}>"
        found += [(f"c:{m[i : i + n]}", e.characters) for n in range(e.shortest, e.longest + 1) for i in range(len(m) - n + 1)]
    held: dict[int, float] = defaultdict(float)
    for (feature, weight), n in Counter(found).items():
        digest = hashlib.md5(feature.encode()).hexdigest()
        held[int(digest[:8], 16) % e.size] += (1 if int(digest[8], 16) < 8 else -1) * weight * math.sqrt(n)
    vec = np.array([held[b] for b in range(e.size)])
    norm = np.linalg.norm(vec)
    return vec / norm if norm else None


@pytest.mark.parametrize("embedder", [HashedNgrams(), HashedNgrams(size=16, shortest=2, longest=5, words=2.0, pairs=0.0)])
def test_same_vectors_as_the_plain_version(spark, embedder):
    texts = ["Software Engineer", "software engineers", "C++ / C# developer", "a", "ab", "", " .. ", "Élève à l\'école", "東京 タワー", "the the the cat", "x" * 5000, " ".join(f"w{i}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, text string")
    got = {r["id"]: r["vec"] for r in embedder.documents(df, "id", "text").collect()}
    assert set(got) == {*range(len(texts)), 99} and got[99] is None
    for i, t in enumerate(texts):
        want = plain(embedder, t)
        assert (got[i] is None) == (want is None)
        assert want is None or np.array(got[i]) == pytest.approx(want, abs=1e-12)
    assert {r["id"]: r["vec"] for r in embedder.queries(df, "id", "text").collect()} == got


def test_near_texts_have_near_vectors(spark):
    texts = ["nurse assistant", "nursing assistant", "Assistant nurse", "steel welder", "welding of steel"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = [np.array(r["vec"]) for r in HashedNgrams().documents(df, "id", "text").orderBy("id").collect()]
    assert min(v[0] @ v[1], v[0] @ v[2]) > 0.6 and v[3] @ v[4] > 0.4 and abs(v[0] @ v[3]) < 0.2


def test_each_row_gets_its_texts_vector(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["vec"] for r in embedded(HashedNgrams(), df, "text").collect()}
    assert got[1] == got[2] and got[3] is None and got[4] is None
    assert embedded(HashedNgrams(), df.where("id > 9"), "text").count() == 0


def test_a_long_text_is_never_shuffled_with_each_of_its_features(spark):
    """Keys that are the texts themselves stand once beside a text's buckets, and no row a feature is shuffled."""
    text = " ".join(f"word{i}" for i in range(2000))
    df = spark.createDataFrame([(text,), ("one two",)], "text string")
    made = HashedNgrams().sparse(df, "text", "text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    got = {r["bucket"]: r["value"] for r in made.where("key != 'one two'").collect()}
    vec = np.array([got.get(b, 0.0) for b in range(256)])
    assert vec / np.linalg.norm(vec) == pytest.approx(plain(HashedNgrams(), text), abs=1e-12)
