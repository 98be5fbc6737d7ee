"""Divergence of sources against sums over all terms of all pairs."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wayfarer.llm import divergence, words  # noqa: E402

DOCS = "lang string, source string, text string"


def found(df, **options) -> set[tuple]:
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.source_divergence(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def drawn() -> list[tuple]:
    rng = np.random.default_rng(2)
    vocabulary = ["the", "The", "a", "él", "ß", "É", "東京", "it's", "x1y", "end.", "\U0001f600", *[f"t{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]]
    odds = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for _ in range(400):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "é", "", "Z"])
        shift = len(source) * 3
        rows.append((str(rng.choice(["en", "fr"])), str(source), " ".join(np.roll(vocabulary, shift)[rng.choice(len(vocabulary), int(rng.integers(0, 25)), p=odds / odds.sum())])))
    long_ = " ".join(rng.choice(vocabulary, 30_000))
    odd = [("en", "s1", None), ("en", "empty", ""), ("en", None, "the the"), (None, None, "a b"), (None, "s1", " 12 \t"), ("xx", "alone", "rare words"), ("fr", "s2", long_), ("fr", "s2", long_), ("en", "only", "q" * 3000)]
    return rows + odd + [("en", "s0", "the same row")] * 12


@pytest.fixture(scope="module")
def rows():
    return drawn()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("x") for c in ("term", "n", "p", "q", "none", "part", "item", "value", "rank", "total", "docs")})


@pytest.mark.parametrize("options", [{}, {"least_docs": 1}, {"least_docs": 60, "top": 3}, {"least_docs": 10_000}])
def test_all_rows(docs, rows, options):
    want = brute.source_divergence(rows, options.get("least_docs", 10), options.get("top", 10))
    assert found(docs, **options) == want and {r[2] for r in want} >= {"pair"}


def test_ties_of_values_go_to_the_smaller_item_in_bytes(spark):
    rows = [("en", s, "one two three") for s in ("B", "a", "\uff5e", "\U0001f600", "b") for _ in range(10)] + [("en", "c", "one one one")]
    assert found(spark.createDataFrame(rows, DOCS)) == brute.source_divergence(rows)


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], DOCS)) == set()
    assert found(spark.createDataFrame([(None, None, None)], DOCS)) == set()


def test_words_of_one_hash_keep_their_own_counts(monkeypatch, spark, rows):
    """With a hash of two bits nearly all words collide, and the counts are right all the same."""
    plain = words.bytes_hash
    monkeypatch.setattr(words, "bytes_hash", lambda *a: plain(*a) & np.uint64(3))
    texts = pa.array([t or "" for *_, t in rows[:50]])
    _, _, held = next(words.word_chunks(texts, lower=True, inside=divergence.LETTERS))
    which, first = words.numbered(held)
    name = [held.data[a:b].tobytes() for a, b in zip(held.start, held.end, strict=True)]
    assert [name[i] for i in first[which]] == name and len({name[i] for i in first}) == len(first)


def test_shares_of_counts_beyond_64_bits(spark):
    """10**9 times a count of 10**13 needs more than 64 bits."""
    row = spark.createDataFrame([(10**13, 10**15 + 3, 10**9)], "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p"), divergence.share(F.col("n"), F.col("t"), F.lit(0)).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (10**15 + 3 + 2 * 10**9) and row["none"] is None
