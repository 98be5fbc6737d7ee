"""License scans against places found word by word and alignments of whole texts."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wayfarer.llm import licenses, queries  # noqa: E402

DOCS = "doc_id long, text string"
BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def prose(rng, n: int) -> list[str]:
    return rng.choice(["the", "of", "license", "under", "public", "work", "cc", "mit", "é", *[f"w{i}" for i in range(80)]], n).tolist()


def drawn() -> list[tuple]:
    rng = np.random.default_rng(9)
    phrases = [p for _, p in licenses.PHRASES]
    rows = []
    for i in range(120):
        w = prose(rng, int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 4))):
            w[(k := int(rng.integers(0, len(w) + 1))) : k] = str(rng.choice(phrases)).split()
        rows.append((i, str(rng.choice([" ", "-", ", ", "\n"])).join(w)))
    odd = [None, "", "\t..", "mit", "MIT License", "mit licenses", "cc", "by", "CC-BY-NC 4.0", "the GNU General Public\nLicense", "gnu general public", "cc by cc by cc by", "apache licenseé", "İ mit license"]
    rows += [(200 + k, t) for k, t in enumerate(odd)]
    long_ = " ".join(prose(rng, 70_000))
    return rows + [(300, long_ + " mit license " + long_), (301, "mit license " * 40_000), (7, "cc by"), (7, "cc by"), (7, "apache license"), (None, "apache license x"), (None, "apache license x"), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return drawn()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("x") for c in ("node", "same", "gram", "template", "votes", "labels", "n_words", "places", "score")})


@pytest.mark.parametrize("bits", [licenses.MAP_BITS, 62])
def test_base_places(docs, rows, monkeypatch, bits):
    """Also where the bitmap is so full that nearly all texts are read again."""
    monkeypatch.setattr(licenses, "MAP_BITS", bits)
    got = [tuple(r[c] for c in BASE) for r in licenses.license_scan(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute.license_base(rows), key=repr)


def test_labels_hold_base_labels(docs):
    for r in licenses.license_scan(docs).collect():
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["base_labels"]) and (r["score"] > 0) == bool(r["labels"])


@pytest.fixture(scope="module")
def noticed():
    """Each notice in prose: as it is, with words changed, dropped and put in, its half, and its words in another order."""
    rng = np.random.default_rng(12)
    rows = []
    for label, text in licenses.NOTICES:
        w = brute.license_words(text)
        if len(w) < 10:
            continue
        many = max(1, len(w) // 12)
        for kind in ("whole", "changed", "dropped", "more", "half", "mixed"):
            x = list(w)
            for k in sorted(rng.choice(np.arange(2, len(w) - 2), many, replace=False).tolist(), reverse=True):
                if kind == "changed":
                    x[k] = "zz"
                elif kind == "dropped":
                    del x[k]
                elif kind == "more":
                    x.insert(k, "zz")
            x = x[: len(x) // 2] if kind == "half" else rng.permutation(x).tolist() if kind == "mixed" else x
            rows.append((len(rows), label, kind, [*prose(rng, 30), *x, *prose(rng, 30)]))
    return rows


def test_notices_whole_changed_and_apart(spark, noticed):
    df = spark.createDataFrame([(i, " ".join(w)) for i, _, _, w in noticed], DOCS)
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, label, kind, w in noticed:
        labels = [x for x in got[i]["labels"].split(",") if x]
        shares: dict[str, float] = {}
        for t in licenses.templates(()):
            shares[t.label] = max(shares.get(t.label, 0), brute.local_alignment(w, [x.decode() for x in t.words]) / len(t.words))
        if kind in ("whole", "changed", "dropped", "more"):
            # Where the very word that tells two notices apart was changed, the other one counts.
            label = next((x for x in labels if x[:5] == label[:5] == "cc-by"), label)
            assert label in labels, (label, kind)
            span = next(s for s in got[i]["spans"] if s["label"] == label)
            assert 0.7 <= span["share"] <= shares[label] and (span["share"] == 1 or kind != "whole") and 28 <= span["first_word"] <= 34
        # Nothing is found that an alignment over the whole text doesn't find.
        assert all(shares[s["label"]] >= 0.7 for s in got[i]["spans"])
        if kind == "mixed":
            assert not got[i]["spans"]


def test_alignment_equals_the_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.choice(list("abcd"), int(rng.integers(n, 12))).tolist() for n in (0, 3))
        t = licenses.templates((), (("x", " ".join(b)),))[0]
        score, first, end = licenses.aligned([x.encode() for x in a], t)
        assert score == brute.local_alignment(a, b)
        assert brute.local_alignment(a[first:end], b) == score and (not score or (a[first] in b and a[end - 1] in b))


def test_more_specific_notices_win(spark):
    """A notice that differs in one word from another's gets its own label alone, and a phrase in it its base label."""
    texts = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY 4.0.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "Released under the MIT License.": "mit",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "",
        dict(licenses.NOTICES)["lgpl"]: "lgpl",
        dict(licenses.NOTICES)["agpl"]: "agpl",
        licenses.NOTICES[4][1]: "gpl",
        licenses.NOTICES[0][1]: "mit",
        licenses.NOTICES[0][1] + " " + licenses.NOTICES[1][1]: "bsd,mit",
    }
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {list(texts)[r["doc_id"]]: r["labels"] for r in got} == texts


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert licenses.license_scan(empty).count() == 0
    assert [r["labels"] for r in licenses.license_scan(spark.createDataFrame([(1, None)], DOCS)).collect()] == [""]
    with pytest.raises(ValueError, match="fewer"):
        licenses.templates((("x", "one"),), ())


def test_given_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op12_license_scan(spark, sf_dir).collect()
    assert sorted((tuple(r[c] for c in BASE) for r in got), key=repr) == sorted(brute.license_base(rows), key=repr)
