"""Whitening against numpy's own eigenvectors, and Jacobi rotations where these are known."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wayfarer.llm import queries, whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<double>"


def checked(got: list, want: dict) -> None:
    assert {(r["vec_id"], r["component"]): (r["n"], r["deviation"]) for r in got} == {k: v[:2] for k, v in want.items()}
    assert len(got) == len(want)
    by_place = {(r["vec_id"], r["component"]): r for r in got}
    assert np.array([abs(by_place[k]["whitened"]) for k in want]) == pytest.approx([v[2] for v in want.values()], abs=1e-7)
    assert [by_place[k]["explained"] for k in want] == pytest.approx([v[3] for v in want.values()], rel=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)
    # One sign for a whole component, so that the covariance is the identity's.
    names = sorted({k[0] for k in want})
    w = np.array([[by_place[i, k]["whitened"] for k in sorted({k[1] for k in want})] for i in names])
    assert np.cov(w.T, bias=True).reshape(w.shape[1], -1) == pytest.approx(np.eye(w.shape[1]), abs=1e-9)


def test_given_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    checked(queries.op13_embedding_whitening(spark, sf_dir).collect(), brute.whitened(rows))


def test_odd_rows_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5) * [1000, 10, 1, 0.1, 3]).tolist()) for i in range(40)]
    odd = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [float("nan")] * 5), (53, [float("inf")] * 5), (54, [1e30] * 5), (55, []), (56, [0.0] * 5), (57, [-0.0005] * 5)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({c: F.lit("x") for c in ("dim", "x", "n", "whitened", "component", "at", "vec", "i", "value")}).repartition(3)
    checked(whitening.whitened(df).collect(), brute.whitened([r for r in rows + odd if r[0] not in (54, 55)]))


def test_repeated_rows_null_ids_and_lengths(spark):
    """Every row counts; each length of vectors has a fit of its own."""
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((2, 12, 3)).tolist(), rng.standard_normal((12, 2)).tolist()
    rows = [(i, v) for i, v in enumerate(a[0])] + [(0, a[0][0]), (None, a[0][1])] + [(100 + i, v) for i, v in enumerate(b)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 14 * 3 + 12 * 2 and {r["n"] for r in got} == {12, 14}
    assert len([r for r in got if r["vec_id"] == 0]) == 6 and len([r for r in got if r["vec_id"] is None]) == 3
    checked([r for r in got if (r["vec_id"] or 0) >= 100], brute.whitened(rows[14:]))


def test_components_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    assert {r["component"] for r in whitening.whitened(spark.createDataFrame(line, VECTORS)).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whitened(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_deviations_of_any_size():
    fit = whitening.Whitening(10**12 + 7, [10**17 + 3, -(10**18)], np.zeros((0, 2)), np.zeros(0))
    x = np.array([[5, -3], [2**40, -(2**40)]])
    assert fit.deviations(x) == [sum((fit.n * int(c) - s) ** 2 for c, s in zip(v, fit.sums, strict=True)) for v in x]


@pytest.mark.parametrize("d", [1, 2, 3, 8, 31])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((d, d))
    for a in (m @ m.T, m + m.T, np.zeros((d, d)), np.eye(d), np.ones((d, d))):
        values, vectors = whitening.jacobi(a)
        assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], abs=1e-12 * max(1, np.abs(a).max()) * d)
        assert vectors.T @ vectors == pytest.approx(np.eye(d), abs=1e-12)
        assert vectors * values @ vectors.T == pytest.approx(a, abs=1e-11 * d)


def test_small_eigenvalues_are_accurate():
    """A scaled matrix, whose smallest eigenvalue the usual solvers lose, keeps it to 12 digits."""
    q = np.random.default_rng(1).standard_normal((10, 10))
    scale = 10.0 ** -np.arange(10)
    a = scale[:, None] * (q @ q.T / 10 + np.eye(10)) * scale
    assert whitening.jacobi(a)[0][-1] == pytest.approx(1 / np.linalg.eigvalsh(np.linalg.inv(a))[-1], rel=1e-11)


def test_rounds_hold_each_pair_once():
    for d in range(1, 9):
        pairs = [tuple(p) for r in whitening.rounds(d) for p in r.tolist()]
        assert sorted(pairs) == [(i, j) for i in range(d) for j in range(i + 1, d)]
        assert all(len(set(r.ravel().tolist())) == r.size for r in whitening.rounds(d))
