"""Recurrent passes against one step at a time, sketches against sorted values, pruned pairs against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import ranking, recurrent, sketches, training
from wayfarer.plans.vectors import careers_encoded


def plain(w: dict, steps: list, summary, skills, cell: str) -> np.ndarray:
    """One history, one step and one direction at a time."""
    lin = lambda x, m: m[:, :-1] @ np.asarray(x, float) + m[:, -1]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    hidden = w["score"].shape[1]
    mean = None
    if "industry" in w:
        kinds = w["industry"].shape[1] - 1
        each = [np.maximum(lin(np.eye(kinds)[i if i is not None and 0 <= i < kinds else 0], w["industry"]), 0) for _, _, i in steps]
        weight = [max(np.expm1(m or 0), 0) for _, m, _ in steps]
        mean = sum((a * b for a, b in zip(each, weight, strict=True)), np.zeros(len(w["industry"]))) / max(sum(weight), 1e-6)
    xs = [np.concatenate([v, np.maximum(lin([m or 0], w["months"]), 0), *([mean] if mean is not None else [])]) for v, m, _ in steps]
    h0 = np.tanh(lin(summary if summary is not None else np.zeros(w["summary"].shape[1] - 1), w["summary"])) if "summary" in w else np.zeros(hidden)
    sides = []
    for side in ("forward", "backward"):
        h, c, out = h0, np.zeros(hidden), {}
        for t in range(len(xs)) if side == "forward" else reversed(range(len(xs))):
            a, b = lin(xs[t], w[f"{side}_input"]), lin(h, w[f"{side}_state"])
            if cell == "gru":
                (ar, az, an), (br, bz, bn) = np.split(a, 3), np.split(b, 3)
                z = sigmoid(az + bz)
                h = (1 - z) * np.tanh(an + sigmoid(ar + br) * bn) + z * h
            else:
                i, f, g, o = np.split(a + b, 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
            out[t] = h
        sides.append([out[t] for t in range(len(xs))])
    states = [np.concatenate(p) for p in zip(*sides, strict=True)]
    made = np.zeros(2 * hidden)
    if states:
        score = np.array([w["score"][0] @ np.tanh(lin(s, w["attention"])) for s in states])
        e = np.exp(score - score.max())
        made = sum(s * x for s, x in zip(states, e / e.sum(), strict=True))
    if "skills" in w:
        made = np.concatenate([made, np.maximum(lin(skills if skills is not None else np.zeros(w["skills"].shape[1] - 1), w["skills"]), 0)])
    return lin(made, w["out"])


@pytest.mark.parametrize(("cell", "beside"), [("gru", {}), ("gru", {"industries": 4, "industry": 3, "summary": 5, "skills": 6, "skill": 2}), ("lstm", {"industries": 4, "industry": 3, "summary": 5})])
def test_same_vectors_as_step_by_step(spark, monkeypatch, cell, beside):
    monkeypatch.setattr(recurrent, "STEPS", 40)  # so that histories are scanned in several parts
    rng = np.random.default_rng(2)
    w = recurrent.drawn_weights(5, 7, 4, seed=1, cell=cell, **beside)
    rows = []
    for i, n in enumerate([0, 1, 2, 17, 3, 90, 1, 0, 5, 5, *rng.integers(0, 20, 20).tolist()]):
        steps = [(rng.standard_normal(5).tolist(), float(rng.uniform(0, 4)) if k % 5 else None, int(rng.integers(-1, 6)) if k % 4 else None) for k in range(n)]
        rows.append((i, steps if n or i else None, rng.standard_normal(5).tolist() if i % 3 else None, rng.standard_normal(6).tolist() if i % 4 else None))
    df = spark.createDataFrame(rows, f"id long, steps array<{recurrent.STEP}>, summary array<double>, skills array<double>").withColumn("vec", F.lit("x"))
    model = recurrent.as_table(spark, w)
    assert all((recurrent.held(model)[k] == v).all() for k, v in w.items())
    got = {r["id"]: r["vec"] for r in recurrent.encoded(df, model, cell).collect()}
    assert len(got) == len(rows)
    for i, steps, summary, skills in rows:
        assert np.array(got[i]) == pytest.approx(plain(w, steps or [], summary, skills, cell), abs=1e-9)
    assert recurrent.encoded(df.where("id < 0"), model, cell).count() == 0


def test_steps_are_read_flat():
    kind = pa.list_(pa.struct([("months", pa.float64()), ("vec", pa.list_(pa.float32())), ("industry", pa.int32())]))
    made = [[(1.0, [9.0, 9.0], 1)], None, [(None, [0.5, None], None), (2.0, [1.0, -1.0], 7)], [], [(3.0, [2.0, 4.0], 2)], [(4.0, [9.0, 9.0], 0)]]
    column = pa.array([h and [dict(zip(("months", "vec", "industry"), s, strict=True)) for s in h] for h in made], kind)
    vec, months, industry = recurrent._steps(column.slice(1, 4), 2, 3)
    assert np.array_equal(vec, [[0.5, np.nan], [1, -1], [2, 4]], equal_nan=True) and vec.dtype == np.float64
    assert months.tolist() == [0, 2, 3] and industry.tolist() == [0, 0, 2]
    for bad in (None, [1.0], [1.0, 2.0, 3.0]):
        with pytest.raises(ValueError, match="vector"):
            recurrent._steps(pa.array([[{"months": 1.0, "vec": [1.0, 2.0], "industry": 0}, {"months": 1.0, "vec": bad, "industry": 0}]], kind), 2, 3)
    assert recurrent._matrix(pa.array([None, [1.0, 2.0], None]), 2).tolist() == [[0, 0], [1, 2], [0, 0]]


def test_careers_are_dealt_before_they_meet_their_vectors(spark, sf_dir, monkeypatch):
    """Orders without vectors are shuffled once, by customer; vectors stay floats."""
    seen = []
    encoded = recurrent.encoded
    monkeypatch.setattr(recurrent, "encoded", lambda h, w: (seen.append(h), encoded(h, w))[1])
    careers_encoded(spark, sf_dir)
    assert "vec:array<float>" in seen[0].schema.simpleString()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_no_step_is_padded(monkeypatch):
    """One long history beside many short ones costs its own steps and no more."""
    seen = []
    plain_gru, _ = recurrent.CELLS["gru"]
    monkeypatch.setitem(recurrent.CELLS, "gru", (lambda a, s, m: (seen.append(len(a)), plain_gru(a, s, m))[1], 1))
    lengths = np.array([1, 500, 2, 1, 0, 3])
    recurrent.scanned(np.zeros((lengths.sum(), 6)), lengths, np.zeros((6, 2)), np.zeros((6, 3)), backward=True)
    assert sum(seen) == lengths.sum() and len(seen) == 500


def test_sketches_within_their_bound(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal(40_000), np.full(20_000, 0.5), rng.pareto(1, 20_000)])
    df = spark.createDataFrame([(i % 3, i % 50, float(v)) for i, v in enumerate(x)] + [(7, 0, None), (8, 0, float("nan")), (9, 0, 4.0)], "g long, day long, v double").repartition(7)
    daily = sketches.sketched(df, ["g", "day"], "v", 200)
    got = sketches.percentiles(sketches.merged(daily, ["g"], 200), ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()
    assert {r["g"] for r in got} == {0, 1, 2, 9} and all(r["value"] == 4.0 for r in got if r["g"] == 9)
    for r in got:
        own = np.sort(x[r["g"] :: 3]) if r["g"] < 3 else np.array([4.0])
        below, upto = np.searchsorted(own, r["value"], "left") / len(own), np.searchsorted(own, r["value"], "right") / len(own)
        assert r["n"] == len(own) and below - sketches.rank_error(200) <= r["share"] <= upto + sketches.rank_error(200)
    size = daily.agg(F.max(F.length("sketch"))).first()[0]
    assert size < 8000


@pytest.mark.parametrize("made", ["clustered", "drawn", "lengths", "few"])
def test_pruned_pairs_are_all_pairs(spark, made):
    rng = np.random.default_rng(4)
    n = 3 if made == "few" else 400
    x = rng.standard_normal((n, 8))
    if made == "clustered":
        x = rng.standard_normal((12, 8))[rng.integers(0, 12, n)] + 0.02 * x
    if made != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x[5:9] = 0
    bank = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, vec array<double>")
    s = np.where(np.triu(np.ones((n, n), bool), 1), x @ x.T, -np.inf)
    levels = [0.3, 0.9, 0.95]
    got = {r["threshold"]: (r["n"], r["percent"]) for r in ranking.similarity_histogram(bank, levels, most=30).collect()}
    pairs = n * (n - 1) // 2
    assert got == {t: (int((s > t).sum()), pytest.approx(100 * (s > t).sum() / pairs)) for t in levels}
    order = np.argsort(-s, axis=None, kind="stable")[: min(25, pairs)]
    top = [(r["u"] // 3, r["v"] // 3) for r in ranking.top_pairs(bank, 25, most=30).collect()]
    assert [s[u, v] for u, v in top] == pytest.approx([s.ravel()[k] for k in order]) and len(set(top)) == len(order)
    if made in ("clustered", "drawn"):
        blocks = ranking.blocked(bank, 30)
        skipped = blocks.skipped(blocks.upper & (blocks.most > 0.9))
        assert (skipped > 0.6) == (made == "clustered")
        b = {r["id"] // 3: r["b"] for r in blocks.rows.collect()}
        of = np.array([b[i] for i in range(n)])
        assert (x @ x.T <= np.maximum(blocks.most, blocks.most.T)[of[:, None], of[None, :]]).all()


def test_no_pairs(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert ranking.top_pairs(none, 5).count() == 0 and ranking.similarity_histogram(none, [0.5]).count() == 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    w, x, target, wrong = rng.standard_normal((5, 4)), rng.standard_normal((7, 5)), _unit(rng.standard_normal((7, 4))), _unit(rng.standard_normal((9, 4)))
    wrong[2], wrong[5] = target[0], target[3]  # masked for these pairs
    loss, gradient = training.loss_and_gradient(w, x, target, wrong, 0.3)
    for i in range(5):
        for j in range(4):
            step = np.zeros_like(w)
            step[i, j] = 1e-6
            up, down = (training.loss_and_gradient(w + s, x, target, wrong, 0.3)[0] for s in (step, -step))
            assert gradient[i, j] == pytest.approx((up - down) / 2e-6, rel=1e-5, abs=1e-6)
    # By hand, for one pair: a masked row changes nothing.
    without = training.loss_and_gradient(w, x[:1], target[:1], np.delete(wrong, 2, axis=0), 0.3)
    assert training.loss_and_gradient(w, x[:1], target[:1], wrong, 0.3)[0] == pytest.approx(without[0])


def test_rows_drawn_again_count_as_often_but_are_multiplied_once():
    rng = np.random.default_rng(9)
    w, x, target, wrong = rng.standard_normal((5, 4)), rng.standard_normal((7, 5)), _unit(rng.standard_normal((7, 4))), _unit(rng.standard_normal((3, 4)))
    loss, gradient = training.loss_and_gradient(w, x, target, wrong[[0, 1, 1, 1, 2, 0]], 0.3)
    rows = [{"place": p, "vec": wrong[p].tolist()} for p in (0, 1, 1, 1, 2, 0)]
    once, times = training._counted(rows)
    assert len(once) == 3 and times.tolist() == [2, 3, 1]
    same, by_w = training.loss_and_gradient(w, x, target, once, 0.3, times)
    assert same == pytest.approx(loss) and np.allclose(by_w, gradient)


def test_training_finds_a_hidden_map(spark):
    """Targets are a turned version of what is given: members learn the turn, and rank held-out pairs better than before."""
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    x = _unit(rng.standard_normal((160, 6)))
    rows = [(i, v.tolist(), (v @ turn).tolist()) for i, v in enumerate(x)] + [(900, None, [1.0] * 6), (901, [1.0] * 6, None)]
    df = spark.createDataFrame(rows, "query long, vec array<double>, target array<double>").repartition(3)
    bank = df.where("query < 160").select(F.col("query").alias("id"), F.col("target").alias("vec"), F.col("query").alias("place"))
    weights, losses = training.trained(df.where("query % 4 != 0"), bank, [1, 2], rounds=25, rate=0.1, negatives=64)
    assert len(losses) == 25 and all(b < 0.5 * a for a, b in zip(losses[0], losses[-1], strict=True))
    again, _ = training.trained(df.where("query % 4 != 0"), bank, [1, 2], rounds=25, rate=0.1, negatives=64)
    assert all(np.allclose(a, b) for a, b in zip(recurrent.held(weights).values(), recurrent.held(again).values(), strict=True))
    asked = df.where("query % 4 = 0 and query < 160")
    got = training.predicted(asked, weights).collect()
    assert {r["member"] for r in got} == {"1", "2", None}
    keys = x @ turn
    rank = lambda q, v: 1 + int((keys @ np.array(v) > keys[q] @ np.array(v)).sum())
    mrr = {m: np.mean([1 / rank(r["query"], r["vec"]) for r in got if r["member"] == m]) for m in ("1", "2", None)}
    before = np.mean([1 / rank(q, x[q]) for q in range(0, 160, 4)])
    assert min(mrr.values()) > before + 0.3
    with pytest.raises(ValueError, match="no pairs"):
        training.trained(df.where("query < 0"), bank, [1])


def test_best_rows_over_several_stretches_with_ties(monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties
    monkeypatch.setattr(ranking, "AGAINST", 32)
    got = ranking._best(pa.array(range(40)), pa.array(x[:40].tolist()), np.arange(300) * 2, x, 7)
    want = np.argsort(-(x[:40] @ x.T), axis=1, kind="stable")[:, :7] * 2
    assert got["id"].to_pylist() == want.ravel().tolist() and got["query"].to_pylist() == np.repeat(np.arange(40), 7).tolist()
    few = ranking._best(pa.array([1]), pa.array([x[0].tolist()]), np.arange(3), x[:3], 7)
    assert few.num_rows == 3


def test_a_row_is_shuffled_to_no_more_blocks_as_the_bank_grows(spark):
    rng = np.random.default_rng(11)
    copies = []
    for n in (300, 1200):
        bank = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 8)))], "id long, vec array<double>")
        blocks = ranking.blocked(bank, 10)
        copies.append(blocks.pairs(blocks.upper).count() / n)
    assert copies[1] < 1.5 * copies[0]
