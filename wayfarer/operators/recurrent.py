"""Recurrent encoders over histories of any length: gated units in both directions, then attention.

A model is a table of weights (name, row, values), so it is written, read and handed on
as any other table. Histories are rows with an array of steps. A batch of histories is
scanned together without padding: the steps of all lie one after another, what the gates
take from the input is one product for all of them, and at each time only histories that
are still going on take part. The longest history costs its own steps and no other's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

Weights = dict[str, np.ndarray]
#: Steps of the histories that are scanned at once.
STEPS = 8192


def held(weights: DataFrame) -> Weights:
    """The matrices of a model, by name; a model is small, and each task gets all of it."""
    found: dict[str, dict[int, list[float]]] = {}
    for r in weights.select("name", "row", "values").collect():
        found.setdefault(r["name"], {})[r["row"]] = r["values"]
    return {name: np.array([rows[k] for k in sorted(rows)], np.float64) for name, rows in found.items()}


def as_table(spark: SparkSession, weights: Weights) -> DataFrame:
    rows = [(name, k, [float(x) for x in row]) for name, m in weights.items() for k, row in enumerate(np.atleast_2d(m))]
    return spark.createDataFrame(rows, "name string, row int, values array<double>")


def drawn_weights(width: int, hidden: int, out: int, seed: int, months: int = 4, industries: int = 0, industry: int = 0, summary: int = 0, skills: int = 0, skill: int = 0, cell: str = "gru") -> Weights:
    """Random weights of a shape; biases are the last column of their matrix."""
    rng = np.random.default_rng(seed)
    gates, step = {"gru": 3, "lstm": 4}[cell], width + months + industry
    shapes = {"months": (months, 2), "attention": (hidden, 2 * hidden + 1), "score": (1, hidden), "out": (out, 2 * hidden + skill + 1)}
    for side in ("forward", "backward"):
        shapes |= {f"{side}_input": (gates * hidden, step + 1), f"{side}_state": (gates * hidden, hidden + 1)}
    shapes |= {"industry": (industry, industries + 1)} if industry else {}
    shapes |= {"summary": (hidden, summary + 1)} if summary else {}
    shapes |= {"skills": (skill, skills + 1)} if skill else {}
    return {name: rng.uniform(-1, 1, shape) / np.sqrt(shape[1]) for name, shape in shapes.items()}


def affine(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return x @ m[:, :-1].T + m[:, -1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gru(from_input: np.ndarray, state: tuple[np.ndarray, ...], m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates in the order reset, update, new; the reset gate lies on the state's share of the new value."""
    (h,) = state
    n = h.shape[1]
    from_state = affine(h, m)
    reset, update = _sigmoid(from_input[:, :n] + from_state[:, :n]), _sigmoid(from_input[:, n : 2 * n] + from_state[:, n : 2 * n])
    new = np.tanh(from_input[:, 2 * n :] + reset * from_state[:, 2 * n :])
    return ((1 - update) * new + update * h,)


def lstm(from_input: np.ndarray, state: tuple[np.ndarray, ...], m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates in the order input, forget, cell, output."""
    h, c = state
    gates = np.split(from_input + affine(h, m), 4, axis=1)
    c = _sigmoid(gates[1]) * c + _sigmoid(gates[0]) * np.tanh(gates[2])
    return _sigmoid(gates[3]) * np.tanh(c), c


CELLS: dict[str, tuple[Callable, int]] = {"gru": (gru, 1), "lstm": (lstm, 2)}


def scanned(from_input: np.ndarray, lengths: np.ndarray, first: np.ndarray, m: np.ndarray, cell: str = "gru", backward: bool = False) -> np.ndarray:
    """The state after each step of each history, in the steps' own order.

    ``from_input`` has the steps of all histories one after another, ``first`` the
    state before each history. Backward, a history begins at its own last step.
    """
    step, parts = CELLS[cell]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ends = starts + lengths[order] - 1
    state = (first[order], *[np.zeros_like(first) for _ in range(parts - 1)])
    out = np.zeros((len(from_input), first.shape[1]))
    # As many histories have more than t steps.
    going = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    for t, n in enumerate(going):
        at = ends[:n] - t if backward else starts[:n] + t
        state = step(from_input[at], tuple(s[:n] for s in state), m)
        out[at] = state[0]
    return out


def pooled(x: np.ndarray, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each history's steps, weighted by the softmax of their scores; zeros for one without steps."""
    out = np.zeros((len(lengths), x.shape[1]))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        of = np.repeat(np.arange(len(some)), lengths[some])
        weight = np.exp(scores - np.maximum.reduceat(scores, starts)[of])
        total = np.add.reduceat(weight, starts)
        out[some] = np.add.reduceat(x * weight[:, None], starts, axis=0) / total[:, None]
    return out


def forward(w: Weights, steps: np.ndarray, months: np.ndarray, industry: np.ndarray, lengths: np.ndarray, summary: np.ndarray, skills: np.ndarray, cell: str = "gru") -> np.ndarray:
    """A vector for each history.

    Each step is its vector beside its months (logarithms, widened) and, the same for
    all steps, the history's industries, weighted by their months. A summary, where the
    model has one, is the state before both scans. Skills stand beside what attention
    makes of all states.
    """
    n, of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    parts = [steps, np.maximum(affine(months[:, None], w["months"]), 0)]
    if "industry" in w:
        # The one-hot product is a column of the matrix.
        each = np.maximum(w["industry"][:, :-1].T[industry] + w["industry"][:, -1], 0)
        weight = np.maximum(np.expm1(months), 0)
        mean = np.zeros((n, each.shape[1]))
        np.add.at(mean, of, each * weight[:, None])
        parts.append((mean / np.maximum(np.bincount(of, weight, n), 1e-6)[:, None])[of])
    x = np.concatenate(parts, axis=1)
    hidden = w["score"].shape[1]
    first = np.tanh(affine(summary, w["summary"])) if "summary" in w else np.zeros((n, hidden))
    states = [scanned(affine(x, w[f"{side}_input"]), lengths, first, w[f"{side}_state"], cell, side == "backward") for side in ("forward", "backward")]
    both = np.concatenate(states, axis=1)
    made = [pooled(both, np.tanh(affine(both, w["attention"])) @ w["score"][0], lengths)]
    if "skills" in w:
        made.append(np.maximum(affine(skills, w["skills"]), 0))
    return affine(np.concatenate(made, axis=1), w["out"])


STEP = "struct<vec:array<double>,months:double,industry:int>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, read flat; null ones are zero."""
    out, known = np.zeros((len(column), width)), column.is_valid().to_numpy(zero_copy_only=False)
    out[known] = _flat(column.filter(pa.array(known)), width)
    return out


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls; null elements are not numbers."""
    if not pc.all(pc.fill_null(pc.equal(pc.list_value_length(column), width), False), min_count=0).as_py():
        raise ValueError(f"a vector is null or has not {width} elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _steps(column: pa.Array, width: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, months and industries of all steps, one history after another; no step becomes a Python object."""
    flat = column.flatten()
    vec, months, industry = (flat.flatten()[flat.type.get_field_index(name)] for name in ("vec", "months", "industry"))
    known = pc.and_(pc.greater_equal(industry, 0), pc.less(industry, kinds))
    industry = pc.if_else(pc.fill_null(known, False), industry, 0)
    return _flat(vec, width), pc.fill_null(months, 0).to_numpy(zero_copy_only=False).astype(np.float64), industry.to_numpy(zero_copy_only=False).astype(np.int64)


def encoded(histories: DataFrame, weights: DataFrame, cell: str = "gru") -> DataFrame:
    """(id, vec): the vector of each history.

    ``histories`` has id, steps (array of vec, months and industry, in order), summary
    and skills (arrays, null for none); vectors are of floats or doubles. Null months
    count as 0, a null or unknown industry as the first. A null or empty history is
    encoded from what stands beside it. A history is one row, so its length is bounded
    by what a task holds; histories are scanned some thousands of steps at a time.
    """
    w = held(weights)
    width = w["forward_input"].shape[1] - 1 - len(w["months"]) - (len(w["industry"]) if "industry" in w else 0)
    beside = {name: w[name].shape[1] - 1 if name in w else 0 for name in ("summary", "skills")}
    kinds = w["industry"].shape[1] - 1 if "industry" in w else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("steps")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, a = np.cumsum(sizes), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEPS, "right")))
                part = batch.slice(a, b - a)
                steps, months, industry = _steps(part.column("steps"), width, kinds)
                summary, skills = (_matrix(part.column(name), beside[name]) if beside[name] else np.zeros((b - a, 0)) for name in ("summary", "skills"))
                vec = forward(w, steps, months, industry, sizes[a:b], summary, skills, cell)
                bounds = np.arange(0, vec.size + 1, vec.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(bounds, pa.array(vec.ravel()))], names=["id", "vec"])
                a = b

    return histories.select("id", "steps", "summary", "skills").mapInArrow(run, f"id {dict(histories.dtypes)['id']}, vec array<double>")
