"""Contrastive training of maps between vectors, by gradients that tasks add up.

A pair is what is given (a history's vector) and what it should lead to (the next
step's). Each round every task computes the gradient of its own pairs, for all members
of an ensemble at once, and yields one row a task for each row of a weight matrix.
Spark adds them up entry by entry, and the driver, which holds nothing but the weights,
takes a step. A round is one pass over the pairs; a lost task is run again and gives the
same gradient.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.vectors import mean_vectors, normalised
from wayfarer.operators.ranking import drawn
from wayfarer.operators.recurrent import Weights, as_table, held

#: Rows of the bank this near the target don't count as wrong ones.
SAME = 0.999
#: Pairs that a task multiplies at once, and rounds that share their wrong answers.
PAIRS, KEPT = 512, 10


def loss_and_gradient(w: np.ndarray, x: np.ndarray, target: np.ndarray, wrong: np.ndarray, temperature: float, times: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Sum of the losses of some pairs under ``x @ w``, and its gradient by ``w``.

    The loss is the cross-entropy of the target among itself and the wrong rows; rows
    too like a pair's target are left out for that pair. Targets and wrong rows are of
    length 1, and predictions are made so. ``times`` says how often each wrong row
    counts (once, if not given).
    """
    made = x @ w
    size = np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    unit = made / size
    scores = unit @ wrong.T / temperature
    scores[target @ wrong.T > SAME] = -np.inf
    true = (unit * target).sum(axis=1, keepdims=True) / temperature
    top = np.maximum(scores.max(axis=1, keepdims=True, initial=-np.inf), true)
    e, own = np.exp(scores - top), np.exp(true - top)
    e = e if times is None else e * times
    total = e.sum(axis=1, keepdims=True) + own
    by_unit = ((e / total) @ wrong + (own / total - 1) * target) / temperature
    by_made = (by_unit - unit * (unit * by_unit).sum(axis=1, keepdims=True)) / size
    return float((np.log(total) + top - true).sum()), x.T @ by_made


@dataclass
class Adam:
    """Steps with decoupled decay."""

    rate: float
    decay: float = 1e-2
    first: float = 0.9
    second: float = 0.999
    n: int = 0

    def step(self, w: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if not self.n:
            self.m, self.v = np.zeros_like(w), np.zeros_like(w)
        self.n += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient**2
        mean, spread = self.m / (1 - self.first**self.n), self.v / (1 - self.second**self.n)
        return w * (1 - self.rate * self.decay) - self.rate * mean / (np.sqrt(spread) + 1e-8)


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _gradients(weights: list[np.ndarray], wrong: list[tuple[np.ndarray, np.ndarray]], temperature: float):
    width, out = weights[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient, n = np.zeros(len(weights)), np.zeros((len(weights), width, out)), 0
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                part = batch.slice(i, PAIRS)
                x, target = _rows(part.column("vec")), _rows(part.column("target"))
                n += len(x)
                for k, w in enumerate(weights):
                    a, g = loss_and_gradient(w, x, target, wrong[k][0], temperature, wrong[k][1])
                    loss[k] += a
                    gradient[k] += g
        if n:
            member, row = (a.ravel() for a in np.indices((len(weights), width)))
            lists = pa.ListArray.from_arrays(np.arange(0, gradient.size + 1, out, dtype=np.int32), pa.array(gradient.ravel()))
            # A member's loss and the number of pairs stand beside its first row alone.
            head = row == 0
            yield pa.RecordBatch.from_arrays([pa.array(member.astype(np.int32)), pa.array(row.astype(np.int32)), lists, pa.array(np.where(head, loss[member], 0.0)), pa.array(np.where(head, n, 0))], names=["member", "row", "values", "loss", "n"])

    return run


def _counted(drawn_rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Each row once, and how often it was drawn: from a small bank the same few come again and again."""
    times, vecs = Counter(r["place"] for r in drawn_rows), {r["place"]: r["vec"] for r in drawn_rows}
    return np.array([vecs[p] for p in sorted(vecs)]), np.array([times[p] for p in sorted(vecs)], np.float64)


def trained(pairs: DataFrame, bank: DataFrame, seeds: list[int], rounds: int = 40, rate: float = 0.02, temperature: float = 0.1, negatives: int = 4096) -> tuple[DataFrame, list[list[float]]]:
    """(weights, losses): a table of one matrix for each seed, named by it, and each round's mean loss of each member.

    ``pairs`` has vec and target, ``bank`` (id, vec, place) the rows that wrong answers
    are drawn from, for each seed and anew every ``KEPT`` rounds; ``place`` numbers them from 0. Pairs
    with a null side take no part. The first weights are near the identity.
    """
    spark = pairs.sparkSession
    unit = lambda c: normalised(F.col(c))
    fine = pairs.where("vec is not null and target is not null").select(F.transform("vec", lambda v: v.cast("double")).alias("vec"), unit("target").alias("target"))
    # A small table lies in few files; each pass is to keep all cores busy.
    fine = fine.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("vec", "target")).persist()
    shape = fine.select(F.size("vec").alias("a"), F.size("target").alias("b")).first()
    if shape is None:
        raise ValueError("there are no pairs to learn from")
    weights = [np.eye(shape["a"], shape["b"]) + 0.02 * np.random.default_rng(s).standard_normal((shape["a"], shape["b"])) for s in seeds]
    steps, losses = [Adam(rate) for _ in seeds], []
    rows = bank.select("id", "place", unit("vec").alias("vec"))
    wrong: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        if r % KEPT == 0:
            # As many rows as are drawn, whatever the size of the bank.
            wrong = [_counted(drawn(rows, negatives, 1000 * s + r).select("place", "vec").collect()) for s in seeds]
        parts = fine.mapInArrow(_gradients(weights, wrong, temperature), "member int, row int, values array<double>, loss double, n long")
        flat = parts.select("member", "row", F.posexplode("values").alias("at", "value"), "loss", "n")
        first = F.col("at") == 0
        added = flat.groupBy("member", "row", "at").agg(F.sum("value").alias("value"), F.sum(F.when(first, F.col("loss"))).alias("loss"), F.sum(F.when(first, F.col("n"))).alias("n"))
        gradient, loss, n = [np.zeros_like(w) for w in weights], [0.0] * len(seeds), 1
        for g in added.collect():
            gradient[g["member"]][g["row"], g["at"]] = g["value"]
            if g["row"] == 0 and g["at"] == 0:
                loss[g["member"]], n = g["loss"], g["n"]
        losses.append([x / n for x in loss])
        weights = [a.step(w, g / n) for a, w, g in zip(steps, weights, gradient, strict=True)]
    fine.unpersist()
    return as_table(spark, {str(s): w for s, w in zip(seeds, weights, strict=True)}), losses


def predicted(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(member, query, vec): each member's unit vector for each query, and that of all (null member): their mean, of length 1."""
    models: Weights = held(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("vec"))
            for name, w in models.items():
                made = x @ w if len(x) else np.zeros((0, w.shape[1]))
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), batch.column("query"), pa.array(made.tolist(), pa.list_(pa.float64()))], names=["member", "query", "vec"])

    each = queries.where("vec is not null").select("query", "vec").mapInArrow(run, f"member string, query {dict(queries.dtypes)['query']}, vec array<double>")
    mean = mean_vectors(each, ["query"], "vec")
    return each.unionByName(mean.select(F.lit(None).cast("string").alias("member"), "query", normalised(F.col("mean")).alias("vec")))
