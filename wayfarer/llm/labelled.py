"""Classifiers fitted on bounded samples of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import held_out, texts
from wayfarer.llm.words import word_chunks

#: Texts of more bytes than this take no part in a fit, which so holds a bounded number of bytes.
LONGEST = 1 << 15


def fitted(docs: DataFrame, labels: DataFrame, label: str, each: int, fit: Callable[[list[str], np.ndarray, np.ndarray], Any], longest: int = LONGEST) -> Any:
    """``fit(texts, labels, weights)`` on at most ``each`` labelled documents of either class.

    Documents that are held out are never among them. Which ones are chosen depends
    on a hash of the id alone; the weights restore the classes' shares among all
    labelled rows. Texts over ``longest`` bytes are left out, and of rows that share an
    id the one whose text comes first counts. The bounded sample meets in one task,
    which returns the model: the driver holds neither its texts nor what the fit makes
    of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(label))
    parts = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(each) for y in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = texts(docs).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y", order.alias("place")).agg(F.min("text").alias("text"))

    def model(found: list[str], y: np.ndarray) -> Any:
        got = np.bincount(y, minlength=2)
        weight = np.array([shares.get(k, 0) / max(1, got[k]) for k in (0, 1)])[y]
        return fit(found, y, weight / weight.mean() if len(weight) else weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if sum(b.num_rows for b in parts):
            all_ = pa.Table.from_batches(parts).sort_by([("place", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
            made = model(all_.column("text").to_pylist(), all_.column("y").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(made)], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else model([], np.zeros(0, np.int64))


def kept_rows(docs: DataFrame, model: Any, keep: Callable[[np.ndarray], np.ndarray], lower: bool) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text's score passes ``keep``.

    Scoring and filtering are one pass over each row: nothing is shuffled, and of rows
    that share an id each goes by its own text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for i, j, words in word_chunks(text, lower):
                yield batch.slice(i, j - i).filter(pa.array(keep(model.value.scores(words))))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
