"""Quality of documents from random-indexing word vectors and a small network.

Random indexing: each word has a fixed sparse random index vector, taken from a hash;
a word's vector sums the index vectors of the words beside it in the fitted sample.
Two streams are indexed that way, words themselves and their shapes (case, digits,
punctuation around them, whether they repeat the word before), so that a word never
seen still has a shape that was. Both streams' vectors are pooled over the whole
document into means and deviations, which a two-layer numpy network scores together
with the document's length; a temperature calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import held_out, texts
from wayfarer.llm.labelled import fitted, kept_rows, sigmoid
from wayfarer.llm.words import Words, bytes_hash, lowered, mix, word_chunks

DIM, ROWS, HIDDEN = 32, 1 << 14, 32
#: The fit's bound: so many labelled documents of each class at most.
EACH = 2500
#: Distinct words that get a vector of their own, the most frequent in the sample.
VOCABULARY = 20_000
#: Bytes of text that the fit works on at a time.
PART = 1 << 19

_rng = np.random.default_rng(6)
_INDEX = np.zeros((ROWS, DIM), np.float32)
np.put_along_axis(_INDEX, _rng.random((ROWS, DIM)).argsort(axis=1)[:, :4], _rng.choice([-1.0, 1.0], (ROWS, 4)), 1)
_KIND = np.zeros(256, np.int64)  # 0 letters beyond ASCII, 1 lower, 2 upper, 3 digit, 4 other
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in lower case, and hash of its shape."""
    data, start, end = words.data, words.start, words.end
    word = bytes_hash(lowered(data), start, end)
    kind = _KIND[data]
    counts = []
    for k in range(5):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts.append(total[end] - total[start])
    _, small, upper, digit, other = counts
    case = np.where(upper == 0, 0, np.where(small == 0, np.where(upper > 1, 3, 2), np.where((upper == 1) & (kind[start] == 2), 1, 4)))
    last, before = data[end - 1].astype(np.int64), data[np.maximum(end - 2, start)].astype(np.int64)
    tail = np.where(_KIND[last] == 4, last, 0) * 2 + (_KIND[before] == 4)
    repeats = np.zeros(len(word), np.int64)
    repeats[1:] = word[1:] == word[:-1]
    repeats[words.first[:-1][np.diff(words.first) > 0]] = 0
    shape = (((tail * 5 + case) * 2 + (digit > 0)) * 3 + np.minimum(other, 2)) * 2 + repeats
    return word, mix(shape.astype(np.uint64) + np.uint64(1 << 40))


def _index(h: np.ndarray) -> np.ndarray:
    return _INDEX[(h % np.uint64(ROWS)).astype(np.int64)]


def _contexts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, how often they occur, and the sums of their neighbours' index vectors."""
    x = _index(h)
    near = np.zeros_like(x)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for d in (1, 2):
        same = (doc[d:] == doc[:-d])[:, None]
        near[d:] += x[:-d] * same
        near[:-d] += x[d:] * same
    names, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    return names, counts, np.add.reduceat(near[order], np.cumsum(counts) - counts, axis=0) if len(h) else near


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    names, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(names))
    keep = np.sort(np.lexsort([names, -counts])[:most])
    place = np.full(len(names), -1)
    place[keep] = np.arange(len(keep))
    total, at = np.zeros((len(keep), DIM)), 0
    for part in parts:  # names are distinct within a part
        where = place[inverse[at : at + len(part[0])]]
        total[where[where >= 0]] += part[2][where >= 0]
        at += len(part[0])
    return names[keep], (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Vectors:
    """Vectors of the known words and shapes; unknown ones have their index vector."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], shapes: tuple[np.ndarray, np.ndarray]):
        self.streams = words, shapes

    def pooled(self, words: Words) -> np.ndarray:
        """Mean and deviation of both streams' vectors, and log length, of each document."""
        n = len(words.first) - 1
        out = np.zeros((n, 4 * DIM + 1))
        out[:, -1] = np.log1p(np.diff(words.first))
        some = np.flatnonzero(np.diff(words.first))
        if len(some):
            starts, size = words.first[some], np.diff(words.first)[some, None]
            for s, h in enumerate(tokens(words)):
                # Each distinct token's vector is looked up once; counts do the pooling.
                names, inverse = np.unique(h, return_inverse=True)
                known, table = self.streams[s]
                at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
                vectors = np.where((known[at] == names)[:, None], table[at], 0.5 * _index(names)) if len(known) else 0.5 * _index(names)
                for i in range(0, len(some), 64):
                    a, b = starts[i], words.first[some[min(i + 64, len(some)) - 1] + 1]
                    x = vectors[inverse[a:b]]
                    mean = np.add.reduceat(x, starts[i : i + 64] - a, axis=0) / size[i : i + 64]
                    square = np.add.reduceat(x * x, starts[i : i + 64] - a, axis=0) / size[i : i + 64]
                    rows = some[i : i + 64]
                    out[rows, 2 * s * DIM : (2 * s + 1) * DIM] = mean
                    out[rows, (2 * s + 1) * DIM : (2 * s + 2) * DIM] = np.sqrt(np.maximum(square - mean**2, 0))
        return out


class Model:
    def __init__(self, vectors: Vectors | None, layers: list[np.ndarray], scale: tuple[np.ndarray, np.ndarray], temperature: float, prior: float):
        self.vectors, self.layers, self.scale, self.temperature, self.prior = vectors, layers, scale, temperature, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.scale[0]) / self.scale[1] @ a + b, 0) @ c + d

    def scores(self, words: Words) -> np.ndarray:
        out = np.full(len(words.first) - 1, self.prior)
        some = np.flatnonzero(np.diff(words.first))
        if self.vectors is not None and len(some):
            out[some] = sigmoid(self.logits(self.vectors.pooled(words)[some]) / self.temperature)
        return out


def _train(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 300) -> list[np.ndarray]:
    """Two layers by Adam on the weighted log loss."""
    rng = np.random.default_rng(66)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for t in range(1, rounds + 1):
        a, b, c, d = layers
        hidden = np.maximum(x @ a + b, 0)
        error = (sigmoid(hidden @ c + d) - y) * w
        back = np.outer(error, c) * (hidden > 0)
        grads = [x.T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ error + 1e-4 * c, error.sum()]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            layers[k] = layers[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(found: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    prior = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    if len(found) < 10 or y.min() == y.max():
        return Model(None, [], (np.zeros(1), np.ones(1)), 1.0, prior)
    parts: list[list] = [[], []]
    # Small parts keep the driver's memory low: a word's context takes DIM numbers.
    for _, _, words in word_chunks(pa.array(found, pa.string()), most=PART):
        for s, h in enumerate(tokens(words)):
            parts[s].append(_contexts(h, words.first))
    vectors = Vectors(_merge(parts[0], VOCABULARY), _merge(parts[1], VOCABULARY))
    x = np.concatenate([vectors.pooled(words) for _, _, words in word_chunks(pa.array(found, pa.string()), most=PART)])
    # Every fifth document calibrates the temperature; the others train.
    apart = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~apart])) < 2 or not apart.any():
        apart[:] = False
    scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 0.05
    layers = _train((x[~apart] - scale[0]) / scale[1], y[~apart], weight[~apart] / weight[~apart].sum())
    model = Model(vectors, layers, scale, 1.0, prior)
    if apart.any():
        z, target, w = model.logits(x[apart]), y[apart], weight[apart]
        loss = lambda t: -(w * np.log(np.where(target == 1, sigmoid(z / t), sigmoid(-z / t)))).sum()
        model.temperature = min(np.geomspace(0.5, 5, 40), key=loss)
    return model


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column("text")):
                score = model.value.scores(words)
                ids = batch.select(["doc_id", "held_out"]).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, each: int = EACH) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 is likelier) and predicted.

    Fitted on at most ``each`` labelled documents of either class, none of them held
    out. Null, empty and blank texts get the share of good labels as their score.
    With fewer than ten labels, or one class only, every document gets that share (of
    no labels: one half). Rows with null or repeated ids are scored like all others;
    a null id isn't held out. Other columns are ignored. No rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, "quality", each, fit))
    plain = texts(docs).withColumn("held_out", held_out("doc_id"))
    return plain.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, each: int = EACH) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, "quality", each, fit))
    return kept_rows(docs, model, lambda score: score >= threshold, lower=False)
