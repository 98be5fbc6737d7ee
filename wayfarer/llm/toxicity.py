"""Toxicity of documents from subword bags under a linear softmax.

A word is the mean of its character n-grams' embeddings, so a misspelling that was
never seen shares most of its vector with the word it stands for. A linear softmax
sees a document in several ways, each with a weight of its own: the average of all its
words, so that evidence in many places adds up, and for each of several widths the most
toxic of all its stretches of so many words, from whichever word these begin, so that
one insult isn't diluted by a long text around it. Embeddings, softmax and weights are
trained jointly, through this pooling, in numpy, from a random start that leans nowhere.
The average alone finds fewer toxic documents (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import held_out, texts
from wayfarer.llm.labelled import fitted, kept_rows, sigmoid
from wayfarer.llm.words import Loads, Words, bytes_hash, mix, ragged, split_rows, word_chunks

BUCKETS, DIM = 1 << 17, 8
#: Words of the stretches that are looked at, from every word on.
WIDTHS = (1, 2, 4)
#: The fit's bound: so many labelled documents of each class at most.
EACH = 1000
ROUNDS = 60
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which distinct word each word is, without punctuation around it; hashes and places of these."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start += _PUNCT[words.data[start]] & (end - start > 1)
        end -= _PUNCT[words.data[end - 1]] & (end - start > 1)
    h, at, number = np.unique(bytes_hash(words.data, start, end), return_index=True, return_inverse=True)
    return number, h, start[at], end[at]


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of 3 to 6 bytes of the words, and of each whole word."""
    n = end - start + 2
    ends = np.cumsum(n)
    first = ends - n
    inner = np.arange(int(ends[-1]) if len(n) else 0)
    of = np.repeat(np.arange(len(n)), n)
    within = inner - first[of]
    marked = data[np.clip(start[of] + within - 1, 0, max(0, len(data) - 1))] if len(of) else np.zeros(0, np.uint8)
    marked = np.where(within == 0, np.uint8(2), np.where(within == n[of] - 1, np.uint8(3), marked))
    out, loads = [(np.arange(len(n)), bytes_hash(marked, first, ends))], Loads(marked)
    for k in range(3, 7):
        at = np.flatnonzero(within + k <= n[of])
        out.append((of[at], mix(loads.at(at, np.full(len(at), k)) + np.uint64(k << 56))))
    word, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return word, (h % np.uint64(BUCKETS)).astype(np.int64)


class Pooling:
    """Documents' views of their words' logits: the best stretch of each width, and the average."""

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        self.some = np.flatnonzero(n)
        self.first, self.n = first[:-1][self.some], n[self.some]
        #: For each width, the first word of each stretch and where each document's stretches begin.
        self.starts, self.at = [], []
        for w in WIDTHS:
            many = np.maximum(self.n - w + 1, 1)
            self.starts.append(ragged(self.first, many))
            self.at.append(np.cumsum(many) - many)

    def views(self, logit: np.ndarray, pick: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """(documents with words, views), and with ``pick`` the first word of each best stretch."""
        whole = np.add.reduceat(logit, self.first) / self.n
        out, picked = [], []
        for w, starts, at in zip(WIDTHS, self.starts, self.at, strict=True):
            total = logit.copy()
            for k in range(1, w):
                total[:-k] += logit[k:]
            stretch = total[starts] / w
            short = self.n < w  # the only stretch is the whole document
            stretch[at[short]] = whole[short]
            top = np.maximum.reduceat(stretch, at)
            out.append(top)
            if pick:
                of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(starts))))
                is_top = np.flatnonzero(stretch == top[of])
                picked.append(starts[is_top[np.unique(of[is_top], return_index=True)[1]]])
        return np.stack([*out, whole], axis=1), picked

    def back(self, error: np.ndarray, mix: np.ndarray, picked: list[np.ndarray], total: int) -> np.ndarray:
        """Each word's share of its document's error."""
        steps = np.zeros(total + 1)
        for w, start, m in zip(WIDTHS, picked, mix, strict=False):
            size = np.minimum(self.n, w)
            np.add.at(steps, start, error * m / size)
            np.subtract.at(steps, start + size, error * m / size)
        return np.cumsum(steps)[:-1] + np.repeat(error * mix[-1] / self.n, self.n)


class Model:
    """What scoring needs: each bucket's share of the toxic logit, the views' weights, a bias and a fallback."""

    def __init__(self, share: np.ndarray, mix: np.ndarray, bias: float, empty: float):
        self.share, self.mix, self.bias, self.empty = share, mix, bias, empty

    def scores(self, words: Words) -> np.ndarray:
        n_docs = len(words.first) - 1
        out = np.full(n_docs, self.empty)
        if len(words.start):
            number, _, start, end = distinct_words(words)
            word, bucket = grams(words.data, start, end)
            size = np.bincount(word, minlength=len(start))
            logit = (np.bincount(word, self.share[bucket], len(start)) / size)[number]
            pool = Pooling(words.first)
            out[pool.some] = sigmoid(self.bias + pool.views(logit)[0] @ self.mix)
        return out


def fit(found: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """Joint training by Adagrad over the whole bounded sample."""
    prior = (float((weight * y).sum()) + 1) / (float(weight.sum()) + 2)
    rng = np.random.default_rng(8)
    embed = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 1, DIM), float(np.log(prior / (1 - prior)))
    mix = np.ones(len(WIDTHS) + 1)
    if len(found) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS), mix, bias, prior)
    # Small parts, and n-grams once for each distinct word of the sample: the driver's
    # memory holds no more than their buckets, word by word.
    known, known_id = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    numbers, buckets, sizes, first, base, seen = [], [], [], [0], 0, 0
    for _, _, w in word_chunks(pa.array(found, pa.string()), lower=True, most=1 << 19):
        first += (w.first[1:] + seen).tolist()
        if not len(w.start):
            continue
        number, h, start, end = distinct_words(w)
        at = np.searchsorted(known, h)
        old = known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
        new = np.flatnonzero(~old)
        ids = np.empty(len(h), np.int64)
        ids[old], ids[new] = known_id[at[old]], base + np.arange(len(new))
        known, known_id = np.insert(known, at[new], h[new]), np.insert(known_id, at[new], ids[new])
        word, bucket = grams(w.data, start[new], end[new])
        buckets.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(word, minlength=len(new)))
        numbers.append(ids[number])
        base, seen = base + len(new), seen + len(number)
    if not seen:
        return Model(np.zeros(BUCKETS), mix, bias, prior)
    number, bucket_of, size = np.concatenate(numbers), np.concatenate(buckets), np.concatenate(sizes)
    del numbers, buckets, known, known_id
    gram_at = np.concatenate([[0], np.cumsum(size)])
    pool = Pooling(np.array(first))
    some = pool.some
    target, wt = y[some], weight[some] / weight[some].sum()
    # Both classes count at least a fifth, or rare toxic texts would teach nothing at first.
    for k in (0, 1):
        share = wt[target == k].sum()
        if 0 < share < 0.2:
            wt = np.where(target == k, wt * 0.2 / share, wt * 0.8 / (1 - share))
    seen_embed, seen_soft, seen_mix, seen_bias = np.full(BUCKETS, 1e-8), np.full(DIM, 1e-8), np.full(len(mix), 1e-8), 1e-8
    for _ in range(ROUNDS):
        share = embed @ soft
        logit = (np.add.reduceat(share[bucket_of], gram_at[:-1]) / size)[number]
        views, picked = pool.views(logit, pick=True)
        error = (sigmoid(bias + views @ mix) - target) * wt
        # Gradients flow to the n-grams of all words, by the views that these are in.
        per_word = np.bincount(number, pool.back(error, mix, picked, len(number)), len(size))
        per_bucket = np.bincount(bucket_of, np.repeat(per_word / size, size), BUCKETS)
        d_mix = error @ views
        used = np.flatnonzero(per_bucket)
        d_soft = per_bucket[used] @ embed[used]
        d_embed = per_bucket[used, None] * soft[None, :]
        seen_embed[used] += (d_embed**2).mean(axis=1)
        embed[used] -= (0.5 * d_embed / np.sqrt(seen_embed[used])[:, None]).astype(np.float32)
        seen_soft = seen_soft + d_soft**2
        soft = soft - 0.1 * d_soft / np.sqrt(seen_soft)
        seen_mix = seen_mix + d_mix**2
        mix = np.maximum(mix - 0.05 * d_mix / np.sqrt(seen_mix), 0.05)  # no view is ever left out
        seen_bias += error.sum() ** 2
        bias -= 0.2 * error.sum() / np.sqrt(seen_bias)
    return Model((embed @ soft).astype(np.float64), mix, bias, prior)


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column("text"), lower=True):
                score = model.value.scores(words)
                ids = batch.select(["doc_id", "held_out"]).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, each: int = EACH) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more likely toxic) and predicted.

    Fitted on at most ``each`` labelled documents of either class, none of them held
    out. Null, empty and blank texts get the share of toxic labels as their score.
    Without labels, or with one class only, every document gets that share (of no
    labels: one half). Rows with null or repeated ids are scored like all others; a
    null id isn't held out. Other columns are ignored. No rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, "toxic", each, fit))
    plain = texts(docs).withColumn("held_out", held_out("doc_id"))
    return plain.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, each: int = EACH) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is under ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, "toxic", each, fit))
    return kept_rows(docs, model, lambda score: score < threshold, lower=True)
