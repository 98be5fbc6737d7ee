"""Vectors of texts: hashed n-grams behind an interface that any encoder can take.

An embedder turns a query (a user's skill, a title that is looked for) or a document (a
label of the catalogue) into a unit vector; the two sides may differ, as encoders with
prompts do. The one here needs no weights: signed feature hashing of character and word
n-grams. Spark cuts a text into words; a small helper counts their n-grams, text by text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import sqrt
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are handed back at once, and features whose bucket a task remembers.
TEXTS, KNOWN = 256, 200_000
TEXT = "_embedded_text"
KINDS = {"array<double>": pa.list_(pa.float64()), "array<struct<bucket:bigint,value:double>>": pa.list_(pa.struct([("bucket", pa.int64()), ("value", pa.float64())]))}


class Embedder(Protocol):
    """``key`` and ``vec`` (unit array<double>, or null where a text says nothing) for the rows of a frame."""

    def queries(self, df: DataFrame, key: str, text: str) -> DataFrame: ...

    def documents(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


@dataclass(frozen=True)
class HashedNgrams:
    """Signed feature hashing of the n-grams of a lower-cased text.

    Words are runs of letters and digits of any script. Features are the words, pairs
    of neighbouring words, and the character n-grams of each word between two marks;
    each falls into the bucket that the first 32 bits of its md5 name, with the sign of
    the next bit, and counts with its kind's weight times the root of how often it
    stands there. Both sides are the same.
    """

    size: int = 256
    shortest: int = 3
    longest: int = 4
    words: float = 1.0
    pairs: float = 0.5
    characters: float = 0.4

    def left(self, words: list[str], known: dict[str, tuple[int, float]]) -> dict[int, float]:
        """What a text's words leave in the buckets; ``known`` holds the bucket and sign of features met before."""
        count, weighed = Counter(words), []
        if self.words:
            weighed += [(f"w:{w}", self.words, n) for w, n in count.items()]
        if self.pairs:
            weighed += [(f"p:{a} {b}", self.pairs, n) for (a, b), n in Counter(pairwise(words)).items()]
        if self.characters:
            grams: dict[str, int] = {}
            for w, times in count.items():
                w = f"<{w}>"
                for n in range(self.shortest, self.longest + 1):
                    for i in range(len(w) - n + 1):
                        gram = w[i : i + n]
                        grams[gram] = grams.get(gram, 0) + times
            weighed += [(f"c:{g}", self.characters, n) for g, n in grams.items()]
        out: dict[int, float] = {}
        for feature, weight, n in weighed:
            at = known.get(feature)
            if at is None:
                digest = hashlib.md5(feature.encode(), usedforsecurity=False).digest()
                at = int.from_bytes(digest[:4]) % self.size, 1.0 if digest[4] < 128 else -1.0
                if len(known) < KNOWN and feature[0] != "p":  # pairs seldom come again
                    known[feature] = at
            out[at[0]] = out.get(at[0], 0.0) + at[1] * weight * sqrt(n)
        return out

    def _made(self, df: DataFrame, key: str, text: str, column: str, kind: str, turned: Callable[[dict[int, float]], object]) -> DataFrame:
        """``key`` and what ``turned`` makes of a text's buckets. A text is read in one task, so only what is left of it is ever shuffled."""
        words = F.filter(F.split(F.lower(F.col(TEXT).cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, tuple[int, float]] = {}
            for batch in batches:
                for i in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(i, TEXTS)
                    rows = [turned(self.left(w or [], known)) for w in part.column("words").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, KINDS[kind])], names=["key", column])

        # Rows often come from a shuffle that was joined into few tasks, as texts are small beside the work on them.
        dealt = df.select(F.col(key).alias("key"), F.col(text).alias(TEXT)).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "key")
        return dealt.select("key", words.alias("words")).mapInArrow(run, f"key {dict(df.dtypes)[key]}, {column} {kind}")

    def sparse(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, bucket, value): what each text leaves in its buckets, before its length is made 1; keys are distinct."""
        made = self._made(df, key, text, "m", "array<struct<bucket:bigint,value:double>>", lambda left: [{"bucket": b, "value": v} for b, v in left.items()])
        return made.select("key", F.explode("m").alias("m")).select("key", "m.bucket", "m.value")

    def dense(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """One row for each key of ``df``, which are distinct; null where a text has no word."""

        def unit(left: dict[int, float]) -> np.ndarray | None:
            out = np.zeros(self.size)
            out[list(left)] = list(left.values())
            norm = np.sqrt((out * out).sum())
            return out / norm if norm > 0 else None

        return self._made(df, key, text, "vec", "array<double>", unit).withColumnRenamed("key", key)

    def queries(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return self.dense(df, key, text)

    def documents(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return self.dense(df, key, text)


def embedded(embedder: Embedder, df: DataFrame, text: str, side: str = "documents") -> DataFrame:
    """``df`` with a column vec; each distinct text is embedded once, a null one not at all."""
    distinct = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    made = getattr(embedder, side)(distinct, "_text", "_text")
    return df.join(made, F.col(text) == F.col("_text"), "left").drop("_text")
