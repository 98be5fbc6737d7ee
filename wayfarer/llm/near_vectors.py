"""Near-duplicate vectors by spherical-cap filters from a random product code.

A random rotation cuts each unit vector in two. Each half has its own K random
codewords; a filter is one codeword of each half, so there are K * K filter
directions, none of which is ever stored. A vector's filters are all whose inner
product with it exceeds a threshold: of each half, only codewords that can reach it
together with the best one of the other half are combined (list decoding). Near
vectors fall into common caps, so the join on filters holds the pairs, which are then
verified by exact cosine, block against block. Several codes with rotations of their
own make a miss improbable; how many it takes is measured on drawn pairs that are just
near enough.

A pair meets in several filters and is counted in the first of them only. A filter
holds some hundred vectors by chance, beside those that are near each other: the work
grows with the rows, and with the number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import staged
from wayfarer.llm.components import components
from wayfarer.llm.words import ragged

#: The chance that two vectors just near enough share no filter of any code.
MISS = 1e-4
#: Vectors of a filter on average; there are as many filters as that takes.
HELD = 1024
#: Members of a block.
BLOCK = 2048


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that can be compared at all."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding").cast("array<float>" if kind == "array<float>" else "array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column that all have the same length, each of norm 1."""
    flat = column.flatten().to_numpy().astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class ProductCode:
    """Filters numbered 0 .. codewords**2 - 1 over ``dim`` dimensions; one a vector on average, and one at least."""

    def __init__(self, dim: int, codewords: int, seed: int):
        rng = np.random.default_rng(seed)
        self.k = codewords
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = []
        for part in np.array_split(np.arange(dim), 2):
            c = rng.standard_normal((len(part), codewords))
            norm = np.linalg.norm(c, axis=0, keepdims=True)
            self.parts.append((part, c / np.where(norm > 0, norm, 1) / math.sqrt(2)))
        probe = rng.standard_normal((512, dim))
        a, b = (np.sort(s, axis=1)[:, -24:] for s in self._scores(probe / np.linalg.norm(probe, axis=1, keepdims=True)))
        best = np.sort((a[:, :, None] + b[:, None, :]).ravel())
        self.threshold = best[-min(len(best), len(probe))]

    def _scores(self, x: np.ndarray) -> list[np.ndarray]:
        turned = x @ self.rotation
        return [turned[:, part] @ c for part, c in self.parts]

    def exceeded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all filters over the threshold, and of each vector's best one anyway."""
        a, b = self._scores(x)
        row_a, i = np.nonzero(a >= self.threshold - b.max(axis=1, keepdims=True))
        row_b, j = np.nonzero(b >= self.threshold - a.max(axis=1, keepdims=True))
        many_b = np.bincount(row_b, minlength=len(x))
        first_b = np.cumsum(many_b) - many_b
        n = many_b[row_a]
        left, right = np.repeat(np.arange(len(i)), n), ragged(first_b[row_a], n)
        row, i, j = row_a[left], i[left], j[right]
        over = a[row, i] + b[row, j] >= self.threshold
        row, found = row[over], i[over] * self.k + j[over]
        none = np.setdiff1d(np.arange(len(x)), row)
        return np.concatenate([row, none]), np.concatenate([found, a[none].argmax(axis=1) * self.k + b[none].argmax(axis=1)])


class Codes:
    """Several independent product codes; filters are numbered through."""

    def __init__(self, rows: int, dim: int, least_cosine: float):
        self.k = max(2, math.ceil(math.sqrt(1.6 * rows / HELD)))
        rng = np.random.default_rng(dim)
        # Pairs at the limit itself; nearer ones are missed less.
        x, z = rng.standard_normal((2, 2000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        y = least_cosine * x + math.sqrt(max(0.0, 1 - least_cosine**2)) * (z if dim > 1 else 0 * z)
        self.codes: list[ProductCode] = []
        chance = 1.0
        while chance > MISS and len(self.codes) < 200:
            code = ProductCode(dim, self.k, len(self.codes))
            a, b = code.exceeded(x), code.exceeded(y)
            both = np.intersect1d(a[0] * self.k**2 + a[1], b[0] * self.k**2 + b[1])
            met = len(np.unique(both // self.k**2))
            chance *= max(1 - met / len(x), 1e-4)
            self.codes.append(code)
        self.chance = chance

    def exceeded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, filters): each vector's filters of all codes, in ascending order."""
        rows, found = [], []
        for n, code in enumerate(self.codes):
            row, f = code.exceeded(x)
            rows.append(row)
            found.append(f + n * self.k**2)
        row, f = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort([f, row])
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]), f[order]


@lru_cache(16)
def codes(rows: int, dim: int, least_cosine: float) -> Codes:
    """Made anew in each process: a few numbers stand for all codewords."""
    return Codes(rows, dim, least_cosine)


DEALT = "vec_id long, copies long, dim int, vec array<double>, filters array<long>"


def _filters(rows_of: dict[int, int], least_cosine: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                for i in range(0, part.num_rows, 1000):
                    some = part.slice(i, 1000)
                    offsets, found = codes(rows_of[dim], dim, least_cosine).exceeded(unit(some.column("vec")))
                    lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(found.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*some.select(["vec_id", "copies", "dim"]).columns, some.column("vec").cast(kind), lists], names=["vec_id", "copies", "dim", "vec", "filters"])

    return run


def _block(least_cosine: float):
    """Links of one block of a filter: counts where it is the pair's first filter."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, this, first, second = (k.as_py() for k in key)
        ids, weight = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        x = unit(table.column("vec").combine_chunks())
        chunk = table.column("chunk").to_numpy()
        rows, cols = np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)
        near = x[rows] @ x[cols].T >= least_cosine
        if first == second:
            np.fill_diagonal(near, False)
        # Only those that are near any other matter from here on.
        some_r, some_c = near.any(axis=1), near.any(axis=0)
        rows, cols, near = rows[some_r], cols[some_c], near[np.ix_(some_r, some_c)]
        links, least = np.zeros(len(ids), np.int64), ids.copy()
        if len(rows):
            # Pairs that share an earlier filter were counted there.
            lists = table.column("filters").combine_chunks()
            of, flat = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            used = np.zeros(len(ids), bool)
            used[rows] = used[cols] = True
            before = (flat < this) & used[of]
            names, number = np.unique(flat[before], return_inverse=True)
            held = np.zeros((len(ids), len(names)), np.float32)
            held[of[before], number] = 1
            new = near & (held[rows] @ held[cols].T == 0)
            links[rows] += new @ weight[cols]
            if first != second:
                links[cols] += new.T @ weight[rows]
            # Each vector points to the least one it is linked with here, by way of any others.
            big = np.iinfo(np.int64).max
            while True:
                after = least.copy()
                after[cols] = np.minimum(after[cols], np.where(near, least[rows][:, None], big).min(axis=0, initial=big))
                after[rows] = np.minimum(after[rows], np.where(near, least[cols][None, :], big).min(axis=1, initial=big))
                if (after == least).all():
                    break
                least = after
        return pa.table({"vec_id": ids, "links": links, "least": least}).filter(pa.array((links > 0) | (least < ids)))

    return run


def near_vectors(vectors: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``.

    Two rows link if their vectors have the same length and their cosine, in double
    precision, is at least ``least_cosine``; labels play no part. Rows whose vector is
    null, zero, or holds null or non-finite components link with nothing, and so do
    rows without vec_id (component null, kept). Equal vectors link with each other.
    Rows that repeat a vec_id are separate rows that link by their vectors and get the
    sum of their links. Other columns are ignored. No rows give no rows.

    Of two vectors at the limit itself, one pair in ``1 / MISS`` is missed; nearer
    ones are missed less. As ``n_links`` counts every partner, a group of g different
    vectors near each other takes g * g products, in blocks. The driver holds one
    number for each length of vectors.
    """
    fine = clean(vectors)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    # Equal vectors are one, with a weight.
    keyed = staged(fine.withColumn("same", F.sha2(F.array_join(F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)), "vectors")
    firsts = keyed.groupBy("same").agg(F.min(F.struct("vec_id", "vec")).alias("m"), F.count("*").alias("copies")).select("same", "m.vec_id", "m.vec", "copies")
    # Where one id has several vectors, each of them has a number of its own.
    firsts = staged(firsts.select("same", F.xxhash64("same").alias("node"), F.col("vec_id").alias("least_id"), "copies", F.size("vec").alias("dim"), "vec"), "firsts")
    sizes = {r["dim"]: r["n"] for r in firsts.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect()}
    kind = dict(fine.dtypes)["vec"]
    arrow = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())
    asked = firsts.where(F.col("dim").isin(list(sizes))).select(F.col("node").alias("vec_id"), "copies", "dim", "vec")
    dealt = staged(asked.mapInArrow(_filters(sizes, least_cosine, arrow), DEALT.replace("array<double>", kind)), "dealt")
    held = dealt.select("dim", F.explode("filters").alias("f")).groupBy("dim", "f").agg(F.count("*").alias("n")).where("n > 1")
    full = dealt.withColumn("f", F.explode("filters")).join(held, ["dim", "f"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    full = full.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    full = full.select("vec_id", "vec", "copies", "filters", "dim", "f", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    out = staged(full.groupBy("dim", "f", "i", "j").applyInArrow(_block(least_cosine), "vec_id long, links long, least long"), "links")

    counts = out.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))
    per_class = firsts.join(counts, "node", "left").select("same", "node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    per_class = staged(per_class, "classes")
    # Keyed rows with links; a repeated vec_id sums over its rows.
    rows = keyed.select("same", "vec_id").join(per_class, "same")
    per_id = rows.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    # Nodes stand for vectors; their links unite the ids of all rows that have them.
    name = per_class.select("node", F.col("least_id").alias("id"))
    edges = out.where("least != vec_id").select(F.col("vec_id").alias("node"), "least").join(name, "node").select(F.col("id").alias("u"), F.col("least").alias("node")).join(name, "node").select("u", F.col("id").alias("v"))
    groups = components(edges.union(rows.where("vec_id != least_id").select(F.col("vec_id").alias("u"), F.col("least_id").alias("v"))))
    return ids.join(per_id, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
