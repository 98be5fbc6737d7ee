"""Nearest neighbours by inner product: inverted lists, product codes, exact reranking.

Coarse centroids cut the vectors into lists. What a vector lacks from its centroid,
the residual, is stored as its length and one byte for every two dimensions of its
direction, each the number of a trained codeword; so estimates are the finer the
closer a list's vectors lie together. A query visits the lists whose centroids are nearest to it; there
its inner products with all codewords, the asymmetric distance table, add up to
estimates. With each entry goes how far its code lies from its vector, so an estimate
bounds the exact inner product from above: every entry whose bound reaches the query's
last place is replaced by the exact inner product, however many these are.

Equal vectors are one entry, with as many of their least ids as a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import staged
from wayfarer.llm.near_vectors import clean

#: A list holds about so many vectors, up to so many lists; the index is fitted on so
#: many vectors for each list, within these bounds.
LIST_SIZE, LISTS_MOST = 64, 16_384
PER_LIST, SAMPLE_LEAST, SAMPLE_MOST = 4, 16_384, 65_536
#: Lists are visited until this share of the sample's true neighbours is in them.
COVER = 0.96
#: So many of a query's best estimates set the bar that all other bounds are held to.
FIRST = 150
#: Entries and queries of a block, and queries that are searched at the same time.
BLOCK, QUERIES, AT_ONCE = 8192, 8192, 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        centres[some] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0) / count[some, None]
        if len(some) < len(centres):
            centres[count == 0] = x[rng.integers(0, len(x), int((count == 0).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 2048] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def lists_of(rows: int) -> int:
    return min(LISTS_MOST, max(1, rows // LIST_SIZE))


class Index:
    def __init__(self, x: np.ndarray, rows: int, k: int):
        self.centres = kmeans(x, min(len(x), lists_of(rows)))
        lists = nearest(x, self.centres)
        self.parts = np.array_split(np.arange(x.shape[1]), max(1, x.shape[1] // 2))
        rest, _ = self._direction(x - self.centres[lists])
        self.words = [kmeans(rest[:, p], min(256, len(x))) for p in self.parts]
        # How many lists does it take until the sample's neighbours are covered?
        query = np.random.default_rng(77).permutation(len(x))[:256]
        exact = x[query] @ x.T
        exact[np.arange(len(query)), query] = -np.inf
        top = np.argsort(-exact, axis=1)[:, : min(k, max(1, len(x) - 1))]
        order = np.argsort(-(x[query] @ self.centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        needed = np.sort(np.take_along_axis(place, lists[top], 1).ravel())
        self.probes = int(needed[min(len(needed) - 1, int(COVER * len(needed)))]) + 1
        # Lists that lie near each other are searched together.
        self.group = nearest(self.centres, kmeans(self.centres, max(1, -(-rows // BLOCK))))

    @staticmethod
    def _direction(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.linalg.norm(rest, axis=1)
        return rest / np.where(length > 0, length, 1)[:, None], length.astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, residual's length, code, and how far an estimate may be off for a query of norm 1."""
        lists = nearest(x, self.centres)
        rest, length = self._direction(x - self.centres[lists])
        codes = np.stack([nearest(rest[:, p], w) for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)
        coded = np.concatenate([w[c] for w, c in zip(self.words, codes.T, strict=True)], axis=1) * length[:, None].astype(np.float64)
        error = np.linalg.norm(x - self.centres[lists] - coded, axis=1)
        # Estimates are sums in single precision.
        single = (len(self.parts) + 8) * 2.0**-23 * (np.linalg.norm(self.centres[lists], axis=1) + np.linalg.norm(coded, axis=1))
        return lists, length, codes, error + single

    def visits(self, q: np.ndarray) -> np.ndarray:
        near = q @ self.centres.T
        return np.argpartition(-near, self.probes - 1, axis=1)[:, : self.probes]

    def search(self, q: np.ndarray, visits: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, length: np.ndarray, codes: np.ndarray, error: np.ndarray, most: int):
        """(query row, entry row, score) of the ``most`` best visited entries of each query.

        These are exact among the entries of the visited lists; ties go to the smaller id.
        """
        coarse = q @ self.centres.T
        tables = [(q[:, p] @ w.T).astype(np.float32) for p, w in zip(self.parts, self.words, strict=True)]
        found = np.full((len(q), len(lists)), -np.inf, np.float32)
        visited = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(visited, visits, True, 1)
        order = np.argsort(lists, kind="stable")
        in_lists = np.split(order, np.flatnonzero(np.diff(lists[order])) + 1) if len(order) else []
        for at in in_lists:
            rows = np.flatnonzero(visited[:, lists[at[0]]])
            if len(rows):
                total = np.zeros((len(rows), len(at)), np.float32)
                for table, code in zip(tables, codes[at].T, strict=True):
                    total += table[rows][:, code]
                found[rows[:, None], at[None, :]] = total * length[at] + coarse[rows, lists[at[0]]][:, None].astype(np.float32)
        # Exact products of the best estimates set each query's bar.
        norm, keep = np.linalg.norm(q, axis=1), min(max(FIRST, most), len(lists))
        slack = 4 * q.shape[1] * 2.0**-52 * norm * np.linalg.norm(x, axis=1).max(initial=0)
        first = np.argpartition(-found, keep - 1, axis=1)[:, :keep]
        bar = np.full(len(q), -np.inf)
        for r in range(len(q)):
            real = first[r][found[r, first[r]] > -np.inf]
            if len(real) >= most:
                bar[r] = np.partition(x[real] @ q[r], -most)[-most] - slack[r]
        # All entries whose bound reaches the bar, list by list; the bar rises on the way.
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
        held = np.zeros(len(q), np.int64)

        def reduce(r: int) -> None:
            at, value = (np.concatenate(c) for c in zip(*best[r], strict=True))
            if len(at) > most:
                bar[r] = max(bar[r], np.partition(value, -most)[-most] - slack[r])
                at, value = at[value >= bar[r]], value[value >= bar[r]]
            best[r], held[r] = [(at, value)], len(at)

        for at in in_lists:
            rows = np.flatnonzero(visited[:, lists[at[0]]])
            may = found[rows[:, None], at[None, :]] + norm[rows][:, None] * error[at][None, :] >= bar[rows][:, None]
            rows, may = rows[may.any(axis=1)], may[may.any(axis=1)]
            if not len(rows):
                continue
            some = np.flatnonzero(may.any(axis=0))
            exact = q[rows] @ x[at[some]].T
            for r, m, value in zip(rows, may[:, some], exact, strict=True):
                m &= value >= bar[r]
                if m.any():
                    best[r].append((at[some[m]], value[m]))
                    held[r] += int(m.sum())
                    if held[r] > 8 * most + len(best[r][0][0]):
                        reduce(r)
        out_row, out_at, out_score = [], [], []
        for r in range(len(q)):
            if not best[r]:
                continue
            reduce(r)
            at = best[r][0][0]
            score = np.zeros(len(at))
            for i in range(q.shape[1]):  # one after another, so that equal vectors' scores are equal in every block
                score += x[at, i] * q[r, i]
            top = np.lexsort([ids[at], -score])[:most]
            out_row.append(np.full(len(top), r))
            out_at.append(at[top])
            out_score.append(score[top])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(out_row or none), np.concatenate(out_at or none), np.concatenate(out_score or [np.zeros(0)])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _encode(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists, length, codes, error = index.value.encode(_matrix(batch.column("vec")))
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                columns = [batch.column("cid"), batch.column("least"), batch.column("vec"), pa.array(lists), pa.array(index.value.group[lists]), pa.array(length), code, pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "least", "vec", "list", "g", "length", "code", "error"])

    return run


def _visit(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                visits = index.value.visits(_matrix(batch.column("vec")))
                groups = pa.array([np.unique(index.value.group[v]) for v in visits], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("cid"), groups], names=["cid", "groups"])

    return run


def _search(index, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        q, ids, least = _matrix(right.column("vec")), left.column("cid").to_numpy(), left.column("least").to_numpy()
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        lists, length, error = (left.column(c).to_numpy() for c in ("list", "length", "error"))
        x, asked, found = _matrix(left.column("vec")), right.column("cid").to_numpy(), []
        for i in range(0, len(q), AT_ONCE):
            part = q[i : i + AT_ONCE]
            row, entry, score = index.value.search(part, index.value.visits(part), x, least, lists, length, codes, error, most)
            found.append(pa.table({"query": asked[i + row], "cid": ids[entry], "least": least[entry], "score": score}))
        return pa.concat_tables(found)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right)

    return block


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query, nearest first.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows
    but the query's own. Nearness is the inner product in double precision, ties go
    to the smaller vec_id; with fewer candidates all are returned. Rows without
    vec_id, and those whose vector is null, zero, of another length than most, or
    holds null or non-finite components, take no part. Rows that repeat a vec_id
    count once for each different vector, as queries too. Other columns are ignored.

    Lists grow in number up to ``LISTS_MOST``, so beyond a million rows each list, and
    a query's work, grows with the table. The driver holds the sample that the index
    is fitted on, ``SAMPLE_MOST`` vectors at most.
    """
    spark = vectors.sparkSession
    fine = clean(vectors)
    sizes = fine.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    same = F.sha2(F.array_join(F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    keyed = staged(fine.where(F.size("vec") == sizes["dim"]).withColumn("same", same), "vectors").dropDuplicates(["vec_id", "same"])
    # A query's own id may have several vectors, as many places are left out of its result.
    own = keyed.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    most = k + own
    # A result needs no more than the k + 1 least ids of equal vectors.
    by_id = Window.partitionBy("same").orderBy("vec_id")
    few = keyed.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    classes = few.groupBy("same").agg(F.min("vec_id").alias("cid"), F.min_by("vec", "vec_id").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # Where one id has several vectors, each of them gets a number of its own.
    classes = staged(classes.withColumn("cid", F.xxhash64("same")), "classes")
    rows = classes.count()
    sample = min(SAMPLE_MOST, max(SAMPLE_LEAST, PER_LIST * lists_of(rows)))
    fitted = np.stack(classes.orderBy(F.xxhash64("cid"), "same").limit(sample).select("vec").toPandas()["vec"]).astype(np.float64)
    index = spark.sparkContext.broadcast(Index(fitted, rows, k))

    asked = keyed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("same").alias("query"))
    asking = classes.join(asked.select(F.col("query").alias("cid")).distinct(), "cid", "left_semi").select("cid", "vec")
    kind = dict(classes.dtypes)["vec"]
    coded = classes.select("cid", F.col("ids")[0].alias("least"), "vec").mapInArrow(_encode(index), f"cid long, least long, vec {kind}, list long, g long, length float, code binary, error double")
    coded = staged(coded, "codes")
    going = asking.mapInArrow(_visit(index), "cid long, groups array<long>").select("cid", F.explode("groups").alias("g")).join(asking, "cid")
    going = staged(going, "visits")
    # Groups are cut into blocks of entries and of queries; each meets each.
    entries = coded.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    visits = going.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
    plan = entries.join(visits, "g")
    part = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    left = coded.join(plan, "g").withColumn("b", part("blocks")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = going.join(plan, "g").withColumn("t", part("turns")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = left.select("g", "b", "t", "cid", "least", "vec", "list", "length", "code", "error").groupBy("g", "b", "t").cogroup(right.select("g", "b", "t", "cid", "vec").groupBy("g", "b", "t"))
    near = near.applyInArrow(_search(index, most), "query long, cid long, least long, score double")
    # An entry behind ``most`` others, by score and least id, has no id among the best ``most``.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    near = staged(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("query", "cid", "score"), "near")

    scored = near.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    mine = asked.join(lists, "query").withColumn("top", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k))
    return mine.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
