"""Ranking by vectors: filters, paging, exact neighbours, and what scores a ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.vectors import clamped, dot
from wayfarer.sources.shared import settled

#: A bank of vectors is broadcast only up to so many bytes.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class RankSpec:
    """What to filter, sort and show; unknown sorts and orders mean score, descending."""

    education: str | None = None
    least: tuple[tuple[str, float], ...] = ()
    sort: str = "score"
    order: str = "desc"
    page: int = 1
    page_size: int = 20

    def clean(self, columns: list[str]) -> RankSpec:
        return RankSpec(
            (self.education or "").strip() or None,
            tuple((c, v) for c, v in self.least if v is not None),
            self.sort if self.sort in columns else "score",
            self.order if self.order in ("asc", "desc") else "desc",
            max(1, self.page),
            min(100, max(1, self.page_size)),
        )


def filtered(df: DataFrame, spec: RankSpec) -> DataFrame:
    """Predicates of the parameters that are set; a null fails each of them."""
    if spec.education:
        df = df.where(F.lower("education") == spec.education.lower())
    for column, value in spec.least:
        df = df.where(F.col(column) >= value)
    return df


def ordered(df: DataFrame, spec: RankSpec, key: str) -> list[Column]:
    if spec.sort == "score":
        first = [F.desc_nulls_last("score") if spec.order == "desc" else F.asc_nulls_last("score")]
    else:
        c = F.col(spec.sort)
        first = [c.desc_nulls_last() if spec.order == "desc" else c.asc_nulls_last(), F.desc_nulls_last("score")]
    return [*first, F.asc(key)]


def rank_page(items: DataFrame, user: DataFrame, spec: RankSpec, key: str = "id", vec: str = "vec") -> DataFrame:
    """One row: the page's ``items`` in order of rank, and the ``total`` of all that pass the filters.

    A page past the end has no items and the real total; without a user's vector both
    are empty and 0. The user's side is one row, so the join is a broadcast of that
    row; the page is a top-k over all items and holds 100 at most.
    """
    spec = spec.clean(items.columns)
    one = user.select(F.col(vec).alias("_u")).limit(1)
    fine = filtered(items, spec).crossJoin(F.broadcast(one))
    scored = fine.withColumn("score", clamped(dot(F.col(vec), F.col("_u")))).drop("_u", vec)
    order = ordered(scored, spec, key)
    top = scored.orderBy(*order).offset((spec.page - 1) * spec.page_size).limit(spec.page_size)
    place = F.row_number().over(Window.orderBy(*order))  # over the page's rows alone
    page = top.withColumn("place", place).agg(F.array_sort(F.collect_list(F.struct("place", *scored.columns))).alias("items"))
    return page.crossJoin(F.broadcast(fine.agg(F.count("*").alias("total"))))


def page_items(page: DataFrame) -> DataFrame:
    """The items of a page as rows; one row with nulls beside the total if it has none."""
    return page.select("total", F.explode_outer("items").alias("i")).select("i.*", "total")


def scores_for(items: DataFrame, user: DataFrame, ids: list[int], key: str = "id", vec: str = "vec", most: int = 200) -> DataFrame:
    """Scores of the first ``most`` distinct ids."""
    asked = list(dict.fromkeys(ids))[:most]
    one = user.select(F.col(vec).alias("_u")).limit(1)
    score = clamped(dot(F.col(vec), F.col("_u")))
    return items.where(F.col(key).isin(asked)).crossJoin(F.broadcast(one)).select(key, score.alias("score"))


def like(text: str) -> str | None:
    """The pattern of a search box; % and _ of the text stay wildcards. Blank: none."""
    text = text.strip()
    return f"%{text}%" if text else None


def search(df: DataFrame, text: str, label: str, alternatives: str, boost: bool = True) -> tuple[DataFrame, list[Column]]:
    """Rows whose label or any alternative matches, and their order: label matches first."""
    pattern = like(text)
    if pattern is None:
        return df, [F.asc(label)]
    in_label = F.ilike(F.col(label), F.lit(pattern))
    hit = df.where(in_label | F.exists(alternatives, lambda x: F.ilike(x, F.lit(pattern))))
    return hit, [F.when(F.coalesce(in_label, F.lit(False)), 0).otherwise(1).asc(), F.asc(label)] if boost else [F.asc(label)]


def nearest(queries: DataFrame, bank: DataFrame, k: int, bank_rows: int, most: int = 20_000) -> DataFrame:
    """(query, id, score, rank): exact top k by inner product, ties to the smaller id.

    A bank of up to ``most`` rows (``bank_rows`` is its counted size) and 32 MB is
    broadcast as one matrix and each batch of queries is multiplied with it. A greater
    bank is cut into blocks, and so are the queries; each block of the bank meets each
    block of queries and keeps its own top k of every query before they come together.
    The work is the product of both sides by definition.
    """
    row = bank.select(F.size("vec").alias("n")).first()
    width = max(1, row["n"] if row else 1)
    most = max(1, min(most, BROADCAST_BYTES // (8 * width)))
    blocks = max(1, -(-bank_rows // most))
    turns = 1 if blocks == 1 else max(1, -(-queries.count() // most))
    ask = queries.select("query", F.col("vec").alias("ask")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("t", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int"))
    if blocks == 1:
        rows = bank.orderBy("id").toPandas()
        ids, matrix = rows["id"].to_numpy(), np.array(rows["vec"].tolist(), np.float64).reshape(len(rows), -1)
        held = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            for batch in batches:
                yield from _best(batch.column("query"), batch.column("vec"), ids, matrix, k).to_batches()

        found = queries.select("query", "vec").mapInArrow(run, "query long, id long, score double")
    else:

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            order = left.sort_by("id")
            matrix = _matrix(order.column("vec"))
            return _best(right.column("query").combine_chunks(), right.column("ask").combine_chunks(), order.column("id").to_numpy(), matrix, k)

        spread = bank.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        parts = spread.groupBy("b", "t")
        found = parts.cogroup(ask.groupBy("b", "t")).applyInArrow(block, "query long, id long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


#: Queries and rows of the bank that are multiplied at once; their products stay in a core's cache.
ASKED, AGAINST = 256, 2048
#: Rows of either side whose products are read several times, and for both sides.
MET = 512


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix; null entries are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best and of all that tie with the last of them."""
    if scores.shape[1] <= k:
        return tuple(a.ravel() for a in np.indices(scores.shape))
    last = np.partition(scores, -k, axis=1)[:, -k]
    return np.nonzero(scores >= last[:, None])


def _best(query: pa.Array, vec: pa.Array, ids: np.ndarray, matrix: np.ndarray, k: int) -> pa.Table:
    """The k best of each query, ties to the smaller id; ``ids`` ascend.

    A stretch of the bank after the first is only searched for what reaches a query's
    k-th best so far, so nothing but the products grows with the bank.
    """
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if len(query) and len(ids):
        q, names = _matrix(vec), query.to_numpy()
        for at in range(0, len(q), ASKED):
            asked = q[at : at + ASKED]
            row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            least = np.full(len(asked), -np.inf)
            for a in range(0, len(ids), AGAINST):
                scores = asked @ matrix[a : a + AGAINST].T
                r, c = _top(scores, k) if a == 0 else np.nonzero(scores >= least[:, None])
                if not len(r):
                    continue
                row, col, score = np.append(row, r), np.append(col, c + a), np.append(score, scores[r, c])
                order = np.lexsort([col, -score, row])
                row, col, score = row[order], col[order], score[order]
                first = np.searchsorted(row, np.arange(len(asked)))
                keep = np.arange(len(row)) - first[row] < k
                row, col, score = row[keep], col[keep], score[keep]
                count = np.bincount(row, minlength=len(asked))
                full = np.flatnonzero(count == k)
                least[full] = score[np.cumsum(count)[full] - 1]
            for held, new in zip(out, (names[at + row], ids[col], score), strict=True):
                held.append(new)
    return pa.table([pa.array(np.concatenate(x)) for x in out], names=["query", "id", "score"])


def reciprocal_rank(rank: Column, cutoff: int | None = None) -> Column:
    """1 / rank; 0 for none, and beyond the cutoff where one is set."""
    found = 1.0 / rank
    return F.coalesce(found if cutoff is None else F.when(rank <= cutoff, found), F.lit(0.0))


def recall_at(rank: Column, k: int) -> Column:
    return F.coalesce((rank.between(1, k)).cast("double"), F.lit(0.0))


def ranking_metrics(df: DataFrame, rank: Column, cutoff: int | None, groups: list[str]) -> DataFrame:
    """mrr, r1, r5, r10 and n for each group and (null group) over all, in one pass."""
    made = df.withColumn("_rr", reciprocal_rank(rank, cutoff)).withColumns({f"_{k}": recall_at(rank, k) for k in (1, 5, 10)})
    return made.rollup(*groups).agg(F.avg("_rr").alias("mrr"), F.avg("_1").alias("r1"), F.avg("_5").alias("r5"), F.avg("_10").alias("r10"), F.count("*").alias("n"))


def against_bank(queries: DataFrame, bank: DataFrame, rows: int, temperature: float = 1.0, mask: float | None = None, most: int = 20_000) -> DataFrame:
    """(query, above, ties, loss): each query's true row held against a whole bank.

    ``queries`` has query, vec and own, the id of the true row. ``above`` counts rows
    that score higher, ``ties`` those with the same score and a smaller id, ``loss``
    is the cross-entropy of the true row at a temperature. With ``mask``, rows whose
    inner product with the true one exceeds it don't count as wrong in the loss.

    Blocks of the bank meet blocks of queries and yield one row for each query, so no
    list of scores ever leaves a block.
    """
    blocks, turns = max(1, -(-rows // most)), max(1, -(-queries.count() // most))
    # New names, as both sides may come from one table.
    asked = queries.select("query", F.col("vec").alias("ask"), F.col("own").alias("own"))
    known = asked.join(bank.select(F.col("id").alias("own"), F.col("vec").alias("own_vec")), "own")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "above": [], "ties": [], "top": [], "rest": [], "true": []}
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            matrix, ask, own = _matrix(left.column("vec")), _matrix(right.column("ask")), _matrix(right.column("own_vec"))
            own_id, query = right.column("own").to_numpy(), right.column("query").to_numpy()
            for at in range(0, len(ask), ASKED):
                q, mine, own_ids = ask[at : at + ASKED], own[at : at + ASKED], own_id[at : at + ASKED, None]
                true = (q * mine).sum(axis=1)
                above, ties, top, rest = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), -np.inf), np.zeros(len(q))
                for a in range(0, len(ids), AGAINST):
                    m, some = matrix[a : a + AGAINST], ids[None, a : a + AGAINST]
                    scores, other = q @ m.T, some != own_ids
                    # Sums in another order differ in the last bits; such scores are the same.
                    same = np.isclose(scores, true[:, None], rtol=1e-12, atol=1e-12) & other
                    wrong = other if mask is None else other & (mine @ m.T <= mask)
                    z = np.where(wrong, scores / temperature, -np.inf)
                    new = np.maximum(top, z.max(axis=1))
                    fine = np.where(np.isfinite(new), new, 0.0)
                    above += ((scores > true[:, None]) & other & ~same).sum(axis=1)
                    ties += (same & (some < own_ids)).sum(axis=1)
                    rest = rest * np.exp(top - fine) + np.exp(z - fine[:, None]).sum(axis=1)
                    top = new
                out["query"] += query[at : at + ASKED].tolist()
                out["above"] += above.tolist()
                out["ties"] += ties.tolist()
                out["top"] += np.where(np.isfinite(top), top, 0.0).tolist()
                out["rest"] += rest.tolist()
                out["true"] += (true / temperature).tolist()
        kinds = {"query": pa.int64(), "above": pa.int64(), "ties": pa.int64()}
        return pa.table(out, schema=pa.schema([(c, kinds.get(c, pa.float64())) for c in out]))

    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = bank.select("id", "vec", place("id", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"))
    right = known.select("query", "ask", "own", "own_vec", place("query", turns).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    found = left.groupBy("b", "t").cogroup(right.groupBy("b", "t")).applyInArrow(block, "query long, above long, ties long, top double, rest double, true double")
    return _summed(found, "above", "ties")


def _summed(found: DataFrame, *counts: str) -> DataFrame:
    """(query, counts, loss) of (query, counts, top, rest, true) by block; a block's wrong rows are ``rest`` times exp(``top``)."""
    # The true row counts once beside the wrong ones of all blocks.
    parts = F.collect_list(F.struct("top", "rest"))
    whole = found.groupBy("query").agg(*[F.sum(c).alias(c) for c in counts], F.first("true").alias("true"), F.max("top").alias("most"), parts.alias("parts"))
    high = F.greatest("most", "true")
    total = F.aggregate("parts", F.exp(F.col("true") - high), lambda s, p: s + p["rest"] * F.exp(p["top"] - high))
    return whole.select("query", *counts, (high + F.log(total) - F.col("true")).alias("loss"))


def drawn(bank: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """(draw, rows of ``bank``): ``n`` random rows with replacement, the same ones for a seed.

    ``bank.place`` numbers its rows from 0.
    """
    rows = bank.count()
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8)
    draws = bank.sparkSession.range(n).select(F.col("id").alias("draw"), (F.conv(digest, 16, 10).cast("long") % max(1, rows)).alias("place"))
    return draws.join(bank, "place")


def shuffled(df: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Rows in a random order that is the same for a seed; the first ``n`` of them if asked for."""
    made = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return made if n is None else made.limit(n)


#: Pivots that rows are dealt to at most; beyond that, a pivot's rows are cut further.
PIVOTS = 1024
#: A row is shuffled once for each block that its own meets, so blocks grow with the bank, up to what a task holds.
BLOCKS, LARGEST = 24, 65_536


@dataclass(frozen=True)
class Blocks:
    """Rows (id, vec, b) in blocks, and bounds on the inner products between blocks i <= j."""

    rows: DataFrame
    sizes: np.ndarray
    #: No inner product of rows of blocks i and j is greater.
    most: np.ndarray

    def pairs(self, wanted: np.ndarray) -> DataFrame:
        """Each row in all pairs of blocks (i, j), i <= j, that are wanted and that its own block is in."""
        near = wanted | wanted.T
        lists = [(int(b), np.flatnonzero(row).tolist()) for b, row in enumerate(near)]
        spark = self.rows.sparkSession
        # At most as many numbers as there are pairs of blocks, each of which stands for millions of products.
        found = self.rows.join(spark.createDataFrame(lists, "b int, o array<int>"), "b").withColumn("o", F.explode("o"))
        return found.select("id", "vec", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    @property
    def upper(self) -> np.ndarray:
        return np.triu(np.ones_like(self.most, bool))

    def skipped(self, wanted: np.ndarray) -> float:
        """The share of block pairs that needn't be looked at."""
        return 1 - float((wanted & self.upper).sum()) / max(1, int(self.upper.sum()))


def blocked(bank: DataFrame, most: int) -> Blocks:
    """``bank`` in blocks of about ``most`` rows, or a 24th of it where that is more, that lie near a pivot.

    Pivots are rows of the bank, drawn by a seed. A row goes to the pivot of largest
    cosine; blocks too large are cut by the ids' hash. By the largest angle of a block's
    rows to its pivot and their largest length, the triangle inequality on the sphere
    bounds every inner product between two blocks. Rows whose vector is null take no
    part; vectors are all of one length.
    """
    rows = bank.select("id", "vec").where("vec is not null")
    count = rows.count()
    most = max(most, min(LARGEST, count // BLOCKS))
    pivots = shuffled(rows, "id", 7, min(PIVOTS, max(1, -(-2 * count // most)))).toPandas()["vec"].tolist() or [[0.0]]
    p = np.array(pivots, np.float64).reshape(len(pivots), -1)
    norm = np.linalg.norm(p, axis=1, keepdims=True)
    p = np.divide(p, norm, out=np.zeros_like(p), where=norm > 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            size = np.linalg.norm(x, axis=1)
            cos = (x @ p.T) / np.where(size > 0, size, 1)[:, None]
            at = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(x)), at], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(at.astype(np.int32)), pa.array(angle), pa.array(size)], names=["id", "vec", "p", "angle", "size"])

    kinds = dict(rows.dtypes)
    dealt = settled(rows.mapInArrow(deal, f"id {kinds['id']}, vec {kinds['vec']}, p int, angle double, size double"), "dealt")
    # A few numbers a pivot.
    of = {r["p"]: r for r in dealt.groupBy("p").agg(F.count("*").alias("n")).collect()}
    parts, first = {k: -(-r["n"] // most) for k, r in of.items()}, {}
    for k in sorted(parts):
        first[k] = sum(parts[q] for q in first)
    table = rows.sparkSession.createDataFrame([(k, parts[k], first[k]) for k in sorted(parts)], "p int, parts int, first int")
    b = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    placed = settled(dealt.join(F.broadcast(table), "p").select("id", "vec", b.alias("b"), "p", "angle", "size"), "blocks")
    n = sum(parts.values())
    sizes, pivot, radius, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for r in placed.groupBy("b").agg(F.count("*").alias("n"), F.first("p").alias("p"), F.max("angle").alias("angle"), F.max("size").alias("size")).collect():
        sizes[r["b"]], pivot[r["b"]], radius[r["b"]], longest[r["b"]] = r["n"], r["p"], r["angle"], r["size"]
    between = np.arccos(np.clip(p[pivot] @ p[pivot].T, -1, 1)) - radius[:, None] - radius[None, :]
    # Rounding of angles and products is far below the margin.
    cos = np.cos(np.clip(between - 1e-6, 0, np.pi))
    return Blocks(placed.select("id", "vec", "b"), sizes, np.where(cos > 0, longest[:, None] * longest[None, :] * cos, 0.0) + 1e-9)


def _block_scores(table: pa.Table, first: int, second: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of rows and columns, and their inner products, a stretch at a time; pairs not to be counted are -inf."""
    b = table.column("b").to_numpy()
    matrix, ids = _matrix(table.column("vec")), table.column("id").to_numpy()
    rows, cols = np.flatnonzero(b == first), np.flatnonzero(b == second)
    left, right = matrix[rows], matrix[cols]
    for i in range(0, len(rows), ASKED):
        for j in range(0, len(cols), AGAINST):
            u, v = ids[rows[i : i + ASKED]], ids[cols[j : j + AGAINST]]
            scores = left[i : i + ASKED] @ right[j : j + AGAINST].T
            if first == second:
                scores[u[:, None] >= v[None, :]] = -np.inf
            yield u, v, scores


#: Places in a matrix: (rows, columns), or a matrix of booleans.
Places = tuple[np.ndarray, np.ndarray] | np.ndarray


class _Stretch:
    """Some rows of a block, and after them those of their true rows that aren't among them."""

    def __init__(self, block: np.ndarray, place: np.ndarray, ids: np.ndarray, own: np.ndarray, first: int) -> None:
        at = place[first : first + MET]
        n, last = len(at), first + len(at)
        inside = (at >= first) & (at < last)
        more = np.unique(at[~inside])
        # By eights, so that a row of marks can be searched by eights.
        rows = np.concatenate([np.arange(first, last), more, np.zeros(-(n + len(more)) % 8, np.int64)])
        self.at, self.n, self.matrix, self.ids, self.own = slice(first, last), n, block[rows], ids[first:last], own[first:last]
        self.span = self.own.min(), self.own.max()
        #: Where in the matrix the true row of each lies, and whose true row each of the matrix is.
        self.place = np.where(inside, at - first, n + np.searchsorted(more, at))
        self.count = np.bincount(self.place, minlength=len(rows))
        self.start, self.order = np.cumsum(self.count) - self.count, np.argsort(self.place, kind="stable")

    def not_wrong(self, marks: np.ndarray, true: np.ndarray, other: np.ndarray, t: _Stretch) -> Places:
        """Places of rows here and rows of ``t`` that are their true row or too like it.

        (``true``, ``other``) are those of ``marks``, whose rows are this matrix's; where
        they are many, ``marks`` is read instead.
        """
        row = own = np.zeros(0, np.int64)
        if self.span[0] <= t.ids[-1] and self.span[1] >= t.ids[0]:
            own = np.minimum(np.searchsorted(t.ids, self.own), t.n - 1)
            row = np.flatnonzero(t.ids[own] == self.own)
            own = own[row]
        if len(true) > marks.size // 32:
            found = marks[self.place, : t.n]
            found[row, own] = True
            return found
        n = self.count[true]
        n[other >= t.n] = 0
        end = np.cumsum(n)
        first = np.repeat(self.start[true] - end + n, n)
        return np.append(self.order[first + np.arange(len(first))], row), np.append(np.repeat(other, n), own)


class _Side:
    """A block's rows by id, with the sums over wrong rows: ``rest`` times exp(``top``)."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("id")
        ids, own, far = table.column("id").to_numpy(), table.column("own"), table.column("far")
        asked, away = own.is_valid().to_numpy(), far.is_valid().to_numpy()
        own = pc.coalesce(own, table.column("id")).to_numpy()
        matrix = _matrix(table.column("vec"))
        block = np.concatenate([matrix, _matrix(far.drop_null())]) if away.any() else matrix
        place = np.where(away, len(ids) + np.cumsum(away) - 1, np.searchsorted(ids, own))
        self.ids, self.asked, self.true = ids, asked, np.einsum("ij,ij->i", matrix, block[place])
        self.top, self.rest = np.full(len(ids), -np.inf), np.zeros(len(ids))
        self.longest = np.linalg.norm(block, axis=1).max(initial=0)
        self.stretches = [_Stretch(block, place, ids, own, a) for a in range(0, len(ids), MET)]

    def add(self, at: slice, z: np.ndarray, but: Places, plain: bool) -> None:
        """Add exponentials to the sums of some rows, ``but`` for some places; ``plain``: they are taken already."""
        held = z[but]
        z[but] = 0.0 if plain else -np.inf
        if plain:
            self.rest[at] += z.sum(axis=1)
        else:
            top = np.maximum(self.top[at], z.max(axis=1))
            fine = np.where(np.isfinite(top), top, 0.0)
            self.rest[at] = self.rest[at] * np.exp(self.top[at] - fine) + np.exp(z - fine[:, None]).sum(axis=1)
            self.top[at] = top
        z[but] = held

    def found(self, temperature: float, plain: bool) -> pa.Table:
        true = self.true / temperature
        top = np.zeros(len(true)) if plain else np.where(np.isfinite(self.top), self.top, true)
        return pa.table({"query": self.ids, "top": top, "rest": self.rest, "true": true}).filter(pa.array(self.asked))


#: Exponents up to this need no largest one taken off: neither they nor sums of them leave a double's range.
PLAIN = 600.0


def _masked(left: pa.Table, right: pa.Table | None, temperature: float, mask: float) -> pa.Table:
    """(query, top, rest, true) of two blocks' rows, each against the other block; of one block against itself.

    A product and its exponential serve both rows, and a row that is a query and the
    true one of another in the same stretch is multiplied once.
    """
    one = _Side(left)
    two = one if right is None else _Side(right)
    plain = bool(one.longest * two.longest <= PLAIN * temperature)
    held = np.empty(max((len(s.matrix) for s in one.stretches), default=0) * max((len(t.matrix) for t in two.stretches), default=0))
    for s in one.stretches:
        for t in two.stretches:
            shape = len(s.matrix), len(t.matrix)
            scores = np.matmul(s.matrix, t.matrix.T, out=held[: shape[0] * shape[1]].reshape(shape))
            marks = ~(scores <= mask)
            eights = np.flatnonzero(marks.view(np.int64))
            row, col = np.nonzero(marks.reshape(-1, 8)[eights])
            row, col = np.divmod(eights[row] * 8 + col, shape[1])
            z = scores[: s.n]
            z *= 1 / temperature
            if plain:
                np.exp(z, out=z)
            z = z[:, : t.n]
            one.add(s.at, z, s.not_wrong(marks, row, col, t), plain)
            if right is not None:
                two.add(t.at, z.T, t.not_wrong(marks.T, col, row, s), plain)
    sides = [one] if right is None else [one, two]
    return pa.concat_tables([side.found(temperature, plain) for side in sides])


def masked_losses(rows: DataFrame, temperature: float, mask: float, most: int = 2_000) -> DataFrame:
    """(query, loss): ``against_bank`` with a mask, where the queries are the bank's own rows.

    ``rows`` has id, vec and own, the id of the true row; rows whose own isn't there are
    no queries. A row without a vector is no wrong one, and a query's loss is null if
    its own vector or the true row's is. Blocks of about ``most`` rows, or a 24th of the bank
    where that is more, are ranges of ids, as neighbours are often each other's true
    rows. Each pair of blocks meets once, for the queries of both: the work is half of
    the product of both sides.
    """
    # Rows without an id are nobody's true row, but wrong ones.
    rows, count = rows.withColumn("id", F.coalesce("id", F.lit(-(1 << 63)))), rows.count()
    blocks = max(1, -(-count // max(most, min(LARGEST, count // BLOCKS))))
    cuts = rows.approxQuantile("id", [k / blocks for k in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    block = lambda c: sum([(F.col(c) >= x).cast("int") for x in cuts], F.lit(0))
    owns = rows.select(F.col("id").alias("own"), F.col("vec").alias("own_vec"), F.lit(True).alias("there")).dropDuplicates(["own"])
    known = settled(rows.select("id", "vec", "own").join(owns, "own", "left").withColumn("b", block("id")), "known")
    bare = F.col("vec").isNull() | F.col("own_vec").isNull()
    own, far = F.when(F.col("own_vec").isNotNull(), F.col("own")), F.when(block("own") != F.col("b"), F.col("own_vec"))
    placed = known.where("vec is not null").select("id", "vec", own.alias("own"), far.alias("far"), "b").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = placed.select("id", "vec", "own", "far", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        sides = [table.filter(pc.equal(table.column("b"), b)) for b in (i, j)]
        return _masked(sides[0], None if i == j else sides[1], temperature, mask)

    # Tasks of some seconds, that aren't merged by their bytes, of which their work is the square.
    tasks = min(blocks * (blocks + 1) // 2, max(2 * rows.sparkSession.sparkContext.defaultParallelism, count * count >> 31))
    found = met.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(run, "query long, top double, rest double, true double")
    none = known.where(F.col("there") & bare).select(F.col("id").alias("query"), F.lit(None).cast("double").alias("loss"))
    return _summed(found).unionByName(none)


def similarity_histogram(bank: DataFrame, thresholds: list[float], most: int = 2_000) -> DataFrame:
    """(threshold, n, percent): pairs of different rows above each threshold.

    Rows meet in pairs of bounded blocks, which yield counts and no pairs. Pairs of
    blocks whose bound lies at or below all thresholds are counted and not looked at;
    beyond that the work is quadratic by definition.
    """
    blocks = blocked(bank, most)
    wanted = blocks.upper & (blocks.most > min(thresholds)) if thresholds else blocks.upper & False

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = np.zeros(len(thresholds), np.int64)
        for _, _, scores in _block_scores(table, key[0].as_py(), key[1].as_py()):
            some = scores[scores > min(thresholds)]
            n += [int((some > t).sum()) for t in thresholds]
        return pa.table({"threshold": thresholds, "n": n})

    counts = blocks.pairs(wanted).groupBy("i", "j").applyInArrow(run, "threshold double, n long")
    rows = int(blocks.sizes.sum())
    none = bank.sparkSession.createDataFrame([(t, 0) for t in thresholds], "threshold double, n long")
    found = counts.unionByName(none).groupBy("threshold").agg(F.sum("n").alias("n"))
    return found.withColumn("percent", 100.0 * F.col("n") / F.lit(rows * (rows - 1) // 2)).where(F.lit(rows > 1))


def top_pairs(bank: DataFrame, k: int, most: int = 2_000) -> DataFrame:
    """(u, v, score): the k most similar pairs of different rows, u < v.

    Each pair of blocks keeps k pairs. Blocks are held against themselves first; what
    is then the k-th best score rules out pairs of blocks whose bound lies below it. Of
    the others the work is quadratic by definition.
    """
    blocks = blocked(bank, most)
    own = np.eye(len(blocks.sizes), dtype=bool)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for u, v, scores in _block_scores(table, key[0].as_py(), key[1].as_py()):
            # What lies below the k-th best so far is no answer; of equal scores the ids decide.
            floor = best[-1] if len(best) == k else np.partition(scores.ravel(), -k)[-k] if scores.size > k else -np.inf
            r, c = np.nonzero((scores >= floor) & (scores > -np.inf))
            a, b = np.append(a, np.minimum(u[r], v[c])), np.append(b, np.maximum(u[r], v[c]))
            best = np.append(best, scores[r, c])
            order = np.lexsort([b, a, -best])[:k]
            a, b, best = a[order], b[order], best[order]
        return pa.table({"u": a, "v": b, "score": best})

    best = lambda wanted: settled(blocks.pairs(wanted).groupBy("i", "j").applyInArrow(run, "u long, v long, score double").orderBy(F.desc("score"), "u", "v").limit(k), "pairs")
    first = best(own)
    known = first.agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    reached = blocks.most >= known["s"] if known["n"] == k else np.ones_like(own)
    return first.unionByName(best(blocks.upper & ~own & reached)).orderBy(F.desc("score"), "u", "v").limit(k)
