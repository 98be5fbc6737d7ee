"""Approximate search of vectors under filters, by walks through graphs of near vectors.

Rows are dealt to shards of bounded size, and each shard gets a graph: every row is
linked with near rows that lie in different directions, and with a few random ones, so
that a greedy walk gets near any target in few steps. A search walks each shard's graph
for all its queries at once and merges the shards' answers.

A filter is tested during the walk: rows that fail it are walked through but are no
answers, and the walk goes on until as many answers as asked for are found and nothing
nearer is left to look at. Where few rows of a shard pass, a walk would see most of the
shard, so these rows are compared one by one. So a filter never returns fewer rows than
asked for, unless fewer pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.sources.shared import settled

#: Rows of a shard.
SHARD = 16_384
#: Links of a row to near rows, those looked at for them, and links to random rows.
LINKS, LOOKED_AT, FAR = 24, 96, 4
#: Queries that meet a shard in one task, and those that walk at once.
QUERIES, WALKERS = 2048, 256
#: Queries of a task that are tried against all rows of its shard, and the share of right answers that they need.
TRIED, RECALL = 64, 0.95


def _units(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of length 1; null vectors and ones that can't be compared are zero rows."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    out[~np.isfinite(out).all(axis=1)] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def linked(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbours of each row (padded with the row itself), near ones first.

    Of a row's nearest rows, nearest first, one is linked unless an already linked one
    is nearer to it than the row is. What is left of the places goes to links back, so
    that rows that are nobody's nearest are reached too, and to random rows.
    """
    n = len(x)
    out = np.repeat(np.arange(n)[:, None], LINKS + LINKS + FAR, axis=1)
    most = min(LOOKED_AT, n - 1)
    if most <= 0:
        return out
    for a in range(0, n, 512):
        scores = x[a : a + 512] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        near = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, 1), axis=1, kind="stable"), 1)
        own = np.take_along_axis(scores, near, 1)
        among = x[near] @ x[near].transpose(0, 2, 1)
        taken, count = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
        for k in range(most):
            # Equal rows hide each other as well; the first of them is linked.
            hidden = (taken & (among[:, k] > own[:, k, None])).any(axis=1)
            take = ~hidden & (count < LINKS)
            taken[:, k] = take
            count += take
        for r in range(len(near)):
            found = near[r][taken[r]]
            out[a + r, : len(found)] = found
    # Links back, the first places of each row first.
    column = np.tile(np.arange(LINKS), n)
    source, target = np.repeat(np.arange(n), LINKS), out[:, :LINKS].ravel()
    fine = source != target
    order = np.lexsort([column[fine], target[fine]])
    source, target = source[fine][order], target[fine][order]
    first = np.searchsorted(target, np.arange(n))
    place = np.arange(len(target)) - first[target]
    some = place < LINKS
    out[target[some], LINKS + place[some]] = source[some]
    out[:, -FAR:] = np.random.default_rng(seed).integers(0, n, (n, FAR))
    return out


def walked(x: np.ndarray, links: np.ndarray, fine: np.ndarray, asked: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, scores, seen) of the ``k`` best rows that pass, found by walks of ``width``.

    All queries walk at once. Rows are -1 where fewer were found; ``seen`` counts the
    rows a query was compared with.
    """
    q, n = len(asked), len(x)
    passing = np.flatnonzero(fine)
    if len(passing) <= max(4 * width, n // 4):
        scores = asked @ x[passing].T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.full((q, k), -1)
        best = np.full((q, k), -np.inf)
        rows[:, : order.shape[1]] = passing[order]
        best[:, : order.shape[1]] = np.take_along_axis(scores, order, 1)
        return rows, best, np.full(q, len(passing))
    width = max(width, k)
    entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    # Rows to walk on from (a row leaves when it was), and answers.
    room = 2 * width
    front_row, front = np.tile(entry, (q, 1)), asked @ x[entry].T
    ok = fine[front_row]
    top_row, top = np.where(ok, front_row, -1), np.where(ok, front, -np.inf)
    live = np.arange(q)
    while len(live):
        best = front[live].argmax(axis=1)
        here = front[live, best]
        worst = np.sort(top[live], axis=1)[:, -width] if top.shape[1] >= width else np.full(len(live), -np.inf)
        going = np.isfinite(here) & (here >= worst)
        live, best = live[going], best[going]
        if not len(live):
            break
        at = front_row[live, best]
        front[live, best] = -np.inf
        near = links[at]
        new = ~seen[live[:, None], near]
        # A row may stand twice among the links.
        order = np.argsort(near, axis=1, kind="stable")
        twice = np.zeros_like(new)
        ordered = np.take_along_axis(near, order, 1)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        new &= ~twice
        seen[live[:, None], near] = True
        scores = np.where(new, np.einsum("qd,qld->ql", asked[live], x[near]), -np.inf)
        both, both_row = np.concatenate([front[live], scores], axis=1), np.concatenate([front_row[live], near], axis=1)
        hit = np.where(fine[near], scores, -np.inf)
        tops, tops_row = np.concatenate([top[live], hit], axis=1), np.concatenate([top_row[live], np.where(np.isfinite(hit), near, -1)], axis=1)
        if top.shape[1] < width or front.shape[1] < room:
            grown = lambda a, m, fill: np.concatenate([a, np.full((q, m - a.shape[1]), fill)], axis=1) if a.shape[1] < m else a
            front, front_row, top, top_row = grown(front, room, -np.inf), grown(front_row, room, 0), grown(top, width, -np.inf), grown(top_row, width, -1)
        # The walk's front keeps all rows that may still matter under a filter that few pass.
        if np.isfinite(both).sum(axis=1).max() > front.shape[1]:
            front, front_row = np.concatenate([front, np.full(front.shape, -np.inf)], axis=1), np.concatenate([front_row, np.zeros_like(front_row)], axis=1)
        for kept, kept_row, a, b in ((front, front_row, both, both_row), (top, top_row, tops, tops_row)):
            m = min(kept.shape[1], a.shape[1])
            order = np.argpartition(-a, m - 1, axis=1)[:, :m]
            kept[live[:, None], np.arange(m)] = np.take_along_axis(a, order, 1)
            kept_row[live[:, None], np.arange(m)] = np.take_along_axis(b, order, 1)
            kept[live, m:] = -np.inf
    order = np.argsort(-top, axis=1, kind="stable")[:, :k]
    rows, best = np.take_along_axis(top_row, order, 1), np.take_along_axis(top, order, 1)
    if rows.shape[1] < k:
        rows, best = (np.concatenate([a, np.full((q, k - a.shape[1]), fill)], axis=1) for a, fill in ((rows, -1), (best, -np.inf)))
    return np.where(np.isfinite(best), rows, -1), best, seen.sum(axis=1)


def wide_enough(x: np.ndarray, links: np.ndarray, fine: np.ndarray, asked: np.ndarray, k: int, width: int) -> int:
    """``width``, if walks find ``RECALL`` of what some of the queries should; else one at which rows are compared one by one.

    The queries tried are ``TRIED`` at most and are compared with all rows that pass.
    """
    passing = np.flatnonzero(fine)
    tried = asked[np.unique(np.linspace(0, len(asked) - 1, min(len(asked), TRIED)).astype(np.int64))]
    width = max(width, k)
    if len(passing) <= max(4 * width, len(x) // 4):
        return width
    last = np.partition(tried @ x[passing].T, -k, axis=1)[:, -k]
    found = (walked(x, links, fine, tried, k, width)[1] >= last[:, None] - 1e-9).mean()
    return width if found >= RECALL else len(x)


@dataclass(frozen=True)
class GraphIndex:
    """One row for each id: shard, unit (its vector of length 1), links (ids), and all other columns in ``about``."""

    rows: DataFrame
    shards: int
    width: int
    size: int


def build(bank: DataFrame, key: str = "id", vec: str = "vec", most: int = SHARD) -> GraphIndex:
    """Graphs over all rows of ``bank``, written to the shared folder.

    Rows whose vector is null, zero, not finite or of another length than the longest
    are left out, as no cosine can be told; so are rows without an id, and of rows that
    share one an arbitrary one counts. A shard holds about ``most`` rows and is
    built in one task; what the other columns hold is kept for filters.
    """
    count = bank.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("width")).first()
    size, width = count["n"], max(count["width"] or 0, 1)
    shards = max(1, -(-size // most))
    about = F.struct(*[F.col(c) for c in bank.columns if c != vec])
    dealt = bank.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"), about.alias("about"))
    rows = settled(dealt, "graph-rows")
    kind = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("unit", pa.list_(pa.float32())), ("links", pa.list_(pa.int64()))])

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _units(table.column("vec"), width)
        some = x.any(axis=1)
        ids, x = table.column("id").to_numpy()[some], x[some].astype(np.float32)
        links = ids[linked(x.astype(np.float64))] if len(ids) else np.zeros((0, 1), np.int64)
        return pa.table([pa.array(np.full(len(ids), table.column("shard")[0].as_py(), np.int32)), pa.array(ids), pa.array(list(x), kind.field("unit").type), pa.array(list(links), kind.field("links").type)], schema=kind)

    made = rows.select("shard", "id", "vec").where(F.col("id").isNotNull()).dropDuplicates(["id"]).groupBy("shard").applyInArrow(graph, "shard int, id long, unit array<float>, links array<long>")
    one = rows.dropDuplicates(["id"]).select("id", "about")
    return GraphIndex(settled(made.join(one, "id"), "graph"), shards, width, size)


FOUND = "query long, id long, score double, seen long"


def search(index: GraphIndex, queries: DataFrame, k: int, where: Column | None = None, width: int = 48, itself: bool = True) -> DataFrame:
    """(query, id, score, rank, seen): about the k rows of largest cosine that pass ``where``.

    ``queries`` has query and vec; ``where`` is a predicate over the bank's columns but
    the vector, which a null fails. ``width`` is how many answers a walk keeps at
    least: more find more and see more, and where some tried queries find too little in a
    shard, its rows are compared one by one. ``seen`` counts the rows of all shards a query was compared
    with. Without ``itself``, the row whose id is the query's is no answer. Queries
    whose vector is null, zero or of another length find nothing.
    """
    turns = max(1, -(-queries.count() // QUERIES))
    ask = queries.select(F.col("query").cast("long").alias("query"), F.col("vec").alias("ask"), F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int").alias("t"))
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    # The bank's columns, whatever their names, are told apart from the index's own.
    bank = index.rows.select(F.struct("shard", "id", "unit", "links").alias("_row"), "about.*")
    bank = bank.select("_row.*", (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("fine"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"))
    size, more = index.width, 0 if itself else 1

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            ids = left.column("id").to_numpy()
            x = left.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
            links = np.searchsorted(ids, left.column("links").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
            fine = left.column("fine").to_numpy()
            asked, names = _units(right.column("ask"), size), right.column("query").to_numpy()
            some = asked.any(axis=1)
            asked, names = asked[some], names[some]
            wide = wide_enough(x, links, fine, asked, k + more, width) if len(names) else width
            for a in range(0, len(names), WALKERS):
                rows, scores, seen = walked(x, links, fine, asked[a : a + WALKERS], k + more, wide)
                q, c = np.nonzero(rows >= 0)
                for held, new in zip(out, (names[a + q], ids[rows[q, c]], scores[q, c], seen[q]), strict=True):
                    held.extend(new.tolist())
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)], names=["query", "id", "score", "seen"])

    found = bank.groupBy("shard", "t").cogroup(ask.groupBy("shard", "t")).applyInArrow(walk, FOUND)
    if not itself:
        found = found.where("query != id")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Each answer tells what its shard saw; answers of all shards are few.
    seen = found.select("query", F.pmod(F.xxhash64("id"), F.lit(index.shards)).alias("s"), "seen").groupBy("query", "s").agg(F.max("seen").alias("n")).groupBy("query").agg(F.sum("n").alias("seen"))
    return top.drop("seen").join(seen, "query").select("query", "id", "score", "rank", "seen")
