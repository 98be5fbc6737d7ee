"""Best-fit packing of documents into sequences, planned on lengths alone.

Documents become pieces of at most one sequence each. Only the counts of each length
go to the driver: at most as many numbers as a sequence has tokens, however many
documents there are. Best fit over these counts, longest first, yields slots for each
length; then each piece takes the slot of its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import staged, texts
from wayfarer.llm.encoding import encoder


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first one takes the remainder."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, seen = encoder(vocabulary, spaced=True), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for part in code.encode(batch.column("text")):
                rows = []
                for x in part:
                    doc_id = next(ids)
                    plain = np.append(x, np.uint32(end_id)).astype("<u4").tobytes()
                    for piece, (start, n) in enumerate(cut_points(len(plain) // 4, capacity)):
                        rows.append((doc_id, piece, start, n, zlib.crc32(plain[4 * start : 4 * (start + n)]), task, seen[n]))
                        seen[n] += 1
                names, kinds = zip(*(c.split() for c in PIECES.split(", ")), strict=True)
                arrays = [pa.array(c, {"long": pa.int64(), "int": pa.int32()}[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    return run


class Plan:
    """For each length, ranges of ranks and the sequences that they fill."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges (first sequence, how many)
        sizes: list[int] = []

        def put(free: int, first: int, n: int) -> None:
            if n and free:
                if free not in room:
                    room[free] = []
                    insort(sizes, free)
                room[free].append((first, n))

        for length in sorted(counts, reverse=True):
            left, slots = counts[length], []
            while left:
                at = bisect_left(sizes, length)
                if at < len(sizes):
                    free = sizes[at]
                    first, n = room[free].pop()
                    if not room[free]:
                        del room[free], sizes[at]
                else:
                    free, first = capacity, self.sequences
                    n = -(-left // (capacity // length))
                    self.sequences += n
                each = free // length
                full = min(n, left // each)
                if full:
                    slots.append((counts[length] - left, first, each, capacity - free))
                    left -= full * each
                    put(free - each * length, first, full)
                if full < n and left:
                    slots.append((counts[length] - left, first + full, left, capacity - free))
                    put(free - left * length, first + full, 1)
                    left, full = 0, full + 1
                put(free, first + full, n - full)
            self.slots[length] = slots

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            here = np.flatnonzero(length == n)
            lo, first, each, used = np.array(self.slots[int(n)]).T
            slot = np.searchsorted(lo, rank[here], "right") - 1
            ahead = rank[here] - lo[slot]
            sequence[here] = first[slot] + ahead // each[slot]
            offset[here] = used[slot] + ahead % each[slot] * n
        return sequence, offset


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                rest = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end_id``. Those over ``capacity`` are cut into
    full pieces behind a first one that takes the remainder; the others stay whole.
    Null and empty texts are just the end id. Rows with null or repeated ids are
    packed like all others. Other columns are ignored. No rows give no pieces.
    """
    pieces = staged(texts(docs).mapInArrow(_pieces(vocabulary, end_id, capacity), PIECES), "pieces")
    by_task = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The counts by length and task grow with the tasks, so they are never broadcast.
    ranked = pieces.join(base.hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
