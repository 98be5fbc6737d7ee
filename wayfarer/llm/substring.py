"""Removal of long word passages that an earlier document has, through FM-indexes.

1. Documents with the same words in the same order (by SHA-256) are one class; its
   smallest id stands for it and only that one goes on.
2. Each window of 50 words has an anchor: the least hash of the 8-word runs in it,
   which depends on nothing but the window's words. Windows whose anchor is in one
   document only can't repeat. Consecutive windows with one anchor are a segment.
3. Equal segments (by a 128-bit digest of their words) are one, under their smallest
   document. The others of an anchor may have anything from 8 words on in common.
4. Segments are sharded by anchor, so equal windows always meet. A shard's lower half
   by document and its upper half get a compressed FM-index each. Segments stream
   through it backwards, the upper ones through both, which gives the matching
   statistics at each word. Where they reach 50, the match's interval in suffix order
   names the smallest indexed document that has that very window.
5. An anchor with more words than a shard may have is split by its windows' hashes,
   after those windows that one segment has alone were set aside.
6. The intervals go back to the segments, from there to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import staged, texts
from wayfarer.llm.fm_index import FmIndex
from wayfarer.llm.words import Words, sliding_hash, word_chunks

GRAM = 8
#: Words of a shard on average. An anchor with more of them is split.
SHARD_WORDS = 200_000
#: A run that very many segments have meets its first document in so many groups.
RUN_SALTS = 64


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    m, have = x, 1
    while 2 * have <= n:
        m, have = np.minimum(m[: len(m) - have], m[have:]), 2 * have
    return np.minimum(m[: len(x) - n + 1], m[n - have :][: len(x) - n + 1])


def window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window that starts at each word (none for short texts)."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    gram = min(GRAM, window)
    return _sliding_min(sliding_hash(hashes, gram), window - gram + 1).view(np.int64)


def _digests(texts_: list[bytes]) -> list[np.ndarray]:
    """128 bits of each text, as two columns."""
    return list(np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts_), np.int64).reshape(-1, 2).T)


def _lists(values: np.ndarray, lengths: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values))


def _sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


READ = "doc_id long, text_id long, n_words long, sha256 string, anchors array<long>"


def _read(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column("text")):
                hashes, sha, anchors = words.hashes(), [], []
                for k in range(j - i):
                    at, to = words.first[k], words.first[k + 1]
                    sha.append(_sha256(words.text(at, to)))
                    anchors.append(np.unique(window_anchors(hashes[at:to], window)))
                flat = np.concatenate(anchors) if anchors else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["doc_id", "text_id"]).slice(i, j - i).columns, pa.array(np.diff(words.first)), pa.array(sha, pa.string()), _lists(flat, [len(x) for x in anchors])],
                    names=["doc_id", "text_id", "n_words", "sha256", "anchors"],
                )

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


SEGMENTS = "doc_id long, text_id long, at long, n long, anchor long, seg_a long, seg_b long"


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, bounds = _numbers(batch.column("anchors"))
            for i, j, words in word_chunks(batch.column("text")):
                hashes, found = words.hashes(), []
                for k in range(j - i):
                    base = words.first[k]
                    anchor = window_anchors(hashes[base : words.first[k + 1]], window)
                    edge = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
                    keep = np.isin(anchor[edge[:-1]], repeated[bounds[i + k] : bounds[i + k + 1]])
                    at, to = edge[:-1][keep], edge[1:][keep]
                    found.append((np.full(len(at), i + k), at, to - at, anchor[at], base + at))
                row, at, n, anchor, start = (np.concatenate(x) for x in zip(*found, strict=True))
                a, b = _digests([words.text(x, y) for x, y in zip(start, start + n + window - 1, strict=True)])
                ids = batch.select(["doc_id", "text_id"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*ids.columns, *map(pa.array, (at, n, anchor, a, b))], names=["doc_id", "text_id", "at", "n", "anchor", "seg_a", "seg_b"])

    return run


CUT = "anchor long, seg_a long, seg_b long, doc_id long, hot boolean, windows array<long>, text binary"


def _cut(window: int):
    """The text of chosen segments, and for hot anchors a hash of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for i, j, words in word_chunks(batch.column("text")):
                hashes, rows, windows = words.hashes(), [], []
                for k in range(j - i):
                    for x in wanted[i + k]:
                        start = words.first[k] + x["at"]
                        end = start + x["n"] + window - 1
                        windows.append(sliding_hash(hashes[start:end], window).view(np.int64) if x["hot"] else np.zeros(0, np.int64))
                        rows.append((x["anchor"], x["seg_a"], x["seg_b"], i + k, x["hot"], words.text(start, end)))
                if rows:
                    anchor, a, b, row, hot, text = zip(*rows, strict=True)
                    ids = batch.column("doc_id").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (anchor, a, b)), ids, pa.array(hot), _lists(np.concatenate(windows), [len(x) for x in windows]), pa.array(text, pa.binary())],
                        names=[c.split()[0] for c in CUT.split(", ")],
                    )

    return run


RUNS = "anchor long, part int, seg_a long, seg_b long, doc_id long, skip long, n long, run_a long, run_b long, text binary"


def _runs(window: int):
    """Stretches of consecutive repeated windows of one part, cut out of their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist()
            for i, j, words in word_chunks(batch.column("text")):
                rows = []
                for k in range(j - i):
                    p = np.sort(np.array(places[i + k], np.int64))
                    for stretch in np.split(p, np.flatnonzero(np.diff(p) > 1) + 1):
                        start = words.first[k] + stretch[0]
                        rows.append((i + k, stretch[0], len(stretch), words.text(start, start + len(stretch) + window - 1)))
                row, skip, n, text = zip(*rows, strict=True)
                ids = batch.select(["anchor", "part", "seg_a", "seg_b", "doc_id"]).take(pa.array(row))
                columns = [*ids.columns, pa.array(skip, pa.int64()), pa.array(n, pa.int64()), *map(pa.array, _digests(text)), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RUNS.split(", ")])

    return run


EARLIER = "anchor long, part int, run_a long, run_b long, place long, n long"


def earlier_windows(doc: np.ndarray, values: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Which windows of these sequences, by their first word, an earlier document has.

    ``doc`` is each sequence's document, in ascending order. The lower half is
    indexed and all sequences are streamed through it; then the upper half is, for
    what the lower one doesn't have.
    """
    ends = np.cumsum(lengths)
    middle = doc[min(int(np.searchsorted(ends, ends[-1] // 2)), len(doc) - 1)]
    low = int(np.searchsorted(doc, middle, "right"))
    owner = np.full(len(values), np.iinfo(np.int64).max)
    for first, last in ((0, low), (low, len(doc))):
        if first < last:
            a, b = int(ends[first] - lengths[first]), int(ends[last - 1])
            index = FmIndex(values[a:b], lengths[first:last], window)
            size, where = index.matching_statistics(values[a:], lengths[first:])
            found = np.where(size >= window, index.least(doc[first:last])[where], np.iinfo(np.int64).max)
            owner[a:] = np.minimum(owner[a:], found)
    return owner < np.repeat(doc, lengths)


def _earlier(window: int):
    """One shard: ranges of windows that an earlier document of the shard has."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("run_a", "ascending"), ("run_b", "ascending")])
        words = [x.split(b" ") for x in table.column("text").to_pylist()]
        lengths = np.array([len(x) for x in words])
        number: dict[bytes, int] = {}
        values = np.array([number.setdefault(w, len(number) + 1) for x in words for w in x])
        del words
        hit = earlier_windows(table.column("doc_id").to_numpy(), values, lengths, window)
        of = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(hit)
        heads = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(of[at], prepend=-1) != 0)) if len(at) else at
        first = at[heads]
        n = np.diff(np.append(heads, len(at)))
        keys = table.select(["anchor", "part", "run_a", "run_b"]).take(pa.array(of[first]))
        return pa.table([*keys.columns, pa.array(first - (np.cumsum(lengths) - lengths)[of[first]]), pa.array(n, pa.int64())], names=[x.split()[0] for x in EARLIER.split(", ")])

    def shard(table: pa.Table) -> pa.Table:
        return run(table)

    return shard


def _own_hits(segments: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row for each segment of its first document that has earlier windows, with all of these.

    A segment's ranges meet in an array before the join, so however many ranges it has
    and however often its document repeats it, the join makes no more rows than it reads.
    """
    key = ["anchor", "seg_a", "seg_b", "doc_id"]
    ranges = earlier.groupBy(key).agg(F.collect_list(F.struct("from", "n")).alias("ranges"))
    moved = F.transform("ranges", lambda r: F.struct((F.col("at") + r["from"]).alias("at"), r["n"].alias("n")))
    return segments.drop("n").join(ranges, key).select("doc_id", "text_id", moved.alias("hits"))


SPANS = "doc_id long, text_id long, n_removed long, sha256 string, spans array<struct<start:long,end:long>>"


def _covered(hits: list, window: int, n: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows that start in any of (first, count)."""
    out: list[tuple[int, int]] = []
    for at, count in sorted((h["at"], h["n"]) for h in hits):
        start, end = at, min(n, at + count + window - 1)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _kept(words: Words, first: int, last: int, spans: list) -> bytes:
    parts, at = [], first
    for s, e in spans:
        parts.append(words.text(at, first + s))
        at = first + e
    parts.append(words.text(at, last))
    return b" ".join(x for x in parts if x)


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits").to_pylist()
            for i, j, words in word_chunks(batch.column("text")):
                spans, sha = [], []
                for k in range(j - i):
                    first, last = words.first[k], words.first[k + 1]
                    spans.append(_covered(hits[i + k], window, int(last - first)))
                    sha.append(_sha256(_kept(words, first, last, spans[-1])))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.select(["doc_id", "text_id"]).slice(i, j - i).columns,
                        pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                        pa.array(sha, pa.string()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "text_id", "n_removed", "sha256", "spans"],
                )

    return run


def _with_text_id(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_id", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text_id, n_words, n_removed, kept_sha256 and spans, one row for each row.

    ``spans`` are the word ranges [start, end) covered by a window of ``window``
    consecutive words that also starts in a document with a smaller doc_id;
    kept_sha256 is the digest of the other words joined by one space.

    Null, empty and blank texts have no words; texts of fewer words than a window
    lose none. A row with a null doc_id neither loses words nor takes any from
    others. Repeated rows get the same result each. Rows that share an id but not a
    text are told apart by ``text_id``, and take nothing from each other. Columns
    other than doc_id and text are ignored. No rows give no rows.
    """
    plain = _with_text_id(docs)
    read = staged(plain.mapInArrow(_read(window), READ), "read")
    able = read.where(f"n_words >= {window} and doc_id is not null")
    classes = able.groupBy("sha256").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_id")).alias("rep"), F.max("doc_id").alias("most"))
    reps = able.join(classes.select("sha256", "rep.doc_id", "rep.text_id"), ["sha256", "doc_id", "text_id"], "left_semi").select("doc_id", "text_id", "anchors").dropDuplicates(["doc_id", "text_id"])
    whole = able.join(classes.where("least < most"), "sha256").where("doc_id > least").select("doc_id", "text_id", F.col("n_words").alias("gone")).distinct()

    dealt = reps.select("doc_id", "text_id", F.explode("anchors").alias("anchor"))
    shared = dealt.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    wanted = dealt.join(shared, "anchor").groupBy("doc_id", "text_id").agg(F.collect_list("anchor").alias("anchors"))
    held = staged(plain.join(wanted, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"]), "held")

    segments = staged(held.mapInArrow(_segments(window), SEGMENTS), "segments")
    key = ["anchor", "seg_a", "seg_b"]
    firsts = staged(segments.groupBy(key).agg(F.min(F.struct("doc_id", "text_id", "at", "n")).alias("o")).select(*key, "o.*"), "firsts")
    # Anchors whose distinct segments are all of one document repeat nothing more.
    open_ = firsts.groupBy("anchor").agg(F.sum(F.col("n") + (window - 1)).alias("words"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    open_ = open_.select("anchor", (F.col("words") > SHARD_WORDS).alias("hot"))
    chosen = firsts.join(open_, "anchor").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("at", "n", "hot", *key)).alias("wanted"))
    cut = staged(held.select("doc_id", "text_id", "text").join(chosen, ["doc_id", "text_id"]).mapInArrow(_cut(window), CUT), "cut")

    # Of hot anchors, only windows in two segments go on, each in the part of its hash.
    hot = cut.where("hot")
    windows = hot.select(*key, F.posexplode("windows").alias("place", "w"))
    # Segments of one anchor differ, so a window in two of them is in two (seg_a, seg_b).
    again = windows.groupBy("anchor", "w").agg(F.min(F.struct("seg_a", "seg_b")).alias("a"), F.max(F.struct("seg_a", "seg_b")).alias("b"), F.count("*").alias("times")).where("a != b").select("anchor", "w", "times")
    parts = again.groupBy("anchor").agg(F.ceil(F.sum("times") / SHARD_WORDS).cast("int").alias("parts"))
    placed = windows.join(again.join(parts, "anchor"), ["anchor", "w"]).groupBy(*key, F.pmod("w", "parts").cast("int").alias("part")).agg(F.collect_list("place").alias("places"))
    split = hot.join(placed, key).select(*key, "part", "doc_id", "places", "text").mapInArrow(_runs(window), RUNS)
    cool = cut.where("not hot").select("anchor", F.lit(0).alias("part"), "seg_a", "seg_b", "doc_id", F.lit(0).cast("long").alias("skip"), F.lit(None).cast("long").alias("n"), F.col("seg_a").alias("run_a"), F.col("seg_b").alias("run_b"), "text")
    split = staged(split, "runs")
    run_key = ["anchor", "part", "run_a", "run_b"]
    # Very many segments may have one run, so its first document is found, and given back, by salts.
    split = split.withColumn("salt", F.pmod(F.xxhash64("seg_a", "seg_b"), F.lit(RUN_SALTS)))
    salted = split.groupBy(*run_key, "salt").agg(F.min(F.struct("doc_id", "text")).alias("o"))
    merged = salted.groupBy(run_key).agg(F.min("o").alias("o")).select(*run_key, "o.*")
    runs = staged(cool.select(*run_key, "doc_id", "text").union(merged), "distinct")
    amount = runs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + amount // (6 * SHARD_WORDS)
    found = staged(runs.withColumn("shard", F.pmod(F.xxhash64("anchor", "part"), F.lit(shards))).groupBy("shard").applyInArrow(_earlier(window), EARLIER), "earlier")

    # (segment, its first document): windows that an earlier document has.
    of_cool = found.join(cool.drop("text", "n"), run_key).select(*key, "doc_id", F.col("place").alias("from"), "n")
    owner = salted.select(*run_key, "salt").join(merged.select(*run_key, F.col("doc_id").alias("owner")), run_key)
    owners = split.drop("text").join(owner, [*run_key, "salt"])
    of_hot = owners.where("doc_id = owner").drop("n").join(found, run_key).select(*key, "doc_id", (F.col("skip") + F.col("place")).alias("from"), "n")
    of_copies = owners.where("doc_id > owner").select(*key, "doc_id", F.col("skip").alias("from"), "n")
    earlier = of_cool.union(of_hot).union(of_copies)

    later = segments.join(firsts.select(*key, F.col("doc_id").alias("least")), key).where("doc_id > least").select("doc_id", "text_id", F.array(F.struct("at", "n")).alias("hits"))
    hits = later.union(_own_hits(segments, earlier)).groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    part = held.select("doc_id", "text_id", "text").join(hits, ["doc_id", "text_id"]).mapInArrow(_apply(window), SPANS)
    gone = F.col("gone").isNotNull()
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    return (
        read.join(part.withColumnRenamed("sha256", "part_sha"), ["doc_id", "text_id"], "left")
        .join(whole, ["doc_id", "text_id"], "left")
        .select(
            "doc_id",
            "text_id",
            "n_words",
            F.when(gone, F.col("gone")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.lit(_sha256(b""))).otherwise(F.coalesce("part_sha", "sha256")).alias("kept_sha256"),
            F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("gone").alias("end")))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        )
    )


def _rewrite(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, new = batch.column("_spans").to_pylist(), []
            for i, j, words in word_chunks(batch.column(text).cast(pa.string())):
                for k in range(j - i):
                    new.append(_kept(words, words.first[k], words.first[k + 1], [(x["start"], x["end"]) for x in spans[i + k]]).decode("utf8"))
            names = [x for x in batch.schema.names if x != "_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if x == text else batch.column(x) for x in names], names=names)

    return run


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with all its columns and rows; repeated passages are cut from ``text``.

    Texts that lose nothing stay as they are, null ones null; in the others the
    kept words are joined by one space, and n_chars (if there) is counted anew.
    Columns may have any other names.
    """
    found = repeated_spans(docs, window).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), F.col("spans").alias("_spans")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    # Rows of a repeated id and text are told apart by nothing, so each gets its spans.
    both = plain.join(found, (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_text_id")), "left")
    same = both.where("_spans is null").select(*plain.columns)
    cut = both.where("_spans is not null").select(*plain.columns, "_spans").mapInArrow(_rewrite(text), plain.schema)
    if "n_chars" in names:
        at = f"c{names.index('n_chars')}"
        cut = cut.withColumn(at, F.length(text).cast(dict(plain.dtypes)[at]))
    return same.union(cut).toDF(*names)
