"""MinHash near-duplicate groups of documents, verified through odd sketches.

1. Every document becomes its set of 5-word shingles, 128 MinHash samples of it and
   an odd sketch: a 512-bit map that holds the parity of how many (sample number,
   sample) pairs fall on each bit. Two sketches' XOR counts the samples that differ.
2. Documents with the same words in the same order (a 128-bit digest of the words
   themselves) have the same set and are one class; only its smallest id goes on.
3. 32 bands of 4 samples each deal the classes into buckets. Each bucket names one
   pivot, the member that meets the most others over all its bands, which for a
   group of edited copies tends to be their original. All members are held against
   the pivot: one pair for each, however large the bucket is.
4. Pairs whose sketches allow a similarity of 0.75 are confirmed on the full sets.
5. Buckets whose members are in one component by now are done. The others, united if
   their largest component is the same, go to blocks of bounded size in which every
   pair of different components is compared, again by sketch and then on full sets.
   So no candidate pair is given up, and a block yields only the links that unite.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import staged, texts
from wayfarer.llm.components import components
from wayfarer.llm.words import Words, mix, shingles, word_chunks

SAMPLES, BANDS, SKETCH_BITS = 128, 32, 512
#: Sketches further apart than this are not confirmed. At a similarity of 0.75, 32 of
#: 128 samples differ on average (deviation 4.9) and 57 bits; 64 differing samples,
#: over six deviations more, give about 101 bits.
SKETCH_MOST = 106
#: Members of a block, and outliers of a block.
BLOCK = 256

_rng = np.random.default_rng(4)
_MUL = _rng.integers(1, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def minhash(h: np.ndarray) -> np.ndarray:
    """128 samples of a set of 64-bit hashes."""
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        x = short[None, i : i + 2048] * _MUL[:, None]
        x += _ADD[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of 4 samples (rows: documents)."""
    x = samples.reshape(len(samples), BANDS, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for i in range(x.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """512 parities as 8 words of 64 bits (rows: documents)."""
    n = len(samples)
    at = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    bit = (at % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(bit.ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.int64)


SIGNED = "doc_id long, n_shingles long, seq_a long, seq_b long, bands array<long>, sketch array<long>"


def _rows(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(values.ravel()))


def _digest(words: Words, i: int, j: int) -> bytes:
    """128 bits that stand for words i to j - 1 in their order."""
    return hashlib.blake2b(words.text(i, j), digest_size=16).digest()


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch.column("text"), lower=True):
                hashes, n = words.hashes(), j - i
                samples = np.full((n, SAMPLES), 0xFFFFFFFF, np.uint32)
                size, ids = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
                for k in range(n):
                    at, to = words.first[k], words.first[k + 1]
                    s = np.unique(shingles(hashes[at:to], width))
                    if size_k := len(s):
                        size[k], samples[k] = size_k, minhash(s)
                        ids[:, k] = np.frombuffer(_digest(words, at, to), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(size), pa.array(ids[0]), pa.array(ids[1]), _rows(band_keys(samples)), _rows(odd_sketch(samples))],
                    names=["doc_id", "n_shingles", "seq_a", "seq_b", "bands", "sketch"],
                )

    return run


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, words in word_chunks(column, lower=True):
        hashes = words.hashes()
        out += [np.unique(shingles(hashes[words.first[k] : words.first[k + 1]], width)) for k in range(j - i)]
    return out


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The partner is the same for long runs of rows: hash it once.
            v = list(zip(batch.column("v").to_pylist(), batch.column("v_alt").to_pylist(), strict=True))
            fresh = [k for k in range(len(v)) if not k or v[k] != v[k - 1]]
            cache = dict(zip(fresh, _sets(batch.column("v_text").take(pa.array(fresh)), width), strict=True)) if fresh else {}
            ok, b = [], np.zeros(0, np.uint64)
            for k, a in enumerate(_sets(batch.column("u_text"), width)):
                b = cache.get(k, b)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(bool(len(a)) and 100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(keep)

    return run


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the name of their word sequence, where their id has others too."""
    for batch in batches:
        names = [""] * batch.num_rows
        many = np.flatnonzero(batch.column("many").fill_null(False).to_numpy(zero_copy_only=False))
        for i, j, words in word_chunks(batch.column("text").take(pa.array(many)), lower=True):
            for k in range(j - i):
                a, b = np.frombuffer(_digest(words, words.first[k], words.first[k + 1]), np.int64)
                names[many[i + k]] = f"{a}:{b}"
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), batch.column("text")], names=["doc_id", "alt", "text"])


def confirmed(pairs: DataFrame, docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Of pairs (u, u_alt, v, v_alt), the ids u and v of those whose full shingle sets are similar enough."""
    side = lambda s: docs.select(F.col("doc_id").alias(s), F.col("alt").alias(f"{s}_alt"), F.col("text").alias(f"{s}_text"))
    both = pairs.join(side("u"), ["u", "u_alt"]).join(side("v"), ["v", "v_alt"])
    return both.select("u", "v", "v_alt", "u_text", "v_text").mapInArrow(_verify(width, percent), "u long, v long")


def _sketch_distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _common(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets u[i] and v[i]."""
    if len(u) <= 2000:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(u, v, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = times > 1
    owner, number = owner[again[number]], (np.cumsum(again) - 1)[number[again[number]]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(again.sum()), 4096):
        a, b = np.searchsorted(number, [first, first + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[a:b], number[a:b] - first] = 1
        both += held @ held.T
    return both[u, v].astype(np.int64)


def _candidates(table: pa.Table) -> np.ndarray:
    """Rows u, v and distances of a block's pairs of different components whose sketches allow a link.

    In a large group only outliers are compared, with all that are here.
    """
    comp = table.column("comp").to_numpy()
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(comp), -1)
    pairs = [np.zeros((3, 0), np.int64)]
    for i in np.flatnonzero(table.column("outlier").to_numpy(zero_copy_only=False)):
        apart = np.bitwise_count(sketch ^ sketch[i]).sum(axis=1, dtype=np.int32)
        j = np.flatnonzero((apart <= SKETCH_MOST) & (comp != comp[i]))
        pairs.append(np.stack([np.full(len(j), i), j, apart[j]]))
    return np.concatenate(pairs, axis=1)


def _possible(table: pa.Table) -> pa.Table:
    """A block's rows that have any candidate there."""
    return table.take(pa.array(np.unique(_candidates(table)[:2])))


def _settle(width: int, percent: int):
    """One block: links on full sets that unite members of different components."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("doc_id").to_numpy(), table.column("comp").to_numpy()
        u, v, apart = _candidates(table)
        links: dict[str, list[int]] = {"u": [], "v": []}
        if len(u):
            sets = _sets(table.column("text").combine_chunks(), width)
            size = np.array([len(x) for x in sets])
            both = _common(sets, u, v)
            good = np.flatnonzero((100 * both >= percent * (size[u] + size[v] - both)) & (both > 0))
            root = {c: c for c in comp.tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for k in good[np.argsort(apart[good], kind="stable")]:
                a, b = find(int(comp[u[k]])), find(int(comp[v[k]]))
                if a != b:
                    root[a] = b
                    links["u"].append(int(ids[u[k]]))
                    links["v"].append(int(ids[v[k]]))
        return pa.table(links, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    def block(table: pa.Table) -> pa.Table:
        return run(table)

    return block


def near_text(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    Words are runs of bytes other than white space, with A-Z lower-cased; a
    document's set holds its distinct ``width``-word shingles, or all its words as
    one if it has fewer. Documents link if 100 * intersection >= percent * union.

    Null, empty and blank texts have an empty set and link with nothing. A null
    doc_id links with nothing, has a null component and is kept. Repeated rows get
    the same result each; rows that share an id but not a text are one node of the
    graph. Columns other than doc_id and text are ignored. No rows give no rows.
    """
    plain = texts(docs)
    signed = staged(plain.mapInArrow(_sign(width), SIGNED), "signed")
    of_set = signed.where("n_shingles > 0 and doc_id is not null")
    # One row for each word sequence: its least document, with what describes its set.
    classes = of_set.groupBy("seq_a", "seq_b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    firsts = classes.select("seq_a", "seq_b", F.col("least").alias("doc_id"))
    reps = of_set.join(firsts, ["seq_a", "seq_b", "doc_id"], "left_semi").groupBy("doc_id", "seq_a", "seq_b").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    same = of_set.join(classes.where("least != most"), ["seq_a", "seq_b"]).select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    # An id with several texts has a node for each, told apart by ``alt``; links unite ids.
    seq = F.struct("seq_a", "seq_b")
    several = staged(of_set.groupBy("doc_id").agg(F.min(seq).alias("a"), F.max(seq).alias("b")).where("a != b").select("doc_id", F.lit(True).alias("many")), "several")
    alt = F.when(F.col("many"), F.concat_ws(":", "seq_a", "seq_b")).otherwise("").alias("alt")
    reps = staged(reps.join(several, "doc_id", "left").select("doc_id", alt, "bands", "sketch"), "reps")
    node = ["doc_id", "alt"]

    dealt = reps.select(*node, F.explode("bands").alias("band")).distinct()
    sizes = dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(dealt.join(sizes, "band"), "members")
    degree = members.groupBy(node).agg(F.sum("n").alias("degree"))
    pivot = members.join(degree, node).groupBy("band").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("m"), "alt")).alias("top")).select("band", (-F.col("top.m")).alias("v"), F.col("top.alt").alias("v_alt"))
    sketches = reps.select(*node, "sketch")
    first = members.join(pivot, "band").where("doc_id != v").select(F.col("doc_id").alias("u"), F.col("alt").alias("u_alt"), "v", "v_alt").distinct()
    side = lambda s: sketches.select(*(F.col(c).alias(n) for c, n in zip([*node, "sketch"], [s, f"{s}_alt", f"{s}_sketch"], strict=True)))
    first = staged(
        first.join(side("u"), ["u", "u_alt"]).join(side("v"), ["v", "v_alt"])
        .where(_sketch_distance("u_sketch", "v_sketch") <= SKETCH_MOST)
        .select("u", "u_alt", "v", "v_alt"),
        "pairs",
    )
    wanted = members.select("doc_id").distinct()
    held = plain.join(wanted, "doc_id", "left_semi").distinct().join(several, "doc_id", "left")
    held = staged(held.mapInArrow(_told_apart, "doc_id long, alt string, text string"), "texts")
    links = staged(confirmed(first, held, width, percent), "links")
    comps = components(links)

    # What is left: buckets that still hold more than one component.
    placed = members.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", *node, F.coalesce("component_id", "doc_id").alias("comp"))
    by_comp = placed.groupBy("band", "comp").agg(F.count("*").alias("m"))
    open_ = by_comp.groupBy("band").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("band", F.col("top.comp").alias("main"))
    rest = staged(placed.join(open_, "band").select("main", *node, "comp").distinct(), "rest")
    size = rest.groupBy("main").agg(F.count("*").alias("n"), F.sum((F.col("comp") != F.col("main")).cast("int")).alias("m"))
    rest = rest.join(size, "main").withColumn("outlier", F.col("comp") != F.col("main")).withColumn("large", F.col("n") > BLOCK)
    at = lambda c: F.pmod(F.xxhash64(*node), F.ceil(F.col(c) / BLOCK)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.ceil(F.col(c) / BLOCK).cast("int") - 1)
    # Each block of members meets each block of outliers, which are members too.
    small = rest.where("not large").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    as_member = rest.where("large").withColumn("i", at("n")).withColumn("j", F.explode(every("m"))).withColumn("outlier", F.lit(False))
    as_outlier = rest.where("large and outlier").withColumn("j", at("m")).withColumn("i", F.explode(every("n")))
    columns = ["main", "i", "j", *node, "comp", "outlier"]
    blocks = small.select(columns).union(as_member.select(columns)).union(as_outlier.select(columns))
    # Sketches alone tell which members of a block can link there; only these bring their texts.
    blocks = blocks.join(sketches, node).select(*columns, "sketch")
    blocks = staged(blocks.groupBy("main", "i", "j").applyInArrow(_possible, blocks.schema), "blocks")
    more = blocks.join(held, node).groupBy("main", "i", "j").applyInArrow(_settle(width, percent), "u long, v long")
    groups = components(links.union(more).union(same))
    return signed.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
