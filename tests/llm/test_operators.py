"""The corpus operators against plain versions of themselves, with odd rows among the others."""

from __future__ import annotations

import collections
import re
import sys
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wayfarer.llm import ann, dom, encoding, fm_index, html_text, near_text, near_vectors, packing, pieces, quality, queries, substring, token_files, toxicity, words  # noqa: E402
from wayfarer.llm.common import scratch  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def drawn_texts() -> list[tuple]:
    rng = np.random.default_rng(3)
    words = [f"{'aeiou'[i % 5]}w{i}é" if i % 7 == 0 else f"Wort{i}." for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(int(n)) for n in rng.integers(1, 400, 25)]
    rows: list[tuple] = [(i, t) for i, t in enumerate(base)]
    for t in base:
        w = t.split()
        if len(w) > 60:
            rows += [(len(rows), " ".join([*w[:30], "changed", *w[31:]])), (len(rows) + 1, "  " + t.replace(" ", "\t", 2).upper() + "\n"), (len(rows) + 2, text(20) + " " + " ".join(w[3:58]) + " " + text(9))]
    odd = [None, "", " \n\t", "one", "One", "a b c d", "A  b\tc d", text(6000), "x" * 5000, "<|endoftext|> don't  DON'T ß İ ▁ 東京 \U0001f600 é", "1234567 3.14 ... !!!?\r\n\r\n  end  ", "▁a▁"]
    return rows + [(len(rows) + k, t) for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def rows():
    return drawn_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that are named like those that operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("n", "key", "text_id", "held_out", "band", "u", "v", "score", "spans", "comp", "h", "n_words")})


@pytest.mark.parametrize("block", [near_text.BLOCK, 3])
def test_near_text(docs, rows, monkeypatch, block):
    """Also where nearly every bucket is cut into blocks."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_text.near_text(docs).collect()}
    assert got == brute.near_text(rows)


def test_near_text_at_the_limit(spark):
    """Sets of 7 with 6 in common have 6 / 8; one word less in common is too little."""
    w = [f"w{i}" for i in range(20)]
    made = [(1, " ".join(w[:11])), (2, " ".join([*w[:10], "z"])), (3, " ".join([*w[:9], "y", "z"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_text.near_text(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == brute.near_text(made) == {1: (7, 1), 2: (7, 1), 3: (7, 3)}


def near_copy(text: str, k: int) -> str:
    w = text.split()
    w[k] = "changed"
    return " ".join(w)


@pytest.mark.parametrize("block", [near_text.BLOCK, 3])
def test_near_text_of_ids_with_several_texts(spark, monkeypatch, block):
    """An id links wherever any of its texts does."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    rng = np.random.default_rng(11)
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    made = [(10, a), (10, b), (2, near_copy(a, 40)), (3, near_copy(b, 40))]
    many = [(1, a), (1, b), (2, near_copy(a, 9)), (3, near_copy(a, 70)), (4, near_copy(b, 9)), (5, near_copy(b, 70))]
    bases = [" ".join(rng.choice([f"w{i}" for i in range(500)], 60)) for _ in range(12)]
    drawn = [(int(rng.integers(0, 25)), near_copy(bases[int(rng.integers(0, 12))], int(rng.integers(0, 60)))) for _ in range(70)]
    for rows in (made, many, drawn + [(7, None), (7, ""), (8, "a b")]):
        sets = [(i, set(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else set()) for i, t in rows for w in [(t or "").split()]]
        links = [(i, j) for i, x in sets for j, y in sets if i < j and x and 100 * len(x & y) >= 75 * len(x | y)]
        want = brute.groups([i for i, _ in rows], links)
        got = near_text.near_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, want[i]) for i, _ in rows)


def thue_morse(n: int, first: str) -> str:
    """Two such words, of a and b and the other way round, collide in polynomial hashes modulo 2**64."""
    other = {"a": "b", "b": "a"}
    out = first
    while len(out) < n:
        out += "".join(other[c] for c in out)
    return out


def test_words_and_sequences_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(2048, "a"), thue_morse(2048, "b")
    rest = [f"r{i}" for i in range(60)]
    made = [(5, f"x {x}"), (6, f"x {y}"), (7, " ".join([*rest[:30], x, *rest[30:]])), (8, " ".join([*rest[:30], y, *rest[30:]]))]
    words_of = lambda s: [w for k, c in enumerate(s[:512]) for w in (f"{c}x", *[f"g{k}_{i}" for i in range(39)])]
    made += [(9, " ".join(words_of(x))), (10, " ".join(words_of(y)))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_text.near_text(df).collect()} == brute.near_text(made)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_spans(df).collect()} == brute.substring(made)
    from tokenizers import Tokenizer

    for path, spaced in ((WORDS, False), (BYTES, True)):
        texts = [x, y, f"{x} {y} {x}", thue_morse(64, "a"), thue_morse(64, "b")]
        got = [ids.tolist() for part in encoding.Encoder(path, spaced).encode(pa.array(texts)) for ids in part]
        assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_stretches_whose_hash_is_another_ones(monkeypatch):
    """With a hash of 3 bits nearly all collide, and the ids are right all the same."""
    from tokenizers import Tokenizer

    plain = words.bytes_hash
    monkeypatch.setattr(encoding, "bytes_hash", lambda *a: plain(*a) & np.uint64(7))
    texts = [t or "" for _, t in drawn_texts()[:20]]
    got = [ids.tolist() for part in encoding.Encoder(BYTES, True).encode(pa.array(texts)) for ids in part]
    assert got == [Tokenizer.from_file(BYTES).encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("path", "spaced"), [(WORDS, False), (BYTES, True)])
def test_long_texts_are_encoded_in_parts(path, spaced):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    some = ["Wort.", "don't", "<|endoftext|>", "\n\n", "  x", "é", "12345", "東京"]
    long_ = " ".join(rng.choice(some, 900_000))
    texts = ["a", long_, "", "b" * 300, long_[: 3 << 20], ""]
    got = [ids.tolist() for part in encoding.Encoder(path, spaced).encode(pa.array(texts)) for ids in part]
    plain = Tokenizer.from_file(path)
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_that_repeat(spark):
    t = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t), (None, None)], "doc_id long, text string")
    near = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_text.near_text(df).collect()), key=repr)
    assert near == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (None, None, True)], key=repr)
    cut = sorted(((r["doc_id"], r["n_removed"]) for r in substring.repeated_spans(df).collect()), key=repr)
    assert cut == sorted([(5, 0), (5, 0), (7, 70), (None, 0), (None, 0)], key=repr)
    assert packing.pack(df, BYTES).count() == 5


def test_substring(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_spans(docs).collect()}
    assert got == brute.substring(rows)


def test_substring_with_repeats_inside_one_text(spark):
    p = [f"p{i}" for i in range(55)]
    found = [(1, " ".join(p + p)), (2, " ".join(["a", *p, "b", *p, "c"])), (3, " ".join(p[:50])), (4, " ".join(p[:49])), (5, " ".join(["q"] * 200)), (6, " ".join(["q"] * 90))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_spans(spark.createDataFrame(found, "doc_id long, text string")).collect()}
    assert got == brute.substring(found)


@pytest.mark.parametrize("shard", [substring.SHARD_WORDS, 120])
def test_substring_through_hot_anchors(spark, monkeypatch, shard):
    """With tiny shards all anchors are hot, and their windows go to parts."""
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    rng = np.random.default_rng(8)
    line = [f"l{i}" for i in range(20)]
    text = lambda n: rng.choice([f"v{i}" for i in range(4000)], n).tolist()
    passage = text(30) + line + text(25)
    made = [(i, " ".join([*text(40), *line, *text(40)])) for i in range(40)]
    made += [(40 + i, " ".join([*text(i % 7), *passage[i % 3 :], *text(30), *passage[: 50 + i % 5]])) for i in range(30)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_spans(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == brute.substring(made)


def test_a_segment_meets_all_its_ranges_in_one_row(spark):
    """Three places of a segment with 40 ranges are three rows with 40 hits each, not 120 rows."""
    segments = spark.createDataFrame([(1, 11, at, 60, 7, 8, 9) for at in (0, 100, 200)] + [(2, 12, 5, 60, 7, 8, 9)], substring.SEGMENTS)
    earlier = spark.createDataFrame([(7, 8, 9, 1, 2 * k, 1) for k in range(40)], "anchor long, seg_a long, seg_b long, doc_id long, from long, n long")
    found = substring._own_hits(segments, earlier).collect()
    assert sorted((r["doc_id"], r["text_id"], sorted(tuple(h) for h in r["hits"])) for r in found) == [(1, 11, [(at + 2 * k, 1) for k in range(40)]) for at in (0, 100, 200)]


@pytest.mark.parametrize("window", [5, 63, 64, 130])
def test_substring_of_other_windows(spark, window):
    rng = np.random.default_rng(window)
    text = lambda n: rng.choice([f"v{i}" for i in range(900)], n).tolist()
    p = text(window + 3)
    made = [(1, " ".join([*text(9), *p, *text(200)])), (2, " ".join([*text(70), *p])), (3, " ".join(p[1:])), (4, " ".join([*p[: window - 1], *text(5)])), (5, " ".join(["q"] * 300)), (6, " ".join(["q"] * (window + 2)))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeated_spans(spark.createDataFrame(made, "doc_id long, text string"), window).collect()}
    assert got == brute.substring(made, window)


def test_the_index_decides_what_is_removed(spark, monkeypatch):
    """Texts of one anchor with 49 and with 50 words in common; matching statistics tell them apart."""
    anchor = [f"k{i}" for i in range(120)]
    made = [(1, " ".join(anchor)), (2, " ".join(["x", *anchor[:50], "y"])), (3, " ".join(["z", *anchor[5:54], "y", "z"]))]
    want = {1: 0, 2: 50, 3: 0}
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.repeated_spans(df).collect()} == want
    doc = np.array([1, 2, 3])
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(" ".join(t for _, t in made).split()))}
    values = np.array([number[w] for _, t in made for w in t.split()])
    lengths = np.array([len(t.split()) for _, t in made])
    hit = substring.earlier_windows(doc, values, lengths, 50)
    assert np.flatnonzero(hit).tolist() == [121]
    plain = fm_index.FmIndex.matching_statistics
    # An index that finds each match one word shorter, or one longer, changes the result.
    monkeypatch.setattr(fm_index.FmIndex, "matching_statistics", lambda *a: (plain(*a)[0] - 1, plain(*a)[1]))
    assert not substring.earlier_windows(doc, values, lengths, 50).any()
    monkeypatch.setattr(fm_index.FmIndex, "matching_statistics", lambda *a: (plain(*a)[0] + 1, plain(*a)[1]))
    assert len(np.flatnonzero(substring.earlier_windows(doc, values, lengths, 50))) > 1


def test_matching_statistics():
    rng = np.random.default_rng(4)
    seq = [rng.integers(1, 4, n) for n in (40, 1, 25, 60)]
    index = fm_index.FmIndex(np.concatenate(seq), np.array([len(x) for x in seq]), 20)
    asked = [rng.integers(1, 5, 50), seq[2]]
    size, _ = index.matching_statistics(np.concatenate(asked), np.array([len(x) for x in asked]))
    text = "|".join("".join(map(str, x)) for x in seq)
    want = []
    for a in asked:
        t = "".join(map(str, a))
        want += [max(n for n in range(len(t) - i + 1) if t[i : i + n] in text) for i in range(len(t))]
    assert size.tolist() == want


def test_without_repeats_keeps_rows_and_columns(docs, rows):
    new = substring.without_repeats(docs)
    assert new.columns == docs.columns
    got, want = {r["doc_id"]: r["text"] for r in new.collect()}, brute.substring(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == t if want[i][1] == 0 else len(got[i].split()) == want[i][0] - want[i][1]


def test_token_files(spark, docs, rows):
    manifest = token_files.write_token_files(docs, scratch(spark, "tokens"), WORDS)
    got = {r["doc_id"]: tuple(r)[1:4] for r in token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for (i, _), ids in zip(sorted(rows), brute.token_ids([t or "" for _, t in sorted(rows)], WORDS, 1), strict=True):
        assert got[i] == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_ids_of_wanted_documents_only(spark, docs, rows, monkeypatch):
    manifest = token_files.write_token_files(docs, scratch(spark, "tokens"), WORDS)
    wanted = [3, 7, 10, 10**9, None, max(i for i, _ in rows)]
    got = {r["doc_id"]: r["ids"] for r in token_files.ids_of(manifest, spark.createDataFrame([(i,) for i in wanted], "doc_id long")).collect()}
    texts = {i: t or "" for i, t in rows if i in wanted}
    assert got == {i: ids.tolist() for i, ids in zip(texts, brute.token_ids(list(texts.values()), WORDS, 1), strict=True)}


@pytest.mark.parametrize(("path", "spaced"), [(WORDS, False), (BYTES, True)])
def test_names_of_added_tokens_as_the_library_takes_them(rows, path, spaced):
    """Ids of the library's plain ``encode``, for names in odd places and for all other rows."""
    from tokenizers import Tokenizer

    e, s = "<|endoftext|>", "<|startoftext|>"
    odd = [f"see {e} here", e, s, e + e, f"a.{e}.b  {e}", f"SEE{e.upper()}x {e}X", f"a  {s}{e}\n b", "<|endof", f"text|> {e}", f"e{e}\u0301 don't{e}'t", f" {e} ", f"\u3000{e}\u3000", f"<{e}>", f"<|<|endof{e}"]
    texts = odd + [t or "" for _, t in rows] + odd
    code, plain = encoding.Encoder(path, spaced), Tokenizer.from_file(path)
    got = [ids.tolist() for part in code.encode(pa.array(texts, pa.string())) for ids in part]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_frame_is_read_alone_and_damage_is_found(tmp_path):
    path = tmp_path / "x"
    with path.open("wb") as f:
        w = token_files.Writer(f)
        for i in range(50):
            w.add(i, np.arange(i + 1))
        w.close()
    with path.open("rb") as f:
        r = token_files.Reader(f, path.stat().st_size)
        assert r.ids(17).tolist() == list(range(18)) and r.doc_ids.tolist() == list(range(50))
        place = int(r.start[30]) + int(r.entries[30, 0]) - 1
    data = bytearray(path.read_bytes())
    data[place] ^= 0xFF
    path.write_bytes(bytes(data))
    with path.open("rb") as f:
        r = token_files.Reader(f, len(data))
        assert len(r.ids(29)) == 30
        with pytest.raises(Exception):
            r.ids(30)


def test_pack(docs, rows):
    got = [tuple(r) for r in packing.pack(docs, BYTES).collect()]
    ids = dict(zip([i for i, _ in rows], brute.token_ids([t or "" for _, t in rows], BYTES, 2), strict=True))
    n = brute.packed_right(got, ids)
    assert n <= 1.1 * sum(map(len, ids.values())) / 1024 + 1


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 65), 40, replace=False), rng.integers(1, 90, 40), strict=True)}
    plan, taken = packing.Plan(counts, 64), set()
    for n, c in counts.items():
        s, o = plan.place(np.full(c, n), np.arange(c))
        assert (o + n <= 64).all()
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            spots = {(a, b + k) for k in range(n)}
            assert not spots & taken
            taken |= spots
    # From 0 without gaps.
    for a in {x for x, _ in taken}:
        here = sorted(b for x, b in taken if x == a)
        assert here == list(range(len(here)))


def test_sampled_pieces(docs, rows):
    first = {r["doc_id"]: (r["ids"], r["lossless"]) for r in pieces.sampled_pieces(docs, PIECES).collect()}
    again = {r["doc_id"]: r["ids"] for r in pieces.sampled_pieces(docs.coalesce(1), PIECES).collect()}
    other = {r["doc_id"]: r["ids"] for r in pieces.sampled_pieces(docs, PIECES, seed=1).collect()}
    assert all(ok for _, ok in first.values())
    assert {i: ids for i, (ids, _) in first.items()} == again
    assert other != again
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.sampled_pieces(docs, PIECES), PIECES).collect()}
    assert back == {i: t or "" for i, t in rows}


@pytest.mark.parametrize("word", ["the", " of", "ended"])
def test_sampled_shares_follow_the_lattice(word):
    """Of all segmentations there are, each comes up as often as its weight says."""
    code = pieces.Lattice(PIECES, 0.3)
    n = 8000
    seen: dict[tuple, int] = {}
    for x in code.samples([word] * n, list(range(n))):
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1
    every = brute.segmentations(word, {p.replace(pieces.MARK, " "): i for p, i in code.piece.items()})
    weight = {x: np.exp(sum(code.weight[i] for i in x)) for x in every}
    total = sum(weight.values())
    assert set(seen) <= set(every) and len(every) >= 3
    for x, w in weight.items():
        assert seen.get(x, 0) / n == pytest.approx(w / total, abs=5 * np.sqrt(w / total / n) + 1e-3)


def vectors() -> list[tuple]:
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, 40, 2):
        for scale in (0.02, 0.05, 0.09):
            out.append((len(out), (3 * (base[i] + scale * rng.standard_normal(16))).tolist()))
    out += [(len(out), base[0].tolist()), (len(out) + 1, None), (len(out) + 2, [0.0] * 16), (len(out) + 3, [float("nan")] * 16), (len(out) + 4, [None] + [1.0] * 15), (len(out) + 5, [1.0, 2.0]), (len(out) + 6, [float("inf")] + [1.0] * 15)]
    return out


@pytest.mark.parametrize(("held", "block"), [(near_vectors.HELD, near_vectors.BLOCK), (6, 5)])
def test_near_vectors(spark, monkeypatch, held, block):
    """Also with filters of a few vectors and blocks of five."""
    monkeypatch.setattr(near_vectors, "HELD", held)
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    made = vectors()
    made += [(len(made) + k, v) for k, v in enumerate([[1.0, 2.0], [2.0, 4.1], [-1.0, 2.0], [3.0], [-3.0], [0.5], [1.0, 2.0, 3.0]])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "f": F.lit("x"), "vec": F.lit(2)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}
    assert got == brute.near_vectors(made)


def test_codes_find_pairs_at_the_limit():
    """Of 4,000 drawn pairs at the limit itself, nearly all share a filter, at any size and length."""
    rng = np.random.default_rng(12)
    for rows, dim in ((500, 64), (50_000, 64), (50_000, 8), (3_000_000, 48)):
        code = near_vectors.Codes(rows, dim, 0.95)
        assert code.chance <= near_vectors.MISS
        x, z = rng.standard_normal((2, 4000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        (a, f), (b, g) = code.exceeded(x), code.exceeded(y)
        missed = sum(not set(f[a[i] : a[i + 1]]) & set(g[b[i] : b[i + 1]]) for i in range(4000))
        assert missed <= 4


def test_vectors_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 5, 1, True)] * 3 + [(2, 2, 1, False), (3, 1, 1, False), (None, 0, None, True)], key=repr)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16))
    x[100:110] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16)], "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    got: dict[int, list] = {}
    for r in ann.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort([np.arange(900), -s])[:20]
        assert [k for k, _, _ in got[q]] == list(range(1, 21))
        assert all(v != q and score == pytest.approx(s[v]) for _, v, score in got[q])
        assert [v for _, v, _ in got[q]] == sorted([v for _, v, _ in got[q]], key=lambda v: (-round(s[v], 9), v))
        hit += len({v for _, v, _ in got[q]} & set(want.tolist()))
    assert set(got) == set(range(0, 900, 20)) and hit >= 0.9 * 20 * len(got)


def test_nearest_vectors_inside_a_group_of_near_copies(spark, monkeypatch):
    """400 vectors that differ by less than estimates can tell, in the one list there is."""
    monkeypatch.setattr(ann, "LIST_SIZE", 1000)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((500, 16))
    x[:400] = x[0] + 1e-7 * rng.standard_normal((400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in ann.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert got[q] == np.argsort(-s)[:20].tolist()


@pytest.mark.parametrize("groups", [0, 60])
def test_nearest_vectors_with_more_lists_than_are_visited(spark, monkeypatch, groups):
    """Recall against brute force where lists are left out, in blocks, with and without groups of copies."""
    monkeypatch.setattr(ann, "LIST_SIZE", 20)
    monkeypatch.setattr(ann, "BLOCK", 1500)
    monkeypatch.setattr(ann, "QUERIES", 100)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24))
    if groups:
        x = x[rng.integers(0, groups, 4000)] + 0.3 * x
    index = ann.Index(x, 4000, 20)
    assert index.probes < 0.8 * len(index.centres)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.nearest_vectors(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got)


def test_nearest_vectors_of_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest_vectors(df, every=5, k=2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 2.0), (0, 2, 1, 0.0), (0, 2, 3, 1.0)]


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>home</a> <a href=/x>news</a></nav>
    <div class="cookie-notice"><p>We use cookies on this site to give you more.</p></div>
    <article><h1>The  title &amp; more</h1><p>First <b>block</b> of\n text, which is quite long and has several words. It goes on for a while, too.</p>
    <script>var x = "<p>no</p>";</script><p>Second block, with some more words in it; they are the article's own.</p></article>
    <div class="comments"><div class="comment"><p>I liked it.</p></div></div><footer>&copy; 2020 All rights reserved</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()}
    want = "The title & more\nFirst block of text, which is quite long and has several words. It goes on for a while, too.\nSecond block, with some more words in it; they are the article's own."
    assert got[1] == (want, len(want))
    assert got[2] == ("", 0) and got[3] == ("", 0) and len(got) == 4


@pytest.fixture(scope="module")
def extractor(spark):
    return html_text.trained(spark)


def marked_text(html: str) -> str:
    """The marked runs of a drawn page."""
    return "\n".join(o.replace("\x01", "").replace("\x02", "") for own in dom.parse(html).own for o in own if "\x01" in o)


def test_main_text_of_pages_never_seen(extractor):
    """Also where every class and id is a word that no page of the fit had."""
    pages = html_text.drawn(999, 200)
    want, bare = [marked_text(p) for p in pages], [p.replace("\x01", "").replace("\x02", "") for p in pages]
    shared = lambda a, b: 2 * sum((collections.Counter(a.split()) & collections.Counter(b.split())).values()) / max(1, len(a.split()) + len(b.split())) if a or b else 1.0
    got = extractor.extracted(bare)
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) >= 0.9
    assert np.mean([shared(g, w) for g, w in zip(got, want, strict=True)]) >= 0.97
    renamed = [re.sub(r"(class|id)=(\"?)([^\">]*)", lambda m: f"{m[1]}={m[2]}" + re.sub("[a-z]+", lambda w: "q" + w[0][::-1] + "x", m[3]), p) for p in bare]
    assert np.mean([shared(g, w) for g, w in zip(extractor.extracted(renamed), want, strict=True)]) >= 0.9


def without_names(html: str) -> str:
    return re.sub(r" (class|id)=(\"[^\"]*\"|[^ >]+)", "", html)


def test_main_text_where_names_tell_nothing(extractor):
    """Pages whose elements bear no class or id at all, drawn by a seed the fit never saw."""
    pages = [without_names(p) for p in html_text.drawn(4321, 150)]
    want, bare = [marked_text(p) for p in pages], [p.replace("\x01", "").replace("\x02", "") for p in pages]
    shared = lambda a, b: 2 * sum((collections.Counter(a.split()) & collections.Counter(b.split())).values()) / max(1, len(a.split()) + len(b.split())) if a or b else 1.0
    got = extractor.extracted(bare)
    assert np.mean([shared(g, w) for g, w in zip(got, want, strict=True)]) >= 0.85
    assert sum(not g and len(w) > 300 for g, w in zip(got, want, strict=True)) <= 1


LINES = [
    "The river rose in the night, and by morning the lower road was under water.",
    "Nobody in the village had seen it so high; the mill was closed for three days.",
    "When the bridge was opened again, most of the carts had gone the long way round.",
    "An old fisherman said that his grandfather had told him of such a spring.",
]


def test_main_text_of_layouts_that_the_fit_does_not_draw(extractor):
    """Meaningless names, a table for the layout, comments without marks, and prose between line breaks."""
    two = f"<p>{LINES[0]} {LINES[1]}</p><p>{LINES[2]} {LINES[3]}</p>"
    prose = f"{LINES[0]} {LINES[1]}\n{LINES[2]} {LINES[3]}"
    named, table, said, broken = extractor.extracted([
        f'<div class="q7"><div class="z1"><a href=1>Home</a> <a href=2>News</a></div><div class="k9">{two}</div><div class="z3">Copyright</div></div>',
        f"<table><tr><td><a href=1>A</a> <a href=2>B</a></td><td>{two}</td></tr></table>",
        f"<body><div><h1>The flood</h1>{two}</div><div><div>Ben: I agree</div><div>Ann: so do I, and it was never otherwise here.</div></div></body>",
        f"<body><div>{'<br><br>'.join(LINES)}</div></body>",
    ])
    assert named == table == prose
    assert said == f"The flood\n{prose}"
    assert broken == " ".join(LINES)


def test_trees_and_decoding_against_plain_versions(extractor):
    rng = np.random.default_rng(9)
    trees, x = extractor.trees, rng.standard_normal((50, 69)) * 3
    for row, got in zip(x, trees.logits(x), strict=True):
        total = trees.bias
        for t in range(len(trees.leaf)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + int(row[trees.feature[t][node]] > trees.cut[t][node])
            total += trees.leaf[t][node - (2**trees.depth - 1)]
        assert got == pytest.approx(total)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        parent = np.array([0] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        logit = rng.standard_normal(n)
        keep = html_text.decode(logit, parent, depth, np.zeros(n, bool))
        allowed = [m for m in range(2**n) if all(not m >> k & 1 or m >> parent[k] & 1 for k in range(n))]
        best = max(allowed, key=lambda m: sum(logit[k] for k in range(n) if m >> k & 1))
        assert sum(int(v) << k for k, v in enumerate(keep)) == best


def test_deep_and_long_pages(extractor):
    deep = "<article>" + "<div>" * 3000 + "<p>Deep down there is text, and it goes on.</p>"
    long_ = "<article><h1>t</h1>" + "<p>One more paragraph with some words in it, for a long page.</p>" * 20_000 + "</article>"
    began = time.perf_counter()
    got = extractor.extracted([deep, long_])
    assert got[1].count("\n") == 20_000 and time.perf_counter() - began < 60


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    pos, neg = score[y == 1], score[y == 0]
    return float((pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2)


@pytest.mark.parametrize(("run", "target", "threshold"), [(quality.quality, "quality", 0.7), (toxicity.toxicity, "toxic", 0.3)])
def test_classifiers_on_held_out_rows(spark, run, target, threshold):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = run(docs, labels, threshold)
    assert found.count() == docs.count() and found.where("score < 0 or score > 1 or score is null").count() == 0
    held = found.join(labels, "doc_id").where("held_out").toPandas()
    assert _auc(held["score"].to_numpy(), held[target].to_numpy()) >= 0.8
    assert ((held["score"] >= threshold) == (held["predicted"] == 1)).all()


def test_toxicity_wherever_a_phrase_begins_and_however_often():
    rng = np.random.default_rng(2)
    plain = [f"{x}{y}{z}" for x in "bdfgk" for y in "aeiou" for z in "lmnrst"]
    text = lambda n: rng.choice(plain, n).tolist()
    insult = ["vile", "wretch"]
    bad = [" ".join([*text(k % 30), *insult, *text(40)]) for k in range(60)]
    good = [" ".join(text(60)) for _ in range(120)]
    y = np.repeat([1, 0], [60, 120])
    model = toxicity.fit(bad + good, y, np.ones(180))
    scores = lambda found: model.scores(next(words.word_chunks(pa.array(found), lower=True))[2])
    w = text(80)
    logit = np.log(1 / scores([" ".join([*w[:k], *insult, *w[k:]]) for k in (10, 11, 30, 31)]) - 1)
    assert np.ptp(logit) < 0.02 * np.abs(logit).mean()
    once, thrice = scores([" ".join([*w[:10], *insult, *w[10:]]), " ".join([*w[:10], *insult, *w[10:30], *insult, *w[30:50], *insult, *w[50:]])])
    assert thrice > once


def test_scores_against_plain_forward_passes(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = [t or "" for _, t in drawn_texts()[:30]] + ["You IDIOT! idiot.", "a", "", "...", "x y x y"]
    chunk = lambda lower: next(words.word_chunks(pa.array(found), lower=lower, most=1 << 30))[2]
    rows = docs.join(labels, "doc_id").orderBy("doc_id").limit(200).toPandas()
    y, weight = rows["toxic"].to_numpy(), np.ones(len(rows))
    toxic = toxicity.fit(rows["text"].fillna("").tolist(), y, weight)
    assert toxic.scores(chunk(True)) == pytest.approx([brute.toxicity(toxic, t) for t in found])
    good = quality.fit(rows["text"].fillna("").tolist(), rows["quality"].to_numpy(), weight)
    assert good.scores(chunk(False)) == pytest.approx([brute.quality(good, t) for t in found], rel=1e-4)


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, "b c"), (3, " ")], "doc_id long, text string").withColumn("quality", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (quality.quality, toxicity.toxicity):
        assert run(docs, labels).count() == 5


def test_a_fit_holds_one_row_an_id(spark):
    """However often an id repeats, and no text beyond the bound."""
    from wayfarer.llm import labelled

    docs = spark.createDataFrame([(1, "b"), (1, "a")] * 500 + [(3, "c"), (5, "y" * 99), (7, "held out or not")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0)], "doc_id long, toxic int")
    rows = lambda t, y, w: sorted(zip(t, y.tolist(), strict=True))
    ids = [r["doc_id"] for r in labels.where(~labelled.held_out("doc_id")).collect()]
    want = sorted(t for i, t in ((1, ("a", 1)), (3, ("c", 0))) if i in ids)
    assert labelled.fitted(docs, labels, "toxic", 10, rows, longest=50) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [
        near_vectors.near_vectors(vecs), token_files.token_files(docs, WORDS), pieces.sampled_pieces_digest(docs, PIECES), near_text.near_text(docs), html_text.main_text(pages), quality.quality(docs, labels),
        ann.nearest_vectors(vecs), toxicity.toxicity(docs, labels), substring.repeated_spans(docs), substring.without_repeats(docs), packing.pack(docs, BYTES),
    ]
    assert [df.count() for df in made] == [0] * len(made)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])
