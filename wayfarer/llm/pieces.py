"""Sampled segmentations over a SentencePiece vocabulary, and their lossless decoding.

Spaces become the vocabulary's space mark, and pieces hold that mark at their front
only; nor do they hold both letters and ASCII punctuation. So a text falls into units
(spaces and a run of one kind after them) that are segmented on their own. Each distinct unit has a lattice: forward filtering sums the weights of
all ways to reach each place in it. Each occurrence then samples backwards: at its
end it draws the last piece in proportion to the weights, then the one before, and
so on. The draws come from a hash of the row's key, the unit's number in the text and
the step, so a row's segmentation is the same in any run and partitioning.

A character that is in no piece, and a literal space mark, are spelled in byte pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import texts
from wayfarer.llm.encoding import batches_of
from wayfarer.llm.words import mix

MARK = "▁"
_LATTICES: dict[tuple[str, float], Lattice] = {}


def _hashes(text: str | np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32) if isinstance(text, str) else text
    h = np.full(len(start), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[start + k] + np.uint64(1)
    return mix(h)


class Lattice:
    """One vocabulary in one process, with the lattices of the units met so far."""

    MOST = 2_000_000

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.byte = np.full(256, -1, np.int64)
        self.piece: dict[str, int] = {}
        self.text: list[bytes] = [b""] * model.vocab_size()
        weight = np.zeros(model.vocab_size())
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece[piece] = i
                self.text[i] = piece.replace(MARK, " ").encode()
            # The vocabulary is ordered by merges: a rank's weight falls as a power of it.
            weight[i] = -alpha * np.log(2.0 + i)
        self.weight = weight
        self.unit = self._units()
        # Hashes of all prefixes of pieces by length, and which of them are pieces.
        self.prefixes: list[tuple[np.ndarray, np.ndarray]] = []
        shown = {p.replace(MARK, " "): i for p, i in self.piece.items()}
        for n in range(1, max(map(len, shown)) + 1):
            cut = sorted({p[:n] for p in shown if len(p) >= n})
            h = _hashes("".join(cut), np.arange(len(cut)) * n, n)
            order = np.argsort(h)
            self.prefixes.append((h[order], np.array([shown.get(c, -1) for c in cut])[order]))
        self._forget()

    def _units(self) -> re.Pattern[str]:
        """Characters that pieces join with ASCII punctuation or digits go with these."""
        other = {chr(c) for c in range(128) if not chr(c).isalpha() and c != 32}
        pieces = [p.lstrip(MARK) for p in self.piece]
        while joined := {c for p in pieces if (x := set(p)) & other for c in x - other}:
            other |= joined
            if len(other) > 200:
                return re.compile(r" *[^ ]+| +")
        kind = "".join(map(re.escape, sorted(other)))
        return re.compile(rf" *(?:[^ {kind}]+|[{kind}]+)| +")

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.end = np.zeros(0, np.int64)  # each unit's last node
        self.low = np.zeros(1, np.int64)  # each node's first edge; edges lead back to `back`
        self.first = np.zeros(0, bool)  # nodes that begin a unit
        self.rise, self.ids, self.back = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Forward filtering of new units, all at the same time; nodes are numbered through."""
        flat = "".join(units)
        length = np.array([len(u) for u in units])
        ends = np.cumsum(length)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.repeat(ends, length)  # where each character's unit ends
        unit = np.repeat(np.arange(len(units)), length)
        start, found = np.flatnonzero(code != ord(MARK)), []
        literal = np.concatenate([[0], np.cumsum(code == ord(MARK))])
        for n, (known, ids) in enumerate(self.prefixes, 1):
            start = start[start + n <= stop[start]]
            start = start[literal[start + n] == literal[start]]
            if not len(start):
                break
            h = _hashes(code, start, n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            start, at = start[hit], at[hit]
            whole = ids[at] >= 0
            found.append((start[whole], start[whole] + n, ids[at[whole]]))
        back, to, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        # Characters that no piece spells alone have a way of their own, in bytes.
        alone = np.zeros(len(code), bool)
        alone[back[to == back + 1]] = True
        rare = np.flatnonzero(~alone)
        back, to = np.concatenate([back, rare]), np.concatenate([to, rare + 1])
        ids = np.concatenate([ids, -1 - code[rare].astype(np.int64)])
        of = unit[back]
        weight = np.where(ids >= 0, self.weight[np.maximum(ids, 0)], self.weight[-1])
        # A unit has one node more than characters.
        back, to = back + of, to + of
        level = to - (ends - length + np.arange(len(units)))[of]
        order = np.lexsort([back, to, level])
        forward = np.zeros(len(code) + len(units))
        share = np.zeros(len(to))
        cuts = np.searchsorted(level[order], np.arange(1, int(length.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            heads = np.flatnonzero(np.diff(to[at], prepend=-1))
            score = forward[back[at]] + weight[at]
            size = np.diff(np.append(heads, len(at)))
            top = np.maximum.reduceat(score, heads)
            part = np.exp(score - np.repeat(top, size))
            total = np.add.reduceat(part, heads)
            forward[to[at[heads]]] = top + np.log(total)
            run = np.cumsum(part)
            share[at] = (run - np.repeat(run[heads] - part[heads], size)) / np.repeat(total, size)
        order = np.lexsort([back, to])
        nodes, edges = len(self.first), len(self.ids)
        many = np.bincount(to, minlength=len(forward))
        self.low = np.concatenate([self.low[:-1], edges + np.cumsum(many) - many, [edges + len(to)]])
        self.rise = np.concatenate([self.rise, nodes + to[order] + share[order]])
        self.ids = np.concatenate([self.ids, ids[order]])
        self.back = np.concatenate([self.back, nodes + back[order]])
        self.first = np.concatenate([self.first, many == 0])
        self.end = np.concatenate([self.end, nodes + ends + np.arange(len(units))])
        for u in units:
            self.number[u] = len(self.number)
        self.chars += len(flat)

    def sample(self, text: str, key: int) -> np.ndarray:
        return self.samples([text], [key])[0]

    def samples(self, found: list[str], keys: list[int]) -> list[np.ndarray]:
        if self.chars > self.MOST:
            self._forget()
        parts = [self.unit.findall(t) for t in found]
        seen: set[str] = set()
        seen.update(*parts)
        if new := list(seen.difference(self.number)):
            self._learn(new)
        size = np.array([len(p) for p in parts])
        at = np.fromiter((self.number[u] for p in parts for u in p), np.int64, int(size.sum()))
        # One stream of draws for each occurrence: (key of the row, number of the unit).
        within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        seed = mix(np.repeat(np.array(keys, np.int64).view(np.uint64), size) + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # Occurrences of one unit are drawn next to each other, so that searches stay near.
        node, live, steps = self.end[at], np.argsort(at, kind="stable"), []
        t = 0
        while len(live):
            draw = (mix(seed[live] + np.uint64(t * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(11)) * 2.0**-53
            here = node[live]
            # Each node's shares rise to node + 1, so one search serves all.
            edge = np.searchsorted(self.rise, here + draw, "right")
            edge = np.clip(edge, self.low[here], self.low[here + 1] - 1)
            steps.append((live, self.ids[edge]))
            node[live] = self.back[edge]
            live = live[~self.first[node[live]]]
            t += 1
        occurrence, ids = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 2
        # Steps were drawn from the end, so later steps come first within an occurrence.
        step = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        many = np.bincount(occurrence, minlength=len(at))
        ends = np.cumsum(many)
        drawn = np.empty(len(ids), np.int64)
        drawn[ends[occurrence] - 1 - step] = ids
        ids, bounds = drawn, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].astype(np.int64)
        return [self._bytes(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Spell characters that no piece covers."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.uint32)
        out, at = [], 0
        for i in odd:
            out += [ids[at:i], self.byte[list(chr(-1 - ids[i]).encode())]]
            at = i + 1
        return np.concatenate([*out, ids[at:]]).astype(np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).decode()


def lattice(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


ENCODED = "doc_id long, n_pieces long, ids array<int>, lossless boolean"


def _encode(path: str, alpha: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lattice(path, alpha)
        for batch in batches:
            ids, found, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text", "key"))
            for i, j in batches_of(found):
                drawn = code.samples(found[i:j], keys[i:j])
                same = [code.decode(x) == t for x, t in zip(drawn, found[i:j], strict=True)]
                rest = [pa.array([x.astype(np.int32) for x in drawn], pa.list_(pa.int32()))] if with_ids else [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in drawn], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([len(x) for x in drawn], pa.int64()), *rest, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids" if with_ids else "ids_crc32", "lossless"])

    return run


def _plan(docs: DataFrame, seed: int) -> DataFrame:
    return texts(docs).select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id").alias("key"))


def sampled_pieces(docs: DataFrame, model: str, alpha: float = 1.5, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids and lossless: one sampled segmentation for each row.

    A piece's weight falls as its rank to the power -alpha, so a greater alpha comes
    closer to the shortest spelling. The same seed and doc_id give the same draws.
    ``lossless`` tells that the ids decode to exactly the text. Null and empty texts
    have no pieces. Rows with null ids share one key, and so do rows that repeat an
    id. Other columns are ignored. No rows give no rows.
    """
    return _plan(docs, seed).mapInArrow(_encode(model, alpha, True), ENCODED)


def sampled_pieces_digest(docs: DataFrame, model: str, alpha: float = 1.5, seed: int = 0) -> DataFrame:
    """Like ``sampled_pieces`` with an unsigned crc32 of the ids instead of the ids."""
    return _plan(docs, seed).mapInArrow(_encode(model, alpha, False), ENCODED.replace("ids array<int>", "ids_crc32 long"))


def decoded(pieces: DataFrame, model: str, alpha: float = 1.5) -> DataFrame:
    """doc_id and text of rows with ids; null ids decode to a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lattice(model, alpha)
        for batch in batches:
            found = [None if x is None else code.decode(np.array(x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return pieces.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
