"""Token ids of whole texts, encoding each distinct stretch of text once.

Both kinds of vocabulary end a token wherever white space follows other text, and
between a letter and punctuation. So a text falls into stretches whose ids, one
after another, are the text's. Stretches are found and hashed with numpy, about a MB of
text at a time, of long texts too; only those not met before go to the tokenizer,
words of letters many in one call, told apart by the mark that the vocabulary puts at
each word's end or beginning. A hash only finds a stretch: its bytes are compared.

Texts are first split at the names of the vocabulary's added tokens, as the library
does by default: each name is that token, and what lies between is encoded by itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wayfarer.llm.words import CHUNK_BYTES, LONG, Words, bytes_hash, column, lowered, ragged, same_bytes, split_rows

_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Last two or three UTF-8 bytes of white space beyond ASCII (fixed values of Unicode).
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE2, _WIDE3 = ([int.from_bytes(b, "big") for b in _WIDE if len(b) == n] for n in (2, 3))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _ends_in_letter(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """ASCII letters, and those of two bytes that begin with 0xC3 (Latin-1)."""
    last, before = data[end - 1], data[np.maximum(end - 2, 0)]
    return _LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))


def stretches(words: Words, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the stretches, and the first stretch of each document.

    Where white space counts (``spaced``) a stretch begins with that before it. Of
    rarer kinds of white space, which regex engines tell apart differently, none is
    ever a stretch's border.
    """
    data, start, end = words.data, words.start, words.end
    stop = end.copy()
    for _ in range(3):
        stop -= _STOPS[data[stop - 1]] & (stop - start > 1)
    cut = (stop < end) & _ends_in_letter(data, stop)
    if not spaced:
        starts = np.sort(np.concatenate([start, stop[cut]]))
        ends = np.sort(np.concatenate([end, stop[cut]]))
        return starts, ends, np.searchsorted(starts, words.offsets)
    whole = data[end - 1] > 0x20
    beyond = np.flatnonzero(data[end - 1] >= 0x80)
    tails = sum(data[np.maximum(end[beyond] - 1 - k, 0)].astype(np.int64) << (8 * k) for k in range(3))
    whole[beyond[np.isin(tails, _WIDE3) | np.isin(tails & 0xFFFF, _WIDE2)]] = False
    borders = np.unique(np.concatenate([words.offsets, end[whole], stop[cut]]))
    starts, ends = borders[:-1], borders[1:]
    return starts, ends, np.searchsorted(starts, words.offsets)


class Encoder:
    """One vocabulary in one process, with the ids of the stretches met so far."""

    #: Remembered stretches, some 60 bytes each; beyond it the memory starts anew.
    MOST = 300_000

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        for t in added.values():
            if t.normalized or t.lstrip or t.rstrip or t.single_word or not t.content or any(c.isspace() for c in t.content):
                raise ValueError(f"added token {t.content!r} of {path} is matched in a way that isn't supported")
        # Stretches never hold a name as it is written, but lower-casing may make one.
        self.tokenizer.encode_special_tokens = True
        self.added = {t.content.encode(): n for n, t in enumerate(added.values())}
        self.added_ids = np.array(list(added), np.uint32)
        longest = sorted(self.added, key=len, reverse=True)
        self.names = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.spaced = spaced
        tokens = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(tokens.values()) + 1, bool)
        for token, i in tokens.items():
            self.edge[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes and their numbers. The first numbers are those of the added tokens.
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.used = len(self.added_ids)
        self.flat = np.concatenate([self.added_ids, np.zeros(1 << 16, np.uint32)])
        self.start, self.length = np.arange(self.used), np.ones(self.used, np.int32)
        # The stretches' own bytes, one after another, and where each one's begin.
        self.bytes, self.filled = np.zeros(1 << 18, np.uint8), 0
        self.place, self.size = np.zeros(self.used, np.int64), np.zeros(self.used, np.int64)

    def _simple(self, s: str) -> bool:
        """One word of letters, behind one space where white space counts."""
        if self.spaced:
            return s[:1] == " " and s[1:].isalpha()
        return s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha())

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these stretches, and how many each of them has."""
        simple = np.fromiter(map(self._simple, texts), bool, len(texts))
        order, ids, lengths, glue = [], [], [], "" if self.spaced else " "
        at, others = np.flatnonzero(simple), [np.flatnonzero(~simple)]
        for i in range(0, len(at), 10_000):
            lines = [at[k : k + 100] for k in range(i, min(i + 10_000, len(at)), 100)]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([glue.join([texts[k] for k in x]) for x in lines], add_special_tokens=False), strict=True):
                x = np.array(e.ids, np.uint32)
                edge = np.flatnonzero(self.edge[x])
                size = np.diff(edge, append=len(x)) if self.spaced else np.diff(edge, prepend=-1)
                if len(size) == len(line) and size.sum() == len(x):
                    order.append(line)
                    ids.append(x)
                    lengths.append(size)
                else:  # a letter here that the vocabulary's own rules don't take for one
                    others.append(line)
        rest = np.concatenate(others)
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)]
            order.append(part)
            ids.append(np.array([x for f in found for x in f], np.uint32))
            lengths.append(np.array([len(f) for f in found], np.int64))
        order_, flat, length = np.concatenate(order), np.concatenate(ids), np.concatenate(lengths)
        back = np.argsort(order_)
        begin = np.cumsum(length) - length
        return flat[ragged(begin[back], length[back])], length[back]

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
        """The number of each stretch, after learning those not met before.

        Stretches that are too long to remember, and those whose hash is another one's,
        have none; these follow with their ids.
        """
        h, at, inverse = np.unique(bytes_hash(data, start, end), return_index=True, return_inverse=True)
        size = (end - start)[at]
        place = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        number = np.where(self.known[place] == h, self.number[place], -1).astype(np.int64) if len(self.known) else np.full(len(h), -1, np.int64)
        met = np.flatnonzero(number >= 0)
        mine = number[met]
        other = met[(self.size[mine] != size[met]) | ~same_bytes(data, start[at[met]], self.bytes, self.place[mine], size[met])]
        lost = np.flatnonzero((number < 0) & (size <= LONG))
        if len(lost):
            self._learn(h[lost], data, start[at[lost]], end[at[lost]])
            number[lost] = len(self.start) - len(lost) + np.arange(len(lost))
        number[other] = -1
        one = at[inverse]
        odd = (number[inverse] < 0) | (end - start != size[inverse]) | ~same_bytes(data, start, data, start[one], end - start)
        number = number[inverse]
        number[odd] = -1
        rest = np.flatnonzero(odd).tolist()
        return number, rest, [np.array(self.tokenizer.encode(data[start[k] : end[k]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for k in rest]

    def _learn(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = data.tobytes()
        ids, length = self._ids([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        size = end - start
        own = data[ragged(start, size)]
        self.flat = _room(self.flat, self.used + len(ids))
        self.bytes = _room(self.bytes, self.filled + len(own))
        self.flat[self.used : self.used + len(ids)] = ids
        self.bytes[self.filled : self.filled + len(own)] = own
        first = len(self.start)
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.place = np.concatenate([self.place, self.filled + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used, self.filled = self.used + len(ids), self.filled + len(own)
        at = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, at, h)
        self.number = np.insert(self.number, at, first + np.arange(len(h), dtype=np.int32))

    def _named(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges of the added tokens' names in the texts, and the number of each."""
        found: list[tuple[int, int, int]] = []
        raw = data.tobytes()
        hits = [m.span() for m in self.names.finditer(raw)] if self.names else []
        if hits:
            # A hit may reach over a text's end, so texts with hits are searched one by one.
            first, last = (np.searchsorted(offsets, [h[k] - k for h in hits], "right") - 1 for k in (0, 1))
            for d in np.unique(ragged(first, last - first + 1)).tolist():
                found += [(m.start(), m.end(), self.added[m.group()]) for m in self.names.finditer(raw, int(offsets[d]), int(offsets[d + 1]))]
        at = np.array(found, np.int64).reshape(-1, 3)
        return at[:, 0], at[:, 1], at[:, 2]

    def encode(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Ids of each text of a string column, in runs of about a MB; nulls are empty."""
        data, offsets = column(texts)
        bounds, row = _cut(data, offsets)
        held: list[np.ndarray] = []
        for i, j in split_rows(np.diff(bounds)):
            if len(self.start) > self.MOST:
                self._forget()
            done = []
            for k, ids in enumerate(self._encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]), i):
                held.append(ids)
                if row[k + 1] > row[k]:  # the next part is another text's
                    done.append(held[0] if len(held) == 1 else np.concatenate(held))
                    held = []
            if done:
                yield done

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        name, name_end, token = self._named(data, bounds)
        part = data if self.spaced else lowered(data)  # the other kind lower-cases
        words = Words(part, np.unique(np.concatenate([bounds, name, name_end])) if len(name) else bounds)
        start, end, first = stretches(words, self.spaced)
        number, rest, ids_of_rest = np.zeros(0, np.int64), [], []
        if len(name):
            inside = np.searchsorted(name, start, "right") - 1
            plain = (inside < 0) | (start >= name_end[inside])
            keep = plain | np.isin(start, name)
            start, end, inside, plain = start[keep], end[keep], inside[keep], plain[keep]
            number = np.empty(len(start), np.int64)
            number[~plain] = token[inside[~plain]]
            if plain.any():
                number[plain], rest, ids_of_rest = self._numbers(part, start[plain], end[plain])
                rest = np.flatnonzero(plain)[rest].tolist()
            first = np.searchsorted(start, bounds)
        elif len(start):
            number, rest, ids_of_rest = self._numbers(part, start, end)
        n = np.where(number < 0, 0, self.length[number]).astype(np.int64)
        from_, at = self.start[number], np.arange(len(n))
        flat = self.flat
        if rest:  # ids of stretches without a number stand behind the remembered ones
            n[rest] = [len(x) for x in ids_of_rest]
            from_[rest] = len(flat) + np.cumsum(n[rest]) - n[rest]
            flat = np.concatenate([flat, *ids_of_rest])
        ids = flat[ragged(from_, n)]
        ends = np.concatenate([[0], np.cumsum(n)])[first]
        return [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts and of parts of long ones; which text begins at or before each.

    A text is cut where one space follows a printable ASCII byte, which every
    vocabulary takes for a border and no added token's name holds.
    """
    cuts = []
    for i in np.flatnonzero(np.diff(offsets) > 2 * CHUNK_BYTES):
        at, end = offsets[i] + CHUNK_BYTES, offsets[i + 1]
        while at < end:
            before, here = data[at - 1 : at + CHUNK_BYTES - 1], data[at : min(at + CHUNK_BYTES, end)]
            good = np.flatnonzero((here == 0x20) & (before[: len(here)] > 0x20) & (before[: len(here)] < 0x7F))
            if len(good):
                cuts.append(at + good[0])
            at += CHUNK_BYTES
    bounds = np.concatenate([offsets, np.array(cuts, np.int64)])
    order = np.argsort(bounds, kind="stable")
    return bounds[order], np.cumsum(order < len(offsets)) - 1


def encoder(path: str, spaced: bool) -> Encoder:
    """This process's encoder for a vocabulary file that every executor has."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def batches_of(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about so many characters."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= chars):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j
