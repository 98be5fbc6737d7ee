"""Plain, slow versions of the operators, for small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def upper_to_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def groups(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def near_text(docs: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id)"""
    sets = {}
    for i, t in docs:
        w = WORD.findall(upper_to_lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = groups(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def substring(docs: list[tuple], window: int = 50) -> dict:
    """doc_id -> (n_words, n_removed, kept_sha256)"""
    words = {i: WORD.findall(t or "") for i, t in docs}
    least: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def token_ids(texts: list[str], path: str, end: int) -> list[np.ndarray]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.array(e.ids + [end], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def packed_right(rows: list[tuple], ids: dict[int, np.ndarray], capacity: int = 1024) -> int:
    """Check (doc_id, piece, start, length, crc, sequence_id, offset) rows; how many sequences."""
    by_doc: dict[int, list] = {}
    by_sequence: dict[int, list] = {}
    for r in sorted(rows):
        by_doc.setdefault(r[0], []).append(r[1:])
        by_sequence.setdefault(r[5], []).append((r[6], r[3]))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for k, (piece, start, n, digest, _, _) in enumerate(pieces):
            assert (piece, start) == (k, at) and 0 < n <= capacity
            assert k == 0 or n == capacity
            assert digest == crc(ids[i][at : at + n])
            at += n
        assert at == len(ids[i]) and (len(ids[i]) > capacity or len(pieces) == 1)
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def near_vectors(rows: list[tuple], least: float = 0.95) -> dict:
    """vec_id -> (n_links, component_id)"""
    fine = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= least]
    comp = groups([i for i, _ in rows], links)
    return {i: (sum(i in x for x in links), comp[i]) for i, _ in rows}


def segmentations(text: str, pieces: dict[str, int]) -> list[tuple[int, ...]]:
    """All ways to spell a text in pieces."""
    if not text:
        return [()]
    return [(pieces[text[:n]], *rest) for n in range(1, len(text) + 1) if text[:n] in pieces for rest in segmentations(text[n:], pieces)]


def toxicity(model, text: str) -> float:
    """Scores word by word and stretch by stretch."""
    from wayfarer.llm.toxicity import BUCKETS, WIDTHS
    from wayfarer.llm.words import bytes_hash, mix

    marks = {c for c in range(128) if c in range(33, 48) or c in range(58, 65) or c in range(91, 97) or c in range(123, 127)}
    logits = []
    for word in WORD.findall(upper_to_lower(text)):
        w = word.encode()
        for _ in range(3):
            if len(w) > 1 and w[0] in marks:
                w = w[1:]
            if len(w) > 1 and w[-1] in marks:
                w = w[:-1]
        w = b"\x02" + w + b"\x03"
        whole = np.frombuffer(w, np.uint8)
        found = [int(bytes_hash(whole, np.array([0]), np.array([len(w)]))[0])]
        for k in range(3, 7):
            found += [int(mix(np.array([int.from_bytes(w[i : i + k], "little") + (k << 56)], np.uint64))[0]) for i in range(len(w) - k + 1)]
        logits.append(np.mean([model.share[h % BUCKETS] for h in found]))
    if not logits:
        return model.empty
    views = [max(np.mean(logits[i : i + n]) for i in range(max(1, len(logits) - n + 1))) for n in WIDTHS] + [np.mean(logits)]
    return 1 / (1 + np.exp(-(model.bias + np.dot(views, model.mix))))


def quality(model, text: str) -> float:
    """Pools a document's two streams and passes them through both layers."""
    from wayfarer.llm.quality import _index, tokens
    from wayfarer.llm.words import Words

    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    if not len(words.start):
        return model.prior
    x = []
    for (known, table), stream in zip(model.vectors.streams, tokens(words), strict=True):
        vectors = [table[list(known).index(h)] if h in known else 0.5 * _index(np.array([h]))[0] for h in stream]
        x += [np.mean(vectors, axis=0), np.std(vectors, axis=0)]
    x = np.concatenate([*x, [np.log1p(len(words.start))]])
    a, b, c, d = model.layers
    hidden = np.maximum((x - model.scale[0]) / model.scale[1] @ a + b, 0)
    return 1 / (1 + np.exp(-np.clip((hidden @ c + d) / model.temperature, -30, 30)))


def whitened(rows: list[tuple], components: int = 8) -> dict:
    """(vec_id, component) -> (n, deviation, |whitened|, explained), all vectors of one length."""
    fine = {i: v for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in fine.values()]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    far = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k in range(min(components, int((values > 1e-12 * values[0]).sum()))):
        for i, d, w in zip(fine, far, np.abs(y @ vectors[:, k]) / np.sqrt(values[k]), strict=True):
            out[i, k + 1] = (n, d, w, values[k] / values.sum())
    return out


def source_divergence(rows: list[tuple], least: int = 10, top: int = 10) -> set[tuple]:
    """All (lang, source, part, item, value, rank) of (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        terms = [(s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", upper_to_lower(t))) for x, s, t in rows if x == lang]
        kept = {w for _, ws in terms for w in ws if sum(w in other for _, other in terms) >= least}
        count = {s: dict.fromkeys(kept, 0) for s, _ in terms}
        for s, ws in terms:
            for w in ws:
                if w in kept:
                    count[s][w] += 1
        whole = {w: sum(c[w] for c in count.values()) for w in kept}
        shares = lambda c: {w: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(c)) for w, n in c.items()}
        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in count if o != s]
            found = [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", found)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top}
    return out


def license_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", upper_to_lower(text))


def license_base(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels) of each row."""
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    out = []
    for i, text in rows:
        w = license_words(text or "")
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        out.append((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))))
    return out


def local_alignment(words: list[str], template: list[str]) -> int:
    """The best score of 1 a word in common and -1 for any other step."""
    before, best = [0] * (len(words) + 1), 0
    for t in template:
        now = [0]
        for j, w in enumerate(words):
            now.append(max(0, before[j] + (1 if w == t else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, *now), now
    return best
