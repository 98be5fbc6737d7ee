"""License notices in documents, by diagonal voting of word k-grams.

1. Tasks hash all rolling word k-grams of every text: pairs for the base phrases,
   triples for the notices. Spark joins them to the positions of the templates.
2. A shared k-gram votes for a diagonal, its place in the document less its place in the
   template. Votes of one diagonal are a bitmap of template places, so rows that repeat
   vote once. On one diagonal a template spans at most its own length.
3. A base phrase stands where its diagonal has all votes. Of a notice, neighbouring
   diagonals are merged, as a word more or less moves the rest to the next one.
4. Only texts with candidates are read once more, found by a bitmap of fixed size. There
   phrases are compared word by word, and spans by local alignment with their template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import staged, texts
from wayfarer.llm.words import Words, bytes_of, sliding_hash, word_chunks

LETTERS = bytes_of((0x30, 0x39), (0x61, 0x7A))
#: Words of a k-gram in phrases and in notices.
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Hashes of a row that tasks hand to the join.
HANDED = 1 << 15
#: Diagonals at most so far apart belong to one span; an alignment may begin so many words before its span and end after it.
SLACK = 8
#: The share of a notice's k-grams that a span needs for being aligned at all.
VOTES = 0.2
#: Bits of the map of texts with candidates: 2 MB where all are used, whatever the number of texts.
MAP_BITS = 1 << 23
#: Votes of a bitmap word.
PLACES = 62

# The phrases of the base labels.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

# The wording of public license notices.
NOTICES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
)


def words_of(text: str) -> tuple[bytes, ...]:
    _, _, found = next(word_chunks(pa.array([text]), lower=True, inside=LETTERS))
    return tuple(found.list(0, len(found.start)))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase: bool
    numbers: dict[bytes, int] = field(hash=False, compare=False)

    @property
    def gram(self) -> int:
        return PHRASE_GRAM if self.phrase else NOTICE_GRAM

    @property
    def grams(self) -> np.ndarray:
        data = np.frombuffer(b" ".join(self.words), np.uint8)
        return sliding_hash(Words(data, np.array([0, len(data)]), inside=LETTERS).hashes(), self.gram)


def templates(phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[Template]:
    """Phrases, which count word by word, then notices, which count where most of their words stand."""
    out = []
    for phrase, named in ((True, phrases), (False, notices)):
        for label, text in named:
            words = words_of(text) if text else ()
            made = Template(label, words, phrase, {w: k for k, w in enumerate(dict.fromkeys(words))})
            if len(words) < made.gram:
                raise ValueError(f"the words of {label} are fewer than {made.gram}")
            out.append(made)
    return out


KEYED = "node long, same string"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of a text: what is found depends on the text alone, so rows may share a key if they share both.

    The id spreads the copies of one text over all tasks.
    """
    return texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")).alias("node"), F.md5(F.col("text").cast("binary")).alias("same"), "text")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, words in word_chunks(batch.column("text"), lower=True, inside=LETTERS):
            hashes = words.hashes()
            rows, at, parts = [], [], []
            for k in (PHRASE_GRAM, NOTICE_GRAM):
                # Runs that begin in one document and end in the next are left out.
                grams = sliding_hash(hashes, k).view(np.int64)
                for d in np.flatnonzero(np.diff(words.first) >= k).tolist():
                    first, end = int(words.first[d]), int(words.first[d + 1]) - k + 1
                    for a in range(first, end, HANDED):
                        rows.append(i + d)
                        at.append(a - first)
                        parts.append(grams[a : min(end, a + HANDED)])
            if rows:
                sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                named = batch.select(["node", "same"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*named.columns, pa.array(at, pa.int64()), pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(parts)))], names=["node", "same", "at", "grams"])


def positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """gram, template and place of each k-gram of the templates."""
    rows = [(int(g), n, p) for n, t in enumerate(known) for p, g in enumerate(t.grams.view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def diagonals(docs: DataFrame, known: list[Template]) -> DataFrame:
    """node, same, template, diagonal, votes: the k-grams that a document and a template share on a diagonal."""
    handed = docs.select("node", "same", "text").mapInArrow(_grams, f"{KEYED}, at long, grams array<long>")
    each = handed.select("node", "same", "at", F.posexplode("grams").alias("i", "gram"))
    # The templates are the operator's own parameter, so their size is known.
    shared = each.join(F.broadcast(positions(docs.sparkSession, known)), "gram")
    shared = shared.select("node", "same", "template", (F.col("at") + F.col("i") - F.col("place")).alias("diagonal"), "place")
    bits = shared.groupBy("node", "same", "template", "diagonal", F.floor(F.col("place") / PLACES).alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % PLACES)).alias("bits")
    )
    return bits.groupBy("node", "same", "template", "diagonal").agg(F.sum(F.bit_count("bits")).alias("votes"))


def candidates(voted: DataFrame, known: list[Template]) -> DataFrame:
    """node, same and places: (template, low, high) diagonals of whole phrases and of merged notices."""
    need = [(n, t.phrase, len(t.words) - t.gram + 1 if t.phrase else max(1, round(VOTES * (len(t.words) - t.gram + 1)))) for n, t in enumerate(known)]
    voted = voted.join(F.broadcast(voted.sparkSession.createDataFrame(need, "template int, phrase boolean, need long")), "template")
    whole = voted.where("phrase and votes = need").select("node", "same", "template", F.col("diagonal").alias("low"), F.col("diagonal").alias("high"))
    of = Window.partitionBy("node", "same", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of) > SLACK, F.lit(True))
    spans = voted.where("not phrase").withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(of))
    spans = spans.groupBy("node", "same", "template", "span", "need").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes")).where("votes >= need")
    both = whole.unionByName(spans.select("node", "same", "template", "low", "high"))
    return both.groupBy("node", "same").agg(F.collect_list(F.struct("template", "low", "high")).alias("places"))


def aligned(words: list[bytes], template: Template) -> tuple[int, int, int]:
    """Best local alignment of a template: score, first word and end; 1 for a word in common, -1 for one that differs, is more or is less.

    Of alignments with the same score, the one that ends first counts, and of those the
    one that begins last.
    """
    numbers = np.array([template.numbers.get(w, -1) for w in words], np.int64)
    n = len(numbers)
    place = np.arange(n + 1)
    score, begun = np.zeros(n + 1, np.int64), place.copy()
    best = (0, 0, 0)
    for word in template.words:
        # Score and first word are one number, so that maxima keep both.
        weight = n + 2
        held = score * weight + begun
        step = np.where(numbers == template.numbers[word], weight, -weight)
        now = held - weight
        now[1:] = np.maximum(now[1:], held[:-1] + step)
        now = np.maximum(now, place)
        now = np.maximum.accumulate(now + place * weight) - place * weight
        score, begun = now // weight, now % weight
        top = int(score.max())
        if top > best[0]:
            end = int(score.argmax())
            best = (top, int(begun[end]), end)
    return best


def settled_spans(words: Words, doc: int, places: list[dict], known: list[Template], least: float) -> tuple[list[tuple[int, str]], list[tuple[float, int, int, str]]]:
    """Places of whole phrases, and (share, first word, end, label) of the notices that a document has.

    Of notices that overlap by half of the shorter one, the one with more words in common counts.
    """
    start, end = int(words.first[doc]), int(words.first[doc + 1])
    phrases, found = [], []
    for p in places:
        t = known[p["template"]]
        if t.phrase:
            at = start + p["low"]
            if tuple(words.list(at, min(end, at + len(t.words)))) == t.words:
                phrases.append((p["low"], t.label))
            continue
        a, b = max(start, start + p["low"] - SLACK), min(end, start + p["high"] + len(t.words) + SLACK)
        score, first, stop = aligned(words.list(a, b), t)
        if score >= least * len(t.words):
            found.append((score, score / len(t.words), a - start + first, a - start + stop, t.label))
    kept: list[tuple[float, int, int, str]] = []
    for _, share, first, stop, label in sorted(found, key=lambda x: (-x[0], x[2:])):
        if all(2 * (min(stop, b) - max(first, a)) < min(stop - first, b - a) for _, a, b, _ in kept):
            kept.append((share, first, stop, label))
    return sorted(phrases), sorted(kept, key=lambda x: x[1:])


FOUND = f"{KEYED}, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,share:double>>"


def _verify(known: list[Template], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for i, j, words in word_chunks(batch.column("text"), lower=True, inside=LETTERS):
                for d, places in enumerate(batch.column("places").slice(i, j - i).to_pylist()):
                    phrases, spans = settled_spans(words, d, places, known, least)
                    base = {label for _, label in phrases}
                    out["n_base"].append(len(phrases))
                    out["first_word"].append(phrases[0][0] if phrases else None)
                    out["last_word"].append(phrases[-1][0] if phrases else None)
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | {s[3] for s in spans})))
                    out["score"].append(1.0 if phrases else max((s[0] for s in spans), default=0.0))
                    out["spans"].append([{"label": s[3], "first_word": s[1], "end_word": s[2], "share": s[0]} for s in spans])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))]
            columns = [pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(["node", "same"]).columns, *columns], names=["node", "same", *out])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.diff(words.first) for _, _, words in word_chunks(batch.column("text"), lower=True, inside=LETTERS)]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "node", "same"]).columns, pa.array(np.concatenate(n or [np.zeros(0)]).astype(np.int64))], names=["doc_id", "node", "same", "n_words"])


def _bit(of: Column) -> tuple[Column, Column]:
    at = F.pmod(of, F.lit(MAP_BITS).cast("long"))
    return F.call_function("div", at, F.lit(PLACES).cast("long")), (at % PLACES).cast("int")


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is among the wanted ones, and a few others; nothing is shuffled.

    The wanted keys are a bitmap of fixed size, so it may be broadcast; where it is
    full, all rows pass.
    """
    word, bit = _bit(F.xxhash64("node", "same"))
    one = F.lit(1).cast("long")
    bits = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("_bits"))
    held = docs.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return held.where(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(one) == 1).drop("_word", "_bits")


def license_scan(docs: DataFrame, known: list[Template] | None = None, least: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans: one row for each row of ``docs``.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. A base
    phrase counts wherever its words stand one after another; ``n_base`` counts the
    places, ``first_word`` and ``last_word`` are the smallest and largest word they
    begin at. ``labels`` adds those of notices of which a local alignment keeps
    ``least`` of the words (a word that differs, is more or is less takes one off);
    ``spans`` tells where. ``score`` is the best such share, 1 with a base phrase.

    Null and empty texts have no words and no labels. Each row is judged by its own
    text, so rows that repeat, share an id or have none get a row each. Other columns
    are ignored. No rows give no rows.
    """
    known = templates() if known is None else known
    plain = keyed(docs)
    found = staged(candidates(diagonals(plain, known), known), "candidates")
    read = among(plain.select("node", "same", "text"), found).dropDuplicates(["node", "same"])
    verified = staged(read.join(found, ["node", "same"]).mapInArrow(_verify(known, least), FOUND), "verified")
    sizes = plain.mapInArrow(_sizes, f"doc_id long, {KEYED}, n_words long")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return sizes.join(verified, ["node", "same"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast(dict(verified.dtypes)["spans"])).alias("spans"),
    )
