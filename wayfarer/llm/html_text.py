"""Main text of web pages from gradient-boosted trees over their DOM nodes.

Each block and each run of text in it gets features: tag, depth, place among its
siblings, density and links of its subtree, and the tokens of its attributes and of
those around it. What a token says is learned: the log-odds of main text below elements
that bear it, for training pages from the other half of these. Boosted trees turn the
features into the odds that a node holds main text.
Decoding is hierarchical: a node can be kept only if all its ancestors are, so the
best such choice over the whole tree is taken, from the leaves up and back down.

Tokens and trees are trained, in a task, on pages drawn from a seeded generator of
common layouts, whose blocks are known to be main text or not.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm.boosting import Trees
from wayfarer.llm.dom import TAGS, Page, parse

_PUNCT = str.maketrans("", "", ".,;:!?")
PAGES = 1600
#: Where fewer than SHORT characters are kept, all log-odds are raised by these, in turn, until DENSE more are.
MARGINS, SHORT, DENSE = (1.0, 2.0, 3.0), 100, 160
TREES = 100
#: What a block's log-odds gain if one of the same tag beside it is kept.
BESIDE = 1.0


def token_weights(pages: list[Page], good: list[np.ndarray]) -> dict[str, float]:
    """How much each attribute token leans to main text: smoothed log-odds against all elements' own."""
    counts: dict[str, list[int]] = {}
    total = [1, 1]
    for page, is_good in zip(pages, good, strict=True):
        for tokens, g in zip(page.tokens, is_good, strict=True):
            for t in tokens:
                counts.setdefault(t, [0, 0])[int(g)] += 1
                total[int(g)] += 1
    base = np.log(total[1] / total[0])
    return {t: float((np.log((g + 0.5) / (b + 0.5)) - base) * (g + b) / (g + b + 6)) for t, (b, g) in counts.items() if g + b > 1}


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from 0 on; found by one sort, so that deep pages cost no more than others."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def features(pages: list[Page], weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of some pages, their parents and depths, which runs are
    their block's only child, and the first node of each page."""
    size = np.array([len(p.tag) for p in pages])
    first = np.cumsum(size) - size
    shift = np.repeat(first, size)
    flat = lambda name: np.array([v for p in pages for v in getattr(p, name)], np.int64)
    tag, depth, controls, link = flat("tag"), flat("depth"), flat("controls"), flat("link")
    parent = flat("parent")
    top = parent < 0
    parent = np.where(top, np.arange(len(tag)), parent + shift)
    end = flat("end") + shift
    leaning = [[weights.get(t, 0.0) for t in ts] for p in pages for ts in p.tokens]
    outside = np.array([-sum(w for w in ws if w < 0) for ws in leaning])
    inside = np.array([sum(w for w in ws if w > 0) for ws in leaning])
    own = [" ".join(o) for p in pages for o in p.own]
    chars = np.array([len(o) for o in own], np.float64)
    marks = chars - np.array([len(o.translate(_PUNCT)) for o in own])
    words = np.array([o.count(" ") + 1 if o else 0 for o in own], np.float64)
    rights = np.array(["©" in o for o in own], np.float64)
    at = np.arange(len(tag))
    is_leaf = tag == TAGS.index("#text")
    p_tag = tag == TAGS.index("p")

    def below(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(v)])
        return total[end] - total[at]

    nodes, text, links = (end - at).astype(np.float64), below(chars), below(np.minimum(link, chars))
    page = np.repeat(text[first], size) if len(size) else text
    runs = below(is_leaf)
    # Ancestors come before their descendants, so marks are handed down level by level.
    from_out, from_in = outside.copy(), inside.copy()
    named = {n: (tag == TAGS.index(n)).astype(np.float64) for n in ("nav", "header", "footer", "aside", "form", "article", "main", "ul")}
    over = {n: v.copy() for n, v in named.items()}
    for here in levels(depth)[1:]:
        up = parent[here]
        from_out[here] += from_out[up]
        from_in[here] += from_in[up]
        for v in over.values():
            v[here] = np.maximum(v[here], v[up])
    # Siblings follow each other: the next one begins where this one ends.
    child = ~top
    brood = np.bincount(parent[child], minlength=len(tag))
    order = np.lexsort([at, np.where(top, -1 - at, parent)])
    rank = np.empty(len(tag), np.int64)
    group = np.where(top, -1 - at, parent)[order]
    heads = np.flatnonzero(np.diff(group, prepend=np.iinfo(np.int64).min)) if len(group) else np.zeros(0, np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    before, after = np.zeros(len(tag)), np.zeros(len(tag))
    same = group[1:] == group[:-1]
    before[order[1:][same]], after[order[:-1][same]] = text[order[:-1][same]], text[order[1:][same]]
    siblings = np.where(top, 1, brood[parent]).astype(np.float64)
    log = np.log1p
    length, marks_below, words_below = np.maximum(text, 1), below(marks), np.maximum(below(words), 1)
    out = [
        depth, siblings, rank, rank / siblings, brood, log(nodes), log(text), text / np.maximum(page, 1), links / length, text / nodes, log(text / np.maximum(runs, 1)),
        marks_below / length, text / words_below, below(p_tag), below(p_tag) / nodes, controls, below(controls), outside, inside, from_out, from_in, below(outside) / nodes, below(rights), log(before), log(after),
        text / np.maximum(text[parent], 1), links[parent] / np.maximum(text[parent], 1), (text[parent] - text) / np.maximum(siblings - 1, 1), tag[parent], from_out - outside, page, first.repeat(size) * 0 + at - shift,
    ]
    out += [tag == k for k in range(len(TAGS) + 1)] + list(over.values())
    sole = is_leaf & (siblings == 1)
    return np.stack(out, axis=1).astype(np.float64), parent, depth, sole, first


def decode(logit: np.ndarray, parent: np.ndarray, depth: np.ndarray, sole: np.ndarray) -> np.ndarray:
    """The likeliest choice in which nothing is kept below what is not."""
    value, steps = np.where(sole, 0.0, logit), levels(depth)
    for here in reversed(steps[1:]):
        np.add.at(value, parent[here], np.maximum(value[here], 0))
    keep = np.where(depth == 0, value > 0, False)
    for here in steps[1:]:
        keep[here] = keep[parent[here]] & ((value[here] > 0) | sole[here])
    return keep


class _Drawn:
    """Pages of common layouts; text within marks \\x01 and \\x02 is main text.

    Of a page, either classes and ids mostly say what they are for, or all of them are
    words without meaning, or there are none.
    """

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.naming = "telling"
        self.vocabulary = ["".join(self.r.choices("abcdefghijklmnoprstuvzéüñ", k=self.r.randrange(1, 10))) for _ in range(800)]

    def one(self, *options):
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        out, left = [], self.r.randint(low, high)
        while left > 0:
            n = min(left, self.r.randrange(1, 18))
            out.append(self.words(n, n).capitalize() + self.one(".", ".", ".", "?", "!"))
            left -= n
        return " ".join(out)

    def attr(self, *names: str) -> str:
        if self.naming == "none":
            return ""
        if self.naming == "meaningless" or self.chance(0.12):
            return f' class="{self.words(1, 1)}"'
        kind = self.one("class", "class", "id")
        return f' {kind}="{self.one(*names)}{self.one("", "", " " + self.words(1, 1), "-" + self.one("wrap", "box", "inner", "1"))}"'

    def links(self, low: int = 2, high: int = 10) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        return self.one("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")

    def block(self, tag: str, names: tuple[str, ...], inner: str, bare: float = 0.1) -> str:
        return f"<{tag}{'' if self.chance(bare) else self.attr(*names)}>{inner}</{tag}>"

    def nav(self) -> str:
        return self.one(f"<nav>{self.links()}</nav>", self.block(self.one("div", "nav", "ul"), ("nav", "menu", "navbar", "breadcrumb", "main-menu"), self.links()))

    def header(self) -> str:
        inner = self.one(f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.prose(2, 10)}</p>", self.words(1, 6)) + (self.nav() if self.chance(0.4) else "")
        return self.one(f"<header>{inner}</header>", self.block("div", ("header", "masthead", "site-header", "top"), inner))

    def ad(self) -> str:
        inner = self.one(self.prose(3, 30), f"<p>{self.prose(3, 30)}</p>", f'<a href="#">{self.prose(2, 14)}</a>')
        return self.block(self.one("div", "div", "section", "aside"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), inner, 0)

    def notice(self) -> str:
        inner = f"<p>{self.prose(6, 40)}</p>" + self.one("", "<button>ok</button>", f'<a href="#">{self.words(1, 2)}</a>')
        return self.block(self.one("div", "section", "aside"), ("cookie", "notice", "cookie-notice", "consent", "alert", "gdpr", "cookie-banner", "popup", "modal", "overlay"), inner, 0)

    def hidden(self) -> str:
        inner = self.one(self.prose(3, 40), f"<p>{self.prose(3, 40)}</p>")
        return self.one(f"<div hidden>{inner}</div>", f'<div style="display: none">{inner}</div>', f'<p aria-hidden="true">{self.prose(2, 12)}</p>')

    def form(self) -> str:
        inner = self.one("", f"<label>{self.words(1, 5)}</label>", f"<p>{self.prose(3, 20)}</p>", self.prose(2, 10)) + "<input type=text>" + self.one(f"<button>{self.words(1, 2)}</button>", "<input type=submit>")
        return self.one(f"<form>{inner}</form>", self.block("div", ("newsletter", "subscribe", "search", "signup"), f"<form>{inner}</form>", 0))

    def aside(self) -> str:
        inner = "".join(self.one(f"<h3>{self.words(1, 4)}</h3>" + self.links(), f"<p>{self.prose(5, 60)}</p>", self.ad(), f"<div>{self.prose(5, 40)}</div>") for _ in range(self.r.randrange(1, 4)))
        return self.one(f"<aside>{inner}</aside>", self.block("div", ("sidebar", "side", "widget", "related", "sidebar-right"), inner, 0))

    def comments(self) -> str:
        text = lambda: self.one(f"<p>{self.prose(2, 90)}</p>", self.prose(2, 90))
        said = lambda: self.one(f"<b>{self.words(1, 2)}</b>: {self.prose(2, 60)}", f"{self.words(1, 2).title()}: {self.prose(2, 60)}", f"<p>{self.words(1, 2).title()}: {self.prose(2, 60)}</p>")
        if self.naming == "telling":
            kinds = (lambda: f'<div class="{self.one("comment", "reply", "comment-body")}">{text()}</div>', lambda: f"<li>{self.words(1, 2)} {text()}</li>", lambda: f"<article class=comment>{text()}</article>")
        else:
            kinds = (lambda: f"<div>{said()}</div>", lambda: f"<li>{said()}</li>", lambda: f"<div{self.attr('x')}>{said()}</div>")
        kind = self.one(*kinds)
        each = [kind() for _ in range(self.r.randrange(1, 7))]
        inner = self.one("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>") + "".join(each)
        return self.block(self.one("div", "section", "ol", "ul"), ("comments", "comment-list", "replies", "responses", "disqus"), inner, 0)

    def footer(self) -> str:
        inner = self.one(f"&copy; {self.words(1, 3)} &middot; {self.prose(2, 30)}", f"<p>&copy; {self.prose(2, 30)}</p>", self.links(), f"<p>{self.prose(2, 40)}</p>", f"<p>{self.prose(4, 30)}</p>{self.links(1, 5)}")
        return self.one(f"<footer>{inner}</footer>", self.block("div", ("footer", "site-footer", "legal", "copyright"), inner, 0))

    def main(self) -> str:
        mark = lambda s: f"\x01{s}\x02"
        parts = [f"<h1>{mark(self.words(2, 12))}</h1>"] if self.chance(0.8) else []
        for _ in range(self.r.randrange(1, 16)):
            text = mark(self.prose(1, self.one(8, 40, 120)))
            kind = self.r.random()
            if kind < 0.6:
                more = mark(self.prose(4, 60))
                parts.append(self.one(f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}<br><br>{more}</p>", f"{text}<br><br>{more}<br>", f"<p>{text} <a href=x>{mark(self.words(1, 3))}</a> {mark(self.words(1, 8))}</p>", f"<p>{text}"))
            elif kind < 0.68:
                parts.append(f"<h2>{mark(self.words(1, 8))}</h2>")
            elif kind < 0.75:
                parts.append("<ul>" + "".join(f"<li>{mark(self.prose(1, 20))}</li>" for _ in range(self.r.randrange(1, 6))) + "</ul>")
            elif kind < 0.8:
                parts.append(self.one(f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>"))
            elif kind < 0.84:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randrange(1, 5))) + "</table>")
            elif kind < 0.9:
                parts.append(self.one(f"<div>{text}</div>", f"<section><h2>{mark(self.words(1, 5))}</h2><p>{text}</p></section>", text))
            else:
                parts.append(self.one(self.ad, self.form, self.aside, self.notice, self.hidden, lambda: self.block("div", ("share", "social", "related", "tags", "recommended", "pagination", "breadcrumb"), self.links(1, 5), 0))())
        inner = "".join(parts)
        return self.one(f"<article>{inner}</article>", f"<article>{inner}</article>", self.block(self.one("div", "main", "section"), ("article", "content", "post", "entry-content", "story", "main", "text", "post-body"), inner, 0.1))

    def laid_out(self, parts: list[str], middle: str) -> str:
        """A table whose cells are the page's parts."""
        cells = [f"<td{self.attr('cell', 'col')}>{x}</td>" for x in parts]
        cells.insert(self.r.randint(0, len(cells)), f"<td>{middle}</td>")
        return "<table>" + self.one("<tr>" + "".join(cells) + "</tr>", "".join(f"<tr>{c}</tr>" for c in cells)) + "</table>"

    def page(self) -> str:
        self.naming = self.r.choices(("telling", "meaningless", "none"), (6, 3, 1))[0]
        before = [f() for f in (self.header, self.nav, self.notice, self.ad) if self.chance(0.5)]
        after = [f() for f in (self.aside, self.comments, self.form, self.ad, self.hidden, self.footer) if self.chance(0.45)]
        self.r.shuffle(before)
        middle = self.main() if self.chance(0.97) else ""
        if self.chance(0.35):
            take = self.r.randint(0, len(after))
            middle = self.block(self.one("div", "main"), ("wrapper", "container", "page", "main", "content"), middle + "".join(after[:take]), 0.2)
            after = after[take:]
        if self.chance(0.15):
            before.append(self.aside())
        if self.chance(0.08):
            middle = self.laid_out([f() for f in (self.nav, self.aside, self.ad) if self.chance(0.5)], middle)
        return "<html><head><title>x</title></head><body>" + "".join(before) + middle + "".join(after) + self.one("</body></html>", "")


def _kept(page: Page, keep: np.ndarray) -> str:
    return "\n".join(t for k, own in zip(keep, page.own, strict=True) if k for t in own)


class Extractor:
    """Token weights and trees, and what they extract."""

    def __init__(self, drawn: list[str]):
        pages, known = [], []
        for html in drawn:
            page = parse(html)
            # Marked runs are main text, and so is all that holds one.
            good = np.array([any("\x01" in o for o in own) for own in page.own], np.float64)
            total = np.concatenate([[0], np.cumsum(good)])
            end = np.array(page.end)
            known.append(total[end] > total[np.arange(len(end))])
            page.own = [[o.replace("\x01", "").replace("\x02", "") for o in own] for own in page.own]
            pages.append(page)
        self.weights = token_weights(pages, known)
        # Pages of either half see what the other half says of their tokens.
        halves = []
        for k in (0, 1):
            x, _, _, sole, _ = features(pages[k::2], token_weights(pages[1 - k :: 2], known[1 - k :: 2]))
            halves.append((x[~sole], np.concatenate(known[k::2]).astype(np.float64)[~sole]))
        self.trees = Trees(*(np.concatenate(c) for c in zip(*halves, strict=True)), trees=TREES)

    def extracted(self, html: list[str]) -> list[str]:
        """The main text of each page; a text holds one line for each block."""
        pages = [parse(h) for h in html]
        x, parent, depth, sole, first = features(pages, self.weights)
        logit = np.zeros(len(x))
        logit[~sole] = self.trees.logits(x[~sole])
        keep = decode(logit, parent, depth, sole)
        # Blocks of one kind beside each other mostly go together, so those beside a kept one get the benefit of a doubt.
        tag = np.array([t for p in pages for t in p.tag], np.int64)
        kind = parent * (len(TAGS) + 1) + tag
        beside = ~keep & keep[parent] & ~sole & np.isin(kind, kind[keep & (depth > 0)])
        keep = decode(logit + BESIDE * beside, parent, depth, sole)
        out = []
        for page, at in zip(pages, first, strict=True):
            of = slice(at, at + len(page.tag))
            text = _kept(page, keep[of])
            # Where next to nothing is kept, the odds of all nodes must say so by a margin.
            for more in MARGINS if len(text) < SHORT else ():
                found = _kept(page, decode(logit[of] + more, parent[of] - at, depth[of], sole[of]))
                if len(found) >= len(text) + DENSE:
                    text = found
                    break
            out.append(text)
        return out


def drawn(seed: int, pages: int) -> list[str]:
    draw = _Drawn(seed)
    return [draw.page() for _ in range(pages)]


@lru_cache(4)
def trained(spark: SparkSession, seed: int = 5, pages: int = PAGES) -> Extractor:
    """The extractor, fitted in a task; the driver only holds the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(Extractor(drawn(seed, pages)))], pa.binary())})

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").first()["model"])


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            i = 0
            while i < len(html):
                j, n = i, 0
                while j < len(html) and (j == i or n + len(html[j]) <= 1_000_000):
                    n += len(html[j])
                    j += 1
                text = model.value.extracted(html[i:j])
                ids = batch.select(["page_id", "url"]).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                i = j

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row for each row of ``pages``.

    Character references are decoded, white space in a block is one space, blocks
    are joined in page order by a line feed. Null, empty and textless html gives an
    empty text. Rows with null or repeated ids are treated like all others. Other
    columns are ignored. No rows give no rows.
    """
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(trained(spark))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return plain.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
