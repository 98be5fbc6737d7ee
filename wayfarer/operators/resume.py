"""Résumés as HTML into summary, education, additional information and skills.

A small reader hands over each section's heading, id and texts; what they mean is
decided in SQL expressions over these arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.text import clean_skills, collapse, skill_chunks
from wayfarer.sources.shared import settled

# Headings of sections, and what they hold.
HEADINGS = {
    "summary": [
        "summary", "professional summary", "career overview", "career summary", "executive summary", "profile", "professional profile", "executive profile", "career profile", "career focus", "objective",
        "career objective", "objective statement", "professional overview", "professional background", "professional objective", "personal summary", "overview", "about",
    ],
    "education": ["education", "education and training", "academic background", "educational background", "certifications", "certificates", "licenses", "licenses and certifications"],
    "skills": ["skills", "core skills", "key skills", "technical skills", "core competencies", "computer skills", "skill highlights"],
    "additional": ["additional information", "interests", "hobbies", "activities", "personal interests", "affiliations", "professional affiliations", "activities and honors"],
    "highlights": ["highlights", "core qualifications", "qualifications", "core strengths", "summary of skills", "summary of qualifications", "areas of expertise", "professional highlights", "competencies"],
}
# Beginnings of section ids, for sections without a heading.
PREFIXES = {"SUMM": "summary", "EDUC": "education", "CERT": "education", "SKLL": "skills", "TSKL": "skills", "HILT": "highlights", "ADDI": "additional", "INTR": "additional", "AFIL": "additional"}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    __slots__ = ("tag", "classes", "id", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.classes, self.id = tag, (attrs.get("class") or "").split(), attrs.get("id") or ""
        self.parts: list[_Node | str] = []

    def below(self) -> Iterator[_Node]:
        """All elements inside, in page order, without recursion."""
        todo = [p for p in reversed(self.parts) if isinstance(p, _Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [p for p in reversed(node.parts) if isinstance(p, _Node)]

    def texts(self) -> list[str]:
        """Stripped pieces of text in page order."""
        out, todo = [], list(reversed(self.parts))
        while todo:
            part = todo.pop()
            if isinstance(part, _Node):
                if part.tag not in ("script", "style", "template"):
                    todo += reversed(part.parts)
            elif text := part.strip():
                out.append(text)
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


# An end tag, a start tag whose attributes are all quoted and hold no reference, or a text; anything else is odd.
# Elements whose content is not markup are odd, too.
_TOKEN = re.compile(
    r"</([a-z][a-z0-9]*)[ \t\n\r\f]*>"
    r"|<(?!script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)([a-z][a-z0-9]*)"
    r"""((?:[ \t\n\r\f]+[a-z][a-z0-9_:-]*="[^"<>&]*")*)[ \t\n\r\f]*(/?)>"""
    r"|([^<]+)|(<)",
    re.ASCII | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9_:-]*)="([^"]*)"', re.ASCII | re.IGNORECASE)


def _tree(html: str) -> _Node:
    """The root of a page. Plain pages are cut into tokens at once; the parser reads those with anything odd."""
    tree, tokens = _Tree(), _TOKEN.findall(html)
    if any(t[5] for t in tokens):
        tree.feed(html)
        tree.close()
        return tree.root
    for end, start, attrs, closed, text, _ in tokens:
        if text:
            tree.handle_data(unescape(text) if "&" in text else text)
        elif start:
            tree.handle_starttag(start.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else [])
            if closed:
                tree.handle_endtag(start.lower())
        else:
            tree.handle_endtag(end.lower())
    return tree.root


def _sections(html: str) -> list[dict]:
    found = []
    for section in _tree(html).below():
        if section.tag != "div" or "section" not in section.classes:
            continue
        inner = [n for n in section.below() if n.tag == "div"]
        title = next((n for n in inner if "sectiontitle" in n.classes), None)
        heading = next((n for n in inner if "heading" in n.classes), None)
        body = [section]
        if heading is not None:  # then only elements count, not text between them
            body = [p for p in section.parts if isinstance(p, _Node) and p is not heading]
        every = [n for b in body for n in ([*b.below()] if b is section else [b, *b.below()])]
        pieces = [n for n in every if n.tag == "li"] or [n for n in every if n.tag == "td"]
        texts = [t for b in body for t in b.texts()]
        m = re.match("SECTION_([A-Z]+)", section.id)
        found.append({"heading": "".join(title.texts()).lower() if title else "", "prefix": m[1] if m else None, "text": " ".join(texts), "chunks": ["\n".join(n.texts()) for n in pieces] if pieces else ["\n".join(texts)]})
    return found


SECTIONS = "array<struct<heading:string,prefix:string,text:string,chunks:array<string>>>"


def sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sections) of each row; null and empty pages have none.

    Pages are read in the partitions that they come in. Reading is the work here, so
    rows of few files or row groups are to be dealt out before.
    """
    kind = pa.list_(pa.struct([("heading", pa.string()), ("prefix", pa.string()), ("text", pa.string()), ("chunks", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                read = [_sections(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(read, kind)], names=["key", "sections"])

    kind_of_key = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"key {kind_of_key}, sections {SECTIONS}").withColumnRenamed("key", key)


def _field(section: Column) -> Column:
    """What a section holds: by its heading, which counts even if nobody knows it; else by its id."""
    named = F.create_map(*[F.lit(x) for field, names in HEADINGS.items() for n in names for x in (n, field)])
    prefixed = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    return F.when(section["heading"] != "", F.element_at(named, section["heading"])).otherwise(F.element_at(prefixed, section["prefix"]))


def parsed(df: DataFrame, key: str, html: str, highlights_add_skills: bool = True) -> DataFrame:
    """(key, summary, additional_info, education, skills) of each row; texts that aren't there are null.

    Summary is the first section of its kind that isn't empty, with all highlights
    behind it. Education and additional information join their sections by line
    feeds. Skills are all sections' in order, repeats included, and then those of the
    highlights that are not among them yet, unless ``highlights_add_skills`` is off.

    Each section's text and skills are made once and written; all outputs read these.
    """
    items = lambda s: F.flatten(F.transform(s["chunks"], lambda c: clean_skills(skill_chunks(c))))
    made = lambda s: F.struct(s["field"].alias("field"), collapse(s["text"]).alias("text"), F.when(s["field"].isin("skills", "highlights"), items(s)).alias("items"))
    read = sections(df, key, html).select(key, F.transform("sections", lambda s: F.struct(_field(s).alias("field"), s["text"].alias("text"), s["chunks"].alias("chunks"))).alias("s"))
    read = settled(read.select(key, F.transform("s", made).alias("s")), "sections")
    of = lambda name: F.filter("s", lambda s: s["field"] == name)
    full = lambda name: F.transform(F.filter(of(name), lambda s: s["text"] != ""), lambda s: s["text"])
    joined = lambda texts: F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    skills = lambda name: F.flatten(F.transform(of(name), lambda s: s["items"]))
    first = F.slice(full("summary"), 1, 1)
    made = read.select(
        key,
        joined(F.concat(first, full("highlights"))).alias("summary"),
        joined(full("additional")).alias("additional_info"),
        joined(full("education")).alias("education"),
        skills("skills").alias("own"),
        (F.array_distinct(skills("highlights")) if highlights_add_skills else F.array().cast("array<string>")).alias("more"),
    )
    return made.select(key, "summary", "additional_info", "education", F.concat("own", F.array_except("more", "own")).alias("skills"))
