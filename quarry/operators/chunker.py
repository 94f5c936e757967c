"""Hierarchical chunks of documents with headings (P14): parents of whole paragraphs, their children by words, and what section each is in.

One document is one row and one pass; documents are independent of each other. Paragraphs end at blank lines, headings are paragraphs of one line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.text import djb2

#: Fixed values, in words: parents, children, what two children share, how far an end moves to a sentence's end, and paragraphs.
PARENT_LEAST, PARENT_MOST, CHILD_LEAST, CHILD_TARGET, CHILD_MOST, OVERLAP, SNAP, PARAGRAPH = 2000, 3000, 300, 400, 500, 40, 40, 800
#: Fixed value: words of a section's title.
TITLE_WORDS = 15
#: Fixed patterns: headings by signs before or on both sides, the end of a sentence.
SHARP, EQUAL = re.compile(r"(#{1,5})\s+(.+)"), re.compile(r"(={2,5})\s*([^=]+?)\s*\1")
SENTENCE, SENTENCE_END = re.compile(r"[^.!?\n]+[.!?]+(?:\s+|$)|[^.!?\n]+$"), re.compile(r"[.!?][\"'”’)]?$")
#: Fixed format of the line that tells a child's place.
BANNER = "[Sử Liệu: {title}] [Kỷ/Triều Đại: {realm}] [Mục: {section}]"
CHUNKS = "chunk_id string, doc_id long, parent_chunk_id string, title string, section string, path array<string>, realm string, first_word int, n_words int, content string"


class Heading(NamedTuple):
    level: int
    title: str
    realm: str


def short(title: str) -> str:
    """A heading without its signs and final marks, of TITLE_WORDS words at most."""
    words = title.strip("#= \t\n").rstrip(".:;,!?").split()
    return " ".join(words[:TITLE_WORDS]) + ("..." if len(words) > TITLE_WORDS else "")


def paragraphs(text: str) -> Iterator[str]:
    """Blocks between blank lines; one of more than PARAGRAPH words as runs of its sentences that have no more, unless a sentence alone has."""
    for block in re.split(r"\n\s*\n", text):
        block = block.strip()
        if len(block.split()) <= PARAGRAPH:
            if block:
                yield block
            continue
        some: list[str] = []
        size = 0
        for sentence in SENTENCE.findall(block):
            n = len(sentence.split())
            if n and some and size + n > PARAGRAPH:
                yield " ".join(some)
                some, size = [], 0
            if n:
                some.append(sentence.strip())
                size += n
        if some:
            yield " ".join(some)


def heading(paragraph: str) -> tuple[int, str] | None:
    m = SHARP.fullmatch(paragraph) or EQUAL.fullmatch(paragraph)
    return (len(m[1]), m[2].strip()) if m else None


def whole_rest(rest: int) -> bool:
    """Whether children can be made of so many words."""
    return rest == 0 or CHILD_LEAST <= rest <= CHILD_MOST or rest >= 2 * CHILD_LEAST


def child_spans(words: list[str]) -> Iterator[tuple[int, int]]:
    """[start, end) of a parent's children. An end is the first sentence end near the target, if what it leaves can be cut again; a child repeats the last OVERLAP words of the one before
    only where it is the last one and long enough."""
    n, at = len(words), 0
    while True:
        end = min(at + CHILD_TARGET, n)
        if n - at <= CHILD_MOST:
            end = n
        else:
            near = range(max(at + CHILD_TARGET * 3 // 4, end - SNAP), min(n - 1, end + SNAP) + 1)
            snapped = next((i + 1 for i in near if SENTENCE_END.search(words[i])), 0)
            if snapped and CHILD_LEAST <= snapped - at <= CHILD_MOST and whole_rest(n - snapped):
                end = snapped
            elif not whole_rest(n - end):
                end = n - (CHILD_LEAST if n - end < CHILD_LEAST else CHILD_MOST)
                end = n if end - at < CHILD_LEAST else end
        yield at, end
        if end >= n:
            return
        back = end - OVERLAP
        at = back if back > at and CHILD_LEAST <= n - back <= CHILD_MOST else end


def chunks_of(doc_id: int | None, title: str, realm: str, text: str, realms: dict[str, str]) -> Iterator[tuple]:
    stack: list[Heading] = []
    top = Heading(0, short(title), realm)
    name = f"{djb2(title + text[:30]):08x}"
    held: list[str] = []
    size, number = 0, 0

    def flush() -> Iterator[tuple]:
        nonlocal held, size, number
        number += 1
        at = stack[-1] if stack else top
        parent, words = f"parent_chunk_{name}_{number}", " ".join(held).split()
        row = (at.title, [h.title for h in stack], at.realm)
        yield parent, doc_id, None, f"{title} (Phần {number})", *row, 0, len(words), "\n\n".join(held)
        for k, (a, b) in enumerate(child_spans(words), 1):
            yield f"{parent}_child_{k}", doc_id, parent, f"{title} - Đoạn {number}.{k}", *row, a, b - a, BANNER.format(title=title, realm=at.realm, section=at.title) + "\n\n" + " ".join(words[a:b])
        held, size = [], 0

    for p in paragraphs(text):
        found = heading(p)
        if found:
            while stack and stack[-1].level >= found[0]:
                stack.pop()
            low = found[1].lower()
            stack.append(Heading(found[0], short(found[1]), next((r for word, r in realms.items() if word in low), stack[-1].realm if stack else realm)))
        n = len(p.split())
        if size + n > PARENT_MOST and size >= PARENT_LEAST:
            yield from flush()
        held.append(p)
        size += n
    if held:
        yield from flush()


def chunk_sections(docs: DataFrame, realms: dict[str, str] | None = None) -> DataFrame:
    """Parents and children of (doc_id, title, realm, text) as rows of CHUNKS.

    A parent takes whole paragraphs until the next would take it over PARENT_MOST, from PARENT_LEAST words on; its section and ``path`` are those of the last heading when it is closed. ``realms``: words in a heading that
    tell the realm below it (the first that occurs); else that of the heading above, else the document's. A null or blank text has no chunks, null titles and realms are empty; ids are equal for documents of one title and beginning."""
    realms = {k.lower(): v for k, v in (realms or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # chunks hold each text twice, so few documents are held at once
                some = batch.slice(first, 256)
                rows = [r for d, t, m, x in zip(*(c.to_pylist() for c in some.columns), strict=True) for r in chunks_of(d, t, m, x, realms)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [f.split()[0] for f in CHUNKS.split(", ")])

    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "realm", "text")]
    return docs.select("doc_id", *filled).mapInArrow(run, CHUNKS)
