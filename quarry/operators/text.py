"""Operators over documents and turns that need more than one column expression."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.relational import keep_first


#: Documents that are held at once in a pass over texts; characters above which a word is hashed by itself.
SLICE_DOCS, LONG_WORD = 256, 100


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_DOCS):
            yield batch.slice(first, SLICE_DOCS)


def mapped_texts(docs: DataFrame, change: Callable[[str | None], str | None], column: str = "text") -> DataFrame:
    """``docs`` with ``change`` made to each text of ``column``: a narrow pass that holds few documents at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            at = some.schema.names.index(column)
            texts = pa.array([change(t) for t in some.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(some.columns)], some.schema.names)

    return docs.mapInArrow(run, docs.schema)


def clamp(c: Column, tokens: int) -> Column:
    """A text cut to ``tokens`` estimated tokens, with an ellipsis if it was longer."""
    most = int(tokens * 3.5)
    return F.when(F.length(c) > most, F.concat(c.substr(1, most), F.lit("..."))).otherwise(c)


def prune_history(turns: DataFrame, budget: int = 800, per_turn: int = 250) -> DataFrame:
    """The first turn of each conversation and, newest first, those that the budget still holds; every turn costs its clamped estimate."""
    w = Window.partitionBy("conv_id")
    t = turns.withColumn("_n", F.row_number().over(w.orderBy("turn"))).withColumn("_cost", F.least(F.lit(per_turn), F.ceil(F.length("text") / 3.5)))
    spent = F.sum(F.when(F.col("_n") == 1, 0).otherwise(F.col("_cost"))).over(w.orderBy(F.desc("turn"))) + F.max(F.when(F.col("_n") == 1, F.col("_cost")).otherwise(0)).over(w)
    return t.withColumn("_spent", spent).filter((F.col("_n") == 1) | (F.col("_spent") <= budget)).drop("_n", "_cost", "_spent").withColumn("text", clamp(F.col("text"), per_turn))


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrase_matches(phrases: DataFrame, chunk_rows: DataFrame, anchor: int = 5) -> DataFrame:
    """(item_id, chunk_id) where a chunk holds a whole phrase, word by word.

    Candidates come from an equi-join on the hash of the phrase's first ``anchor`` words, or of all of a shorter one, against every such run of the
    chunks that have them; the whole phrase is then compared. Nothing is paired that shares no run."""
    p = phrases.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    p = p.withColumn("n", F.least(F.size("words"), F.lit(anchor))).select("item_id", "n", F.array_join("words", " ").alias("phrase"), F.xxhash64(F.array_join(F.slice("words", 1, F.col("n")), " ")).alias("h"))
    c = chunk_rows.select("chunk_id", words_of(F.col("content")).alias("words"))
    lengths = F.explode(F.array(*[F.lit(k) for k in range(1, anchor + 1)])).alias("n")
    runs = c.select("chunk_id", "words", lengths).join(F.broadcast(p.select("n").distinct()), "n", "left_semi")  # at most ``anchor`` rows
    runs = runs.select("chunk_id", "n", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(1, size(words) - n + 1)), i -> xxhash64(array_join(slice(words, i, n), ' '))))")).alias("h"))
    pairs = runs.join(p, ["n", "h"]).select("item_id", "chunk_id", "phrase").distinct()
    body = c.select("chunk_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("body"))
    return pairs.join(body, "chunk_id").filter(F.contains("body", F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("item_id", "chunk_id")


def dedup_passages(docs: DataFrame, least: int = 25) -> DataFrame:
    """Lines of ``least`` characters or more that a document has already, ignoring case, go; shorter ones stay (N08); P30's two levels are `claims.dedup_text`. Result: doc_id, kept_lines, dropped_lines, text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.lower(F.trim("line"))
    w = Window.partitionBy("doc_id", "key").orderBy("pos")
    ranked = lines.withColumn("key", F.when(F.length(key) >= least, key).otherwise(F.concat(F.lit("\u0000"), F.col("pos").cast("string")))).withColumn("again", F.row_number().over(w) > 1)
    part = F.when(~F.col("again"), F.struct("pos", "line"))
    g = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count_if("again").alias("dropped_lines"))
    return g.select("doc_id", F.size("parts").cast("long").alias("kept_lines"), "dropped_lines", F.array_join("parts.line", "\n").alias("text"))


def sections(docs: DataFrame, heading: str, keep: str) -> DataFrame:
    """Lines under headings that match ``keep`` (P11): each line's section is the last heading at or above it."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(heading), F.col("line"))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).filter(F.col("section").rlike(keep))


# -- chunking
PARENT, CHILD_LEAST, CHILD_TARGET, CHILD_MOST, OVERLAP, SNAP, LONG_PARAGRAPH = 2500, 300, 400, 500, 40, 40, 800


def djb2(text: str) -> int:
    h = 5381
    for c in text:
        h = ((h * 33) ^ ord(c)) & 0xFFFFFFFF
    return h


def paragraphs(text: str) -> list[list[str]]:
    """Words of the paragraphs; overlong ones are split at sentence ends."""
    out = []
    for p in re.split(r"\n\s*\n|\n", text):
        words = p.split()
        while len(words) > LONG_PARAGRAPH:
            cut = next((i + 1 for i in range(LONG_PARAGRAPH - 1, LONG_PARAGRAPH // 2, -1) if words[i][-1] in ".!?"), LONG_PARAGRAPH)
            out.append(words[:cut])
            words = words[cut:]
        if words:
            out.append(words)
    return out


def child_spans(words: list[str]) -> list[tuple[int, int]]:
    """[start, end) of the children of a parent: about CHILD_TARGET words, ends moved to a sentence end within SNAP words, no rest that is too short."""
    spans, at = [], 0
    while at < len(words):
        left = len(words) - at
        if left <= CHILD_MOST:
            spans.append((at, len(words)))
            break
        good = lambda e: (r := len(words) - e) == 0 or CHILD_LEAST <= r <= CHILD_MOST or r >= 2 * CHILD_LEAST
        ends = sorted(range(at + CHILD_LEAST, min(at + CHILD_MOST, len(words)) + 1), key=lambda e: (not good(e), words[e - 1][-1] not in ".!?" or abs(e - at - CHILD_TARGET) > SNAP, abs(e - at - CHILD_TARGET)))
        end = ends[0]
        spans.append((at, end))
        at = end if len(words) - end <= CHILD_LEAST - OVERLAP or end == len(words) else end - OVERLAP
        if at <= spans[-1][0]:
            at = end
    return spans


def chunk_document(doc_id: int, title: str, text: str) -> Iterator[tuple]:
    """Parents of whole paragraphs up to PARENT words, and their children."""
    parents, some = [], []
    for p in paragraphs(text or ""):
        if some and len(some) + len(p) > PARENT:
            parents.append(some)
            some = []
        some = some + p
    if some:
        parents.append(some)
    for k, words in enumerate(parents):
        pid = f"{doc_id}-p{k}-{djb2(' '.join(words[:50])):08x}"
        yield pid, doc_id, None, k, 0, len(words), f"[{title}] " + " ".join(words)
        for j, (a, b) in enumerate(child_spans(words)):
            yield f"{pid}-c{j}", doc_id, pid, k, a, b - a, f"[{title}] " + " ".join(words[a:b])


CHUNKS = "chunk_id string, doc_id long, parent_chunk_id string, parent_no int, first_word int, n_words int, content string"


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Hierarchical chunks of (doc_id, source, text): rows of CHUNKS, a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for some in slices(batches):  # chunks hold each text twice
            rows = [r for d, source, text in zip(*(c.to_pylist() for c in some.columns), strict=True) for r in chunk_document(d, source, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return docs.select("doc_id", "source", "text").mapInArrow(run, CHUNKS)


# -- embeddings and spans
def word_hashes(words: list[str], step, start: np.ndarray) -> np.ndarray:
    """``step`` over the characters of each word, for all words at once, from their ``start``; a word of more than LONG_WORD characters by itself."""
    out, n = start.copy(), np.fromiter(map(len, words), np.int64, len(words))
    c, first = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    lengths = n[order]
    long = int(np.searchsorted(-lengths, -LONG_WORD, "left"))
    for k in order[:long].tolist():
        h = out[k : k + 1]
        for x in range(int(first[k]), int(first[k] + n[k])):
            h = step(h, c[x : x + 1])
        out[k] = h[0]
    order, lengths = order[long:], lengths[long:]
    for k in range(int(lengths[0]) if len(lengths) else 0):
        some = order[: np.searchsorted(-lengths, -k, "left")]  # those of more than k characters
        out[some] = step(out[some], c[first[some] + k])
    return out


def text_vectors(docs: DataFrame, vectors: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """doc_id and the ``vectors`` of texts, brought to length 1: few documents are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            v = vectors([t or "" for t in some.column("text").to_pylist()])
            v = np.array([x / (math.sqrt(float(x @ x)) or 1.0) for x in v])
            ends = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["doc_id", "embedding"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, embedding array<double>")


def hashed_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """Deterministic text vectors (X03): hashed words (1.5 and 0.8), word pairs (2.0) and character triples (0.3), of length 1; a blank text is all zero."""

    def vectors(texts: list[str]) -> np.ndarray:
        clean = [t.lower().strip() for t in texts]
        split = [t.split() for t in clean]
        words, doc = [w for ws in split for w in ws], np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        step = lambda h, c: (h * np.uint32(33)) ^ c
        h = word_hashes(words, step, np.full(len(words), 5381, np.uint32))
        follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        pairs = word_hashes([words[k] for k in follows.tolist()], step, step(h[follows - 1], np.uint32(32)))
        c = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32)
        at = np.repeat(np.arange(len(clean)), [len(t) for t in clean])
        first = np.flatnonzero(at[2:] == at[:-2])
        triples = step(step(step(np.full(len(first), 5381, np.uint32), c[first]), c[first + 1]), c[first + 2])
        # Added up in one order, so that sums do not depend on what is hashed at once.
        wide = h.astype(np.int64)
        each = lambda k: np.repeat(k, 2)
        cells = np.concatenate([each(doc) * dim + np.column_stack([wide % dim, (wide * 31 + 17) % dim]).ravel(), doc[follows] * dim + pairs % dim, at[first] * dim + triples % dim])
        weight = np.concatenate([np.tile([1.5, 0.8], len(h)), np.full(len(pairs), 2.0), np.full(len(triples), 0.3)])
        return np.bincount(cells.astype(np.int64), weight, len(texts) * dim).reshape(-1, dim)

    return text_vectors(docs, vectors)


def gazetteer_spans(docs: DataFrame, names: list[str]) -> DataFrame:
    """Longest-match dictionary spans (P18, J14) of whole words: doc_id, start, end, name. The dictionary is fixed and goes with the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Names by their first word, the longest first: other words cost one look.
        starts: dict[str, list[tuple[str, ...]]] = {}
        for name in sorted({tuple(n.lower().split()) for n in names}, key=len, reverse=True):
            if name:
                starts.setdefault(name[0], []).append(name)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = list(re.finditer(r"\w+", text or ""))
                words = [m.group().lower() for m in found]
                i = 0
                while i < len(words):
                    name = next((n for n in starts.get(words[i], ()) if tuple(words[i : i + len(n)]) == n), None)
                    if name:
                        out.append((doc_id, found[i].start(), found[i + len(name) - 1].end(), " ".join(name)))
                    i += len(name) if name else 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "name"]).astype({"doc_id": "Int64", "start": "int64", "end": "int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, end long, name string")


def drop_overlapped(spans: DataFrame, higher: DataFrame) -> DataFrame:
    """Spans of a lower layer that no span of a higher one overlaps (J16): a range anti-join within the document."""
    h = higher.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(h, (spans["doc_id"] == h["doc_id"]) & (F.greatest("start", "_s") < F.least("end", "_e")), "left_anti")


def near_spans(spans: DataFrame, docs: DataFrame, left: str, right: str, most: int = 120, keep_gap: bool = False) -> DataFrame:
    """Pairs of spans of two kinds at most ``most`` characters apart with no sentence end between (J15): joined by document and by cells of ``most`` characters, so that only neighbours meet."""
    a = spans.filter(F.col("kind") == left).select("doc_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("name").alias("a"))
    a = a.withColumn("cell", F.explode(F.expr(f"array(a_end div {most}, a_end div {most} + 1)")))
    b = spans.filter(F.col("kind") == right).select("doc_id", F.col("start").alias("b_start"), F.col("name").alias("b"), F.expr(f"start div {most}").alias("cell"))
    near = a.join(b, ["doc_id", "cell"]).filter((F.col("b_start") >= F.col("a_end")) & (F.col("b_start") - F.col("a_end") <= most))
    gap = F.expr("substring(text, a_end + 1, b_start - a_end)")
    near = near.join(docs.select("doc_id", "text"), "doc_id").filter(~gap.rlike(r"[.\n]"))
    return near.select("doc_id", "a", "b", "a_start", "b_start", *(["a_end", "text"] if keep_gap else []))


def extract_years(c: Column) -> Column:
    """Three- and four-digit years up to 2100 in order of appearance, distinct (P16); P17's extractors are in `claims`."""
    raw = F.regexp_extract_all(c, F.lit(r"(?<![\d.,])(\d{3,4})(?![\d.,]*\d)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda y: y.cast("int")), lambda y: y <= 2100))


def sentences(c: Column) -> Column:
    """Sentences; a mark after a digit or a single letter ends none."""
    return F.filter(F.transform(F.split(c, r"(?<=[^\d\s][^\d\s][.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def extract_claims(answers: DataFrame) -> DataFrame:
    """Claims of an answer (V01): its sentences without bullets, of 12 characters or more."""
    s = answers.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "claim"))
    return s.withColumn("claim", F.regexp_replace("claim", r"^\s*(?:[-*•]|\d+[.)])\s*", "")).filter(F.length("claim") >= 12)


# -- repair and rules
def unwrap_lines(docs: DataFrame, narrow: int = 40) -> DataFrame:
    """Soft-wrapped lines joined (P02): a line goes on in the next unless it is blank, shorter than ``narrow``, ends a sentence or is a heading or list item, or the next one is."""

    def unwrap(text: str | None) -> str | None:
        if text is None:
            return None
        special = lambda s: not s or re.match(r"(#|[-*•|]|\d+[.)]\s)", s)
        out: list[str] = []
        for line in text.split("\n"):
            s = line.strip()
            if out and len(out[-1]) >= narrow and not special(out[-1].rsplit("\n", 1)[-1]) and not special(s) and out[-1][-1] not in ".!?:;":
                out[-1] += " " + s
            else:
                out.append(s)
        return "\n".join(out)

    return mapped_texts(docs, unwrap)


def heal_syllables(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """Words torn apart put together (P06): greedily, three tokens or two whose joint is a word of the lexicon while not all of them are. The lexicon is fixed and goes with the task."""
    known = frozenset(lexicon)

    def heal(text: str | None) -> str | None:
        if text is None:
            return None
        out, words, i = [], text.split(" "), 0
        while i < len(words):
            n = next((n for n in (3, 2) if i + n <= len(words) and (j := "".join(words[i : i + n])).lower() in known and not all(w.lower() in known for w in words[i : i + n])), 1)
            out.append("".join(words[i : i + n]))
            i += n
        return " ".join(out)

    return mapped_texts(docs, heal)


def rule_triples(spans: DataFrame, docs: DataFrame, rules: list[tuple[str, str, str, str, int]]) -> DataFrame:
    """Rule-based triples (P38, J15): for each rule (left kind, right kind, relation, pattern of the gap, most characters) the pairs of neighbouring spans whose gap has the pattern; of one pair the first rule wins."""
    out = None
    for k, (left, right, relation, pattern, most) in enumerate(rules):
        gap = F.expr("substring(text, a_end + 1, b_start - a_end)")
        near = near_spans(spans, docs, left, right, most, keep_gap=True).filter(gap.rlike(pattern))
        near = near.select("doc_id", F.col("a").alias("src"), F.lit(relation).alias("rel"), F.col("b").alias("tgt"), F.lit(k).alias("rule"), "a_start", "b_start")
        out = near if out is None else out.unionByName(near)
    return keep_first(out, ["doc_id", "a_start", "b_start"], [F.col("rule")]).drop("rule")


def composed(docs: DataFrame) -> DataFrame:
    """Text in composed form without control characters, no-break spaces as spaces, full-width punctuation as ASCII."""
    import unicodedata

    wide = str.maketrans({0xFF01 + k: 0x21 + k for k in range(94)} | {0xA0: " ", 0x3000: " "})
    drop = {k: None for k in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]}

    return mapped_texts(docs, lambda t: None if t is None else unicodedata.normalize("NFC", t).translate(wide).translate(drop))


def small_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """Deterministic vectors of words (1, x31 hash) and word pairs (1.5, x33 hash), of length 1."""

    def vectors(texts: list[str]) -> np.ndarray:
        split = [re.findall(r"\w+", t.lower()) for t in texts]
        words, doc = [w for ws in split for w in ws], np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        by = lambda factor: lambda h, c: h * np.uint32(factor) + c
        none = np.zeros(len(words), np.uint32)
        h, start = word_hashes(words, by(31), none), word_hashes(words, by(33), none)
        follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        pairs = word_hashes([words[k] for k in follows.tolist()], by(33), by(33)(start[follows - 1], np.uint32(32)))
        cells = np.concatenate([doc * dim + h % dim, doc[follows] * dim + pairs % dim])
        return np.bincount(cells.astype(np.int64), np.concatenate([np.full(len(h), 1.0), np.full(len(pairs), 1.5)]), len(texts) * dim).reshape(-1, dim)

    return text_vectors(docs, vectors)


def alias_hits(queries: DataFrame, aliases: DataFrame, most: int = 4) -> DataFrame:
    """Aliases in queries by n-grams of 4 words down to 1 (P19): query, alias, canonical; an equi-join on the n-gram, longer ones first."""
    w = queries.select("query", words_of(F.col("text")).alias("w"))
    grams = F.explode(F.expr(f"flatten(transform(sequence(1, {most}), n -> if(size(w) >= n, transform(sequence(1, size(w) - n + 1), i -> struct(array_join(slice(w, i, n), ' ') as alias, n as n)), array())))")).alias("g")
    return w.select("query", grams).select("query", "g.alias", "g.n").distinct().join(aliases, "alias").select("query", "alias", "canonical", "n")


def enrich(docs: DataFrame, chronology: DataFrame) -> DataFrame:
    """Year bounds of a text and the epoch of its first year (P15): doc_id, first_year, last_year, epoch_id, dynasty_id; null without years."""
    from quarry.operators.relational import epoch_of_year

    y = docs.select("doc_id", extract_years(F.col("text")).alias("years"))
    y = y.select("doc_id", F.array_min("years").alias("first_year"), F.array_max("years").alias("last_year"))
    dated = epoch_of_year(y.filter("first_year is not null"), chronology, "first_year").select(*y.columns, "epoch_id", "dynasty_id")
    return dated.unionByName(y.filter("first_year is null"), allowMissingColumns=True)


def parenthetical_pairs(docs: DataFrame) -> DataFrame:
    """Capitalised names followed by another in brackets (P39): doc_id, name, other. Nothing is given back once matched, as no shorter run of names could be followed by a bracket; a long run needs no stack."""
    name = r"\p{Lu}\p{L}++(?: \p{Lu}\p{L}++)*+"
    pattern = rf"({name}) \(({name})\)"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("other"))
    return docs.select("doc_id", F.explode(both).alias("p")).select("doc_id", F.col("p.name").alias("name"), F.col("p.other").alias("other"))
