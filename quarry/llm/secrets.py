"""Secret scans: base patterns, and formats that are learnt from what the patterns find.

Credentials that a base pattern labels are the examples of its kind. Their prefix tree's states are merged where the frequencies of what follows do not
differ significantly, which leaves a probabilistic automaton a kind; one more is learnt from tokens that no pattern labels. Every other token of
the corpus is then scored by the likelihood of its characters under each automaton.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import columns, stage

#: Fixed values of the contract: kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A text without any of these, in small letters, has no match of ASSIGN.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Runs of fewer characters are never matches, so they are not looked at one by one.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Tokens that are scored: whole runs of the characters of values, of so many at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: A kind is learnt from at most so many distinct credentials, those with the least hashes; from fewer than the least number it is not learnt.
SAMPLE, LEAST_SAMPLE = 3000, 20
#: One of so many credentials is held out and fixes the least score of its kind, which so large a share of them may miss. A shorter credential of
#: the format has a lower mean, as its end weighs more; so much is allowed for that.
HELD_OUT, MISSED, SHORTER = 4, 0.02, 0.1
#: States differ if a frequency differs by more than chance allows at this level; states seen less often have no say.
LEVEL, LEAST_SEEN = 0.05, 8
#: Symbols that an automaton may meet, for smoothing, and the part of a count that each one gets.
SYMBOLS, PRIOR = 68, 0.01
#: A symbol never seen in a state counts as this part of the mean symbol of its class there.
UNSEEN, CLASS_SIZE = 0.1, {"digit": 10, "small": 26, "capital": 26}
#: A candidate is a secret if its mean log-likelihood a character is so much above that of ordinary tokens.
MARGIN = 0.25
ORDINARY = "ordinary"
SPANS = "doc_id long, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<start:int,end:int,value:string>>, labelled array<struct<kind:string,value:string>>"
AUTOMATON = "kind string, state int, symbol string, next int, logp double, least double"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of the base matches, by start and then kind."""
    lower = text.lower()
    out = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if any(w in lower for w in WORDS) else []
    out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that share no character with a base match."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][1] < m.end():
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= m.start():
            out.append((*m.span(), m[0]))
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found, labelled = [], [], []
        for text in batch.column("text").to_pylist():
            b = base_spans(text or "")
            c = candidates(text or "", b)
            base.append([{"kind": k, "start": i, "end": j} for k, i, j, _ in b])
            found.append([{"start": i, "end": j, "value": v} for i, j, v in c])
            labelled.append([{"kind": KINDS[k], "value": v} for k, _, _, v in b] + [{"kind": ORDINARY, "value": v} for v in {v for _, _, v in c}])
        span = [("start", pa.int32()), ("end", pa.int32())]
        arrays = [pa.array(base, pa.list_(pa.struct([("kind", pa.int32()), *span]))), pa.array(found, pa.list_(pa.struct([*span, ("value", pa.string())]))), pa.array(labelled, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "base", "candidates", "labelled"])


def symbol_class(symbol: str) -> str:
    return "digit" if symbol.isdigit() else "small" if symbol.islower() else "capital" if symbol.isupper() else symbol


class PrefixTree:
    """States of a prefix tree that are merged step by step: how often each is reached and ends, and where each symbol leads and how often."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen, self.ends = [0], [0]
        self.count: list[dict[str, int]] = [{}]
        for word in words:
            at = 0
            self.seen[0] += 1
            for symbol in word:
                self.count[at][symbol] = self.count[at].get(symbol, 0) + 1
                to = self.next[at].get(symbol)
                if to is None:
                    to = self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.seen.append(0)
                    self.ends.append(0)
                at = to
                self.seen[at] += 1
            self.ends[at] += 1

    def alike(self, a: int, b: int) -> bool:
        """No frequency of ending, of a symbol or of a class of symbols differs significantly, here or after any common continuation."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if n < LEAST_SEEN or m < LEAST_SEEN:
                continue
            most = math.sqrt(0.5 * math.log(2 / LEVEL)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            apart: dict[str, float] = {}
            for symbol in self.count[a].keys() | self.count[b].keys():
                d = self.count[a].get(symbol, 0) / n - self.count[b].get(symbol, 0) / m
                apart[symbol_class(symbol)] = apart.get(symbol_class(symbol), 0.0) + d
                if abs(d) > most:
                    return False
                x, y = self.next[a].get(symbol), self.next[b].get(symbol)
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
            if max(map(abs, apart.values()), default=0) > most:
                return False
        return True

    def fold(self, into: int, state: int) -> None:
        """Add a subtree to the state it is merged with, and its continuations to that one's."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.seen[into] += self.seen[state]
            self.ends[into] += self.ends[state]
            for symbol, to in self.next[state].items():
                self.count[into][symbol] = self.count[into].get(symbol, 0) + self.count[state][symbol]
                mine = self.next[into].get(symbol)
                if mine is None:
                    self.next[into][symbol] = to
                else:
                    todo.append((mine, to))

    def fits(self, a: int, b: int) -> float:
        """The log-likelihood of what follows ``b`` by the frequencies of ``a``."""
        total = math.log(self.seen[a] + PRIOR * (SYMBOLS + 1))
        p = lambda n: math.log(n + PRIOR) - total
        return self.ends[b] * p(self.ends[a]) + sum(n * p(self.count[a].get(c, 0)) for c, n in self.count[b].items())

    def merge(self) -> list[int]:
        """The states that stay. Their border is taken in the order of how often it is reached; a state of it joins, of the settled ones that it is like, the one that explains it best."""
        settled = [0]
        while True:
            known = set(settled)
            border = {to: (s, symbol) for s in settled for symbol, to in self.next[s].items() if to not in known}
            if not border:
                return settled
            state = max(border, key=lambda q: (self.seen[q], -q))
            like = [s for s in settled if self.alike(s, state)]
            if like:
                best = max(like, key=lambda s: (self.fits(s, state), -s))
                source, symbol = border[state]
                self.next[source][symbol] = best
                self.fold(best, state)
            else:
                settled.append(state)


def learn(words: list[str]) -> dict[int, tuple[dict[str, tuple[int, float]], float, float]]:
    """state: (symbol or class: (next state, log-probability), log-probability of the end, that of a symbol whose class was never seen there).

    A class leads where most of its symbols lead."""
    tree = PrefixTree(sorted(words))
    out = {}
    for s in tree.merge():
        total = math.log(tree.seen[s] + PRIOR * (SYMBOLS + 1))
        p = lambda n, total=total: math.log(n + PRIOR) - total
        to = {c: (q, p(tree.count[s][c])) for c, q in tree.next[s].items()}
        for kind, size in CLASS_SIZE.items():
            leads: dict[int, int] = defaultdict(int)
            for c, q in tree.next[s].items():
                if symbol_class(c) == kind:
                    leads[q] += tree.count[s][c]
            if leads:
                to[kind] = (max(leads, key=lambda q, leads=leads: (leads[q], -q)), p(UNSEEN * sum(leads.values()) / size))
        out[s] = (to, p(tree.ends[s]), p(0))
    return out


def score(automaton: dict, word: str) -> float:
    """The mean log-likelihood of the word's characters and its end. A symbol whose class was never seen in a state starts again at the root."""
    at, total = 0, 0.0
    for symbol in word:
        known = automaton[at][0]
        to, p = known.get(symbol) or known.get(symbol_class(symbol)) or (0, automaton[at][2])
        at, total = to, total + p
    return (total + automaton[at][1]) / (len(word) + 1)


def fit(table: pd.DataFrame) -> pd.DataFrame:
    """The automaton of one kind as rows: a symbol or a class of them, the empty symbol is the end, null any symbol of a class never seen there; ``least`` is the score to reach."""
    kind, words = table["kind"].iloc[0], sorted(table["value"])
    rows = []
    if len(words) >= LEAST_SAMPLE:
        held = words[::HELD_OUT]
        automaton = learn([w for i, w in enumerate(words) if i % HELD_OUT])
        scores = sorted(score(automaton, w) for w in held)
        least = scores[int(MISSED * len(scores))] - SHORTER
        for s, (to, end, never) in automaton.items():
            rows += [(kind, s, c, n, p, least) for c, (n, p) in to.items()] + [(kind, s, "", -1, end, least), (kind, s, None, -1, never, least)]
    return pd.DataFrame(rows, columns=["kind", "state", "symbol", "next", "logp", "least"])


def automata(labelled: DataFrame) -> DataFrame:
    """An automaton for each kind of ``labelled`` (kind, value), each learnt in a task of its own from at most SAMPLE distinct values.

    Values are counted once each, so a credential of many copies weighs no more than others; the sample is the values with the least hashes."""
    known = stage(labelled.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    some = [known.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(SAMPLE) for k in (*KINDS, ORDINARY)]
    whole = some[0]
    for df in some[1:]:
        whole = whole.unionByName(df)
    return whole.select("kind", "value").groupBy("kind").applyInPandas(fit, AUTOMATON)


def judged(known: dict[str, tuple[dict, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Base spans and the candidates whose format is likely, by start and then kind as listed, base ones first."""

    def likely(word: str) -> int | None:
        usual = score(known[ORDINARY][0], word) if ORDINARY in known else -math.log(SYMBOLS)
        scores = [(s, -i) for i, k in enumerate(KINDS) if k in known and (s := score(known[k][0], word)) >= known[k][1] and s - usual >= MARGIN]
        return -max(scores)[1] if scores else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                spans = [(b["start"], b["kind"], b["end"], KINDS[b["kind"]]) for b in base]
                for c in found:
                    k = likely(c["value"])
                    if k is not None:
                        spans.append((c["start"], len(KINDS) + k, c["end"], f"like_{KINDS[k]}"))
                out.append([{"kind": k, "start": i, "end": j} for i, _, j, k in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, spans array<struct<kind, start, end>> in code points, end exclusive.

    Kinds are assign, access and hex for what the base patterns match, and like_assign, like_access, like_hex for tokens that only the learnt formats find.
    A null text is empty and has no spans; equal texts get equal spans; further columns are ignored; an empty table gives no rows. A kind with
    fewer than LEAST_SAMPLE distinct credentials in the corpus is not learnt. Texts are read once: what is scored is staged with the base spans.
    """
    found = stage(columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SPANS))
    known: dict[str, tuple[dict, float]] = {}
    states: dict = defaultdict(lambda: defaultdict(lambda: ({}, 0.0, 0.0)))
    least = {}
    # Automata are of bounded size: at most one state a character of the sample.
    for r in automata(found.select(F.explode("labelled").alias("x")).select("x.kind", "x.value")).collect():
        to, end, never = states[r["kind"]][r["state"]]
        if r["symbol"]:
            to[r["symbol"]] = (r["next"], r["logp"])
        states[r["kind"]][r["state"]] = (to, r["logp"] if r["symbol"] == "" else end, r["logp"] if r["symbol"] is None else never)
        least[r["kind"]] = r["least"]
    known = {k: (dict(v), least[k]) for k, v in states.items()}
    return found.select("doc_id", "base", "candidates").mapInArrow(judged(known), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from the spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
