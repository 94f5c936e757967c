"""Secret scans, ranked lexical search and vector codes against plain versions of themselves."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from quarry.llm import lexical, secrets, vectorcode
from tests.llm.cases import SCHEMA, awkward, documents, words

KINDS = ("assign", "access", "hex")


# Secrets


def base(text):
    """(start, kind, end) by the patterns as they are written."""
    text, out = text or "", []
    for k, pattern, group, least in (
        (0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        (1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        (2, re.compile(r"[0-9a-f]+"), 0, 24),
    ):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def access(rng):
    return "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))


def corpus(n=150):
    rng = random.Random(5)
    long = lambda: "".join(w[:2] for w in words(rng.random(), rng.randrange(7, 11)))
    rows = [(k, f"{' '.join(words(k, 30))} password={hexes(rng, 18)} {hexes(rng, 40)} {access(rng)} {long()} {long()} {long()} {rng.randrange(10**15, 10**16)}") for k in range(n)]
    hidden = [(1000 + k, hexes(rng, 20)) for k in range(20)]
    return rows + [(i, f"{' '.join(words(i, 20))} {h} end") for i, h in hidden], dict(hidden)


def test_secrets_base(spark):
    tricky = ["API_KEY : 'abc.def-9", "apiKEY=x token=abc secret:token=abcdef password=token:abcdef", "paſsword=abcdefgh toKen=abcdefgh", "AKIA" * 9, "f" * 23 + " " + "F" * 30 + "0" * 24, "token==abcdef passwd\"='qqqqqq", "éé token=éabcdef 😀 secret = abcdefg", "token=" * 9]
    rows = [*awkward(), *[(200 + k, t) for k, t in enumerate(tricky)], *corpus()[0]]
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(secrets.find_secrets(documents(spark, rows).repartition(5))).collect())
    want = collections.Counter()
    for i, t in rows:
        b = base(t)
        n = [sum(k == j for _, k, _ in b) for j in range(3)]
        want[(i, *n, hashlib.sha256(",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in b).encode()).hexdigest())] += 1
    assert got == want


def test_secrets_learnt(spark):
    rows, hidden = corpus()
    got = {r.doc_id: r for r in secrets.find_secrets(documents(spark, rows)).collect()}
    text = dict(rows)
    found = {i: [(s.kind, text[i][s.start : s.end]) for s in r.spans] for i, r in got.items()}
    # Bare credentials of a labelled format, that no pattern finds.
    assert sum(hidden[i] in [v for _, v in found[i]] for i in hidden) >= 0.9 * len(hidden)
    # Words and other numbers are left alone, and base spans stay.
    assert not [v for i in found if i < 1000 for k, v in found[i] if k.startswith("like")]
    assert all([k for k, _ in found[i]] == ["assign", "hex", "access"] for i in range(150))


def test_secrets_awkward(spark):
    assert secrets.digest(secrets.find_secrets(spark.createDataFrame([], SCHEMA))).count() == 0
    few = secrets.find_secrets(documents(spark, [(1, "token=abcdef"), (1, "token=abcdef"), (None, None)])).collect()
    assert sorted(len(r.spans) for r in few) == [0, 1, 1]


def test_automaton_learns_a_format():
    rng = random.Random(1)
    made = [f"{rng.choice('xy')}-{hexes(rng, 6)}" for _ in range(400)]
    known = secrets.learn(made)
    good, bad = (np.mean([secrets.score(known, w) for w in ws]) for ws in ([f"x-{hexes(rng, 6)}" for _ in range(50)], [f"{hexes(rng, 6)}-x" for _ in range(50)]))
    assert good > bad + 1 and 2 < len(known) < 40
    # Probabilities of a state add up to one, but for what is left to symbols never seen.
    for to, end, _ in known.values():
        assert 0.5 < math.exp(end) + sum(math.exp(p) for c, (_, p) in to.items() if len(c) == 1) <= 1 + 1e-9


# Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """docs: rows, each a document of its own."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for item, t in items:
        asked[item] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_search_against_all_documents(spark, monkeypatch):
    rows = [*awkward(), *[(500 + k, " ".join(words(k % 17, 3 + k % 40, 30))) for k in range(300)], *[(900 + k, "bo1 ca2") for k in range(40)]]
    items = [(1, "bo1 ca2 DU3"), (2, None), (3, ""), (4, " ".join(words(3, 60, 30))), (5, "école É 中文 w­x"), (6, "one TWO"), (6, "words"), (7, "unheardof"), (8, "a x new3x1")]
    queries = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    want = ranked(rows, items, 7)
    for chunk, piece, first in ((200_000, 100_000, 8), (40, 30, 1)):
        monkeypatch.setattr(lexical, "CHUNK", chunk)
        monkeypatch.setattr(lexical, "SLICE", piece)
        monkeypatch.setattr(lexical, "FIRST", first)
        index = lexical.build_index(documents(spark, rows).repartition(7))
        assert sorted(map(tuple, lexical.search(index, queries, 7).collect()), key=repr) == want


def test_index_holds_every_term_once(spark):
    rows = [(k, " ".join(words(k % 5, 50, 20))) for k in range(80)]
    index = lexical.build_index(documents(spark, rows))
    got = collections.Counter()
    for r in index.chunks.collect():
        run = at = 0
        for term, runs in zip(r.terms, r.runs, strict=True):
            for _ in range(runs):
                for d in r.docs[at : at + r.run_docs[run]]:
                    got[(r.doc_ids[d], bytes(term).decode(), r.run_tf[run])] += 1
                at, run = at + r.run_docs[run], run + 1
    assert got == collections.Counter((i, t, n) for i, text in rows for t, n in collections.Counter(terms(text)).items())
    assert (index.documents, index.length) == (80, 80 * 50)


def test_search_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(lexical.build_index(nothing), queries).count() == 0
    assert lexical.search(lexical.build_index(documents(spark, [(1, "one")])), queries.limit(0)).count() == 0
    assert [r.doc_id for r in lexical.search(lexical.build_index(documents(spark, [(1, "one"), (2, None), (3, "--")])), queries).collect()] == [1]


# Vector codes


def lloyd(rows, parts, entries, rounds):
    """Every distance of every round; rows: (vec_id, vector, label) that are kept."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    width, codes, error, books = x.shape[1] // parts, [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        points = x[:, p * width : (p + 1) * width]
        book = points[:entries].copy()
        for r in range(rounds + 1):
            d = ((points[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            for e in range(len(book) if r < rounds else 0):
                if (near == e).any():
                    book[e] = points[near == e].sum(0) // (near == e).sum()
        codes.append(near)
        error += d.min(1)
        books.append(book)
    by_label = collections.Counter()
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] += int(e)
    text = ",".join(str(v) for b in books for v in b.ravel())
    return collections.Counter((r[0], tuple(int(c[i]) for c in codes), int(error[i]), by_label[r[2]], text) for i, r in enumerate(rows))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, error long, codes string")


@pytest.mark.parametrize(("entries", "block", "leaf"), [(256, 4096, 16), (10, 64, 3), (37, 5, 1)])
def test_codes_against_all_distances(spark, monkeypatch, entries, block, leaf):
    monkeypatch.setattr(vectorcode, "BLOCK", block)
    monkeypatch.setattr(vectorcode, "LEAF", leaf)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    rows = [(int(i), [float(v) for v in np.float32(centres[i % 9] + 0.2 * rng.normal(size=16))], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    # Ties: equal vectors under many ids, points half way between two entries, repeated rows.
    rows += [(400 + k, rows[0][1], 1) for k in range(60)] + [(500 + k, [float(k % 2)] * 16, 5) for k in range(20)] + [(7, [0.5] * 16, 1), (None, [0.25] * 16, None)]
    bad = [(600, None, 1), (601, [], 1), (602, [float("nan")] + [0.0] * 15, 1), (603, [float("inf")] + [0.0] * 15, 1), (604, [None] + [0.0] * 15, 1), (605, [1e30] + [0.0] * 15, 1), (606, [1.0] * 12, 1)]
    got = vectorcode.compress(vectors(spark, rows + bad).repartition(3), 4, entries, 4).collect()
    assert collections.Counter((r.vec_id, tuple(r.codes), r.error, r.label_error, r.codebooks) for r in got) == lloyd(rows, 4, entries, 4)


def test_codes_of_few_and_none(spark):
    assert vectorcode.digest(vectorcode.compress(vectors(spark, []))).count() == 0
    assert vectorcode.compress(vectors(spark, [(1, None, 1)])).count() == 0
    one = vectorcode.digest(vectorcode.compress(vectors(spark, [(1, [0.5, -0.5, 1.0, 2.0], None)]))).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(1, "00000000", 0, 0)] and one[0].codebooks_sha256 == hashlib.sha256(b"512,-512,1024,2048").hexdigest()


def test_nodes_are_assigned_as_a_whole():
    """Well separated clusters need few comparisons of single points."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    points = np.repeat(centres, 256, axis=0) + rng.integers(-50, 50, (4096, 8))
    levels = vectorcode.depth(len(points), 16)
    tree = vectorcode.Tree(points[vectorcode.tree_order(points, levels)], levels)
    (entries, names), = vectorcode.entry_trees(centres[None])
    whole, single = [], []
    vectorcode.assign(tree, entries, names, lambda begin, end, *_: whole.append(end - begin), lambda places, *_: single.append(len(places)))
    assert sum(whole) + sum(single) == 4096 and sum(whole) >= 4000 and len(whole) < 200
