"""Each operator against a plain version of itself."""

import collections
import hashlib
import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from quarry.llm import bpe, chat, token_counts
from quarry.llm.binpack import PADDING, best_fit, write_packed
from quarry.llm.common import connected_components, join_groups
from quarry.llm.dedup_exact import drop_exact_duplicates, exact_duplicates
from quarry.llm.jaccard import drop_near_duplicates, jaccard_classes, search
from quarry.llm.packing import Index, fill, pack
from quarry.llm.quality import drop_outliers, quality_verdicts, statistics_of
from quarry.llm.sharding import TABLE_SIZE, lookup_table, place
from quarry.llm.tokens import SEPARATOR, byte_ids
from quarry.llm.url_filter import url_verdicts
from tests.llm.cases import SCHEMA, awkward, documents, words


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, awkward()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def fold(text):
    return (text or "").encode().lower().decode()


# -- shared parts
def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    e = spark.createDataFrame([*chain, *hub, (None, 5), (7, 7), (3, None)], "a long, b long")
    got = dict(map(tuple, connected_components(e).collect()))
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_join_groups_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.common.BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(5000)], "k long, v long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    assert sorted_rows(join_groups(rows, groups, ["k"], "n", 5000), "k", "v", "n", "m") == sorted_rows(rows.join(groups, "k"), "k", "v", "n", "m")
    assert join_groups(rows, groups.filter("k < 3"), ["k"], "n", 5000, "left").count() == 5000


# -- 1
def test_bpe(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in awkward():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    assert sorted_rows(bpe.decode(bpe.encode(docs)), "doc_id", "ids", "decoded") == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_in_many_blocks_buckets_and_partitions(spark, docs, monkeypatch):
    """Each distinct word of the corpus is encoded in one bucket, however many blocks and partitions ask for it."""
    want = sorted_rows(bpe.encode(docs), "doc_id", "ids")
    rows = [r for _ in range(30) for r in awkward()]
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 20_000)
    df = documents(spark, rows).repartition(70)
    assert sorted_rows(bpe.encode(df), "doc_id", "ids") == sorted(want * 30, key=repr)
    size = sum(len((t or "").encode()) for _, t in rows)
    requests = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda it: bpe.request_rows(it, 4000, size // 20_000), "block long, bucket int, size long, words binary").collect()
    asked = collections.defaultdict(set)
    for r in requests:
        for w in bpe.unsqueeze(r.words, r.size).split(b"\n"):
            asked[w].add(r.bucket)
    assert all(len(b) == 1 for b in asked.values()) and set(asked) == {w for _, t in rows for w in (t or "").encode().split()}
    blocks = collections.Counter(b >> 32 for b in {r.block for r in requests})
    assert len(blocks) > 64 and max(blocks.values()) > 1


# -- 2
def test_sharding(docs, empty):
    shards = [f"s{k}" for k in range(10)]
    table = lookup_table(shards, 1009)
    # The same by whole permutations, shard by shard, in turns.
    number = lambda name, salt: int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")
    orders = [iter([(number(s, "offset") + j * (number(s, "skip") % 1008 + 1)) % 1009 for j in range(1009)]) for s in shards]
    owner = {}
    while len(owner) < 1009:
        for k, order in enumerate(orders):
            if len(owner) < 1009:
                owner[next(x for x in order if x not in owner)] = k
    assert table == [owner[x] for x in range(1009)]
    count = collections.Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    # Losing a shard moves its own slots and few others.
    fewer = lookup_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 9) < 0.25 * 1009
    slot = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) % TABLE_SIZE
    full = lookup_table(shards)
    want = sorted(((i, len((t or "").encode()), slot(i), shards[full[slot(i)]]) for i, t in awkward()), key=repr)
    assert sorted_rows(place(docs, shards), "doc_id", "n_bytes", "slot", "shard") == want
    assert place(empty, shards).count() == 0
    with pytest.raises(ValueError):
        lookup_table([])


# -- 3
def test_exact_duplicates(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in awkward():
        groups[fold(t)].append(i)
    big = lambda ids: max((i for i in ids if i is not None), default=None)
    want = sorted(((i, big(groups[fold(t)]), len(groups[fold(t)]), sha(fold(t))) for i, t in awkward()), key=repr)
    got = exact_duplicates(docs)
    assert sorted_rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r.text_sha256 for r in got.filter("kept").collect()]
    assert sorted(kept) == sorted(map(sha, groups))
    assert sorted(map(fold, (r.text for r in drop_exact_duplicates(docs).collect()))) == sorted(groups)
    assert drop_exact_duplicates(docs).columns == docs.columns
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_exact_duplicates_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.common.BROADCAST_BYTES", 0)
    df = documents(spark, [(i, "same" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()}
    groups = collections.defaultdict(list)
    for i in range(3000):
        groups["same" if i % 3 == 0 else i // 2].append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_duplicates_in_slices_shuffle_only_repeated_rows(spark, monkeypatch):
    """However large the filter: what is broadcast is a slice of bounded size, and unrepeated rows never shuffle."""
    from quarry.llm import dedup_exact

    monkeypatch.setattr(dedup_exact, "SLICE_BYTES", 64 * 40)
    rows = [(i, f"once {i}") for i in range(600)] + [(1000 + i, f"Twice {i % 150}") for i in range(300)] + [(5000, "twice 7"), (5000, "twice 7")]
    df = documents(spark, rows).repartition(3)
    held = []
    monkeypatch.setattr(dedup_exact, "probe", lambda r, again, a, b, f=dedup_exact.probe: (held.append((again.filter(f"_word >= {a} and _word < {b}").count(), f(r, again, a, b)._jdf.queryExecution().executedPlan().toString())), f(r, again, a, b))[1])
    got = exact_duplicates(df)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    assert sorted_rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(((i, max(groups[fold(t)]), len(groups[fold(t)]), sha(fold(t))) for i, t in rows), key=repr)
    assert got.filter("kept").count() == len(groups)
    assert len(held) > 2 and all(n <= 80 for n, _ in held) and not any("hashpartitioning" in plan for _, plan in held)
    maybe = sum(f.filter("_maybe").count() for f in [dedup_exact.union_all([dedup_exact.probe(*x) for x in _probes(df)])])
    assert 302 <= maybe < 400
    assert sorted(map(fold, (r.text for r in drop_exact_duplicates(df).collect()))) == sorted(groups)


def _probes(df):
    from quarry.llm import dedup_exact

    rows = dedup_exact.digests(df, 256)
    return [(rows, dedup_exact.seen_again(rows), 0, 256)]


# -- 4
def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, k, num, den):
    """(doc_id, n_shingles, component_id, n_links) of every row with an id, by comparing all rows; rows of one id share a component."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}
    links = [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            n = len(x & y)
            if x and y and den * n >= num * (len(x) + len(y) - n):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted((i, len(s), find(i) if s else i, links[a]) for a, (i, s) in enumerate(sets))


def jaccard_rows(df, *how):
    return sorted(tuple(r) for r in jaccard_classes(df, *how).select("doc_id", "n_shingles", "component_id", "n_links").collect() if r.doc_id is not None)


def variants(seed, n, length, most, start=0):
    """Different texts of ``length`` words, each with up to ``most`` words changed from one base."""
    rng = np.random.default_rng(seed)
    base, rows = words(seed, length), []
    for k in range(n):
        w = list(base)
        for at in rng.choice(length, int(rng.integers(0, most + 1)), replace=False):
            w[at] = f"v{k}x{at}"
        rows.append((start + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard(docs, k, num, den):
    assert jaccard_rows(docs, k, num, den) == classes(awkward(), k, num, den)


def test_jaccard_in_parts_and_blocks(spark, docs, empty, monkeypatch):
    monkeypatch.setattr("quarry.llm.jaccard.PART_DOCS", 3)
    monkeypatch.setattr("quarry.llm.jaccard.BLOCK_BYTES", 20_000)
    monkeypatch.setattr("quarry.llm.jaccard.BUCKET_BYTES", 30_000)
    assert jaccard_rows(docs, 3, 90, 100) == classes(awkward(), 3, 90, 100)
    rows = variants(1, 60, 200, 9) + variants(2, 30, 90, 3, 100) + [(200 + k, t) for k, t in variants(1, 5, 200, 9)]
    assert jaccard_rows(documents(spark, rows).repartition(5), 3, 90, 100) == classes(rows, 3, 90, 100)
    assert jaccard_classes(empty).count() == 0


def test_jaccard_of_hot_lists(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.jaccard.LIST_DOCS", 10)
    rows = variants(3, 50, 120, 4) + [(100 + k, f"{' '.join(words(9, 60))} {' '.join(words(50 + k, 4 + k))}") for k in range(30)]
    assert jaccard_rows(documents(spark, rows), 3, 90, 100) == classes(rows, 3, 90, 100)


def test_jaccard_tells_all_texts_apart(spark):
    """Words that polynomial hashes modulo a power of two confuse."""
    rows = []
    for k, n in ((0, 10), (10, 11)):
        morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        rows += [(k + 1, morse), (k + 2, morse.translate({97: "b", 98: "a"})), (k + 3, f"x {morse} y"), (k + 4, f"x {morse.translate({97: 'b', 98: 'a'})} y")]
    got = jaccard_rows(documents(spark, rows), 3, 90, 100)
    assert got == [(i, 1, i, 0) for i, _ in rows]


def test_jaccard_of_one_id_with_several_texts(spark):
    a, b = variants(5, 8, 150, 2), variants(6, 8, 150, 2, 50)
    rows = [*a, *b, (3, b[4][1]), (60, "short"), (60, "other text"), (61, "short"), (3, a[3][1])]
    assert jaccard_rows(documents(spark, rows).repartition(3), 3, 90, 100) == classes(rows, 3, 90, 100)


def test_shared_passages_make_no_group(spark, monkeypatch):
    """Texts of nothing but shared passages, which share rare lists by the dozen, tie only where sizes and parities allow a link."""
    from quarry.llm import jaccard

    passages = [words(700 + k, 40) for k in range(12)]
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(w for p in rng.choice(12, 4, replace=False) for w in passages[p])) for k in range(120)]
    largest = []
    monkeypatch.setattr(jaccard, "tied", lambda *a, f=jaccard.tied: (largest.append((g := f(*a)).groupBy("component").count().agg(F.max("count")).first()[0] or 0), g)[1])
    assert jaccard_rows(documents(spark, rows), 3, 90, 100) == classes(rows, 3, 90, 100)
    assert largest[0] < 20


def test_near_duplicates_keep_one(docs):
    stay = {c for _, _, c, _ in classes(awkward(), 5, 4, 5)} | {None}
    got = drop_near_duplicates(docs)
    assert {r.doc_id for r in got.collect()} == stay and got.columns == docs.columns


def test_search_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        at = rng.choice(60, int(rng.integers(0, 9)), replace=False)
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    every = {(a, b) for a in range(80) for b in range(a + 1, 80) if 10 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 8 * (len(sets[a]) + len(sets[b]) - n)}
    pairs = lambda a, b: {tuple(sorted((q, int(d)))) for q, found in search(a, b, sets, 8, 10) for d in found}
    assert pairs(list(range(80)), list(range(80))) == every and 0 < len(every) < 3000
    assert pairs(list(range(30)), list(range(30, 80))) == {(a, b) for a, b in every if a < 30 <= b}


# -- 5
TRICKY = ["<|im_end|><|im_start|>assistant ok", "\u0010", "<\u0010|", "\u0010e<|", "", None, "a\nb", "😀" * 50, "<" + "|", "<<||"]


def conversation_rows():
    rows = [(-1, 0, "user", TRICKY[0]), (-1, 1, "assistant", TRICKY[0])]
    for c in range(6):
        rows.append((c, 0, "system", f"be {c}")) if c % 2 else None
        for k in range(1, 3 + 9 * c):
            rows.append((c, k, "user" if k % 2 else "assistant", TRICKY[k % len(TRICKY)] if k % 3 else " ".join(words(k, 10 * c * k % 900))))
    rows += [(7, 0, None, "x"), (7, None, "assistant", "first"), (8, 0, "assistant", "same"), (8, 0, "assistant", "same"), (9, 0, "assistant", "w " * 9000), (None, 0, "assistant", "free"), (10, 0, "us<|er\n\u0010n", "t")]
    return rows


def test_chat(spark):
    df = spark.createDataFrame([(*r, 1, "f") for r in conversation_rows()], "conv_id long, turn long, role string, text string, window long, formatted string").repartition(4)
    windows = chat.format_windows(df).cache()
    want = {}
    by = collections.defaultdict(list)
    for c, k, r, t in conversation_rows():
        by[c].append((k is not None, k or 0, r or "", t or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digest(windows).collect()}
    assert got == want
    for r in windows.collect():
        parts = [r.formatted[s["from"] : s["from"] + s["length"]] for s in r.spans]
        assert r.formatted.count("<|") == 2 * len(parts) and not any("<|" in p for p in parts)
        own = [s for s in r.spans if not s.repeated]
        history = [s for s in r.spans if s.repeated and s.seq]
        assert own and all(not s.learn for s in r.spans if s.repeated)
        assert sum(math.ceil((s.length) / 4) for s in history) <= chat.HISTORY
        assert len(own) == 1 or len(r.formatted) <= 8 * chat.BUDGET
    assert chat.conversation_digest(chat.format_windows(df.limit(0))).count() == 0


def test_chat_windows_hold_their_tokens(spark):
    text = lambda n: " ".join(["x"] * n)
    made = {
        1: [("user", text(n - 5)) for n in (269, 500, 500, 267, 30, 40, 900, 20)],
        2: [("user", "龘靐齉爩麤" * 40) for _ in range(12)],
        3: [("system", text(300)), *[("user", text(40 + 30 * k)) for k in range(30)]],
        4: [("system", text(900)), *[("assistant", text(30)) for _ in range(12)], ("user", text(400)), ("user", "<|" * 20)],
        5: [("user", text(50)), ("user", text(3000)), *[("user", "<|\u0010" * 30) for _ in range(20)]],
        6: [(("user", "assistant")[k % 2], "ok") for k in range(400)],
    }
    df = spark.createDataFrame([(c, k, *t) for c, rows in made.items() for k, t in enumerate(rows)], "conv_id long, turn long, role string, text string").repartition(3)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    seen, history = collections.defaultdict(list), collections.Counter()
    for r in chat.format_windows(df).collect():
        pieces = [p.removesuffix("<|im_end|>\n").split("\n", 1) for p in r.formatted.split("<|im_start|>")[1:]]
        costs = [n(f"<|im_start|>{role}\n{body}<|im_end|>\n") for role, body in pieces]
        assert sum(costs) == n(r.formatted)
        own = [k for k, s in enumerate(r.spans) if not s.repeated and pieces[k][0] != "system"]
        assert sum(costs) <= chat.BUDGET or len(own) == 1 and len(costs) - 1 == (pieces[0][0] == "system")
        assert (made[r.conv_id][0][0] == "system") == (pieces[0][0] == "system")
        old = [k for k, s in enumerate(r.spans) if s.repeated and pieces[k][0] != "system"]
        assert sum(costs[k] for k in old) <= chat.HISTORY
        history[r.conv_id] += len(old)
        seen[r.conv_id] += [s.seq for s in r.spans if not s.repeated]
    assert {c: sorted(s) for c, s in seen.items()} == {c: list(range(len(rows))) for c, rows in made.items()}
    assert history[3] and history[4] and history[5]


# -- 6
def test_token_counts(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in awkward()]
    want = {L: (n.count(L), sum(x > L for x in n), len(n), sum(n), sum(min(x, L) for x in n)) for L in n}
    got = {r.context_limit: (r.n_docs, r.docs_over, r.docs_total, r.tokens_total, r.truncated_total) for r in token_counts.length_histogram(docs).collect()}
    assert got == want
    assert all(abs(r.share_within - sum(x <= r.context_limit for x in n) / len(n)) < 1e-8 for r in token_counts.length_histogram(docs).collect())
    assert token_counts.length_histogram(empty).count() == 0


# -- 7
def check_pieces(rows, encoded):
    """(key, start, length, ids, sequence, offset) cover each document once and lie gapless in sequences."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for k, ids in encoded.items():
        pieces = sorted(by[k], key=lambda r: r[1])
        assert b"".join(r[3] for r in pieces) == ids.tobytes() and [r[1] for r in pieces] == [0, *np.cumsum([r[2] for r in pieces])[:-1].tolist()]


def test_packing(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = awkward()
    rows.remove(rows[12])  # the repeated row is checked by count
    encoded = {(i, x or ""): np.array([*t.encode(x or "", add_special_tokens=False).ids, SEPARATOR], np.uint32) for i, x in rows if i is not None}
    got = pack(docs).collect()
    text = {i: x or "" for i, x in rows if i is not None}
    plain = [((r.doc_id, text[r.doc_id]), r.start, r.length, bytes(r.ids), r.sequence_id, r.offset) for r in got if r.doc_id not in (None, 12)]
    check_pieces(plain, {k: v for k, v in encoded.items() if k[0] != 12})
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in awkward())
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in seqs.values()) <= 1
    assert pack(empty).count() == 0


def test_index_is_bm25():
    tokens = [np.array(x, np.uint32) for x in ([1, 2, 3, 1], [1, 2, 9], [7, 8], [5, 6], [4, 4, 4], [3, 9, 9, 9], [10], [11])]
    index, n = Index(tokens), 8
    mean = np.mean([len(t) for t in tokens])
    for q in range(n):
        for d in range(n):
            score = 0.0
            for term in set(tokens[q].tolist()):
                df = sum(term in t.tolist() for t in tokens)
                tf = tokens[d].tolist().count(term)
                if tf and df > 1 and 2 * df < n:
                    score += math.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[d]) / mean))
            assert index.scores(q)[d] == pytest.approx(score)


def test_windows_take_the_nearest():
    near = list(range(100, 400))
    tokens = [np.array(x, np.uint32) for x in (near, list(range(5000, 5300)), near[50:] + [7], *[list(range(9000 + 400 * k, 9300 + 400 * k)) for k in range(4)])]
    pieces = fill(tokens, 500)
    first = [p[0] for p in pieces if p[3] == 0]
    assert first[:2] == [0, 2]


# -- 8
def test_urls(spark):
    page = lambda href: f'<html><head><LINK href="{href}" rel="canonical"></head>'
    rows = [
        (1, "https://A.example.ORG/es/x?q#f", None), (2, "http://example.org/en/12", ""), (3, "http://example.org/en/2", ""), (4, "http://x.com/fr/", ""), (5, "http://x.com/fr", ""), (6, "x.com/de/", ""), (7, None, None), (8, "http://com/de/a", ""), (9, "http://xcom/de/a", ""),
        (10, "http://alias.net/a", page("http://bad.com/de/1")), (11, "http://bad.com/de/1", ""), (12, "http://third.net/t", page("/moved")), (13, "http://third.net/moved", '<meta http-equiv="refresh" content="0; url=http://alias.net/a">'),
        (14, "http://mixed.net/m", page("http://good.com/fr/1")), (15, "http://good.com/fr/1", page("http://worse.com/de/9")), (16, "http://worse.com/de/9", ""), (17, "http://alone.net/", page("relative")), (18, "http://alias.net/a", ""), (18, "http://alias.net/a", ""), (19, "a://b://example.org/es/", ""), (20, "http://org?x", ""), (21, "http://org\n/es/", ""),
    ]
    df = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(df).collect()}
    assert url_verdicts(df).count() == len(rows)
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"), 4: ("x.com", "/fr/", "com/fr/", "allow"), 5: ("x.com", "/fr", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("com", "/de/a", "com/de/", "block"), 9: ("xcom", "/de/a", None, "allow"),
        10: ("alias.net", "/a", None, "block"), 11: ("bad.com", "/de/1", "com/de/", "block"), 12: ("third.net", "/t", None, "block"), 13: ("third.net", "/moved", None, "block"),
        14: ("mixed.net", "/m", None, "allow"), 15: ("good.com", "/fr/1", "com/fr/", "allow"), 16: ("worse.com", "/de/9", "com/de/", "block"), 17: ("alone.net", "/", None, "allow"), 18: ("alias.net", "/a", None, "block"), 19: ("b:", "//example.org/es/", None, "allow"), 20: ("org", "", None, "allow"), 21: ("org\n", "/es/", None, "allow"),
    }
    assert url_verdicts(df.limit(0)).count() == 0
    moves = spark.createDataFrame([("http://alone.net/", "http://bad.com/de/1"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_verdicts(df, redirects=moves).collect()}[17] == "block"


def test_urls_of_targets_that_are_no_pages(spark):
    refresh = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [
        (1, "http://a.net/x", refresh("http://bad.com/de/1")), (2, "http://b.net/x", ""), (3, "http://c.net/x", refresh("http://bad.com/de/2") + refresh("http://good.com/fr/")), (4, "http://d.net/x", refresh("http://bad.com/de/3")), (5, "http://e.net/x", ""),
        (6, "http://f.com/top/de.html", refresh("../de/index.html")), (7, "http://g.net/dir/p", refresh("q.html?x")), (8, "http://g.net/dir/q.html", refresh("http://bad.com/de/4")), (9, "http://h.com/x", refresh("de/")), (10, "http://i.net/a", refresh("mailto:x@bad.com/de/")),
        (11, "http://j.com", refresh("de/./k?to=http://good.com/fr/")), (12, "http://k.com/a/b", refresh("../../../de/..")), (13, "http://k.com/", refresh("http://bad.com/de/5")), (14, "http://l.net/a", refresh("http:///de/")), (15, None, refresh("http://bad.com/de/1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://b.net/x", "http://mid.net/"), ("http://mid.net/", "http://bad.com/de/1"), ("http://e.net/x", "http://good.com/fr/9"), ("http://e.net/x", "http://d.net/x")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_verdicts(df, redirects=moves).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 6, 7, 8, 9, 11, 12, 13} and len(got) == len(rows)


# -- 9
def test_statistics():
    for _, t in awkward():
        t = t or ""
        w = t.encode().split()
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = set()
        for k in range(len(w) - 2):
            if c[w[k], w[k + 1], w[k + 2]] > 1:
                again |= {k, k + 1, k + 2}
        assert statistics_of(t)[::4] == (len(w), len(again)) and statistics_of(t)[1] == sum(len(x.decode()) for x in w)
    assert statistics_of("a#\n\na#\n \n b $$") == (4, 7, 4, 1, 0)
    assert statistics_of("x y z x y z")[4] == 6 and statistics_of("a a a a")[4] == 4 and statistics_of("a a a")[4] == 0


def test_quality(spark, docs, empty):
    clean = [(i, ". ".join(" ".join(words(1000 * i + k, 12, 4000)) for k in range(6 + i % 40)), "en", f"s{i % 2}" if i % 5 else None) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in words(i, 90, 4000)), "en", f"s{i % 2}") for i in range(40)]
    repeats = [(2000 + i, "\n".join([" ".join(words(i, 8))] * 12), "en", "s0") for i in range(5)]
    few = [(3000, None, None, None), (3001, "short", "fr", "x"), (3002, " ".join(words(5, 60)), "fr", "x")]
    df = documents(spark, clean + junk + repeats + few).repartition(5)
    got = {r.doc_id: r for r in quality_verdicts(df).collect()}
    assert all(got[i].kept for i, *_ in clean) and not any(got[i].kept or got[i].base_failed for i, *_ in junk)
    assert all(got[i].base_failed and not got[i].kept for i, *_ in repeats) and got[3000].base_failed and got[3001].base_failed and got[3002].kept
    assert {r.doc_id for r in drop_outliers(df).collect()} == {i for i, *_ in clean} | {3002} and drop_outliers(df).columns == df.columns
    assert quality_verdicts(docs).count() == len(awkward()) and quality_verdicts(empty).count() == 0


def test_each_statistic_rejects_alone(spark):
    clean = [(i, " ".join(words(i, 1000, 40_000)), "en", "s") for i in range(120)]
    assert not any(statistics_of(t)[k] for _, t, *_ in clean for k in (2, 3, 4))
    fresh = lambda seed, n: words(seed, n, 40_000)
    lines = [" ".join(fresh(7000 + k, 10)) for k in range(20)]
    twice = [w for k in range(100) for w in ("\n", f"line{k}", "\n", *fresh(8000 + k, 8))]
    short = fresh(9200, 12)
    odd = {
        1000: " ".join(w * 4 for w in fresh(9000, 1000)),
        1001: " ".join(w + "#" * (k % 4 == 0) for k, w in enumerate(fresh(9001, 1000))),
        1002: " ".join([*twice, *twice[:2], *(x for k in range(100) for x in ("\n", f"line{k}", "\n", *fresh(9500 + k, 1)))]),
        1003: " ".join([*sum((x.split() for x in lines), []), *fresh(9003, 600), *sum((x.split() for x in lines), [])]),
        1004: "\n".join([*lines, " ".join(fresh(9004, 600)), *lines]),
        1005: " ".join([*short, *fresh(9005, 26), *short]),
    }
    # What each but the fifth differs in: word length, symbols, repeated lines, repeated words; the fifth is in both kinds of repeats.
    alone = [[n > 0 for n in statistics_of(t)[2:]] for t in odd.values()]
    assert alone == [[False, False, False], [True, False, False], [False, True, False], [False, False, True], [False, True, True], [False, False, True]]
    got = {r.doc_id: r for r in quality_verdicts(documents(spark, clean + [(i, t, "en", "s") for i, t in odd.items()])).collect()}
    assert not any(got[i].base_failed for i in odd) and [i for i in odd if got[i].kept] == [] and all(got[i].kept for i, *_ in clean)


def test_quality_does_not_depend_on_partitions(spark):
    rows = [(i, ". ".join(" ".join(words(1000 * i + k, 12, 4000)) for k in range(5 + i % 9)) + "#" * (i % 7) * (i % 3), "en", f"s{i % 2}") for i in range(160)]
    got = [sorted(map(tuple, quality_verdicts(documents(spark, rows).repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_quality_against_every_subset(spark, monkeypatch):
    """Small groups, for which the subset with the least determinant is found among all. Concentration from few starts may end
    in another subset; then only verdicts near the cutoff may differ."""
    import itertools

    from quarry.llm import quality

    monkeypatch.setattr(quality, "LEAST_GROUP", 5)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(4):
        for i in range(14):
            w = words(100 * g + i, 80 + int(rng.integers(0, 60)), 4000)
            for k in range(int(rng.integers(0, 4)) + (40 if i % 7 == 3 else 0)):
                w[k] += "#"
            w = [x + "x" * int(rng.integers(0, 2 + g)) for x in w] if i % 5 else w
            lines = [" ".join(w[k : k + 8]) for k in range(0, len(w), 8)]
            rows.append((100 * g + i, "\n".join(lines + lines[:1] * int(rng.integers(0, 3)) + lines[:3] * (2 * (i == 9))), "en", f"s{g}"))
    got = {r.doc_id: r for r in quality_verdicts(documents(spark, rows).repartition(3)).collect()}
    same = []
    for g in range(4):
        ids = [i for i, *_ in rows if i // 100 == g and not got[i].base_failed]
        n = np.array([[got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words] for i in ids], float)
        z = np.round(np.column_stack([np.log(n[:, 1] / n[:, 0]), *(np.log1p(100 * n[:, k] / (n[:, 0] + 100)) for k in (2, 3, 4))]), 5)

        def estimate(rows):
            return rows.mean(0), quality.CONSISTENT * np.cov(rows.T, bias=True) + np.diag(np.square(quality.FLOORS))

        h = math.ceil(quality.SHARE * len(ids))
        fits = [estimate(z[list(some)]) for some in itertools.combinations(range(len(ids)), h)]
        centre, cov = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
        far = np.einsum("ij,jk,ik->i", z - centre, np.linalg.inv(cov), z - centre)
        assert all(got[i].kept == (d <= quality.CUTOFF) for i, d in zip(ids, far) if abs(d - quality.CUTOFF) > 0.1 * quality.CUTOFF)
        same.append(np.allclose([got[i].outlyingness for i in ids], far, rtol=1e-3, atol=1e-3))
    assert sum(same) >= 3 and 0 < sum(not r.kept for r in got.values()) < len(rows) / 2


# -- 10
def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(0, 90, int(rng.integers(0, 60))).tolist()
        rows = best_fit(lengths, 32)
        assert sorted((d, s, n) for r in rows for d, s, n in r) == sorted((d, s, min(32, L - s)) for d, L in enumerate(lengths) for s in range(0, L, 32))
        free: list[int] = []
        for n in sorted((L % 32 for L in lengths if L % 32), reverse=True):
            fit = [c for c in free if c >= n]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - n)
            else:
                free.append(32 - n)
        packed = [32 - sum(n for _, _, n in r) for r in rows if any(n < 32 for _, _, n in r)]
        assert sorted(packed) == sorted(free)


def test_written_matrices(docs, empty, tmp_path):
    rows = write_packed(docs, str(tmp_path / "packed")).collect()
    total = 0
    pieces = collections.defaultdict(list)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, np.uint32), np.frombuffer(r.position_ids, np.uint16)
        assert len(ids) == len(positions) == 2048 and (ids[r.n_tokens :] == PADDING).all() and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert (positions[a:b] == np.arange(b - a)).all()
            pieces[d].append((s, ids[a:b].tolist()))
        total += r.n_tokens
    assert total == sum(len(byte_ids(t or "")) + 1 for _, t in awkward())
    for i, t in awkward():
        if i not in (None, 12):
            assert sum((x for _, x in sorted(pieces[i])), []) == [*byte_ids(t or ""), SEPARATOR]
    assert write_packed(empty, str(tmp_path / "none")).count() == 0


def test_crc(spark):
    assert zlib.crc32(b"\x01\x00\x00\x00") == spark.createDataFrame([(bytearray(b"\x01\x00\x00\x00"),)], "b binary").select(F.crc32("b")).first()[0]


def test_equal_rows_go_to_many_shards(spark, tmp_path, monkeypatch):
    from quarry.llm import packing

    monkeypatch.setattr(packing, "SHARD_BYTES", 1000)
    rows = write_packed(documents(spark, [(7, "word " * 40)] * 60).repartition(3), str(tmp_path / "packed")).collect()
    by_shard = collections.Counter()
    for r in rows:
        by_shard[r.shard] += len(r.doc_ids)
    assert sum(by_shard.values()) == 60 and len(by_shard) > 6 and max(by_shard.values()) < 20


def test_fill_takes_what_the_best_score_says():
    """As if the best unused document of all were looked for each time; and many short documents take no long."""
    rng = np.random.default_rng(2)
    tokens = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint32) for _ in range(150)] + [np.array([1], np.uint32)] * 30
    index, left, want, seq = Index(tokens), [len(t) for t in tokens], [], 0
    for seed in range(len(tokens)):
        if not left[seed]:
            continue
        room, d, scores = 100, seed, index.scores(seed)
        while room and d is not None:
            n = min(left[d], room)
            want.append((d, len(tokens[d]) - left[d], n, seq, 100 - room))
            left[d], room = left[d] - n, room - n
            d = max((k for k in range(len(tokens)) if left[k] and k != d), key=lambda k: (scores[k], -k), default=None)
        seq += 1
    assert fill(tokens, 100) == want
    began = time.process_time()
    assert len(fill([np.array([1], np.uint32)] * 200_000, 2048)) == 200_000 and time.process_time() - began < 20


def test_shards_are_written(spark, tmp_path):
    from quarry.llm.sharding import write_shards

    docs = documents(spark, [(k % 50, f"text {k}") for k in range(200)] + [(None, None)])
    shards = [f"s{k}" for k in range(5)]
    write_shards(docs, str(tmp_path / "out"), shards)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r.doc_id, r.text)
    assert collections.Counter(map(key, back.collect())) == collections.Counter(map(key, docs.collect()))
    assert {(r.doc_id, r.in_shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in place(docs, shards).collect()}
