"""Packing places each document once, and its index drops the postings of used documents, with the same windows."""

import numpy as np

from quarry.llm import packing as P


def test_documents_are_placed_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i % 11} y{i % 5}") for i in range(60)] + [(60, None)], "doc_id long, text string")
    got = P.pack(docs)
    # The staged vectors are read where documents are dealt.
    assert "vector" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.doc_id for r in got.collect()}) == list(range(61))


def test_index_keeps_unused_documents_only(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(2, 60, rng.integers(1, 40)), P.SEPARATOR).astype(np.uint16) for _ in range(300)]
    index, plain = P.Index(docs), P.Index(docs)
    unused = rng.random(300) < 0.4
    index.keep(unused)
    assert len(index.docs) < len(plain.docs) and set(index.docs.tolist()) <= set(np.flatnonzero(unused).tolist())
    for seed in np.flatnonzero(unused)[:40].tolist():
        assert (index.scores(seed)[unused] == plain.scores(seed)[unused]).all()
    # All at once, without dropping postings or sorting in parts, gives the same pieces.
    got = P.fill(docs, 64)
    monkeypatch.setattr(P.Index, "keep", lambda self, unused: None)
    monkeypatch.setattr(P, "FIRST", 1000)
    assert got == P.fill(docs, 64)


def test_best_first_sorts_parts_as_a_whole():
    scores = np.random.default_rng(6).integers(0, 9, 400) / 2.0
    found = np.flatnonzero(scores > 0)
    assert list(P.best_first(scores)) == found[np.argsort(-scores[found], kind="stable")].tolist()


def test_quick_pattern_gives_the_ids_of_the_vocabularys_own():
    import random

    import public_tokenizers
    import tiktoken

    from quarry.llm import tokens as T

    quick = T._fast("byte_bpe_50k.tiktoken")
    assert quick._pat_str == T.PATTERN
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=quick._mergeable_ranks, special_tokens={})
    rng, parts = random.Random(1), ["a", "bé", "  ", " ", "\n", "\t", "'s", "'S", "'ll", "12", "½", "!?", "\x1c", "\x85", "　", "\xa0", "漢", "\r\n", "x" * 40, "'", "ة", "́", "<"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert quick.encode_ordinary(text) == own.encode_ordinary(text) == T.tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids, repr(text)
