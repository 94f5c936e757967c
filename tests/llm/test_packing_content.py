"""Where packing's documents lie by content, fitted on all of them, against a plain version."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import packing as P


def test_centres_are_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "CENTRES", 4)
    rng = np.random.default_rng(3)
    words = [[f"w{k}x{i}" for i in range(40)] for k in range(5)]
    texts = [" ".join(rng.choice(words[d % 5], 30)) for d in range(400)] + ["", " "]
    docs = [P.encoded(t) for t in texts]
    df = np.zeros(P.TERMS)
    for d in docs:
        df[np.unique(d)] += 1
    plain = P.Content(P.rarity(df, len(docs)))
    some, vectors, _ = plain.places(docs)
    tokens = spark.createDataFrame([(i, d.tobytes()) for i, d in enumerate(docs)], "row long, tokens binary").repartition(3)
    got, bounds = P.fitted(P.Content(plain.idf), tokens, 8)

    order = [r.row for r in spark.createDataFrame([(int(i),) for i in some], "row long").orderBy(F.xxhash64("row"), "row").collect()]
    at = {d: k for k, d in enumerate(some.tolist())}
    plain.centres = P.unit(vectors[[at[d] for d in order[:4]]])
    for _ in range(P.ROUNDS):
        near = plain.nearest(vectors)
        plain.centres = np.array([P.unit(vectors[near == k].sum(0, dtype=np.int64)[None])[0] if (near == k).any() else plain.centres[k] for k in range(4)])
    plain.centres = plain.centres[P.chain(plain.centres)]
    assert len(some) > 300 and np.allclose(got.centres, plain.centres, atol=1e-5)
    assert len(bounds) == 7 and (got.keys(docs) == plain.keys(docs)).all()
    part = got.part_of(got.keys(docs), np.arange(len(docs)), bounds)
    assert np.bincount(part, minlength=8).max() < 2.5 * len(docs) / 8


def test_copies_are_dealt_to_the_parts_that_their_key_fills():
    part = P.Content(np.zeros(P.TERMS)).part_of(np.array([5, 7, 7, 7, 7, 9]), np.arange(6), np.array([6.0, 7.0, 7.0]))
    assert part[0] == 0 and set(part[1:5]) == {1, 2, 3} and part[5] == 3
