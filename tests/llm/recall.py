"""python -m tests.llm.recall [SF_DIR]: of the ten documents that BM25 ranks next to a seed over the whole table, how many lie in the seed's shard,
for random seeds, and the same for those neighbours that share most with the seed (half of its own score or more)."""

import sys

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from quarry.llm.packing import Index, document_ids, pack
from quarry.session import local_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, "12g", 8)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shard = {r.doc_id: r.shard for r in pack(docs).groupBy("doc_id").agg(F.min("shard").alias("shard")).collect()}
    ids, tokens = document_ids(docs.select("doc_id", "text").toArrow())
    index, where = Index(tokens), np.array([shard[i] for i in ids])
    sizes = np.bincount(np.unique(where, return_inverse=True)[1])
    hits = close = n_close = 0
    seeds = np.random.default_rng(1).choice(len(ids), 200, replace=False)
    for seed in seeds:
        scores = index.scores(int(seed))
        own, scores[seed] = scores[seed], -1
        best = np.argsort(-scores, kind="stable")[:10]
        hits += (where[best] == where[seed]).sum()
        near = best[scores[best] >= own / 2]
        close, n_close = close + (where[near] == where[seed]).sum(), n_close + len(near)
    print(f"{len(ids)} documents, {len(sizes)} shards of {sizes.min()} to {sizes.max()}: {hits / 10 / len(seeds):.3f} of the ten nearest, {close / max(1, n_close):.3f} of {n_close} with half of the seed's own score")
