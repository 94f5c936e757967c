"""Small tables with nulls, blanks, ties, repeated rows, very long texts and extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, node long, kept boolean, ids string, n_tokens long, block long, size long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(["en", "s"] if len(r) == 2 else []), 1, "x", 2, False, "y", 3, 4, 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward():
    long = " ".join(words(1, 6000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, "ÉCOLE école 中文 😀 \u0130"), (8, long), (9, long.upper()), (10, "x" * 5000), (11, "a a a a a a"), (12, "<|endoftext|> '<|startoftext|>'"), (12, "<|endoftext|> '<|startoftext|>'"), (13, "tab\tv\x0bf\x0c nb\u00a0sp \u0085 \u3000e")]
    rows += [(20 + k, " ".join(words(k, 120))) for k in range(6)]
    base = words(99, 300)
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[(37 * j + 11) % 300] = f"new{k}x{j}"
        rows.append((40 + k, " ".join(w)))
    return [*rows, (None, "no id"), (None, None)]
