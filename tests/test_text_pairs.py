"""Aliases, year bounds and bracketed names of texts on hand-made rows."""

from quarry import dims
from quarry.operators import text as O


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_aliases_of_up_to_four_words(spark):
    q = spark.createDataFrame([(1, "The Old, old Town of York."), (2, None), (3, "york york")], "query long, text string")
    a = spark.createDataFrame([("old town of york", "York"), ("old", "Age"), ("york", "York"), ("york", "Jorvik"), ("the", None)], "alias string, canonical string")
    assert rows(O.alias_hits(q, a).filter("query = 1 and alias <> 'the'")) == [(1, "old", "Age", 1), (1, "old town of york", "York", 4), (1, "york", "Jorvik", 1), (1, "york", "York", 1)]
    assert rows(O.alias_hits(q, a).filter("query <> 1")) == [(3, "york", "Jorvik", 1), (3, "york", "York", 1)]


def test_years_of_texts_with_their_epoch(spark):
    docs = spark.createDataFrame([(1, "From 1010 to 938 and 1288."), (2, "no year"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in O.enrich(docs, dims.chronology(spark)).collect()}
    assert (found[1].first_year, found[1].last_year) == (938, 1288) and found[1].epoch_id is not None and found[1].dynasty_id is not None
    assert len(found) == 3 and all(found[k][1:] == (None, None, None, None) for k in (2, 3))


def test_bracketed_names(spark):
    run = " ".join(["Anna"] * 20_000)
    docs = spark.createDataFrame([(1, "Anna Bo (Carl) and xYz (Du Eé) or Fa (gi), A (Bo), Ga (Ha (Io)"), (2, None), (3, f"{run} (Carl)")], "doc_id long, text string")
    got = rows(O.parenthetical_pairs(docs))
    assert got[:3] == [(1, "Anna Bo", "Carl"), (1, "Ha", "Io"), (1, "Yz", "Du Eé")]
    # A run of so many names would be too deep for a pattern that can give them back.
    assert got[3:] == [(3, run, "Carl")]
