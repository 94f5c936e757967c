"""Terms of a large batch come out in bounded parts, with every row once."""

import pyarrow as pa

from quarry.llm import lexical


def test_terms_of_a_batch_are_held_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 10)
    texts = ["a b c a", None, "", *(f"w{i} x{i} A" for i in range(50))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    out = list(lexical.term_vectors(iter([batch, batch])))
    assert max(len(b.column("terms").flatten()) for b in out) <= 10 + 3
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(len(texts))] * 2 and [r["spread"] for r in rows] == list(range(2 * len(texts)))
    assert (rows[0]["n"], dict(zip(rows[0]["terms"], rows[0]["tfs"]))) == (4, {b"a": 2, b"b": 1, b"c": 1})
