"""The SQL of entailment and faithfulness states the rule of numbers too."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = {10: "king ruled many lands since 1289 and built roads", 11: "king ruled many lands since 1288", 12: "king ruled many lands since 1289", 13: "1288 1289 king", 14: ""}


@pytest.mark.parametrize("name", ["op_v04_entailment", "op_v03_faithfulness"])
def test_claims_whose_numbers_are_all_lost(spark, tmp_path, name):
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    if name == "op_v04_entailment":
        assert {r[0]: r[2] for r in got} == {11: "NOT_SUPPORTED", 12: "ENTAILED", 13: "NEUTRAL", 14: "NEUTRAL"}
