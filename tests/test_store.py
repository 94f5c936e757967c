"""The keyed store: a second run computes nothing, and the store is not shuffled."""

import uuid

from pyspark.sql import functions as F

from quarry.operators import store as K


def lengths(seen):
    def run(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return texts.select("key", F.array(F.length("text").cast("double")).alias("value"))

    return run


def test_second_run_computes_nothing(spark, tmp_path):
    name, seen = f"s{uuid.uuid4().hex}", []
    K.open_store(spark, name, str(tmp_path / "store"), "ARRAY<DOUBLE>", 4)
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, ""), (None, "bb")], "doc_id long, text string")
    got, n = K.computed(rows, name, lengths(seen), buckets=4)
    assert n == 3 and seen == [["", "a", "bb"]] and sorted((r.value[0], r.hit) for r in got.collect()) == [(0.0, False)] * 2 + [(1.0, False)] * 2 + [(2.0, False)] * 2
    got, n = K.computed(rows.unionByName(spark.createDataFrame([(9, "ccc")], rows.schema)), name, lengths(seen), buckets=4)
    assert n == 1 and seen[1] == ["ccc"] and sum(r.hit for r in got.collect()) == 6
    got, n = K.computed(rows, name, lengths(seen), buckets=4)
    assert n == 0 and seen[2] == [] and all(r.hit for r in got.collect()) and got.count() == 6
    # Another session opens the same files.
    other = K.open_store(spark, f"t{uuid.uuid4().hex}", str(tmp_path / "store"), "ARRAY<DOUBLE>", 4)
    assert K.stored(rows.withColumn("key", K.key_of("text")), other, 4).filter("hit").count() == 3


def test_store_is_not_shuffled(spark, tmp_path):
    name = K.open_store(spark, f"s{uuid.uuid4().hex}", str(tmp_path / "store"), "ARRAY<DOUBLE>", 4)
    rows = spark.range(50).select(F.concat(F.lit("t"), "id").alias("text"))
    K.computed(rows, name, lengths([]), buckets=4)
    asked = rows.withColumn("key", K.key_of("text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole, alone = plan(K.stored(asked, name, 4)), plan(asked.select("key").distinct().repartition(4, "key"))
    assert "SortMergeJoin" in whole and "Bucketed: true" in whole and whole.count("Exchange") == alone.count("Exchange")


def test_empty(spark, tmp_path):
    name = K.open_store(spark, f"s{uuid.uuid4().hex}", str(tmp_path / "store"), "ARRAY<DOUBLE>", 4)
    got, n = K.computed(spark.createDataFrame([], "text string"), name, lengths([]), buckets=4)
    assert n == 0 and got.count() == 0
