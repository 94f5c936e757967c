"""What triples say at once comes of one pass over them, and small groups are matched without a call for each."""

from quarry.operators import closure as C


def test_direct_reads_the_triples_once(spark):
    t = spark.createDataFrame([("g", "event_1", "LED_BY", "person_1"), ("g", "loc_1", "ALIAS_OF", "loc_2")], "group string, src string, rel string, tgt string")
    got = C.direct(t)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert ("g", "person_1", "leads", "event_1") in {tuple(r) for r in got.collect()}


def test_small_groups_are_matched_in_one_pass(spark):
    pairs = spark.createDataFrame([(f"g{k}", p, g) for k in range(30) for p, g in ((1, 2), (1, 1), (2, 1), (3, 3))], "group string, p long, g long")
    got = C.greedy_matching(pairs)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((f"g{k}", p, g) for k in range(30) for p, g in ((1, 1), (3, 3)))
