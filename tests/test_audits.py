"""Diagnostics, promotion and gates on hand-made rows, with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from quarry.operators import audits as A

TRIPLES = "document string, chunk_id long, ord int, source_name string, rel string, target_name string, target_id string, confidence double"
CHUNKS = "document string, chunk_id long, dynasty string, time_start int, time_end int"


def test_diagnose(spark):
    chunks = spark.createDataFrame([("a", 1, None, 938, None), ("a", 2, "Ngo", None, None), ("b", 1, None, 1, 2), (None, 3, None, None, None)], CHUNKS)
    triples = spark.createDataFrame(
        [
            ("a", 1, 0, "Ngo Quyen", "LED_BY", "Bach Dang", "event_1", 0.9), ("a", 1, 1, "king", "LED_BY", "[x]", "event_1", 0.1), ("a", 1, 2, "Ngo Quyen", "LED_BY", "[x]", "event_1", 0.1), ("a", 2, 0, "Ly Bi", "PART_OF", "the text", A.DANGLING_TARGET, 0.1),
            ("b", 1, 0, "Ly Bi", "PART_OF", "Hoa Lu", "loc", 0.84), ("b", 1, 1, None, "PART_OF", "Hoa Lu", None, None), ("b", 1, 2, "Ngo Quyen", None, "Bach Dang", None, None),
        ], TRIPLES)
    masters = spark.createDataFrame([("Ngo Quyen",), ("Bach Dang",), ("Bach Dang",), (None,)], "name string")
    issues = A.diagnose(chunks, triples, masters, ["king"])
    got = [tuple(r) for r in issues.orderBy("document", "chunk_id", "ord", "step").collect()]
    assert got == [
        (None, 3, -1, 0, "TEMPORAL_SPATIAL_MISSING", "WARNING", ""),
        ("a", 1, -1, 0, "TEMPORAL_SPATIAL_MISSING", "WARNING", "a"),
        ("a", 1, 1, 1, "GENERIC_OR_HALLUCINATED_ENTITY", "CRITICAL", "king"),
        ("a", 1, 2, 1, "GENERIC_OR_HALLUCINATED_ENTITY", "CRITICAL", "[x]"),
        ("a", 2, 0, 2, "UNMAPPED_ENTITY", "WARNING", "Ly Bi"),
        ("a", 2, 0, 4, "DANGLING_RELATIONSHIP", "INFO", "Ly Bi PART_OF the text"),
        ("b", 1, 0, 2, "UNMAPPED_ENTITY", "WARNING", "Ly Bi"),
        ("b", 1, 0, 3, "UNMAPPED_ENTITY", "WARNING", "Hoa Lu"),
        ("b", 1, 0, 5, "LOW_CONFIDENCE_RELATION", "WARNING", "Ly Bi PART_OF Hoa Lu"),
        ("b", 1, 1, 1, "GENERIC_OR_HALLUCINATED_ENTITY", "CRITICAL", ""),
        ("b", 1, 2, 5, "LOW_CONFIDENCE_RELATION", "WARNING", "Ngo Quyen Bach Dang"),
    ]
    report = A.diagnostic_report(issues).collect()
    assert [(r.issue, r.n) for r in sorted(report, key=lambda r: r.place) if r.section == "summary"] == [("UNMAPPED_ENTITY", 3), ("GENERIC_OR_HALLUCINATED_ENTITY", 3), ("LOW_CONFIDENCE_RELATION", 2), ("TEMPORAL_SPATIAL_MISSING", 2), ("DANGLING_RELATIONSHIP", 1)]
    assert [r.item for r in sorted(report, key=lambda r: r.place) if r.section == "recommendation"] == ["king", "[x]", "Ly Bi", "Hoa Lu", ""]
    none = A.diagnostic_report(A.diagnose(chunks.limit(0), triples.limit(0), masters, [])).collect()
    assert len(none) == 5 and {r.n for r in none} == {0}


def test_report_ends_at_its_limits(spark):
    chunks = spark.range(0, 300).select(F.lit("d").alias("document"), F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("dynasty"), F.lit(None).cast("int").alias("time_start"), F.lit(None).cast("int").alias("time_end"))
    triples = spark.range(0, 90).selectExpr("'d' AS document", "id AS chunk_id", "0 AS ord", "concat('New ', id div 2) AS source_name", "'R' AS rel", "'New 0' AS target_name", "'x' AS target_id", "1D AS confidence")
    report = A.diagnostic_report(A.diagnose(chunks, triples, spark.createDataFrame([], "name string"), [])).collect()
    issues = sorted((r.place, r.issue) for r in report if r.section == "issue")
    assert len(issues) == A.FIRST_ISSUES and [i for _, i in issues[:4]] == ["TEMPORAL_SPATIAL_MISSING", "UNMAPPED_ENTITY", "UNMAPPED_ENTITY", "TEMPORAL_SPATIAL_MISSING"]
    assert [r.item for r in sorted(report, key=lambda r: r.place) if r.section == "recommendation"] == [f"New {k}" for k in range(A.FIRST_RECOMMENDATIONS)]


def test_promote_triples(spark):
    relations = spark.createDataFrame([("a", "R", "b", 0.7), ("a", "S", "b", 0.95)], "src string, rel string, tgt string, confidence double")
    q = spark.createDataFrame(
        [(1, "a", "R", "b", 0.9, A.PENDING), (2, "a", "S", "b", 0.9, A.PENDING), (3, "a", "R", "c", 0.9, "REJECTED"), (4, "a", "R", "x", 0.9, A.PENDING), (5, "a", "R", "a", 0.9, A.PENDING), (6, "c", "R", "b", 0.79, A.PENDING), (7, None, "R", "b", 0.9, A.PENDING), (8, "c", None, "b", 0.9, A.PENDING), (9, "c", "R", "a", None, A.PENDING), (10, "a", "R", "b", 0.8, A.PENDING)],
        "id long, src string, rel string, tgt string, confidence double, status string")
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "id string")
    stored, marked, audit = A.promote_triples(relations, q, entities, 0.8)
    assert sorted(map(tuple, stored.collect())) == [("a", "R", "b", 0.9), ("a", "S", "b", 0.95)]
    assert {r.id for r in marked.collect() if r.status == A.APPROVED} == {1, 2, 10} and marked.count() == 10 and marked.columns[1:] == q.columns[1:]
    assert [(r.entity_id, r.action_type, r.modified_by) for r in audit.collect()] == [("a", A.ACTION, A.OPERATOR)] * 3 and audit.filter("rationale = 'promoted from quarantine: a R b 0.9'").count() == 1


def test_promote_entities(spark):
    entities = spark.createDataFrame([("p1", "Old", "PERSON", ["Old", "Elder"]), ("p0", "Same", "PERSON", [])], "id string, name string, type string, aliases array<string>")
    unmapped = spark.createDataFrame([(1, "Eld", "PLACE", 9, A.TO_TRIAGE), (2, "New", None, 5, A.TO_TRIAGE), (3, "Newer", "EVENT", 7, A.TO_TRIAGE), (4, "Newest", "PLACE", 7, A.TO_TRIAGE), (5, "Few", None, 4, A.TO_TRIAGE), (6, "Noise", None, 50, "DISCARDED_AS_NOISE"), (7, "Lost", None, 50, A.TO_TRIAGE)], "id long, raw_name string, inferred_type string, occurrences long, status string")
    resolved = spark.createDataFrame([("Eld", "p1", "Other", "GROUP", ["El"]), ("New", "p2", "The New", "GROUP", None), ("Newer", "p2", "The Newer", "GROUP", ["n"]), ("Newest", "p2", "The Newest", None, ["n"]), ("Few", "p3", "Few", None, []), ("Noise", "p4", "Noise", None, [])], "raw_name string, entity_id string, canonical string, type string, aliases array<string>")
    merged, marked, audit = A.promote_entities(entities, unmapped, resolved, 5)
    assert sorted(map(tuple, merged.collect())) == [("p0", "Same", "PERSON", []), ("p1", "Old", "PERSON", ["El", "Eld", "Elder", "Old"]), ("p2", "The Newer", "EVENT", ["New", "Newer", "Newest", "n"])]
    assert {r.id for r in marked.collect() if r.status == A.PROMOTED} == {1, 2, 3, 4} and marked.count() == 7
    assert sorted(r.entity_id for r in audit.collect()) == ["p1", "p2", "p2", "p2"]
    assert A.promote_entities(entities, unmapped.limit(0), resolved, 5)[0].count() == 2


def test_gates(spark):
    base = spark.createDataFrame([("Fact Precision", 85.0), ("Hallucination Rate", 5.0), ("Retrieval Recall@10", 80.0), ("Ranking nDCG@5", 0.8), ("p95 Latency SLA", 900.0)], "metric string, value double")
    runs = {
        "good": [84.0, 6.0, 76.0, 0.76, 1500.0, 800.0], "floor": [79.9, 10.1, 74.9, 0.69, 1500.1, 800.1], "moved": [82.9, 7.1, 74.0, 0.749, 100.0, 1.0], "some": [84.0, None, None, None, None, None], "none": [None] * 6,
    }
    rows = [(run, g[1], v) for run, values in runs.items() for g, v in zip(A.GATES, values)] + [("none", "Other", 1.0)]
    got = A.regression_gates(spark.createDataFrame(rows, "run string, metric string, value double"), base).collect()
    by = {run: [r.status for r in sorted(got, key=lambda r: r.gate) if r.run == run] for run in runs}
    assert by == {"good": ["PASS"] * 6, "floor": ["FAIL"] * 6, "moved": ["FAIL"] * 4 + ["PASS"] * 2, "some": ["PASS"] + ["SKIPPED"] * 5, "none": ["SKIPPED"] * 6}
    assert {r.run: r.all_passed for r in got} == {"good": True, "floor": False, "moved": False, "some": True, "none": True}
    one = {(r.run, r.metric): r for r in got}
    assert one["good", "Fact Precision"].delta == -1.0 and one["good", "p95 TTFT SLA"].baseline == 800.0 and one["good", "Ranking nDCG@5"].delta == -0.04 and one["some", "Hallucination Rate"].delta == 0.0 and not one["some", "Hallucination Rate"].blocking
    bare = A.regression_gates(spark.createDataFrame([("r", "Fact Precision", 90.0)], "run string, metric string, value double"), base.limit(0)).filter("blocking").head()
    assert bare.passed and bare.delta is None
