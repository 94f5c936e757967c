"""Diagnostics of an ingestion, promotion out of quarantine, and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import valid_span

# Classes of issues with their severity, the states of quarantined rows, the audit's action and who does it.
SEVERITY = {"UNMAPPED_ENTITY": "WARNING", "GENERIC_OR_HALLUCINATED_ENTITY": "CRITICAL", "LOW_CONFIDENCE_RELATION": "WARNING", "TEMPORAL_SPATIAL_MISSING": "WARNING", "DANGLING_RELATIONSHIP": "INFO"}
PENDING, APPROVED, TO_TRIAGE, PROMOTED, ACTION, OPERATOR = "PENDING_REVIEW", "APPROVED", "PENDING_TRIAGE", "PROMOTED", "CONFLICT_RESOLVE", "QUARANTINE_OPERATOR"
#: Gate, metric, floor, ceiling, most it may fall and rise against the baseline, decimals of the difference, baseline where there is none.
GATES = [
    ("GATE_1_FACT_PRECISION", "Fact Precision", 80.0, None, 2.0, None, 2, None),
    ("GATE_2_HALLUCINATION_RATE", "Hallucination Rate", None, 10.0, None, 2.0, 2, None),
    ("GATE_3_RETRIEVAL_RECALL", "Retrieval Recall@10", 75.0, None, 5.0, None, 2, None),
    ("GATE_4_RANKING_NDCG", "Ranking nDCG@5", 0.70, None, 0.05, None, 3, None),
    ("GATE_5_LATENCY_P95", "p95 Latency SLA", None, 1500.0, None, None, 2, None),
    ("GATE_6_TTFT_P95", "p95 TTFT SLA", None, 800.0, None, None, 2, 800.0),
]
FIRST_ISSUES, FIRST_RECOMMENDATIONS, LEAST_CONFIDENCE, DANGLING_TARGET = 100, 20, 0.85, "doc:historical_context"


# -- diagnostics
def diagnose(chunk_rows: DataFrame, triples: DataFrame, masters: DataFrame, generic: list[str], least: float = LEAST_CONFIDENCE, dangling: str = DANGLING_TARGET) -> DataFrame:
    """Issues of chunks and their triples (Q11), one row each: document, chunk_id, ord, step, issue, severity, item.

    ``chunk_rows``: document, chunk_id, dynasty, time_start, time_end; ``triples``: document, chunk_id, ord, source_name, rel, target_name, target_id, confidence; ``masters``: name, the known entities.
    A chunk without dynasty and without a full span of years lacks time and place. A triple with an invalid name (of both, the source) has no other issue; else each end that no master knows is unmapped, a target that is only
    the context dangles (and is not looked up), and of the others those below ``least`` have low confidence; a missing confidence is low. In the order (document, chunk_id, ord, step) a chunk's own issue comes first."""
    known = masters.select("name").filter("name is not null").distinct()
    for side in ("source", "target"):
        triples = triples.join(known.select(F.col("name").alias(f"{side}_name"), F.lit(True).alias(f"_{side}")), f"{side}_name", "left")
    valid = lambda side: F.coalesce(valid_span(F.col(f"{side}_name"), generic), F.lit(False))
    loose = F.coalesce(F.col("target_id") == dangling, F.lit(False))
    relation = F.concat_ws(" ", "source_name", "rel", "target_name")

    def issue(step: int, name: str, item: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(step).alias("step"), F.lit(name).alias("issue"), F.lit(SEVERITY[name]).alias("severity"), F.coalesce(item, F.lit("")).alias("item")))

    found = F.when(~valid("source") | ~valid("target"), F.array(issue(1, "GENERIC_OR_HALLUCINATED_ENTITY", F.when(valid("source"), F.col("target_name")).otherwise(F.col("source_name")), F.lit(True)))).otherwise(
        F.array(
            issue(2, "UNMAPPED_ENTITY", F.col("source_name"), F.col("_source").isNull()),
            issue(3, "UNMAPPED_ENTITY", F.col("target_name"), F.col("_target").isNull() & ~loose),
            issue(4, "DANGLING_RELATIONSHIP", relation, loose),
            issue(5, "LOW_CONFIDENCE_RELATION", relation, ~loose & ~F.coalesce(F.col("confidence") >= least, F.lit(False))),
        )
    )
    place = ["document", "chunk_id", "ord"]
    of_triples = triples.select(*place, F.explode(F.array_compact(found)).alias("i")).select(*place, "i.*")
    bare = chunk_rows.filter("dynasty is null and (time_start is null or time_end is null)").withColumn("ord", F.lit(-1).cast(dict(triples.dtypes)["ord"]))
    lacking = bare.select(*place, issue(0, "TEMPORAL_SPATIAL_MISSING", F.col("document").cast("string"), F.lit(True)).alias("i")).select(*place, "i.*")
    return lacking.unionByName(of_triples)


def diagnostic_report(issues: DataFrame) -> DataFrame:
    """The report of `diagnose` (Q11): section, place, issue, item, n. Section "summary": how many of each class, all five; "issue": the first 100; "recommendation": the first 20 different pieces of advice, for invalid names and unmapped entities, by where they first come up."""
    spark = issues.sparkSession
    order = ["document", "chunk_id", "ord", "step"]
    every = spark.createDataFrame(list(enumerate(SEVERITY, 1)), "place int, issue string")
    counted = every.join(issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n")), "issue", "left").select(F.lit("summary").alias("section"), "place", "issue", F.lit(None).cast("string").alias("item"), F.coalesce("n", F.lit(0)).alias("n"))

    def listed(rows: DataFrame, section: str, k: int) -> DataFrame:
        # At most k rows, so one task numbers them.
        best = rows.orderBy(*order, "issue", "item").limit(k)
        return best.select(F.lit(section).alias("section"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "issue", "item")).alias("place"), "issue", "item", F.lit(1).cast("long").alias("n"))

    advice = issues.filter(F.col("issue").isin("GENERIC_OR_HALLUCINATED_ENTITY", "UNMAPPED_ENTITY"))
    advice = advice.groupBy("issue", "item").agg(F.min(F.struct(*order)).alias("at")).select("issue", "item", "at.*")
    return counted.unionByName(listed(issues, "issue", FIRST_ISSUES)).unionByName(listed(advice, "recommendation", FIRST_RECOMMENDATIONS))


# -- promotion
def promote_triples(relations: DataFrame, quarantined: DataFrame, entities: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confident triples leave quarantine (Q12): (relations, quarantined, audit).

    ``relations``: src, rel, tgt, confidence; ``quarantined``: id, src, rel, tgt, confidence, status; ``entities``: id. A pending triple of at least ``threshold`` whose two different ends are entities is stored, with the greater confidence if its key is known, is marked approved, and leaves one audit row
    (entity_id, action_type, modified_by, rationale). Rows with a null end, relation or confidence stay."""
    ids = entities.select("id").filter("id is not null").distinct()
    open_ = quarantined.filter((F.col("status") == PENDING) & (F.col("confidence") >= threshold) & (F.col("src") != F.col("tgt")) & F.col("rel").isNotNull())
    ready = open_.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select("id", "src", "rel", "tgt", "confidence")
    stored = relations.select("src", "rel", "tgt", "confidence").unionByName(ready.drop("id")).groupBy("src", "rel", "tgt").agg(F.max("confidence").alias("confidence"))
    marked = quarantined.join(ready.select("id").distinct().withColumn("_p", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_p"), APPROVED).otherwise(F.col("status"))).drop("_p")
    why = F.concat_ws(" ", F.lit("promoted from quarantine:"), "src", "rel", "tgt", F.col("confidence").cast("string"))
    return stored, marked, ready.select(F.col("src").alias("entity_id"), F.lit(ACTION).alias("action_type"), F.lit(OPERATOR).alias("modified_by"), why.alias("rationale"))


def promote_entities(entities: DataFrame, unmapped: DataFrame, resolved: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names found often enough become entities (Q12): (entities, unmapped, audit).

    ``entities``: id, name, type, aliases; ``unmapped``: id, raw_name, inferred_type, occurrences, status; ``resolved``: raw_name (each once), entity_id, canonical, type, aliases. A name in triage of ``least`` occurrences or more is an alias of its entity, new or stored; a stored entity keeps name and type,
    of several names of a new one the most frequent (then the least id) gives the type, its own or else the resolved one. Aliases are distinct and sorted. Names that ``resolved`` lacks stay."""
    ready = unmapped.filter((F.col("status") == TO_TRIAGE) & (F.col("occurrences") >= least)).join(resolved.select("raw_name", "entity_id", "canonical", "type", "aliases"), "raw_name")
    known = entities.select("id", F.struct(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("often"), F.lit(None).cast(dict(unmapped.dtypes)["id"]).alias("by"), "name", "type").alias("e"), "aliases")
    kind = F.coalesce("inferred_type", "type", F.lit("HISTORICAL_PERSON"))
    fresh = ready.select(F.col("entity_id").alias("id"), F.struct(F.lit(1).alias("rank"), (-F.col("occurrences")).cast("long").alias("often"), F.col("id").alias("by"), F.col("canonical").alias("name"), kind.alias("type")).alias("e"), F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("raw_name")).alias("aliases"))
    # Aliases are merged as rows: an entity with very many names is aggregated before it is one array.
    first = known.select("id", "e").unionByName(fresh.select("id", "e")).groupBy("id").agg(F.min("e").alias("e"))
    every = known.select("id", F.explode("aliases").alias("a")).unionByName(fresh.select("id", F.explode("aliases").alias("a"))).groupBy("id").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    merged = first.join(every, "id", "left").select("id", F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    marked = unmapped.join(ready.select("id").distinct().withColumn("_p", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_p"), PROMOTED).otherwise(F.col("status"))).drop("_p")
    why = F.concat_ws(" ", F.lit("promoted unmapped name:"), "raw_name", F.col("occurrences").cast("string"))
    return merged, marked, ready.select("entity_id", F.lit(ACTION).alias("action_type"), F.lit(OPERATOR).alias("modified_by"), why.alias("rationale"))


# -- gates
def regression_gates(current: DataFrame, baseline: DataFrame, gates: list[tuple] = GATES) -> DataFrame:
    """Each run against each gate (Q13): run, gate, metric, baseline, value, delta, threshold, passed, blocking, status, all_passed.

    ``current``: run, metric, value; ``baseline``: metric, value (each metric once). A gate holds if the value is on the right side of its floor or ceiling and has not moved the wrong way beyond what it may. A metric that a run lacks is SKIPPED: value and difference 0, passed, not blocking;
    a run passes if all its blocking gates do, also if there are none. Without a baseline only floor and ceiling count and the difference is null. Gates are few, so runs are not shuffled for them; metrics of no gate do not count, but their runs do."""
    spark = current.sparkSession
    g = spark.createDataFrame(gates, "gate string, metric string, floor double, ceiling double, fall double, rise double, digits int, stand_in double")
    runs = current.select("run").distinct()
    base = F.broadcast(g).join(baseline.select("metric", F.col("value").alias("b")), "metric", "left").withColumn("baseline", F.coalesce("b", "stand_in")).drop("b", "stand_in")
    j = runs.crossJoin(F.broadcast(base)).join(current.groupBy("run", "metric").agg(F.max("value").alias("value")), ["run", "metric"], "left")
    delta = F.col("value") - F.col("baseline")
    ok = lambda c: F.coalesce(c, F.lit(True))
    holds = ok(F.col("value") >= F.col("floor")) & ok(F.col("value") <= F.col("ceiling")) & ok(delta >= -F.col("fall")) & ok(delta <= F.col("rise"))
    there = F.col("value").isNotNull()
    rounded = F.expr("CASE digits WHEN 3 THEN round(value - baseline, 3) ELSE round(value - baseline, 2) END")
    out = j.select(
        "run", "gate", "metric", "baseline", F.coalesce("value", F.lit(0.0)).alias("value"), F.when(there, rounded).otherwise(0.0).alias("delta"), F.coalesce("floor", "ceiling").alias("threshold"), (~there | holds).alias("passed"), there.alias("blocking"),
        F.when(~there, "SKIPPED").when(holds, "PASS").otherwise("FAIL").alias("status"),
    )
    return out.withColumn("all_passed", F.every("passed").over(Window.partitionBy("run")))
