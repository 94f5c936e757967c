"""Schemas of the stored tables, and checks of their ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "entities": "id string, name string, type string, aliases array<string>, metadata string, created_at timestamp",
    "relationships": "id long, source_entity_id string, target_entity_id string, relation_type string, confidence float, created_at timestamp",
    "document_chunks": "id string, title string, text_content string, dynasty string, epoch_ids array<string>, source_reliability string, parent_chunk_id string, time_start int, time_end int, key_figures array<string>, location string, page_number int, embedding array<float>, metadata string",
    "entity_chunks": "entity_id string, chunk_id string",
    "entity_audit_logs": "log_id long, entity_id string, action_type string, modified_by string, timestamp timestamp, previous_state string, new_state string, rationale string",
    "orchestrator_checkpoints": "project_id string, current_step int, status string, state_data string",
    "quarantine_triples": "id long, source_entity_id string, target_entity_id string, source_name string, target_name string, relation_type string, confidence float, chunk_id string, reason string, status string, metadata string, created_at timestamp",
    "unmapped_entities": "id string, raw_name string, inferred_type string, occurrence_count int, sample_context string, chunk_id string, status string, metadata string",
}
#: Column, least, most; and the default that a missing value takes.
RANGES = {"relationships": [("confidence", 0.0, 1.0)], "quarantine_triples": [("confidence", 0.0, 1.0)], "unmapped_entities": [("occurrence_count", 1, 2**31 - 1)]}
DEFAULTS = {"quarantine_triples": {"status": "PENDING"}, "unmapped_entities": {"status": "PENDING", "occurrence_count": 1}}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the schema of ``table``: missing columns are null, defaults filled in, ``violations`` lists broken rules."""
    fields = [f.strip().split(" ", 1) for f in TABLES[table].split(", ")]
    have = set(df.columns)
    out = df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields])
    out = out.fillna(DEFAULTS.get(table, {}))
    broken = [F.when(~F.col(c).between(lo, hi), F.lit(f"{c} out of range")) for c, lo, hi in RANGES.get(table, [])]
    return out.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
