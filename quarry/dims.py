"""Small fixed dimensions. The values are fixed: results depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Epoch, dynasty, first and last year, in table order.
CHRONOLOGY = [
    ("EPOCH_01", "dynasty_van_lang", -2879, -258),
    ("EPOCH_01", "dynasty_au_lac", -257, -180),
    ("EPOCH_02", "epoch_bac_thuoc", -179, 39),
    ("EPOCH_02", "dynasty_hai_ba_trung", 40, 43),
    ("EPOCH_02", "epoch_bac_thuoc", 44, 543),
    ("EPOCH_02", "dynasty_tien_ly", 544, 602),
    ("EPOCH_02", "epoch_bac_thuoc", 603, 938),
    ("EPOCH_03", "dynasty_ngo", 939, 965),
    ("EPOCH_03", "dynasty_12_su_quan", 966, 967),
    ("EPOCH_03", "dynasty_dinh", 968, 979),
    ("EPOCH_03", "dynasty_tien_le", 980, 1009),
    ("EPOCH_04", "dynasty_ly", 1010, 1225),
    ("EPOCH_05", "dynasty_tran", 1226, 1399),
    ("EPOCH_06", "dynasty_ho", 1400, 1406),
    ("EPOCH_07", "epoch_minh_thuoc", 1407, 1427),
    ("EPOCH_08", "dynasty_le_so", 1428, 1527),
    ("EPOCH_09", "dynasty_mac", 1528, 1592),
    ("EPOCH_09", "dynasty_le_trung_hung", 1593, 1777),
    ("EPOCH_10", "dynasty_nha_tay_son", 1778, 1801),
    ("EPOCH_11", "dynasty_nguyen", 1802, 1883),
    ("EPOCH_12", "epoch_phap_thuoc", 1884, 1944),
    ("EPOCH_13", "epoch_hien_dai", 1945, 2026),
]
#: The years whose overlap always counts for two epochs.
BRIDGE_YEARS, BRIDGE_EPOCHS = (1771, 1777), ("EPOCH_09", "EPOCH_10")

#: Relation, allowed prefixes of its source and target ids.
DIRECTIONS = [
    ("LED_BY", ["event_", "org_"], ["person_"]),
    ("HAPPENED_AT", ["event_"], ["loc_"]),
    ("HAPPENED_IN", ["event_"], ["dynasty_", "epoch_"]),
    ("PART_OF", ["artifact_", "person_", "org_", "event_"], ["dynasty_", "org_", "event_", "epoch_"]),
    ("SAME_AS_LOCATION", ["loc_"], ["loc_"]),
    ("ALIAS_OF", ["person_", "loc_", "dynasty_", "event_", "artifact_", "org_", "doc_"], ["person_", "loc_", "dynasty_", "event_", "artifact_", "org_", "doc_"]),
    ("ROYAL_LINEAGE", ["person_"], ["person_"]),
    ("MENTIONED_IN", ["person_", "event_", "artifact_", "loc_", "dynasty_", "org_"], ["doc_"]),
]
#: Relations walked backwards too, relations not walked by default, relations of the lineage view.
REVERSED = ["LED_BY", "PART_OF", "ALIAS_OF", "SPOUSE_OF", "MARRIED_TO", "PARENT_OF", "CHILD_OF", "SIBLING_OF", "FOUNDED_BY", "COMMANDED_BY"]
NOT_WALKED = ["MENTIONED_IN", "SAME_AS_LOCATION"]
LINEAGE = ["PART_OF", "ROYAL_LINEAGE", "LED_BY", "HAPPENED_IN", "HAPPENED_AT", "ALIAS_OF", "SAME_AS_LOCATION", "FATHER", "MOTHER", "CHILD", "FOUNDED", "COMMANDED"]


def chronology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CHRONOLOGY)], "ord int, epoch_id string, dynasty_id string, start_year int, end_year int")


def directions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRECTIONS, "relation_type string, source_prefixes array<string>, target_prefixes array<string>")


def values_sql(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list."""
    lit = lambda v: "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"
