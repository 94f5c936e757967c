"""The edge list as a graph: walks, closure, lineage, quarantine and audits, as joins over DataFrames.

Loops run one job per hop or round and write their state to the shared checkpoint folder, so that plans stay short and lost executors cost little.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.dims import LINEAGE, NOT_WALKED, REVERSED
from quarry.operators.relational import keep_first, top_per

MIN_CONFIDENCE = 0.5


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder where that is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the checkpoint folder, with the writer's ``options``, and read back."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """For tables whose rows are large: what is staged or collected inside is read, and handed to Python, so many rows at a time."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(rows))
        yield
    finally:
        for k in keys:
            spark.conf.set(k, before[k])


def walkable(edges: DataFrame, relations: list[str] | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Edges that a walk may use (F08): confident enough, of the asked relations or of all but the noisy ones."""
    allowed = F.col("rel").isin(relations) if relations else ~F.col("rel").isin(NOT_WALKED)
    return edges.filter((F.col("confidence") >= least) & allowed)


def oriented(edges: DataFrame) -> DataFrame:
    """Edges in the direction of the walk (U01, G02): all forwards, some relations backwards too; ``at`` to ``to``."""
    forward = edges.select(F.col("src").alias("at"), F.col("tgt").alias("to"), "src", "rel", "tgt", "confidence", F.lit(0).alias("is_reverse"))
    back = edges.filter(F.col("rel").isin(REVERSED)).select(F.col("tgt").alias("at"), F.col("src").alias("to"), "src", "rel", "tgt", "confidence", F.lit(1).alias("is_reverse"))
    return forward.unionByName(back)


def bounded_bfs(edges: DataFrame, seeds: DataFrame, hops: int = 2, budget: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """Directed bounded walks for many queries at once (G01): seeds (query, node) to visited (query, node, hop) and edges (query, src, rel, tgt, confidence, hop).

    In each hop new nodes are ranked by forward before reverse, confidence, source, relation, target at their first occurrence; those beyond what the query's
    node budget has left stay out, and so do edges to them, while edges between visited nodes are kept. An edge keeps its first hop.
    Two joins on the current node a hop; ``edges`` should be pruned by ``walkable`` before. With a budget no hub is walked in full: what a query takes from a node is
    among the first ``budget`` neighbours of it, as those before are visited or taken too; edges between visited nodes are looked up by both ends.
    """
    walk, order = oriented(edges), [F.col("is_reverse"), F.desc("confidence"), F.col("src"), F.col("rel"), F.col("tgt")]
    near = walk if budget is None else staged(top_per(keep_first(walk, ["at", "to"], order), ["at"], order, budget).drop("rank"))
    visited = staged(seeds.select("query", "node").distinct().withColumn("hop", F.lit(0)))
    kept, frontier = None, visited
    for hop in range(1, hops + 1):
        here = frontier.select("query", F.col("node").alias("at"))
        step = here.join(near, "at")
        known = visited.select("query", F.col("node").alias("to"), F.lit(True).alias("known"))
        step = staged(step.join(known, ["query", "to"], "left"))
        new = keep_first(step.filter("known is null"), ["query", "to"], order)
        if budget is not None:
            left = visited.groupBy("query").agg((F.lit(budget) - F.count(F.lit(1))).alias("left"))
            ranked = new.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
            new = ranked.join(left, "query").filter("_place <= left")
        frontier = staged(new.select("query", F.col("to").alias("node"), F.lit(hop).alias("hop")))
        visited = staged(visited.unionByName(frontier))
        ends = visited.select("query", F.col("node").alias("to"))
        met = step.join(ends, ["query", "to"], "left_semi") if budget is None else here.join(ends, "query").join(walk, ["at", "to"])
        got = met.select("query", "src", "rel", "tgt", "confidence", F.lit(hop).alias("hop"))
        kept = got if kept is None else kept.unionByName(got)
        if frontier.isEmpty():
            break
    return visited, keep_first(kept, ["query", "src", "rel", "tgt"], [F.col("hop"), F.desc("confidence")])


def lineage_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The materialised lineage view (G04, J02): edges of the lineage relations with both ends' names and types."""
    end = lambda key, side: nodes.select(F.col("id").alias(key), F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"))
    return edges.filter(F.col("rel").isin(LINEAGE)).join(end("src", "source"), "src").join(end("tgt", "target"), "tgt")


def directionality(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that keep to their relation's allowed ends, and those that would if turned round (F15, Q10). The rules are a fixed table."""
    fits = lambda prefixes, end: F.exists(prefixes, lambda p: F.startswith(F.col(end), p))
    e = edges.join(F.broadcast(rules.withColumnRenamed("relation_type", "rel")), "rel")
    ok, turned = fits("source_prefixes", "src") & fits("target_prefixes", "tgt"), fits("source_prefixes", "tgt") & fits("target_prefixes", "src")
    return e.groupBy("rel").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("compliant"), F.count_if(turned).alias("inverted"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, tgt) of the second relation reached through the first."""
    return first.select(F.col("tgt").alias("src")).distinct().join(second, "src").select("src", "tgt").distinct()


def merge_unseen_pairs(first: DataFrame, later: DataFrame) -> DataFrame:
    """Ensemble union (U07, G12): a later edge comes in only if no earlier one joins the same two ends, either way."""
    pair = lambda df: df.withColumns({"_a": F.least("src", "tgt"), "_b": F.greatest("src", "tgt")})
    return first.unionByName(pair(later).join(pair(first).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b"))


def quarantine(edges: DataFrame, nodes: DataFrame, least: float = 0.85) -> DataFrame:
    """Routing of extracted triples (G09), in this order: SELF_LOOP, LOW_CONFIDENCE, DANGLING, else PRODUCTION."""
    known = lambda key, name: nodes.select(F.col("id").alias(key), F.lit(True).alias(name)).distinct()
    e = edges.join(known("src", "_s"), "src", "left").join(known("tgt", "_t"), "tgt", "left")
    reason = F.when(F.col("src") == F.col("tgt"), "SELF_LOOP").when(F.col("confidence") < least, "LOW_CONFIDENCE").when(F.col("_s").isNull() | F.col("_t").isNull(), "DANGLING").otherwise("PRODUCTION")
    return e.withColumn("route", reason).drop("_s", "_t")


def resolve_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims about one key (G08): score = confidence x tier weight (1, .8, .5); two of the first tier, or scores within .15, stand side by side, else the higher stays.

    ``claims``: key, claim_id, confidence, tier."""
    score = F.col("confidence") * F.when(F.col("tier") == "LEVEL_1", 1.0).when(F.col("tier") == "LEVEL_2", 0.8).otherwise(0.5)
    s = claims.withColumn("score", F.round(score, 9))
    a, b = s.select("key", *[F.col(c).alias(f"a_{c}") for c in ("claim_id", "tier", "score")]), s.select("key", *[F.col(c).alias(f"b_{c}") for c in ("claim_id", "tier", "score")])
    both = (F.col("a_tier") == "LEVEL_1") & (F.col("b_tier") == "LEVEL_1")
    near = F.round(F.abs(F.col("a_score") - F.col("b_score")), 9) <= 0.15
    return a.join(b, "key").filter("a_claim_id < b_claim_id").withColumn("outcome", F.when(both | near, "MULTI_PERSPECTIVE").when(F.col("a_score") > F.col("b_score"), "KEEP_A").otherwise("KEEP_B"))


#: Composition rules of the closure: (first relation, second relation, relation that follows), applied to a -r1-> b -r2-> c.
CLOSURE_RULES = [("PART_OF", "PART_OF", "PART_OF"), ("ALIAS_OF", "LED_BY", "LED_BY"), ("LED_BY", "PART_OF", "HAPPENED_AT"), ("ROYAL_LINEAGE", "ROYAL_LINEAGE", "ROYAL_LINEAGE"), ("HAPPENED_AT", "PART_OF", "HAPPENED_AT")]


def transitive_closure(edges: DataFrame, rules: list[tuple[str, str, str]] | None = None, rounds: int = 4) -> DataFrame:
    """Edges that follow from ``edges`` by composition rules (G03), semi-naive: a round joins only what the last one added. Ends at a fixpoint or after ``rounds``."""
    spark = edges.sparkSession
    table = F.broadcast(spark.createDataFrame(rules or CLOSURE_RULES, "r1 string, r2 string, r3 string"))
    known = staged(edges.select("src", "rel", "tgt").distinct())
    fresh = known
    for _ in range(rounds):
        pairs = None
        for a, b in ((fresh, known), (known, fresh)):
            left = a.join(table, a["rel"] == table["r1"]).select("src", F.col("tgt").alias("mid"), "r2", "r3")
            right = b.select(F.col("src").alias("mid"), F.col("rel").alias("r2"), "tgt")
            got = left.join(right, ["mid", "r2"]).filter("src <> tgt").select("src", F.col("r3").alias("rel"), "tgt")
            pairs = got if pairs is None else pairs.unionByName(got)
        fresh = staged(pairs.distinct().join(known, ["src", "rel", "tgt"], "left_anti"))
        if fresh.isEmpty():
            break
        known = staged(known.unionByName(fresh))
    return known


def connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (Q08, G05): nodes, connected, isolated, mean degree."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("tgt").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count("degree").alias("connected"), F.count_if(F.col("degree").isNull()).alias("isolated"), F.round(F.sum(F.coalesce("degree", F.lit(0))) / F.count(F.lit(1)), 6).alias("mean_degree"))


def spatial_level(name: str):
    """How local a place is, 0 to 4 (G11), by the word its name starts with."""
    c = F.lower(name)
    return F.when(c.rlike("^(country|nation)"), 0).when(c.rlike("^(region|province)"), 1).when(c.rlike("^(district|prefecture)"), 2).when(c.rlike("^(commune|town)"), 3).otherwise(4)
