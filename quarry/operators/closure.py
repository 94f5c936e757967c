"""Closure of triples under identities and rules (G03), and the three-pass match of predicted against gold triples.

Identities are settled first: every node is replaced by the least node of its class, so the rules run on the quotient graph, semi-naive, to a fixpoint;
what follows is expanded back to the members. All of it is done for many groups (snippets) at once; a group column is part of every key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import staged

#: Rounds after which an unsettled loop is an error.
MOST_ROUNDS = 200
#: Staged rounds that are read side by side before they are written as one.
MOST_PARTS = 8
#: Candidate pairs up to which a group is matched in one task; larger ones are matched in rounds until they are as small.
GROUP_PAIRS = 10_000
#: Relations that say that two ids are one, and prefixes of ids by kind.
IDENTITIES = ["ALIAS_OF", "SAME_AS_LOCATION"]
LEADERS, LED, FRAMES, REALMS = ["person_", "org_"], ["event_", "org_"], ["dynasty_", "epoch_", "org_"], ["dynasty_", "org_"]
#: What a triple says at once: (relation, source prefixes or None, target prefixes or None, what follows, turned round). Lower-case relations are inner ones that only rules read.
DIRECT = [
    ("ALIAS_OF", None, None, "ALIAS_OF", True), ("SAME_AS_LOCATION", None, None, "SAME_AS_LOCATION", True), ("SAME_AS_LOCATION", None, None, "ALIAS_OF", False), ("SAME_AS_LOCATION", None, None, "ALIAS_OF", True),
    ("SAME_AS_LOCATION", None, None, "HAPPENED_AT", False), ("SAME_AS_LOCATION", None, None, "HAPPENED_AT", True),
    ("LED_BY", None, None, "led", False), ("LED_BY", None, None, "leads", True), ("LED_BY", None, None, "PART_OF", True), ("LED_BY", None, None, "LED_BY", True),
    ("PART_OF", LEADERS, LED, "led", True), ("PART_OF", LEADERS, LED, "leads", False), ("PART_OF", LEADERS, LED, "LED_BY", True),
    ("HAPPENED_IN", None, FRAMES, "in", False), ("HAPPENED_IN", None, FRAMES, "PART_OF", False), ("HAPPENED_IN", ["doc_"], REALMS, "MENTIONED_IN", False), ("HAPPENED_IN", ["doc_"], REALMS, "MENTIONED_IN", True),
    ("HAPPENED_AT", LED, None, "event at", False), ("HAPPENED_AT", ["loc_"], None, "within", False), ("HAPPENED_AT", ["loc_"], None, "SAME_AS_LOCATION", False), ("HAPPENED_AT", ["loc_"], None, "SAME_AS_LOCATION", True), ("HAPPENED_AT", None, None, "at", False),
    ("MENTIONED_IN", None, None, "MENTIONED_IN", True), ("MENTIONED_IN", LEADERS, ["doc_"], "by", True), ("MENTIONED_IN", LEADERS, ["doc_"], "wrote", False), ("MENTIONED_IN", ["doc_"], LEADERS, "by", False), ("MENTIONED_IN", ["doc_"], LEADERS, "wrote", True),
    ("MENTIONED_IN", ["dynasty_"], ["doc_"], "HAPPENED_IN", True), ("MENTIONED_IN", ["dynasty_"], ["doc_"], "PART_OF", True), ("MENTIONED_IN", ["doc_"], REALMS, "HAPPENED_IN", False), ("MENTIONED_IN", ["doc_"], REALMS, "PART_OF", False),
    ("ROYAL_LINEAGE", None, None, "parent", False), ("ROYAL_LINEAGE", None, None, "child", True),
]
#: A part of a frame is in it, unless it is a leader's part of what is led.
PART_IN = ("PART_OF", FRAMES, ["in", "HAPPENED_IN"])
#: Rules by group, each a -r1-> b -r2-> c to a -r3-> c: leaders, places, authors, lineage (identity is the fifth, settled before).
RULES = [
    ("leads", "event at", "at"), ("leads", "in", "in"), ("led", "at", "event at"), ("led", "in", "in"),
    ("at", "within", "at"),
    ("wrote", "at", "at"), ("by", "at", "at"), ("wrote", "in", "in"), ("by", "in", "in"),
    ("parent", "parent", "parent"), ("child", "child", "child"), ("parent", "in", "in"), ("child", "in", "in"),
]
#: What inner relations say in the end: (inner, relation, source prefixes for which it holds not).
SAID = [("led", "LED_BY", None), ("leads", "PART_OF", None), ("at", "HAPPENED_AT", None), ("event at", "HAPPENED_AT", None), ("in", "HAPPENED_IN", None), ("in", "PART_OF", ["event_"]), ("by", "MENTIONED_IN", None), ("wrote", "MENTIONED_IN", None), ("parent", "ROYAL_LINEAGE", None)]
FACT = ["group", "src", "rel", "tgt"]


def starts(c: str, prefixes: list[str] | None) -> Column:
    out = F.lit(prefixes is None)
    for p in prefixes or []:
        out = out | F.startswith(F.col(c), F.lit(p))
    return out


def classes(pairs: DataFrame) -> DataFrame:
    """(group, node, rep): the least node of each class of ``pairs`` (group, a, b). Each round every node takes the least name that its neighbours have,
    and then the name of that one, so rounds are about the logarithm of a class's diameter."""
    both = pairs.select("group", F.col("a").alias("node"), F.col("b").alias("to")).unionByName(pairs.select("group", F.col("b").alias("node"), F.col("a").alias("to"))).distinct()
    both = staged(both)
    named = staged(both.select("group", "node").distinct().withColumn("rep", F.col("node")))
    for _ in range(MOST_ROUNDS):
        near = both.join(named.select("group", F.col("node").alias("to"), "rep"), ["group", "to"]).groupBy("group", "node").agg(F.min("rep").alias("near"))
        step = named.join(near, ["group", "node"]).select("group", "node", F.least("rep", "near").alias("rep"))
        jump = step.select("group", F.col("node").alias("rep"), F.col("rep").alias("next"))
        new = staged(step.join(jump, ["group", "rep"], "left").select("group", "node", F.least("rep", F.coalesce("next", "rep")).alias("rep")))
        if new.join(named, ["group", "node", "rep"], "left_anti").isEmpty():
            return new
        named = new
    raise RuntimeError("classes did not settle")


def direct(triples: DataFrame) -> DataFrame:
    """The triples, and what each says at once: one pass, as a row becomes a row for each relation that follows from it."""
    follows = [F.struct("src", "rel", "tgt")]

    def say(when: Column, rel: str, turned: bool) -> None:
        src, tgt = ("tgt", "src") if turned else ("src", "tgt")
        follows.append(F.when(when, F.struct(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(tgt).alias("tgt"))))

    for rel, s, o, follow, turned in DIRECT:
        say((F.col("rel") == rel) & starts("src", s) & starts("tgt", o), follow, turned)
    rel, frames, follow = PART_IN
    for f in follow:
        say((F.col("rel") == rel) & ~(starts("src", LEADERS) & starts("tgt", LED)) & starts("tgt", frames), f, False)
    # An alias of a place is the same place.
    places = (F.col("rel") == "ALIAS_OF") & (starts("src", ["loc_"]) | starts("tgt", ["loc_"]))
    for turned in (False, True):
        for r in ("SAME_AS_LOCATION", "HAPPENED_AT"):
            say(places, r, turned)
    return triples.select("group", F.explode(F.array_compact(F.array(*follows))).alias("t")).select("group", "t.*").distinct()


def identity_closure(triples: DataFrame, identities: DataFrame | None = None, expand: bool = True) -> tuple[DataFrame, DataFrame]:
    """Triples that follow from ``triples`` (group, src, rel, tgt) and further ``identities`` (group, a, b): (facts, members).

    facts: group, src, rel, tgt over all members of each class, without triples of a node with itself; with ``expand`` False over representatives only, which
    members (group, node, rep) explains, so that large classes need not be multiplied. Ids and relations are trimmed, ids in small and relations in capital letters; triples with a null or blank part are left out."""
    clean = triples.select("group", F.lower(F.trim("src")).alias("src"), F.upper(F.trim("rel")).alias("rel"), F.lower(F.trim("tgt")).alias("tgt")).filter("src <> '' and rel <> '' and tgt <> ''")
    pairs = clean.filter(F.col("rel").isin(IDENTITIES)).select("group", F.col("src").alias("a"), F.col("tgt").alias("b"))
    if identities is not None:
        pairs = pairs.unionByName(identities.select("group", F.lower(F.trim("a")).alias("a"), F.lower(F.trim("b")).alias("b")))
    members = classes(pairs.filter("a <> b"))
    named = lambda end: members.select("group", F.col("node").alias(end), F.col("rep").alias(f"_{end}"))
    said = direct(clean).filter("src <> tgt").join(named("src"), ["group", "src"], "left").join(named("tgt"), ["group", "tgt"], "left")
    said = staged(said.withColumns({f"_{end}": F.coalesce(f"_{end}", end) for end in ("src", "tgt")}))
    # Rules read and find few of the relations: only rows of these are shuffled round by round.
    firsts, seconds, found_ones = ([*dict.fromkeys(r)] for r in zip(*RULES))
    parts = [staged(said.filter("_src <> _tgt").select("group", F.col("_src").alias("src"), "rel", F.col("_tgt").alias("tgt")).distinct())]
    # Identity relations within a class are between different members, so they come back by expansion alone.
    within = said.filter("_src = _tgt").select("group", F.col("_src").alias("rep"), "rel").distinct()
    table = F.broadcast(triples.sparkSession.createDataFrame(RULES, "r1 string, r2 string, r3 string"))
    known = fresh = parts[0]
    for _ in range(MOST_ROUNDS):
        found = None
        # What is new meets all, and all meets what is new; at first these are the same.
        for a, b in ((fresh, known), (known, fresh))[: 1 if fresh is known else 2]:
            left = a.filter(F.col("rel").isin(firsts)).join(table, F.col("rel") == table["r1"]).select("group", "src", F.col("tgt").alias("mid"), "r2", "r3")
            right = b.filter(F.col("rel").isin(seconds)).select("group", F.col("src").alias("mid"), F.col("rel").alias("r2"), "tgt")
            got = left.join(right, ["group", "mid", "r2"]).filter("src <> tgt").select("group", "src", F.col("r3").alias("rel"), "tgt")
            found = got if found is None else found.unionByName(got)
        fresh = staged(found.distinct().join(known.filter(F.col("rel").isin(found_ones)), FACT, "left_anti"))
        if fresh.isEmpty():
            break
        parts = [*parts, fresh]
        if len(parts) > MOST_PARTS:
            parts = [staged(reduce(DataFrame.unionByName, parts))]
        known = reduce(DataFrame.unionByName, parts)
    else:
        raise RuntimeError("the closure did not settle")
    said_by = [F.when(~F.col("rel").isin([r for r, _, _ in SAID] + ["within", "child"]), F.col("rel"))]
    said_by += [F.when((F.col("rel") == inner) & (~starts("src", but) if but else F.lit(True)), F.lit(rel)) for inner, rel, but in SAID]
    outer = known.select("group", "src", F.explode(F.array_compact(F.array(*said_by))).alias("rel"), "tgt")
    if not expand:
        return outer.distinct(), members
    back = lambda end: members.select("group", F.col("rep").alias(end), F.col("node").alias("_node"))
    for end in ("src", "tgt"):
        outer = outer.join(back(end), ["group", end], "left").withColumn(end, F.coalesce("_node", end)).drop("_node")
    inside = within.join(back("rep").withColumnRenamed("_node", "src"), ["group", "rep"]).join(back("rep").withColumnRenamed("_node", "tgt"), ["group", "rep"]).filter("src <> tgt").filter(F.upper("rel") == F.col("rel"))
    return outer.select(*FACT).unionByName(inside.select(*FACT)).distinct(), members


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """(group, p, g) of the sequential greedy: in order of p, each takes the least g of its ``pairs`` (group, p, g) that is left.

    As every g prefers the least p, that is the one matching without a pair that both sides would rather have: so all pairs whose p and g are each other's least can be
    taken at once, round after round. Rounds go on only for groups of more than GROUP_PAIRS pairs; smaller ones are finished in one task each."""
    left = staged(pairs.select("group", "p", "g").distinct())
    done = None
    for _ in range(MOST_ROUNDS * 50):
        counts = left.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_PAIRS).select("group")
        counts = staged(counts)
        if counts.isEmpty():
            break
        big = left.join(counts, "group", "left_semi")
        best = big.withColumns({"_g": F.min("g").over(Window.partitionBy("group", "p")), "_p": F.min("p").over(Window.partitionBy("group", "g"))})
        taken = staged(best.filter("g = _g and p = _p").select("group", "p", "g"))
        done = taken if done is None else done.unionByName(taken)
        left = staged(left.join(taken.select("group", "p"), ["group", "p"], "left_anti").join(taken.select("group", "g"), ["group", "g"], "left_anti"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used_p, used_g = None, set(), set()
        for batch in batches:
            out = []
            for at, p, g in zip(*(c.to_pylist() for c in batch.columns)):
                if at != group:
                    group, used_p, used_g = at, set(), set()
                if p not in used_p and g not in used_g:
                    used_p.add(p)
                    used_g.add(g)
                    out.append((at, p, g))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["group", "p", "g"])

    # Groups are small and many, so a task goes through its sorted groups in one pass.
    small = left.select(F.col("group").cast("string").alias("group"), F.col("p").cast("long").alias("p"), F.col("g").cast("long").alias("g")).repartition("group").sortWithinPartitions("group", "p", "g").mapInArrow(rest, "group string, p long, g long")
    return small if done is None else done.select("group", "p", "g").unionByName(small)


def three_pass_match(predicted: DataFrame, gold: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """How predicted triples meet gold ones (M09): (group string, p, g, how) for each row of ``predicted`` (group, p, src, rel, tgt) that is right; ``gold`` is (group, g, src, rel, tgt).

    exact: equal triples are paired in order. closure: of the rest, in order of p, each takes the first gold triple left that follows from the predictions, or any if it follows itself
    from the gold ones. entailed: it follows from the gold ones but none is left (g is null)."""
    norm = lambda df, i: df.select(F.col("group").cast("string").alias("group"), i, F.lower(F.trim("src")).alias("src"), F.upper(F.trim("rel")).alias("rel"), F.lower(F.trim("tgt")).alias("tgt"))
    p, g = staged(norm(predicted, "p")), staged(norm(gold, "g"))
    nth = lambda df, i: df.withColumn("_n", F.row_number().over(Window.partitionBy(*FACT).orderBy(i)))
    exact = staged(nth(p, "p").join(nth(g, "g"), [*FACT, "_n"]).select("group", "p", "g"))
    p_left, g_left = p.join(exact, ["group", "p"], "left_anti"), g.join(exact, ["group", "g"], "left_anti")
    closed = lambda df: staged(identity_closure(df, identities)[0].unionByName(df.select(*FACT)).distinct())
    follows = lambda df, facts: df.join(facts.withColumn("_ok", F.lit(True)), FACT, "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    p_left, g_left = staged(follows(p_left, closed(g)).select("group", "p", "_ok")), staged(follows(g_left, closed(p)).select("group", "g", F.col("_ok").alias("_right")))
    # The n-th prediction left finds at most n - 1 gold triples taken, so it needs the first n of those that it may take.
    place = lambda df, name, i, *more: df.withColumn(name, F.row_number().over(Window.partitionBy("group", *more).orderBy(i)))
    ranked = place(place(g_left, "_any", "g"), "_good", "g", "_right")
    may = (F.col("_ok") & (F.col("_any") <= F.col("_at"))) | (F.col("_right") & (F.col("_good") <= F.col("_at")))
    chosen = staged(greedy_matching(place(p_left, "_at", "p").join(ranked, "group").filter(may)))
    entailed = p_left.filter("_ok").join(chosen, ["group", "p"], "left_anti").select("group", "p", F.lit(None).cast("long").alias("g"))
    return exact.withColumn("how", F.lit("exact")).unionByName(chosen.withColumn("how", F.lit("closure"))).unionByName(entailed.withColumn("how", F.lit("entailed")))
