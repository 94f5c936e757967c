"""Closure with identities, greedy matching and the three-pass match against plain versions of themselves."""

import collections
import itertools
import random

import pytest

from quarry.operators import closure as C

FACTS = "group string, src string, rel string, tgt string"


def plain_closure(triples, identities=()):
    """Every rule on every pair of facts, and every fact for every spelling, until nothing is new."""
    same = collections.defaultdict(set)
    pairs = [*identities, *[(s, o) for s, r, o in triples if r in C.IDENTITIES]]
    for a, b in pairs:
        both = {a, b} | same[a] | same[b]
        for x in both:
            same[x] = both
    one = lambda x: same[x] or {x}
    fits = lambda x, prefixes: prefixes is None or any(x.startswith(p) for p in prefixes)
    facts = set(triples)
    for s, r, o in triples:
        facts |= {(o, f, s) if turned else (s, f, o) for rel, a, b, f, turned in C.DIRECT if rel == r and fits(s, a) and fits(o, b)}
        if r == "PART_OF" and not (fits(s, C.LEADERS) and fits(o, C.LED)) and fits(o, C.PART_IN[1]):
            facts |= {(s, f, o) for f in C.PART_IN[2]}
        if r == "ALIAS_OF" and (s.startswith("loc_") or o.startswith("loc_")):
            facts |= {(x, f, y) for x, y in ((s, o), (o, s)) for f in ("SAME_AS_LOCATION", "HAPPENED_AT")}
    while True:
        spelled = {(x, r, y) for s, r, o in facts for x in one(s) for y in one(o)}
        by = collections.defaultdict(set)
        for s, r, o in spelled:
            by[(s, r)].add(o)
        # What leads back to an id of the same class is not followed.
        new = spelled | {(s, r3, z) for s, r, y in spelled for r1, r2, r3 in C.RULES if r == r1 and y not in one(s) for z in by[(y, r2)] if z not in one(s)}
        if new == facts:
            break
        facts = new
    # Inner relations say what they say of a class, by the name of its least member.
    out = {(s, r, o) for s, r, o in facts if r.upper() == r}
    out |= {(x, rel, y) for s, r, o in facts if o not in one(s) for inner, rel, but in C.SAID if r == inner and not (but and fits(min(one(s)), but)) for x in one(s) for y in one(o)}
    return {(s, r, o) for s, r, o in out if s != o}


def triples(rng, n, ids=4):
    rel = ["LED_BY", "PART_OF", "HAPPENED_IN", "HAPPENED_AT", "MENTIONED_IN", "ROYAL_LINEAGE", "ALIAS_OF", "SAME_AS_LOCATION"]
    node = lambda kinds: f"{rng.choice(kinds)}_{rng.randrange(ids)}"
    out = set()
    while len(out) < n:
        r = rng.choices(rel, [4, 4, 4, 4, 3, 3, 1, 1])[0]
        if r in C.IDENTITIES:
            k = "loc" if r == "SAME_AS_LOCATION" else rng.choice(["person", "loc", "event"])
            s, o = node([k]), node([k])
        else:
            s = node({"LED_BY": ["event", "org"], "ROYAL_LINEAGE": ["person"]}.get(r, ["person", "event", "loc", "doc", "dynasty"]))
            o = node({"LED_BY": ["person"], "ROYAL_LINEAGE": ["person"], "HAPPENED_AT": ["loc"], "HAPPENED_IN": ["dynasty"], "MENTIONED_IN": ["doc", "person", "dynasty"]}.get(r, ["event", "org", "dynasty"]))
        if s != o:
            out.add((s, r, o))
    return sorted(out)


def test_closure_against_all_rules(spark):
    rng = random.Random(7)
    groups = {f"g{k}": triples(rng, 3 + k) for k in range(14)}
    extra = {"g3": [("person_0", "person_1")], "g5": [("loc_0", "loc_1"), ("loc_1", "loc_2")]}
    rows = [(g, s.upper() if k % 2 else s, f" {r.lower()}", o) for g, ts in groups.items() for k, (s, r, o) in enumerate(ts)] + [("g0", None, "PART_OF", "x"), ("g0", "", "PART_OF", "x")]
    pairs = spark.createDataFrame([(g, a, b) for g, ps in extra.items() for a, b in ps], "group string, a string, b string")
    got, members = C.identity_closure(spark.createDataFrame(rows, FACTS), pairs)
    found = collections.defaultdict(set)
    for r in got.collect():
        found[r.group].add((r.src, r.rel, r.tgt))
    for g, ts in groups.items():
        assert found[g] == plain_closure(ts, extra.get(g, ())), g
    assert all(r.rep <= r.node for r in members.collect())
    small = C.identity_closure(spark.createDataFrame(rows, FACTS), pairs, expand=False)[0]
    assert small.count() < got.count()


def test_classes_of_a_long_chain(spark):
    pairs = spark.createDataFrame([("a", f"n{k:03d}", f"n{k + 1:03d}") for k in range(300)] + [("b", "n000", "n300")], "group string, a string, b string")
    got = {(r.group, r.node): r.rep for r in C.classes(pairs).collect()}
    assert got == {("a", f"n{k:03d}"): "n000" for k in range(301)} | {("b", "n000"): "n000", ("b", "n300"): "n000"}


def greedy(pairs):
    out, used_p, used_g = set(), set(), set()
    for group, p, g in sorted(pairs):
        if (group, p) not in used_p and (group, g) not in used_g:
            used_p.add((group, p))
            used_g.add((group, g))
            out.add((group, p, g))
    return out


@pytest.mark.parametrize("most", [0, 12, 10_000])
def test_matching_in_rounds_is_the_sequential_one(spark, monkeypatch, most):
    monkeypatch.setattr(C, "GROUP_PAIRS", most)
    rng = random.Random(most)
    pairs = {(f"g{k % 4}", rng.randrange(12), rng.randrange(9)) for k in range(150)} | {("all", p, g) for p, g in itertools.product(range(5), range(4))}
    got = {tuple(r) for r in C.greedy_matching(spark.createDataFrame(sorted(pairs), "group string, p long, g long")).collect()}
    assert got == greedy(pairs)


def test_three_passes(spark):
    rng = random.Random(3)
    gold, predicted = [], []
    for k in range(8):
        ts = triples(rng, 10, 3)
        gold += [(f"s{k}", j, *rng.choice(ts)) for j in range(12)]
        predicted += [(f"s{k}", i, *(rng.choice(ts) if rng.random() < 0.4 else rng.choice(sorted(plain_closure(ts))) if rng.random() < 0.6 else (f"person_{i}", "PART_OF", "event_9"))) for i in range(15)]
    want = set()
    for s in {g[0] for g in gold}:
        ps, gs = [x for x in predicted if x[0] == s], [x for x in gold if x[0] == s]
        p_facts, g_facts = (plain_closure([x[2:] for x in xs]) | {x[2:] for x in xs} for xs in (ps, gs))
        used_p, used_g = set(), set()
        for how in ("exact", "closure"):
            for x in ps:
                if x[1] in used_p:
                    continue
                fit = (lambda y: x[2:] == y[2:]) if how == "exact" else (lambda y: x[2:] in g_facts or y[2:] in p_facts)
                y = next((y for y in gs if y[1] not in used_g and fit(y)), None)
                if y:
                    used_p.add(x[1])
                    used_g.add(y[1])
                    want.add((s, x[1], y[1], how))
        want |= {(s, x[1], None, "entailed") for x in ps if x[1] not in used_p and x[2:] in g_facts}
    schema = "group string, {} long, src string, rel string, tgt string"
    got = {tuple(r) for r in C.three_pass_match(spark.createDataFrame(predicted, schema.format("p")), spark.createDataFrame(gold, schema.format("g"))).collect()}
    assert got == want and len({h for *_, h in want}) == 3
