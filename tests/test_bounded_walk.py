"""Walks with a node budget against a plain version, over a graph with a hub."""

import random

from quarry.operators import graph as G


def plain_walk(edges, seeds, hops, budget):
    walk = [(s, t, (s, r, t, c), 0) for s, r, t, c in edges] + [(t, s, (s, r, t, c), 1) for s, r, t, c in edges if r in G.REVERSED]
    order = lambda w: (w[3], -w[2][3], *w[2][:3])
    nodes, out = set(), {}
    for query in {q for q, _ in seeds}:
        visited = {n: 0 for q, n in seeds if q == query}
        frontier = set(visited)
        for hop in range(1, hops + 1):
            step = sorted((w for w in walk if w[0] in frontier), key=order)
            new = list(dict.fromkeys(w[1] for w in step if w[1] not in visited))[: max(0, budget - len(visited))]
            visited |= dict.fromkeys(new, hop)
            for _, to, (s, r, t, c), _ in step:
                if to in visited:
                    out.setdefault((query, s, r, t), (hop, c))
            frontier = set(new)
            if not new:
                break
        nodes |= {(query, n, h) for n, h in visited.items()}
    return nodes, {(q, s, r, t, c, h) for (q, s, r, t), (h, c) in out.items()}


def test_budget_without_walking_hubs(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"person_{k}", "PART_OF", "loc_0", 0.5 + k % 40 / 100) for k in range(400)]
    edges += [(f"event_{k}", "LED_BY", f"person_{rng.randrange(60)}", 0.5 + rng.randrange(40) / 100) for k in range(80)] + [("loc_0", "PART_OF", "dynasty_1", 0.9)]
    edges += list({(a, b): (f"person_{a}", "KIN", f"person_{b}", 0.7) for a, b in (rng.sample(range(60), 2) for _ in range(120))}.values())
    seeds = [(q, f"event_{q}") for q in range(30)] + [(3, "person_4"), *[(50, f"person_{k}") for k in range(9)]]
    rows, real = [], G.staged

    def counted(df):
        out = real(df)
        if "query" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(G, "staged", counted)
    e, s = spark.createDataFrame(edges, "src string, rel string, tgt string, confidence double"), spark.createDataFrame(seeds, "query long, node string")
    visited, kept = G.bounded_bfs(e, s, 3, 8)
    nodes, want = plain_walk(edges, seeds, 3, 8)
    assert {tuple(r) for r in visited.collect()} == nodes
    assert {tuple(r) for r in kept.select("query", "src", "rel", "tgt", "confidence", "hop").collect()} == want
    # A query has 8 nodes at most (one has 9 seeds), of each 8 neighbours; the hub has 400.
    assert max(rows) <= 31 * 8 * 8
