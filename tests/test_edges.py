"""Dependency edges on a small hand-written graph."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.cycles import strong_components
from tallyframe.operators import edges as G


def graph(spark):
    e = spark.createDataFrame(
        [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "d", "a"), ("g", "e", "f"),
         ("g", "x", "x"), ("g", "y", "nope")],
        "group_id string, child string, parent string",
    )
    n = spark.createDataFrame([("g", v) for v in "abcdefxy"], "group_id string, node string")
    return e, n


def test_audit_reports_every_bad_edge(spark):
    e, n = graph(spark)
    got = sorted((r.child, r.problem) for r in G.audit(e, n).collect())
    assert got == [("x", "self_reference"), ("y", "unknown_parent")]


def test_cycles_levels_and_stuck(spark):
    e, n = graph(spark)
    members = G.cycle_members(G.good_edges(e, n))
    assert sorted(r.node for r in members.collect()) == ["a", "b", "c"]
    lv = {r.node: r.level for r in G.levels(e, n).collect()}
    assert lv == {"f": 0, "e": 1, "x": 0, "y": 0}
    s = G.cycle_summary(n, members, G.levels(e, n)).first()
    assert (s.nodes, s.members, s.stuck) == (8, 3, 1)


def test_closure_depths(spark):
    e = spark.createDataFrame([("g", 3, 2), ("g", 2, 1), ("g", 1, 0), ("g", 4, 2)], "group_id string, child long, parent long")
    got = sorted((r.node, r.ancestor, r.depth) for r in G.closure(e).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (2, 1, 1), (3, 0, 3), (3, 1, 2), (3, 2, 1), (4, 0, 3), (4, 1, 2), (4, 2, 1)]


def _bfs_closure(edges):
    """Brute force: shortest hop count from every node to every node it reaches upwards."""
    up = {}
    for g, c, p in edges:
        up.setdefault((g, c), set()).add(p)
    out = {}
    for g, c, _ in edges:
        seen, level, d = {}, {c}, 0
        while level:
            d += 1
            nxt = set()
            for v in level:
                for p in up.get((g, v), ()):
                    if p not in seen:
                        seen[p] = d
                        nxt.add(p)
            level = nxt
        for a, dist in seen.items():
            out[(g, c, a)] = dist
    return out


def test_closure_matches_bfs_on_shortcuts_cycles_and_long_chains(spark):
    """Doubling must give the least depth where walks of many lengths exist (shortcuts,
    a cycle, a chain longer than any power-of-two band) and in several groups at once."""
    edges = [("g1", i + 1, i) for i in range(37)]                          # chain of 37 hops
    edges += [("g1", i + 5, i) for i in range(0, 30, 3)]                   # shortcuts
    edges += [("g1", 3, 20), ("g2", 1, 2), ("g2", 2, 3), ("g2", 3, 1), ("g2", 4, 3)]  # cycles
    edges += [("g3", 10 + i, 10 + i // 2) for i in range(1, 64)]           # binary tree
    e = spark.createDataFrame(edges, "group_id string, child long, parent long")
    got = {(r.group_id, r.node, r.ancestor): r.depth for r in G.closure(e).collect()}
    assert got == _bfs_closure(edges)


def _plain_components(edges):
    """Brute force: nodes that reach each other and themselves, named by the least."""
    reach = defaultdict(set)
    for g, n, a in _bfs_closure(edges):
        reach[g, n].add(a)
    return {(g, n): min(m for m in up if n in reach.get((g, m), ())) for (g, n), up in reach.items() if n in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_closure(spark, seed):
    """Random graphs of several densities, figures of eight, nested and joined rings, bridges between
    cycles, tails, repeated edges, self edges, all in one table."""
    rng = random.Random(seed)
    edges = []
    for g, (n, m) in enumerate([(12, 14), (30, 60), (40, 44), (25, 150), (60, 75), (6, 5)]):
        edges += [(f"r{g}", rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    ring = lambda g, at, n: [(g, at + i, at + (i + 1) % n) for i in range(n)]
    edges += ring("eight", 0, 7) + [("eight", 0, 10), *(("eight", i, i + 1) for i in range(10, 16)), ("eight", 16, 0)]
    edges += ring("two", 0, 5) + ring("two", 10, 4) + [("two", 2, 10)] + [("two", 30 + i, 29 + i if i else 0) for i in range(9)] + [("two", 12, 50), ("two", 50, 51)]
    edges += ring("pair", 0, 2) + ring("pair", 0, 2) + [("pair", 5, 5), ("pair", 1, 5)]
    edges += ring("chords", 0, 20) + [("chords", 3, 11), ("chords", 11, 3), ("chords", 15, 2)]
    e = spark.createDataFrame(edges, "group_id string, child long, parent long")
    got = {(r.group_id, r.node): r.component for r in strong_components(e).collect()}
    assert got == _plain_components([x for x in edges if x[1] != x[2]])


def test_ring_of_many_nodes(spark):
    """A closure of this ring would hold 10^10 pairs; splicing takes about log n rounds."""
    n = 100_000
    at = F.col("id")
    ring = spark.range(n).select(F.lit("ring").alias("group_id"), at.alias("child"), ((at + 1) % n).alias("parent"))
    tail = spark.range(20_000).select(F.lit("ring").alias("group_id"), (at + n).alias("child"), F.when(at == 0, 0).otherwise(at + n - 1).alias("parent"))
    r = strong_components(ring.unionByName(tail)).agg(F.count("*"), F.min("node"), F.max("node"), F.max("component")).first()
    assert tuple(r) == (n, 0, n - 1, 0)


def test_components_of_nothing(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "c", "c")], "group_id string, child string, parent string")
    assert strong_components(e).collect() == [] and strong_components(e.where("false")).collect() == []
