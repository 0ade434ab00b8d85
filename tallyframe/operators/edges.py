"""Dependency edges (G1-G4) over an edge table (group_id, child, parent), many groups at once.

G1 audit: self references and unknown parents, every one; bad edges leave the graph.
G3 closure: frontier doubling - round r joins the pairs at distance exactly 2^r with the
   pairs known so far, keeps the least depth per new pair and drops pairs already known;
   about log2(depth) rounds, and it ends on cycles. Every round's new pairs are written to
   the session's shared checkpoint folder so the lineage (and a lost executor's recompute)
   stays one round deep.
G2 cycle members: nodes of strongly connected components (``cycles``), without a closure.
G4 levels: peel nodes whose parents are all done, round by round (round = level), each
   round writing only its new nodes; nodes in or behind a cycle never peel (counted, not
   named, by ``cycle_summary``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.cycles import strong_components
from tallyframe.session import materialize

K = ["group_id"]


def audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: (group_id, child, parent, problem) for every bad edge."""
    known = nodes.select(*K, F.col("node").alias("parent"))
    self_ref = edges.filter(F.col("child") == F.col("parent")).withColumn("problem", F.lit("self_reference"))
    unknown = edges.join(known, [*K, "parent"], "left_anti").withColumn("problem", F.lit("unknown_parent"))
    return self_ref.select(*K, "child", "parent", "problem").unionByName(unknown.select(*K, "child", "parent", "problem"))


def good_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that survive the audit (distinct)."""
    known = nodes.select(*K, F.col("node").alias("parent"))
    return edges.filter(F.col("child") != F.col("parent")).join(known, [*K, "parent"], "left_semi").select(
        *K, "child", "parent"
    ).distinct()


def _cut(df: DataFrame) -> DataFrame:
    return materialize(df, "edges")


def closure(edges: DataFrame) -> DataFrame:
    """(group_id, node, ancestor, depth) - every ancestor of every node with the fewest
    hops. Descendants are the same pairs read the other way.

    Frontier doubling. After round r the known pairs are exactly those at distance <= 2^r,
    with exact depths. A shortest walk of length L in (2^r, 2^(r+1)] splits into a first
    part of exactly 2^r hops and a rest of at most 2^r, both shortest, so joining only the
    frontier (pairs at distance exactly 2^r) with the known pairs on the middle node, taking
    the least depth per pair and dropping pairs already known gives every pair of the next
    band with its exact depth. It ends after about log2(longest shortest path) rounds, also
    on cycles (a node reaching itself is a pair like any other). Each round's new pairs are
    written once to the shared checkpoint folder, so lineage stays one round deep and
    nothing found is rewritten. On the join, a middle node with a huge frontier (a hub) has
    few known ancestors within 2^r hops; AQE splits the skewed frontier side."""
    e = _cut(edges.select(*K, "child", "parent").distinct())
    first = _cut(e.select(*K, F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    rounds = [first]
    frontier, span = first, 1
    while True:
        known = reduce(lambda a, b: a.unionByName(b), rounds)
        head = frontier.select(*K, "node", F.col("ancestor").alias("_mid"))
        tail = known.select(*K, F.col("node").alias("_mid"), "ancestor", F.col("depth").alias("_d"))
        step = head.join(tail, [*K, "_mid"]).groupBy(*K, "node", "ancestor").agg(
            (F.min("_d") + F.lit(span)).alias("depth")
        )
        new = _cut(step.join(known.select(*K, "node", "ancestor"), [*K, "node", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        rounds.append(new)
        span *= 2
        frontier = new.filter(F.col("depth") == F.lit(span))
    return reduce(lambda a, b: a.unionByName(b), rounds)


def cycle_members(edges: DataFrame) -> DataFrame:
    """(group_id, node) for nodes that can reach themselves, from the good edges: the nodes of
    the strongly connected components, found without a closure (see ``cycles``)."""
    return strong_components(edges).select(*K, "node")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, node, level). Level 0 = no parents; a node peels once all its
    parents have peeled, at 1 + the greatest parent level.

    Each child waits with the number of parents not yet peeled. A round joins the edges with
    the nodes of the last round only, takes their number off the waiting children, and peels
    those that reach 0; the waiting table shrinks and is the only thing written again. The
    last parent to peel is the one of the greatest level, so the round is the level."""
    e = _cut(good_edges(edges, nodes))
    waiting = _cut(e.groupBy(*K, "child").agg(F.count(F.lit(1)).alias("_left")))
    roots = nodes.select(*K, "node").distinct().join(
        waiting.select(*K, F.col("child").alias("node")), [*K, "node"], "left_anti"
    )
    rounds, level = [_cut(roots.withColumn("level", F.lit(0)))], 0
    while not rounds[-1].isEmpty():
        level += 1
        last = rounds[-1].select(*K, F.col("node").alias("parent"))
        done = e.join(last, [*K, "parent"]).groupBy(*K, "child").agg(F.count(F.lit(1)).alias("_done"))
        stepped = _cut(
            waiting.join(done, [*K, "child"], "left").select(*K, "child", (F.col("_left") - F.coalesce("_done", F.lit(0))).alias("_left"))
        )
        rounds.append(stepped.filter("_left = 0").select(*K, F.col("child").alias("node"), F.lit(level).alias("level")))
        waiting = stepped.filter("_left > 0")
    return reduce(lambda a, b: a.unionByName(b), rounds)


def cycle_summary(nodes: DataFrame, members: DataFrame, lv: DataFrame) -> DataFrame:
    """G2 counts: (group_id, nodes, members, stuck) - stuck = not leveled and not a member."""
    mark = lambda df, name: df.select(*K, "node").distinct().withColumn(name, F.lit(True))
    known = nodes.select(*K, "node").distinct()
    told = known.join(mark(lv, "_leveled"), [*K, "node"], "left").join(mark(members, "_member"), [*K, "node"], "left")
    return told.groupBy(*K).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("_member").alias("members"),
        F.count_if(F.col("_leveled").isNull() & F.col("_member").isNull()).alias("stuck"),
    )
