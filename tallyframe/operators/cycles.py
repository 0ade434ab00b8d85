"""Strongly connected components of an edge table (group_id, child, parent), many groups at once.

Only nodes on a cycle belong to a component here. Work goes in rounds, each written once:

1. *Trim*: an edge that leaves a node nothing enters, or enters a node nothing leaves, lies on no
   cycle. Nodes without edges on either side go.
2. *Splice*: a node with one edge in and one out is taken out and its two edges become one. It is
   on a cycle exactly if its neighbours are in one component, which is looked up when the rounds
   are run back. Of neighbours only the one of least hash goes, a new hash each round, so about a
   third of a chain or ring goes a round and a ring of n nodes takes log n rounds, not n.
3. *Colour* what is left, where every node has three edges or more: the least node that reaches a
   node is its colour, carried forward from changed nodes only. A colour's own node is reached back
   from exactly its component, along edges of one colour; all colours are searched at once. The
   components found and the edges between colours go, and the rest starts again at 1.

Nothing of the size of the closure is made: every table has at most as many rows as there are edges
or nodes. Rounds are not capped; those of step 3 follow the longest shortest walk in what splicing
leaves. A node of very many edges is an aggregate on the map side, and a join whose larger side Spark
may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

K = ["group_id"]
NODE = [*K, "node"]


def _cut(df: DataFrame) -> DataFrame:
    return materialize(df, "cycles")


def _of(edges: DataFrame, *names: str) -> DataFrame:
    """(group_id, node) of one end or both of every edge (u, v)."""
    ends = [edges.select(*K, F.col(n).alias("node")) for n in names]
    return ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        edges = edges.join(gone.select(*K, F.col("node").alias(end)), [*K, end], "left_anti")
    return edges


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Steps 1 and 2 until no edge is left to trim and no node to splice: the edges left, per round the
    nodes taken out (node, before, after), and the nodes that an edge then led back to."""
    spliced, loops, number = [], [], 0
    while True:
        ends = edges.select(*K, F.col("u").alias("node"), F.lit(0).alias("_in"), F.lit(1).alias("_out"), F.lit(None).alias("_before"), F.col("v").alias("_after")).unionByName(
            edges.select(*K, F.col("v").alias("node"), F.lit(1).alias("_in"), F.lit(0).alias("_out"), F.col("u").alias("_before"), F.lit(None).alias("_after"))
        )
        per = ends.groupBy(*NODE).agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"), F.min("_before").alias("before"), F.min("_after").alias("after"))
        one = (F.col("_in") == 1) & (F.col("_out") == 1)
        rank = lambda c: F.struct(F.xxhash64(F.lit(number), *K, c), F.col(c))
        first = (rank("node") < rank("before")) & (rank("node") < rank("after"))
        dead = (F.col("_in") == 0) | (F.col("_out") == 0)
        open_ = _cut(per.where(one | dead).select(*NODE, "before", "after", dead.alias("dead"), (one & first).alias("picked")))
        if open_.isEmpty():
            return edges, spliced, loops
        picked = open_.where("picked").select(*NODE, "before", "after")
        joined = picked.select(*K, F.col("before").alias("u"), F.col("after").alias("v"))
        kept = _without(edges, open_.where("dead OR picked")).unionByName(joined).distinct()
        edges = _cut(kept)
        spliced.append(picked)
        loops.append(_of(edges.where("u = v"), "u"))
        edges = edges.where("u <> v")
        number += 1


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step 3: (group_id, node, component) of the components of two nodes or more that hold the least
    node of their colour, and the edges that may lie on other cycles."""
    colours = _cut(_of(edges, "u", "v").distinct().withColumn("colour", F.col("node")))
    changed = colours
    while True:
        sent = edges.join(changed.select(*K, F.col("node").alias("u"), "colour"), [*K, "u"]).groupBy(*K, F.col("v").alias("node")).agg(F.min("colour").alias("_sent"))
        lowered = _cut(colours.join(sent, NODE).where("_sent < colour").select(*NODE, F.col("_sent").alias("colour")))
        if lowered.isEmpty():
            break
        new = lowered.withColumnRenamed("colour", "_new")
        colours = _cut(colours.join(new, NODE, "left").select(*NODE, F.coalesce("_new", "colour").alias("colour")))
        changed = lowered
    end = lambda name: colours.select(*K, F.col("node").alias(name), F.col("colour").alias(f"_{name}"))
    within = _cut(edges.join(end("u"), [*K, "u"]).join(end("v"), [*K, "v"]).where("_u = _v").select(*K, "u", "v", F.col("_u").alias("colour")))
    frontier = _cut(colours.where("node = colour"))
    reached = frontier
    while True:
        back = within.join(frontier.select(*K, F.col("node").alias("v"), "colour"), [*K, "v", "colour"])
        frontier = _cut(back.select(*K, F.col("u").alias("node"), "colour").distinct().join(reached, [*NODE, "colour"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = _cut(reached.unionByName(frontier))
    many = reached.groupBy(*K, "colour").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = _cut(reached.join(many, [*K, "colour"], "left_semi").select(*NODE, F.col("colour").alias("component")))
    return found, _cut(_without(within.select(*K, "u", "v"), reached))


def strong_components(edges: DataFrame) -> DataFrame:
    """(group_id, node, component) for every node on a cycle of two nodes or more; the component's
    name is its least node. Edges from a node to itself count nothing."""
    left = _cut(edges.select(*K, F.col("child").alias("u"), F.col("parent").alias("v")).where("u <> v").distinct())
    spliced, loops, labels = [], [], None
    while True:
        left, out, back = _contracted(left)
        spliced, loops = spliced + out, loops + back
        if left.isEmpty():
            break
        found, left = _coloured(left)
        labels = found if labels is None else labels.unionByName(found)
    if labels is None:
        labels = left.select(*K, F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    if loops:
        own = loops[0]
        for more in loops[1:]:
            own = own.unionByName(more)
        own = _cut(own.distinct())
        gone = spliced[0].select(*NODE)
        for more in spliced[1:]:
            gone = gone.unionByName(more.select(*NODE))
        alone = own.join(labels, NODE, "left_anti").join(gone, NODE, "left_anti")
        labels = labels.unionByName(alone.select(*NODE, F.col("node").alias("component")))
        for taken in reversed(spliced):
            near = lambda name: labels.select(*K, F.col("node").alias(name), F.col("component").alias(f"_{name}"))  # noqa: E731, B023
            both = taken.join(near("before"), [*K, "before"], "left").join(near("after"), [*K, "after"], "left")
            both = both.join(own.withColumn("_loop", F.lit(True)), NODE, "left")
            name = F.when(F.col("_before") == F.col("_after"), F.col("_before")).otherwise(F.when(F.col("_loop"), F.col("node")))
            labels = _cut(labels.unionByName(both.select(*NODE, name.alias("component")).where("component IS NOT NULL")))
    least = labels.groupBy(*K, "component").agg(F.min("node").alias("_least"))
    return labels.join(least, [*K, "component"]).select(*NODE, F.col("_least").alias("component"))
