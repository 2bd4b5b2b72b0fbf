"""Graphs as edge tables: nearest sources, components, routes. Each round is a join that is cut from what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def _cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df without its lineage, kept as a table in the folder that the session shares, or at a path there.

    A checkpoint would hand on the plan's estimated size, which a join multiplies: in rounds that join a table with itself the
    number doubles its digits, and by the 20th round planning takes minutes. A table's size is that of its files.
    """
    path = path or shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def of_lines(lines: DataFrame, grid: float) -> DataFrame:
    """Edges (a, b, cost) in both directions of lines (x1, y1, x2, y2), whose ends are the places of a grid that they lie nearest
    to; the cost is the line's length, the least of parallel lines."""
    at = lambda x, y: F.concat_ws(",", *[F.round(F.col(c) / grid).cast("long").cast("string") for c in (x, y)])
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return both_ways(lines.select(at("x1", "y1").alias("a"), at("x2", "y2").alias("b"), length.alias("cost")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b, cost) in both directions, the cheapest of parallel ones, without loops."""
    rows = edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    return rows.filter("a <> b").groupBy("a", "b").agg(F.min("cost").alias("cost"))


def nearest_source(edges: DataFrame, sources: DataFrame, runs: int = 16) -> DataFrame:
    """(node, source, cost, parent): for each node the source that is reached cheapest, ties to the smaller source, then the
    smaller parent. sources: (node, cost), where to start and at what initial cost. Costs are whole numbers.

    A round goes two edges on from the nodes that became cheaper in the one before, and keeps only those that do so now, beside
    what was kept earlier: it moves no other node. Every `runs` rounds what was kept becomes one table again. Parents follow from
    the final costs.
    """
    session, m = edges.sparkSession, F.min(F.struct("cost", "source")).alias("m")
    steps = _cut(both_ways(edges).select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("cost").alias("more")))
    onward = lambda df: df.join(steps, "node").select(F.col("to").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), "source")
    least = lambda df: df.groupBy("node").agg(m).select("node", "m.*")
    start = sources.groupBy("node").agg(F.min(F.col("cost").cast("long")).alias("cost")).withColumn("source", F.col("node"))
    folder, turn = shared_path(session, "kept"), 0
    fresh = _cut(start.select("node", "cost", "source"), f"{folder}/{turn}")
    kept = lambda: session.read.schema(fresh.schema).option("recursiveFileLookup", True).parquet(folder)
    while fresh.head(1):
        near = _cut(least(onward(fresh)))
        near = _cut(least(near.unionByName(onward(near))))
        had = least(near.select("node").join(kept(), "node")).select("node", F.struct("cost", "source").alias("had"))
        turn += 1
        fresh = _cut(near.join(had, "node", "left").filter("had IS NULL OR struct(cost, source) < had").select("node", "cost", "source"), f"{folder}/{turn}")
        if turn % runs == 0:
            whole, folder = least(kept()), shared_path(session, "kept")
            _cut(whole, f"{folder}/{turn}")
    best = _cut(least(kept()))
    # The way to a node ends with any edge over which it is as cheap from the same source, unless it starts there.
    last = best.join(steps, "node").select(F.col("to").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), "source", F.col("node").alias("parent"))
    parents = last.join(best, ["node", "cost", "source"]).groupBy("node").agg(F.min("parent").alias("parent"))
    starts = start.select("node", F.col("cost").alias("own"))
    parent = F.when((F.col("own") == F.col("cost")) & (F.col("source") == F.col("node")), F.lit(None)).otherwise(F.col("parent"))
    return best.join(parents, "node", "left").join(starts, "node", "left").select("node", "source", "cost", parent.alias("parent"))


def distances(edges: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """(source, node, cost): the cheapest way from each source to each node within limit. Only ways that became cheaper go on."""
    steps = _cut(both_ways(edges).select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("cost").alias("more")))
    best = _cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("cost"), F.lit(True).alias("fresh")))
    while best.filter("fresh").head(1):
        onward = best.filter("fresh").join(steps, "node").select("source", F.col("to").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.lit(True).alias("fresh")).filter(F.col("cost") <= limit)
        both = best.withColumn("fresh", F.lit(False)).unionByName(onward)
        best = _cut(both.groupBy("source", "node").agg(F.min(F.struct("cost", "fresh")).alias("m")).select("source", "node", "m.*"))
    return best.drop("fresh")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node is connected with, by label passing with pointer jumps."""
    pairs = _cut(both_ways(edges.select("a", "b", F.lit(1).alias("cost"))).select("a", "b"))
    label = _cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = pairs.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        now = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = now.select(F.col("node").alias("component"), F.col("component").alias("top"))
        now = _cut(now.join(up, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component")))
        if not now.join(label.withColumnRenamed("component", "old"), "node").filter("component <> old").head(1):
            return now
        label = now


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree), 0 for isolated nodes."""
    count = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(count, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def route_cost(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, hops, cost) of each leaf's way up the parents of a tree (node, parent, cost) to its root. Pointers double, so the
    rounds are as many as the longest way has binary digits; a leaf whose way runs into a cycle has no root and is left out."""
    up = _cut(tree.select("node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("hops")))
    for _ in range(up.count().bit_length() + 1):
        if not up.filter("up IS NOT NULL").head(1):
            break
        ahead = up.select(F.col("node").alias("up"), F.col("up").alias("then"), F.col("hops").alias("more"))
        up = _cut(up.join(ahead, "up", "left").select("node", F.col("then").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    rooted = up.filter("up IS NULL").select(F.col("node").alias("leaf"), "hops")
    own = leaves.select(F.col("node").alias("leaf"))
    return own.join(rooted, "leaf").join(tree.select(F.col("node").alias("leaf"), "cost"), "leaf").select("leaf", "hops", "cost")
