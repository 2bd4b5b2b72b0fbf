"""Shortest-path trees of hubs within zones, and the routes that run along them from the leaves to the hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut, both_ways


def zone_edges(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """The edges (a, b, cost) whose ends lie in one zone of zones (node, zone)."""
    a, b = (zones.select(F.col("node").alias(c), F.col("zone").alias(f"__{c}")) for c in ("a", "b"))
    return edges.join(a, "a").join(b, "b").filter("__a = __b").select("a", "b", "cost")


def hub_trees(edges: DataFrame, hubs: DataFrame, limit: int | None = None) -> DataFrame:
    """(hub, node, cost, parent): the cheapest way from each of hubs (hub) to every node that edges (a, b, cost; whole costs above
    0, both ways) lead to, within limit. Of equally cheap ways the one whose last step starts nearer the hub counts, then at the
    smaller node. A hub is its own root, with a null parent. Each round only goes on from nodes that became cheaper."""
    steps = _cut(both_ways(edges.filter("a IS NOT NULL AND b IS NOT NULL AND cost IS NOT NULL")).select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("cost").cast("long").alias("more")))
    none = F.lit(None).cast(hubs.schema["hub"].dataType)
    best = _cut(hubs.filter("hub IS NOT NULL").distinct().select("hub", F.col("hub").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("so_far"), none.alias("parent"), F.lit(True).alias("fresh")))
    while best.filter("fresh").head(1):
        onward = best.filter("fresh").join(steps, "node").select("hub", F.col("to").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.col("cost").alias("so_far"), F.col("node").alias("parent"), F.lit(False).alias("old"))
        onward = onward.filter(F.col("cost") <= limit) if limit is not None else onward
        both = best.select("hub", "node", "cost", "so_far", "parent", F.lit(True).alias("old")).unionByName(onward)
        least = F.min(F.struct("cost", "so_far", F.coalesce(F.col("parent"), F.col("hub")).alias("by"), "parent")).alias("m")
        now = both.groupBy("hub", "node").agg(least, F.min(F.when(F.col("old"), F.col("cost"))).alias("was"))
        best = _cut(now.select("hub", "node", "m.cost", "m.so_far", "m.parent", (F.col("was").isNull() | (F.col("m.cost") < F.col("was"))).alias("fresh")))
    return best.select("hub", "node", "cost", "parent")


def chains(trees: DataFrame) -> DataFrame:
    """(hub, node, stop, place): every stop on the way of each node of trees (hub, node, parent) up to its root, itself at place 0.

    Ways double in each round: after k rounds a node has its first 2^k stops and knows who comes next. Nodes on a cycle, or on the
    way to one, have no root and are left out; so the rounds end after as many as the number of nodes has binary digits.
    """
    at = _cut(trees.select("hub", "node", F.col("parent").alias("next"), F.array("node").alias("stops")))
    most = at.count().bit_length() + 1
    for _ in range(most):
        if not at.filter("next IS NOT NULL").head(1):
            break
        ahead = at.select("hub", F.col("node").alias("next"), F.col("next").alias("then"), F.col("stops").alias("more"))
        met = at.join(ahead, ["hub", "next"], "left").select("hub", "node", F.when(F.col("more").isNotNull(), F.col("then")).alias("next"), F.when(F.col("more").isNotNull(), F.concat("stops", "more")).otherwise(F.col("stops")).alias("stops"))
        at = _cut(met.filter(F.size("stops") <= 1 << most))
    return at.filter("next IS NULL").select("hub", "node", F.posexplode("stops").alias("place", "stop"))


def leaf_routes(trees: DataFrame, members: DataFrame, people: DataFrame) -> DataFrame:
    """(hub, leaf, place, stop, serves): the stops of a route for each leaf of a hub's tree, from the leaf to the hub.

    members (node, hub) says whom a hub serves; leaves are those members that lie on no other member's way. Routes are drawn by
    people (node, population), the most first, then the smaller leaf, and a stop is served by the first route that passes it:
    which is the first leaf beyond it, so no route waits for another. The hub itself, and stops that are no members, are passed.
    Members that no way leads to have no route.
    """
    own = members.filter("node <> hub").select("hub", "node").distinct()
    ways = _cut(chains(trees).join(own, ["hub", "node"]))
    passed = ways.filter("place > 0").select("hub", F.col("stop").alias("node")).distinct()
    leaves = own.join(ways.select("hub", "node").distinct(), ["hub", "node"]).join(passed, ["hub", "node"], "left_anti")
    ranked = leaves.join(people.groupBy("node").agg(F.max("population").alias("population")), "node", "left").select("hub", F.col("node").alias("leaf"), (-F.coalesce("population", F.lit(0))).alias("rank"))
    stops = _cut(ways.withColumnRenamed("node", "leaf").join(ranked, ["hub", "leaf"]))
    first = stops.groupBy("hub", "stop").agg(F.min(F.struct("rank", "leaf")).alias("f")).select("hub", "stop", F.col("f.leaf").alias("by"))
    first = first.join(own.withColumnRenamed("node", "stop"), ["hub", "stop"])
    out = stops.join(first, ["hub", "stop"], "left")
    return out.select("hub", "leaf", "place", "stop", F.coalesce(F.col("by") == F.col("leaf"), F.lit(False)).alias("serves"))


def path_metres(stops: DataFrame, lengths: DataFrame, route: list[str]) -> DataFrame:
    """(route, stops, metres) of routes given as rows (route, place, stop): the lengths (a, b, metres, one way or both) of the
    steps from stop to stop; null where one of them is missing, for a route of unknown length isn't free."""
    edges = lengths.select("a", "b", "metres").unionByName(lengths.select(F.col("b").alias("a"), F.col("a").alias("b"), "metres"))
    edges = edges.groupBy("a", "b").agg(F.min("metres").alias("metres"))
    onward = stops.select(*route, (F.col("place") - 1).alias("place"), F.col("stop").alias("b"))
    steps = stops.select(*route, "place", F.col("stop").alias("a")).join(onward, [*route, "place"]).join(edges, ["a", "b"], "left")
    sums = steps.groupBy(*route).agg(F.count("*").alias("__n"), F.when(F.count("metres") == F.count("*"), F.sum("metres")).alias("metres"))
    every = stops.groupBy(*route).agg(F.count("*").alias("stops")).join(sums, route, "left")
    return every.select(*route, "stops", F.when(F.col("__n").isNull(), 0).otherwise(F.col("metres")).alias("metres"))
