"""Plane geometry as column expressions: rings are arrays of structs (x, y), closed or not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The radius of the sphere that web maps project.
RADIUS_M = 6_378_137.0


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS_M


def unprojected_lon(x: Column) -> Column:
    return F.degrees(x / RADIUS_M)


def unprojected_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / RADIUS_M)) - math.pi / 2)


def _edges(ring: Column) -> Column:
    """The ring's edges, the last back to the first point."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def _sum(ring: Column, f) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda total, e: total + f(e))


def signed_area(ring: Column) -> Column:
    """By the shoelace formula, positive where the ring turns left."""
    return _sum(ring, lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def perimeter(ring: Column) -> Column:
    return _sum(ring, lambda e: planar(e["ax"], e["ay"], e["bx"], e["by"]))


def centroid(ring: Column) -> Column:
    """The struct (x, y) of the ring's centre of mass."""
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    six = 6 * signed_area(ring)
    return F.struct((_sum(ring, lambda e: (e["ax"] + e["bx"]) * cross(e)) / six).alias("x"), (_sum(ring, lambda e: (e["ay"] + e["by"]) * cross(e)) / six).alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    crosses = F.filter(_edges(ring), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return F.size(crosses) % 2 == 1


def compactness(area: Column, around: Column) -> Column:
    """Polsby and Popper's share of the circle of the same perimeter."""
    return F.when(around > 0, 4 * math.pi * area / (around * around))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def within(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """points (x, y, ...) with each ring (ring_id, ring) that holds them, by an equi-join on the grid cells that the rings' boxes
    touch; the exact test follows."""
    low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
    boxed = rings.withColumn("__cx", F.explode(F.sequence(_cell(low("x"), cell), _cell(high("x"), cell)))).withColumn("__cy", F.explode(F.sequence(_cell(low("y"), cell), _cell(high("y"), cell))))
    met = points.withColumn("__cx", _cell(F.col("x"), cell)).withColumn("__cy", _cell(F.col("y"), cell)).join(boxed, ["__cx", "__cy"])
    return met.filter(contains(F.col("ring"), F.col("x"), F.col("y"))).drop("__cx", "__cy", "ring")


def _dealt(left: DataFrame, right: DataFrame, on: list[str], parts: int, how: str = "inner") -> DataFrame:
    """A join of sorted sides in so many tasks. Left to itself, Spark goes by bytes as shuffled, and rows of few different values
    shrink so much there that one task, or the driver, would get millions of them."""
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on, how)


def within_reach(points: DataFrame, sites: DataFrame, reach: float, parts: int | None = None) -> DataFrame:
    """points (x, y, ...) with each site (site, sx, sy) within reach and metres, how far it is. Points meet the sites of their own
    grid cell of size reach and its neighbours; with parts, in so many tasks."""
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = sites.withColumn("__s", F.explode(around)).withColumn("__cx", _cell(F.col("sx"), reach) + F.col("__s.a")).withColumn("__cy", _cell(F.col("sy"), reach) + F.col("__s.b")).drop("__s")
    placed = points.withColumn("__cx", _cell(F.col("x"), reach)).withColumn("__cy", _cell(F.col("y"), reach))
    met = placed.join(spread, ["__cx", "__cy"]) if parts is None else _dealt(placed, spread, ["__cx", "__cy"], parts)
    met = met.withColumn("metres", planar(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))).filter(F.col("metres") <= reach)
    return met.drop("__cx", "__cy", "sx", "sy")


def great_circle_pairs(points: DataFrame, most: float, cell: int = 10, block: int = 500) -> DataFrame:
    """(a, b, metres) of points (id, lat, lon) with a < b that lie at most `most` metres apart, to the millimetre. cell is a
    divisor of 360 in degrees that is wider than `most` in the latitudes of the points.

    Distinct places are compared, so copies of a place share its way to others. Their points then meet by place, those of a place
    dealt over blocks, so a place or cell that holds many points is many tasks' work.
    """
    from ..operators.graph import _cut
    from .numbers import haversine_m

    points = points.filter("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    sizes = _cut(points.groupBy("lat", "lon").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    at = sizes.withColumn("__row", F.floor(F.col("lat") / cell)).withColumn("__column", F.pmod(F.floor((F.col("lon") + 180) / cell), F.lit(360 // cell)))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = at.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("blocks").alias("blocks2"), "__row", "__column").withColumn("__s", F.explode(around))
    b = b.withColumn("__row", F.col("__row") + F.col("__s.i")).withColumn("__column", F.pmod(F.col("__column") + F.col("__s.j"), F.lit(360 // cell)))
    metres = F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3)
    ways = _cut(at.join(b, ["__row", "__column"]).select("lat", "lon", "lat2", "lon2", "blocks2", metres.alias("metres")).filter(F.col("metres") <= most))
    left = points.select(F.col("id").alias("a"), "lat", "lon").join(ways, ["lat", "lon"])
    left = left.select("a", "lat2", "lon2", "metres", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("block"))
    right = points.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    right = right.join(sizes.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "blocks"), ["lat2", "lon2"])
    right = right.select("b", "lat2", "lon2", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    return left.join(right.hint("merge"), ["lat2", "lon2", "block"]).filter("a < b").select("a", "b", "metres")


def nearest(points: DataFrame, sites: DataFrame, k: int, reach: float) -> DataFrame:
    """(id, site, metres, place): the k nearest sites (site, sx, sy) within reach of each point (id, x, y), ties to the smaller
    site."""
    met = within_reach(points, sites, reach)
    return met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("metres", "site"))).filter(F.col("place") <= k).select("id", "site", "metres", "place")


def clark_evans(points: DataFrame, area: float, reach: float, rows: int = 1_000_000) -> DataFrame:
    """(n, mean, dispersion) of points (id, x, y) in an area: the mean way to the nearest other point, and its ratio to that of
    as many random points. Points with another one within reach meet only what lies around them; those still alone look twice as
    far in each further round, so all count, isolated ones too. A single point has no mean. Rows without coordinates are no points.

    A task gets about `rows` rows: the points that look, in nine cells each, and those that they may find, in one."""
    from ..operators.graph import _cut

    parts = lambda n: max(1, -(-n // rows))
    points = points.filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y")
    points = _cut(points.repartition("id"))
    size = left = points.count()
    alone, found, several = points, points.select("id", F.lit(None).cast("double").alias("metres")).limit(0), len(points.select("id").distinct().head(2)) > 1
    while several and left:
        looking = alone.select(F.col("id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        near = within_reach(points, looking, reach, parts(9 * left + size)).filter("site <> id").groupBy(F.col("site").alias("id")).agg(F.min("metres").alias("metres"))
        near, reach = _cut(near), 2 * reach
        found, alone = found.unionByName(near), _cut(_dealt(alone, near, ["id"], parts(2 * left), "left_anti"))
        left = alone.count()
    n, mean = F.count("*"), F.avg("metres")
    every = _dealt(points.select("id"), found, ["id"], parts(2 * size), "left").groupBy("id").agg(F.first("metres").alias("metres"))
    return every.agg(n.alias("n"), mean.alias("mean"), (mean / (0.5 * F.sqrt(F.lit(area) / F.nullif(n, F.lit(0))))).alias("dispersion"))
