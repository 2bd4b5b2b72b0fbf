"""Coverages, buffers, crossings, clusters and the snap cascade against figures worked out by hand or by plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from polis.functions import places as P
from polis.operators import polygons as PG

RING = "array<struct<x: double, y: double>>"


def square(x, y, w=1.0, h=1.0):
    return [tuple(map(float, p)) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def rings(spark, rows):
    return spark.createDataFrame(rows, f"unit long, key string, ring {RING}")


def test_borders_are_shared_exterior_or_contested(spark):
    cover = rings(spark, [(1, "a", square(0, 0)), (2, "a", square(1, 0)), (3, "b", square(0, 1)), (4, "b", square(5, 5)), (5, "b", None), (None, None, square(9, 9))])
    out = {(r.a, r.b): (r.segments, r.border) for r in PG.adjacency(PG.directed_edges(cover), "unit").collect()}
    assert out == {(1, 2): (1, 1.0), (1, 3): (1, 1.0)}
    kinds = {r["kind"]: r["count"] for r in PG.borders(PG.directed_edges(cover.filter("unit IS NOT NULL")), "key").groupBy("kind").count().collect()}
    assert kinds == {"self_loop": 1, "shared": 1, "exterior": 12}
    twice = rings(spark, [(1, "a", square(0, 0)), (2, "a", square(0, 0)), (3, "a", square(1, 0))])
    assert {r["kind"] for r in PG.borders(PG.directed_edges(twice), "unit").filter("p.x = 1 AND q.x = 1").collect()} == {"overlap"}
    assert PG.adjacency(PG.directed_edges(cover.limit(0)), "unit").count() == 0


def test_edges_snap_to_the_grid(spark):
    near = rings(spark, [(1, "a", square(0, 0)), (2, "a", [(1.04, 0.0), (2.0, 0.0), (2.0, 1.0), (0.97, 1.02)])])
    assert PG.adjacency(PG.directed_edges(near, grid=0.1), "unit", 0.1).collect()[0].border == pytest.approx(1.0)


def test_dissolve_joins_finds_holes_and_parts_at_touching_corners(spark):
    frame = [(k, "frame", square(x, y)) for k, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1))]
    corner = [(20, "corner", square(0, 0)), (21, "corner", square(1, 1)), (22, "corner", square(7, 7)), (23, None, square(8, 8)), (24, "gone", None)]
    out = PG.ring_measures(PG.dissolve(rings(spark, frame + corner), "key"), "key").collect()
    frame_out = sorted((r.twice_area, r.edges, r.corners, r.is_hole, r.length) for r in out if r.key == "frame")
    assert frame_out == [(-2, 4, 4, True, 4.0), (18, 12, 4, False, 12.0)]
    assert sorted((r.twice_area, r.edges) for r in out if r.key == "corner") == [(2, 4), (2, 4), (2, 4)]
    assert {r.key for r in out} == {"frame", "corner"}


def test_dissolved_chains_walk_around_their_rings(spark):
    random.seed(5)
    cells = random.sample([(x, y) for x in range(9) for y in range(9)], 50)
    rows = [(k, "ab"[k % 2], square(x, y)) for k, (x, y) in enumerate(cells)]
    chains = PG.dissolve(rings(spark, rows), "key").collect()
    whole = {}
    for r in chains:
        whole.setdefault((r.key, tuple(r.ring)), []).append(r)
    for (key, name), edges in whole.items():
        edges.sort(key=lambda r: r.place)
        assert [r.place for r in edges] == list(range(len(edges)))
        assert name == min((r.ax, r.ay, r.bx, r.by) for r in edges) == (edges[0].ax, edges[0].ay, edges[0].bx, edges[0].by)
        assert all((a.bx, a.by) == (b.ax, b.ay) for a, b in zip(edges, edges[1:] + edges[:1]))
    for key in "ab":
        assert sum(r.ax * r.by - r.bx * r.ay for r in chains if r.key == key) == 2 * sum(k == key for _, k, _ in rows)
    # Every ring is a simple one: it passes no vertex twice.
    assert all(len({(r.ax, r.ay) for r in edges}) == len(edges) for edges in whole.values())


def test_buffers_widen_convex_rings_only(spark):
    df = rings(spark, [(1, "a", square(0, 0, 4, 2)), (2, "a", [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)]), (3, "a", None)])
    out = {r.unit: r for r in df.select("unit", PG.buffered(F.col("ring"), F.lit(1.0), 64).alias("w")).select("unit", P.signed_area(F.col("w")).alias("area"), PG.covers(F.col("w"), F.lit(-0.99), F.lit(1.0)).alias("in"), PG.covers(F.col("w"), F.lit(-0.9), F.lit(-0.9)).alias("out")).collect()}
    assert out[1].area == pytest.approx(8 + 12 + math.pi, abs=0.02) and out[2].area == pytest.approx(6 + 12 + math.pi, abs=0.02) and out[3].area is None
    assert out[1]["in"] and not out[1]["out"]
    dart = rings(spark, [(1, "a", [(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)])])
    with pytest.raises(Exception, match="only convex rings"):
        dart.select(PG.buffered(F.col("ring"), F.lit(1.0))).collect()


def test_overlap_shares(spark):
    absorbers = spark.createDataFrame([(1, "c", square(0, 0, 10, 10)), (9, "c", None)], f"absorber long, county string, ring {RING}")
    units = [(1, "c", square(0, 0, 10, 10), 5.0, 5.0), (2, "c", square(10, 0, 10, 10), 19.0, 5.0), (3, "c", square(2, 2, 1, 1), 2.5, 2.5), (4, "c", square(40, 0, 10, 10), 41.0, 5.0), (5, "d", square(10, 0, 10, 10), 15.0, 5.0), (6, "c", square(11, 20, 1, 10), None, None), (7, "c", [(10.0, 10.0), (14.0, 10.0), (10.0, 14.0), (11.0, 11.0)], 99.0, 99.0)]
    units = spark.createDataFrame(units, f"unit long, county string, ring {RING}, seat_x double, seat_y double")
    out = {(r.radius, r.unit): (r.share, r.seat_inside) for r in PG.overlap_shares(absorbers, units, "county", [0.5, 5.0, 31.0], 7.0, 0.001).collect()}
    assert out[5.0, 2] == (0.5, False) and out[0.5, 2] == (0.05, False) and out[31.0, 2] == (1.0, True)
    assert out[0.5, 3] == out[5.0, 3] == (1.0, True)  # enclosed
    assert (5.0, 4) not in out and out[31.0, 4] == (0.1, True) and not any(u in (1, 5) for _, u in out)
    assert all(0 <= share <= 1 for share, _ in out.values())
    counts = [sum(r == radius for r, _ in out) for radius in (0.5, 5.0, 31.0)]
    assert counts == sorted(counts)  # candidates grow with the radius
    assert PG.overlap_shares(absorbers, units.limit(0), "county", [1.0], 7.0, 0.001).count() == 0


def test_crossings_touch_cross_and_run_along(spark):
    lines = [(1, 0, 0, 10, 10), (2, 0, 10, 10, 0), (3, 10, 10, 20, 10), (4, 12, 10, 18, 10), (5, 0, 30, 5, 30), (6, 100, 0, 100, 5), (7, 2, 30, 2, 40)]
    df = spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in lines], "x1 double, y1 double, x2 double, y2 double, line long")
    out = sorted((r.a, r.b, r.x, r.y) for r in PG.crossings(df, 4.0).collect())
    assert out == [(1, 2, 5.0, 5.0), (1, 3, 10.0, 10.0), (3, 4, 12.0, 10.0), (3, 4, 18.0, 10.0), (5, 7, 2.0, 30.0)]


@pytest.mark.parametrize("crowd", [False, True])
def test_clusters_match_brute_force(spark, crowd):
    random.seed(8)
    at = [(random.uniform(0, 30), random.uniform(0, 30)) for _ in range(150)] + [(1.0, 1.0)] * 5
    at += [(50 + random.random() / 9, 50 + random.random() / 9) for _ in range(60)] if crowd else []
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)] + [(999, None, 1.0)], "id long, x double, y double")
    group = list(range(len(at)))
    for a in range(len(at)):
        for b in range(a):
            if math.dist(at[a], at[b]) <= 2 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert {r.id: r.cluster for r in PG.clustered(df, 2.0).collect()} == dict(enumerate(group))


def test_snap_cascade_stops_at_the_first_step(spark):
    points = [(1, "c", 10, 0.5, 0.5), (2, "c", 10, 1.5, 0.5), (3, "c", 10, 7.0, 7.0), (4, "c", 77, 8.0, 8.0), (5, "d", 77, 8.0, 8.0), (6, "c", None, 0.5, 0.5), (7, "c", 77, None, None), (8, "e", 77, 900.0, 0.0), (9, "f", 77, 1.0, 1.0)]
    points = spark.createDataFrame(points, "id long, county string, home long, x double, y double")
    polygons = spark.createDataFrame([(10, "c", square(0, 0)), (11, "c", square(1, 0)), (12, "d", square(8, 8))], f"node long, county string, ring {RING}")
    nodes = spark.createDataFrame([(10, "c", 0.5, 0.5), (11, "c", 1.5, 0.5), (13, "e", 0.0, 0.0), (14, "e", 0.0, 1.0)], "node long, county string, x double, y double")
    out = {r.id: (r.node, r.step) for r in PG.snapped(points, polygons, nodes, 1.0, 0.5).collect()}
    assert out == {1: (10, "own_polygon"), 2: (11, "containing_polygon"), 3: (10, "home_centroid"), 4: (11, "nearest_node"), 5: (12, "containing_polygon"), 9: (None, "none"), 6: (10, "containing_polygon"), 7: (None, "none"), 8: (13, "nearest_node")}
