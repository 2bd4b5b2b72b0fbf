"""Queries of parcels, lines and places that grow with the customers, each with DuckDB SQL that must return the same rows.

Customers lie on a grid, 40 in a row; a parcel is the quadrilateral between four displaced corners of the grid, so neighbours share
theirs and the area grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places as P
from ..operators import assignment as AS
from ..operators import polygons as PG
from ..operators import routes as RT
from .queries import query

#: Corners of the grid, in whole metres: (column, row) moved by up to 199 in either direction.
_CORNER = "(1000 * ({i}) + (({i}) * 37 + ({j}) * 91) % 200), (1000 * ({j}) + (({i}) * 53 + ({j}) * 71) % 200)"


def _corner_sql(i: str, j: str) -> str:
    x, y = _CORNER.format(i=i, j=j).split("), (")
    return f"[{x}), ({y}]"


_PARCELS = f"""k AS (SELECT c_custkey AS unit, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, c_custkey % 40 AS i, c_custkey // 40 AS j FROM customer),
parcel AS (SELECT *, [{_corner_sql("i", "j")}, {_corner_sql("i + 1", "j")}, {_corner_sql("i + 1", "j + 1")}, {_corner_sql("i", "j + 1")}] AS ring FROM k),
edge AS (SELECT parcel.* EXCLUDE (ring, i, j), ring[s][1] AS ax, ring[s][2] AS ay, ring[s % 4 + 1][1] AS bx, ring[s % 4 + 1][2] AS bz FROM parcel, range(1, 5) t(s))"""


def _parcels(read):
    """(unit, nation, balance, segment, i, j, ring)."""
    k = F.col("c_custkey").cast("long")
    own = read("customer").select(k.alias("unit"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), (k % 40).alias("i"), F.floor(k / 40).alias("j"))

    def corner(di: int, dj: int):
        i, j = F.col("i") + di, F.col("j") + dj
        return F.struct((1000 * i + (i * 37 + j * 91) % 200).cast("double").alias("x"), (1000 * j + (i * 53 + j * 71) % 200).cast("double").alias("y"))

    return own.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


@query(f"""
WITH {_PARCELS}, s AS (SELECT least({{'x': ax, 'y': ay}}, {{'x': bx, 'y': bz}}) AS p, greatest({{'x': ax, 'y': ay}}, {{'x': bx, 'y': bz}}) AS q, min(unit) AS a, max(unit) AS b, count(*) AS n FROM edge GROUP BY 1, 2)
SELECT a, b, count(*) AS segments, round(sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 3) AS border FROM s WHERE n = 2 GROUP BY 1, 2
""")
def shared_borders(read):
    """Which parcels share a border, and how long it is (GR-12)."""
    edges = PG.directed_edges(_parcels(read).select("unit", "ring"))
    return PG.adjacency(edges, "unit").withColumn("border", F.round("border", 3))


@query(f"""
WITH {_PARCELS}, s AS (SELECT least({{'x': ax, 'y': ay}}, {{'x': bx, 'y': bz}}) AS p, greatest({{'x': ax, 'y': ay}}, {{'x': bx, 'y': bz}}) AS q, min(nation) AS a, max(nation) AS b, count(*) AS n FROM edge GROUP BY 1, 2)
SELECT CASE WHEN n = 1 THEN 'exterior' WHEN a = b THEN 'self_loop' ELSE 'shared' END AS kind, count(*) AS edges, round(sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 3) AS length FROM s GROUP BY 1
""")
def border_kinds(read):
    """Borders with the outside, between nations and within one, counted before any is dropped (GR-12)."""
    edges = PG.directed_edges(_parcels(read).select("nation", "ring"))
    return PG.borders(edges, "nation").groupBy("kind").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 3).alias("length"))


@query(f"""
WITH RECURSIVE {_PARCELS}, d AS (SELECT CASE WHEN balance < 0 THEN 'debit' ELSE 'credit' END AS region, least({{'x': ax, 'y': ay}}, {{'x': bx, 'y': bz}}) AS p, greatest({{'x': ax, 'y': ay}}, {{'x': bx, 'y': bz}}) AS q,
  sum(CASE WHEN {{'x': ax, 'y': ay}} < {{'x': bx, 'y': bz}} THEN 1 ELSE -1 END) AS net FROM edge GROUP BY 1, 2, 3 HAVING net <> 0),
e AS (SELECT *, row_number() OVER (ORDER BY region, ax, ay, bx, bz) AS id FROM (SELECT region, CASE WHEN net > 0 THEN p.x ELSE q.x END AS ax, CASE WHEN net > 0 THEN p.y ELSE q.y END AS ay, CASE WHEN net > 0 THEN q.x ELSE p.x END AS bx, CASE WHEN net > 0 THEN q.y ELSE p.y END AS bz FROM d)),
t AS (SELECT e.id, f.id AS next, (e.bx - e.ax) * (f.bz - f.ay) - (e.bz - e.ay) * (f.bx - f.ax) <> 0 AS corner, atan2(e.ay - e.bz, e.ax - e.bx) - atan2(f.bz - f.ay, f.bx - f.ax) AS turn FROM e JOIN e f ON f.region = e.region AND f.ax = e.bx AND f.ay = e.bz),
s AS (SELECT id, arg_min(next, turn) AS next, arg_min(corner, turn) AS corner FROM (SELECT id, next, corner, CASE WHEN turn > 0 THEN turn ELSE turn + 2 * pi() END AS turn FROM t) GROUP BY 1),
r AS (SELECT id, id AS other FROM s UNION SELECT r.id, s.next FROM r JOIN s ON s.id = r.other),
l AS (SELECT id, min(other) AS ring FROM r GROUP BY 1)
SELECT n.region, n.ax AS x1, n.ay AS y1, n.bx AS x2, n.bz AS y2, count(*) AS edges, CAST(sum(CAST(corner AS INTEGER)) AS BIGINT) AS corners, CAST(sum(e.ax * e.bz - e.bx * e.ay) AS BIGINT) AS twice_area,
  round(sum(sqrt((e.ax - e.bx) * (e.ax - e.bx) + (e.ay - e.bz) * (e.ay - e.bz))), 3) AS length, sum(e.ax * e.bz - e.bx * e.ay) < 0 AS is_hole
FROM l JOIN e USING (id) JOIN s USING (id) JOIN e n ON n.id = l.ring GROUP BY ALL
""")
def dissolved_regions(read):
    """Parcels of customers with and without debt, each joined to regions: their rings and holes (SP-11)."""
    own = _parcels(read).select(F.when(F.col("balance") < 0, "debit").otherwise("credit").alias("region"), "ring")
    out = PG.ring_measures(PG.dissolve(own, "region"), "region")
    ends = [F.col(f"ring.{c}").alias(name) for c, name in (("ax", "x1"), ("ay", "y1"), ("bx", "x2"), ("by", "y2"))]
    return out.select("region", *ends, "edges", "corners", "twice_area", F.round("length", 3).alias("length"), "is_hole")


_WIDENED = """
a AS (SELECT unit AS absorber, j // 10 AS county, ring, radius FROM parcel, (SELECT unnest([500.0, 1500.0, 2500.0]::DOUBLE[]) AS radius) WHERE balance >= 9000),
w AS (SELECT k, sin(2 * pi() * k / 16) AS x, -cos(2 * pi() * k / 16) AS y, sin(2 * pi() * ((k + 1) % 16) / 16) AS nx, -cos(2 * pi() * ((k + 1) % 16) / 16) AS ny FROM range(16) t(k)),
g AS (SELECT absorber, radius, CAST(ring[s % 4 + 1][1] - ring[s][1] AS DOUBLE) AS dx, CAST(ring[s % 4 + 1][2] - ring[s][2] AS DOUBLE) AS dy FROM a, range(1, 5) t(s) UNION ALL SELECT absorber, radius, radius * (nx - x), radius * (ny - y) FROM a, w),
o AS (SELECT *, CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END AS angle FROM g),
p AS (SELECT absorber, radius, angle, dx, dy, sum(dx) OVER v - dx AS x, sum(dy) OVER v - dy AS y FROM o WINDOW v AS (PARTITION BY absorber, radius ORDER BY angle, dx, dy)),
b AS (SELECT a.absorber, a.county, a.radius, list_min(list_transform(ring, lambda q: {'y': q[2], 'x': q[1]})) AS low FROM a),
z AS (SELECT b.absorber, county, b.radius, list([b.low.x + p.x, b.low.y - b.radius + p.y] ORDER BY angle, dx, dy) AS win FROM b JOIN p USING (absorber, radius) GROUP BY ALL)"""


@query(f"""
WITH RECURSIVE {_PARCELS}, {_WIDENED},
m AS (SELECT absorber, radius, unit, win, list_transform(ring, lambda q: [CAST(q[1] AS DOUBLE), CAST(q[2] AS DOUBLE)]) AS ring, 1000.0 * i + 500 AS sx, 1000.0 * parcel.j + 500 AS sy FROM z JOIN parcel ON parcel.j // 10 = county AND unit <> absorber
  WHERE list_max(list_transform(win, lambda q: q[1])) >= list_min(list_transform(ring, lambda q: q[1])) AND list_min(list_transform(win, lambda q: q[1])) <= list_max(list_transform(ring, lambda q: q[1]))
    AND list_max(list_transform(win, lambda q: q[2])) >= list_min(list_transform(ring, lambda q: q[2])) AND list_min(list_transform(win, lambda q: q[2])) <= list_max(list_transform(ring, lambda q: q[2]))),
c AS (SELECT absorber, radius, unit, win, ring AS part, 1 AS k, true AS seat, sx, sy, ring FROM m
  UNION ALL SELECT absorber, radius, unit, win, flatten(list_transform(range(1, len(d) + 1), lambda s: CASE WHEN d[s] >= 0 AND d[s % len(d) + 1] >= 0 THEN [part[s % len(d) + 1]]
      WHEN d[s] >= 0 THEN [[part[s][1] + (part[s % len(d) + 1][1] - part[s][1]) * (d[s] / (d[s] - d[s % len(d) + 1])), part[s][2] + (part[s % len(d) + 1][2] - part[s][2]) * (d[s] / (d[s] - d[s % len(d) + 1]))]]
      WHEN d[s % len(d) + 1] >= 0 THEN [[part[s][1] + (part[s % len(d) + 1][1] - part[s][1]) * (d[s] / (d[s] - d[s % len(d) + 1])), part[s][2] + (part[s % len(d) + 1][2] - part[s][2]) * (d[s] / (d[s] - d[s % len(d) + 1]))], part[s % len(d) + 1]] ELSE [] END)), k + 1,
    seat AND (w2[1] - w1[1]) * (sy - w1[2]) - (w2[2] - w1[2]) * (sx - w1[1]) >= 0, sx, sy, ring
  FROM (SELECT *, win[k] AS w1, win[k % len(win) + 1] AS w2, list_transform(part, lambda q: (win[k % len(win) + 1][1] - win[k][1]) * (q[2] - win[k][2]) - (win[k % len(win) + 1][2] - win[k][2]) * (q[1] - win[k][1])) AS d FROM c WHERE k <= len(win))),
f AS (SELECT absorber, radius, unit, seat, part, ring FROM c WHERE k = len(win) + 1),
x AS (SELECT absorber, radius, unit, seat AS seat_inside, round(coalesce(abs(list_sum(list_transform(range(1, len(part) + 1), lambda s: part[s][1] * part[s % len(part) + 1][2] - part[s % len(part) + 1][1] * part[s][2]))), 0)
  / abs(list_sum(list_transform(range(1, 5), lambda s: ring[s][1] * ring[s % 4 + 1][2] - ring[s % 4 + 1][1] * ring[s][2]))), 4) AS share FROM f)
SELECT absorber, radius, unit, share, seat_inside FROM x WHERE share >= 0.001 OR seat_inside
""")
def overlap_candidates(read):
    """Which share of each parcel of the county lies within several distances of a rich customer's, and whether its seat does
    (SP-10, JN-21, PF-17)."""
    own = _parcels(read).withColumn("county", F.floor(F.col("j") / 10))
    units = own.select("unit", "county", "ring", (1000.0 * F.col("i") + 500).alias("seat_x"), (1000.0 * F.col("j") + 500).alias("seat_y"))
    absorbers = own.filter("balance >= 9000").select(F.col("unit").alias("absorber"), "county", "ring")
    return PG.overlap_shares(absorbers, units, "county", [500.0, 1500.0, 2500.0], 2000.0, 0.001)


_LINES = """l AS (SELECT c_custkey AS line, CAST(c_custkey * 37 % 400 AS DOUBLE) AS x1, CAST(c_custkey // 4 + c_custkey * 13 % 50 AS DOUBLE) AS y1,
  CAST(c_custkey * 37 % 400 + 40 - c_custkey * 7 % 80 AS DOUBLE) AS x2, CAST(c_custkey // 4 + c_custkey * 13 % 50 + c_custkey * 11 % 40 - 15 AS DOUBLE) AS y2 FROM customer)"""


def _lines(read):
    k = F.col("c_custkey").cast("long")
    x, y = k * 37 % 400, F.floor(k / 4) + k * 13 % 50
    ends = {"x1": x, "y1": y, "x2": x + 40 - k * 7 % 80, "y2": y + k * 11 % 40 - 15}
    return read("customer").select(k.alias("line"), *[e.cast("double").alias(c) for c, e in ends.items()])


@query(f"""
WITH RECURSIVE {_LINES}, m AS (SELECT s.line AS a, t.line AS b, s.x1, s.y1, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy, t.x2 - t.x1 AS ex, t.y2 - t.y1 AS ey, t.x1 - s.x1 AS gx, t.y1 - s.y1 AS gy, s AS s, t AS t FROM l s JOIN l t ON s.line < t.line
  AND greatest(s.x1, s.x2) >= least(t.x1, t.x2) AND least(s.x1, s.x2) <= greatest(t.x1, t.x2) AND greatest(s.y1, s.y2) >= least(t.y1, t.y2) AND least(s.y1, s.y2) <= greatest(t.y1, t.y2)),
i AS (SELECT a, b, x1 + ((gx * ey - gy * ex) / (dx * ey - dy * ex)) * dx AS x, y1 + ((gx * ey - gy * ex) / (dx * ey - dy * ex)) * dy AS y FROM m WHERE dx * ey <> dy * ex AND (gx * ey - gy * ex) / (dx * ey - dy * ex) BETWEEN 0 AND 1 AND (gx * dy - gy * dx) / (dx * ey - dy * ex) BETWEEN 0 AND 1
  UNION ALL SELECT a, b, x, y FROM (SELECT a, b, t.x1 AS x, t.y1 AS y, s AS o FROM m WHERE dx * ey = dy * ex UNION ALL SELECT a, b, t.x2, t.y2, s FROM m WHERE dx * ey = dy * ex UNION ALL SELECT a, b, s.x1, s.y1, t FROM m WHERE dx * ey = dy * ex UNION ALL SELECT a, b, s.x2, s.y2, t FROM m WHERE dx * ey = dy * ex)
  WHERE (o.x2 - o.x1) * (y - o.y1) = (o.y2 - o.y1) * (x - o.x1) AND x BETWEEN least(o.x1, o.x2) AND greatest(o.x1, o.x2) AND y BETWEEN least(o.y1, o.y2) AND greatest(o.y1, o.y2)),
p AS (SELECT min(a * 10000000 + b) AS id, round(x, 6) AS x, round(y, 6) AS y FROM i GROUP BY round(x, 6), round(y, 6)),
side AS (SELECT *, CAST(floor(x / (3 / sqrt(2.0))) AS BIGINT) AS cx, CAST(floor(y / (3 / sqrt(2.0))) AS BIGINT) AS cy FROM p),
c AS (SELECT cx, cy, min(id) AS node FROM side GROUP BY 1, 2),
e AS (SELECT DISTINCT u.node AS a, v.node AS b FROM side s JOIN side t ON (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= 9 AND abs(s.cx - t.cx) <= 2 AND abs(s.cy - t.cy) <= 2 JOIN c u ON u.cx = s.cx AND u.cy = s.cy JOIN c v ON v.cx = t.cx AND v.cy = t.cy WHERE u.node <> v.node),
r AS (SELECT node, node AS other FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
n AS (SELECT node, min(other) AS cluster FROM r GROUP BY 1)
SELECT cluster, count(*) AS points, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM side JOIN c USING (cx, cy) JOIN n USING (node) GROUP BY 1
""")
def crossing_clusters(read):
    """Where lines cross, and the places that crossings near one another stand for (SP-14)."""
    met = PG.crossings(_lines(read), 50.0)
    points = met.groupBy("x", "y").agg(F.min(F.col("a") * 10_000_000 + F.col("b")).alias("id"))
    out = PG.cluster_centres(PG.clustered(points, 3.0))
    return out.select("cluster", "points", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_NODES = """n AS (SELECT unit AS node, j // 10 AS county, 1000.0 * i + 500 AS x, 1000.0 * j + 500 AS y, segment, ring FROM parcel),
q AS (SELECT s_suppkey AS id, 15 * s_suppkey - s_acctbal::BIGINT % 15 AS home, s_suppkey * 7919 % 40000 + 0.5 AS x, 15 * s_suppkey // 40 * 1000.0 + s_suppkey * 104729 % 5000 - 2000 + 0.5 AS y, 15 * s_suppkey // 40 // 10 AS county FROM supplier)"""


def _homes(read):
    s = F.col("s_suppkey").cast("long")
    row = F.floor(15 * s / 40)
    return read("supplier").select(
        s.alias("id"), (15 * s - F.round("s_acctbal").cast("long") % 15).alias("home"), (s * 7919 % 40000 + 0.5).alias("x"), (row * 1000.0 + s * 104729 % 5000 - 2000 + 0.5).alias("y"), F.floor(row / 10).alias("county"),
    )


@query(f"""
WITH {_PARCELS}, {_NODES},
h AS (SELECT id, home, q.county, q.x, q.y, node FROM q JOIN n ON n.county = q.county AND segment <> 'MACHINERY' AND len(list_filter(range(1, 5), lambda s: (ring[s][2] > q.y) <> (ring[s % 4 + 1][2] > q.y) AND q.x < (ring[s % 4 + 1][1] - ring[s][1]) * (q.y - ring[s][2]) / (ring[s % 4 + 1][2] - ring[s][2]) + ring[s][1])) % 2 = 1),
a AS (SELECT id, arg_min(node, {{'o': node <> home, 'n': node}}) AS node, CASE WHEN bool_or(node = home) THEN 'own_polygon' ELSE 'containing_polygon' END AS step FROM h GROUP BY 1),
b AS (SELECT id, home AS node, 'home_centroid' AS step FROM q WHERE id NOT IN (SELECT id FROM a) AND home IN (SELECT node FROM n WHERE segment <> 'FURNITURE')),
c AS (SELECT id, arg_min(node, {{'m': sqrt((n.x - q.x) * (n.x - q.x) + (n.y - q.y) * (n.y - q.y)), 'n': node}}) AS node, 'nearest_node' AS step FROM q JOIN n ON n.county = q.county AND segment <> 'FURNITURE' WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) GROUP BY 1),
f AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT q.id, f.node, coalesce(step, 'none') AS step, round(sqrt((n.x - q.x) * (n.x - q.x) + (n.y - q.y) * (n.y - q.y)), 4) AS metres FROM q LEFT JOIN f USING (id) LEFT JOIN n ON n.node = f.node
""")
def snap_cascade(read):
    """Suppliers at the parcel that holds them, else at their home's centre, else at the nearest centre of the county (SP-06).
    Some parcels have no polygon and some no node."""
    own = _parcels(read).select(F.col("unit").alias("node"), F.floor(F.col("j") / 10).alias("county"), (1000.0 * F.col("i") + 500).alias("x"), (1000.0 * F.col("j") + 500).alias("y"), "segment", "ring")
    out = PG.snapped(_homes(read), own.filter("segment <> 'MACHINERY'").select("node", "county", "ring"), own.filter("segment <> 'FURNITURE'").select("node", "county", "x", "y"), 2000.0, 1500.0)
    every = own.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"))  # a polygon may stand without a node
    at = _homes(read).select("id", "x", "y").join(out.select("id", "node", "step"), "id").join(every, "node", "left")
    return at.select("id", "node", "step", F.round(F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2)), 4).alias("metres"))


# --- Routes and assignments ---------------------------------------------------------------------------------------------------

_ROADS = f"""{_PARCELS}, road AS (SELECT a.unit AS a, b.unit AS b, 40 + (a.unit * 37 + b.unit * 11) % 50 AS cost FROM parcel a JOIN parcel b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)
  WHERE (a.unit * 7 + b.unit) % 5 <> 0 AND a.j // 10 = b.j // 10),
way AS (SELECT a, b, cost FROM road UNION ALL SELECT b, a, cost FROM road)"""


def _roads(read):
    """(a, b, cost) between neighbours on the grid, of which some have no road."""
    own = _parcels(read).select("unit", "i", "j")
    near = own.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((1, 0), (0, 1))])))
    near = near.select(F.col("unit").alias("a"), (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    met = near.join(own.withColumnRenamed("unit", "b"), ["i", "j"])
    return met.filter((F.col("a") * 7 + F.col("b")) % 5 != 0).select("a", "b", (40 + (F.col("a") * 37 + F.col("b") * 11) % 50).alias("cost"))


def _zones(read):
    return _parcels(read).select(F.col("unit").alias("node"), F.floor(F.col("j") / 10).alias("zone"))


@query(f"""
WITH RECURSIVE {_ROADS}, hub AS (SELECT unit AS hub FROM parcel WHERE balance >= 9500),
d(hub, node, cost) USING KEY (hub, node) AS (SELECT hub, hub, CAST(0 AS BIGINT) FROM hub UNION SELECT d.hub, way.b, min(d.cost + way.cost) FROM d JOIN way ON way.a = d.node LEFT JOIN recurring.d o ON o.hub = d.hub AND o.node = way.b WHERE o.node IS NULL OR d.cost + way.cost < o.cost GROUP BY 1, 2),
t AS (SELECT d.hub, d.node, d.cost, arg_min(p.node, {{'c': p.cost, 'n': p.node}}) FILTER (WHERE d.node <> d.hub) AS parent FROM d LEFT JOIN way ON way.b = d.node LEFT JOIN d p ON p.hub = d.hub AND p.node = way.a AND p.cost + way.cost = d.cost GROUP BY d.hub, d.node, d.cost),
m AS (SELECT arg_min(hub, {{'c': cost, 'h': hub}}) AS hub, node FROM d GROUP BY node),
c AS (SELECT m.hub, m.node, m.node AS stop, 0 AS place FROM m WHERE m.node <> m.hub UNION ALL SELECT c.hub, c.node, t.parent, place + 1 FROM c JOIN t ON t.hub = c.hub AND t.node = c.stop WHERE t.parent IS NOT NULL),
l AS (SELECT m.hub, m.node, -coalesce(n, 0) AS rank FROM m LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = node WHERE m.node <> m.hub AND NOT EXISTS (SELECT 1 FROM c WHERE c.hub = m.hub AND c.stop = m.node AND place > 0)),
s AS (SELECT c.hub, c.node AS leaf, c.place, c.stop, rank FROM c JOIN l USING (hub, node)),
f AS (SELECT s.hub, stop, arg_min(leaf, {{'r': rank, 'l': leaf}}) AS first FROM s JOIN m ON m.hub = s.hub AND m.node = s.stop WHERE stop <> s.hub GROUP BY 1, 2),
g AS (SELECT s.*, coalesce(first = leaf, false) AS serves, lead(s.stop) OVER (PARTITION BY s.hub, leaf ORDER BY place) AS onward FROM s LEFT JOIN f ON f.hub = s.hub AND f.stop = s.stop)
SELECT g.hub, g.leaf, count(*) AS stops, sum(CAST(serves AS BIGINT))::BIGINT AS served, any_value(t.cost) AS cost,
  CASE WHEN bool_or(onward IS NOT NULL AND (g.stop + onward) % 17 = 0) THEN NULL ELSE sum(CASE WHEN onward IS NOT NULL THEN 900 + (g.stop + onward) % 300 END)::BIGINT END AS metres
FROM g JOIN t ON t.hub = g.hub AND t.node = g.leaf GROUP BY 1, 2
""")
def hub_routes(read):
    """Routes from the leaves of each hub's shortest-path tree, within zones, every stop served once; their lengths, unknown where
    a step's is (GR-01, GR-06, GR-07)."""
    roads, zones = _roads(read), _zones(read)
    hubs = _parcels(read).filter("balance >= 9500").select(F.col("unit").alias("hub"))
    trees = PG._cut(RT.hub_trees(RT.zone_edges(roads, zones), hubs))
    members = trees.groupBy("node").agg(F.min(F.struct("cost", "hub")).alias("m")).select("node", "m.hub")
    people = read("orders").groupBy(F.col("o_custkey").cast("long").alias("node")).agg(F.count("*").alias("population"))
    stops = PG._cut(RT.leaf_routes(trees, members, people))
    both = F.col("a") + F.col("b")
    lengths = roads.filter(both % 17 != 0).select("a", "b", (900 + both % 300).alias("metres"))
    served = stops.groupBy("hub", "leaf").agg(F.sum(F.col("serves").cast("long")).alias("served"))
    out = RT.path_metres(stops, lengths, ["hub", "leaf"]).join(served, ["hub", "leaf"])
    return out.join(trees.select("hub", F.col("node").alias("leaf"), "cost"), ["hub", "leaf"]).select("hub", "leaf", "stops", "served", "cost", F.col("metres").cast("long").alias("metres"))


_OPTIONS = """site AS (SELECT s_suppkey AS site, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS sx, 15.0 * s_suppkey AS sy FROM supplier),
load AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
item AS (SELECT c_custkey AS item, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y, 1 + coalesce(n, 0) AS weight FROM customer LEFT JOIN load ON o_custkey = c_custkey),
option AS (SELECT item, site, weight, CAST(round(sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y))) AS BIGINT) AS cost FROM item, site WHERE sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) <= 400),
ceil AS (SELECT 1.1 * sum(weight) / (SELECT count(*) FROM supplier) AS most FROM item)"""


def _options(read):
    """(item, site, cost, weight): sites within reach of each customer, whose weight is one and its orders."""
    k, s = F.col("c_custkey").cast("long"), F.col("s_suppkey").cast("long")
    load = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    items = read("customer").join(load, "c_custkey", "left").select(k.alias("id"), (k * 37 % 1000).cast("double").alias("x"), k.cast("double").alias("y"), (1 + F.coalesce("n", F.lit(0))).alias("weight"))
    sites = read("supplier").select(s.alias("site"), (s * 53 % 1000).cast("double").alias("sx"), (15.0 * s).alias("sy"))
    near = P.within_reach(items, sites, 400.0)
    return near.select(F.col("id").alias("item"), "site", F.round("metres").cast("long").alias("cost"), "weight"), items


@query(f"""
WITH RECURSIVE {_OPTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cost, site) AS place, lead(cost) OVER (PARTITION BY item ORDER BY cost, site) - cost AS more FROM option),
p AS (SELECT item, max(weight) AS w, list({{'s': site, 'c': cost}} ORDER BY place) AS o, coalesce(max(CASE WHEN place = 1 THEN more END), 0) AS regret FROM r GROUP BY 1),
q AS (SELECT *, row_number() OVER (ORDER BY regret DESC, item) AS i FROM p),
walk AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(CAST(0 AS BIGINT)) FROM range((SELECT max(s_suppkey) + 1 FROM supplier))) AS l, CAST(NULL AS BIGINT) AS item, CAST(0 AS BIGINT) AS k
  UNION ALL SELECT n.i, list_transform(n.l, lambda v, s: v + CASE WHEN s - 1 = n.o[n.k].s THEN n.w ELSE 0 END), n.item, n.k
  FROM (SELECT q.i, walk.l, q.item, q.o, q.w, coalesce(list_position(list_transform(q.o, lambda x: walk.l[x.s + 1] + q.w <= most), true), 1) AS k FROM walk JOIN q ON q.i = walk.i + 1 JOIN ceil ON true) n)
SELECT walk.item, o[k].s AS site, o[k].c AS cost, CAST(k AS INTEGER) AS place FROM walk JOIN q USING (i)
""")
def ceiling_assignment(read):
    """Customers at the nearest site that has room for their cases, those with the most to lose first (MO-07)."""
    options, items = _options(read)
    ceiling = 1.1 * items.agg(F.sum("weight")).head()[0] / read("supplier").count()
    return AS.assign_under_ceiling(options, ceiling)


_SHARDS = """load AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1), known AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM load),
item AS (SELECT c_custkey AS item, coalesce(n, (SELECT max(known.n) FROM known WHERE k = c // 2)) AS weight FROM customer LEFT JOIN load ON o_custkey = c_custkey),
q AS (SELECT *, row_number() OVER (ORDER BY weight DESC, item) AS i FROM item),
walk AS (SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS t, CAST(0 AS INTEGER) AS shard
  UNION ALL SELECT n.i, list_transform(n.t, lambda v, s: v + CASE WHEN s - 1 = n.best THEN n.weight ELSE 0 END), n.best FROM (SELECT q.i, walk.t, q.weight, CAST(list_position(walk.t, list_min(walk.t)) - 1 AS INTEGER) AS best FROM walk JOIN q ON q.i = walk.i + 1) n)"""


def _sharded(read):
    load = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("weight"))
    return AS.shards_by_weight(read("customer").join(load, "c_custkey", "left").select(F.col("c_custkey").alias("item"), "weight"), 12)


@query(f"WITH RECURSIVE {_SHARDS} SELECT item, weight, shard FROM walk JOIN q USING (i)")
def weighted_shards(read):
    """Customers in twelve shards of like many orders; one without known orders counts as the middle one (SM-06)."""
    return _sharded(read)


@query(f"WITH RECURSIVE {_SHARDS}, s AS (SELECT shard, CAST(sum(weight) AS BIGINT) AS load FROM walk JOIN q USING (i) GROUP BY 1) SELECT count(*) AS shards, min(load) AS lightest, max(load) AS heaviest, CAST(max(load) AS DOUBLE) / min(load) AS spread FROM s")
def shard_balance(read):
    """How much heavier the heaviest shard is than the lightest (SM-06)."""
    return AS.imbalance(_sharded(read))
