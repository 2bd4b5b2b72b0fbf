"""Coverages of polygons as edge tables: shared borders, dissolving by key, buffers and overlap shares.

A polygon is a row with a ring (array of structs x, y, closed or not). Rings of a coverage turn left around their inside (holes
turn right) and meet their neighbours at common vertices, which are snapped to a grid; all that follows works on whole numbers of
grid steps, so it is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from .graph import _cut

_END = ["ax", "ay", "bx", "by"]


def directed_edges(rings: DataFrame, ring: str = "ring", grid: float = 1.0) -> DataFrame:
    """A row for each edge of a ring, in its direction: the other columns of rings, and ax, ay, bx, by in steps of the grid. A null
    ring has none; edges whose ends snap to one place go."""
    rest = [c for c in rings.columns if c != ring]
    snap = lambda e, c: F.round(e[c] / grid).cast("long").alias(c)
    each = rings.select(*rest, F.explode(P._edges(F.col(ring))).alias("__e"))
    e = F.col("__e")
    return each.select(*rest, *[snap(e, c) for c in _END]).filter("ax <> bx OR ay <> by")


def _undirected() -> list[Column]:
    """The ends of an edge as two structs, the smaller first."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    return [F.least(a, b).alias("p"), F.greatest(a, b).alias("q")]


def _length(scale: float) -> Column:
    return F.sqrt(F.pow((F.col("q.x") - F.col("p.x")).cast("double"), 2) + F.pow((F.col("q.y") - F.col("p.y")).cast("double"), 2)) * scale


def borders(edges: DataFrame, unit: str, grid: float = 1.0) -> DataFrame:
    """(p, q, a, b, length, kind) of each edge of a coverage, once: its unordered ends, the units on both sides and its length.
    kind: shared; exterior, with one side; self_loop, where both sides are of one unit; overlap, where more than two units claim it
    or two do from the same side. An edge is an aggregate of its sides, so no unit meets another in a join."""
    forward = (F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")) < F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).cast("int")
    rows = edges.select(*_undirected(), unit, forward.alias("f"))
    sides = rows.groupBy("p", "q").agg(F.count("*").alias("n"), F.min(unit).alias("a"), F.max(unit).alias("b"), F.sum("f").alias("forward"))
    kind = F.when(F.col("n") == 1, "exterior").when((F.col("n") > 2) | (F.col("forward") != 1), "overlap").when(F.col("a") == F.col("b"), "self_loop").otherwise("shared")
    return sides.select("p", "q", "a", F.when(F.col("n") > 1, F.col("b")).alias("b"), _length(grid).alias("length"), kind.alias("kind"))


def adjacency(edges: DataFrame, unit: str, grid: float = 1.0) -> DataFrame:
    """(a, b, segments, border): each unordered pair of units that share a border, and its length. Borders with the outside,
    edges of a unit with itself and contested edges are no border; see borders for them."""
    shared = borders(edges, unit, grid).filter("kind = 'shared'")
    return shared.groupBy("a", "b").agg(F.count("*").alias("segments"), F.sum("length").alias("border"))


def dissolved_edges(edges: DataFrame, key: str) -> DataFrame:
    """(key, ax, ay, bx, by): the directed edges left when polygons of one key are joined. Where two of them meet, an edge is
    walked both ways and cancels; what is left is walked one way more than the other."""
    forward = F.when(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")) < F.struct(F.col("bx").alias("x"), F.col("by").alias("y")), 1).otherwise(-1)
    net = edges.select(key, *_undirected(), forward.alias("f")).groupBy(key, "p", "q").agg(F.sum("f").alias("net")).filter("net <> 0")
    a, b = (F.when(F.col("net") > 0, F.col(x)).otherwise(F.col(y)) for x, y in (("p", "q"), ("q", "p")))
    return net.select(key, a.alias("a"), b.alias("b")).select(key, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def _successors(edges: DataFrame, key: str) -> DataFrame:
    """edges with nx, ny, where the edge that follows on the ring ends, and corner, whether the ring turns in between.

    Of several ways on from a vertex the first one clockwise from the way back is taken: there the inside ends, which lies on the
    left. A vertex has as many ways on as ways in; they meet by an equi-join on the vertex, and both are as few as the polygons
    that touch in it.
    """
    onward = edges.select(key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("nx"), F.col("by").alias("ny"))
    met = edges.join(onward, [key, "bx", "by"])
    back = F.atan2((F.col("ay") - F.col("by")).cast("double"), (F.col("ax") - F.col("bx")).cast("double"))
    way = F.atan2((F.col("ny") - F.col("by")).cast("double"), (F.col("nx") - F.col("bx")).cast("double"))
    turn = F.when(back > way, back - way).otherwise(back - way + 2 * math.pi)
    out = met.groupBy(key, *_END).agg(F.min(F.struct(turn.alias("t"), "nx", "ny")).alias("m"))
    cross = (F.col("bx") - F.col("ax")) * (F.col("ny") - F.col("by")) - (F.col("by") - F.col("ay")) * (F.col("nx") - F.col("bx"))
    return out.select(key, *_END, F.col("m.nx").alias("nx"), F.col("m.ny").alias("ny")).withColumn("corner", cross != 0)


def chained(edges: DataFrame, key: str) -> DataFrame:
    """(key, ring, place, ax, ay, bx, by, corner): directed edges put in order. A ring is named by its smallest edge, a struct,
    which has place 0.

    Pointers double: after k rounds an edge knows the smallest of the 2^k edges that follow it, and who comes after those. Once
    every ring has its name, pointers to the edges before double until they reach the edge of that name, and count the way.
    So a ring of n edges takes about 2 log2 n joins, and no task holds one.
    """
    own = F.struct(*_END)
    named = _cut(_successors(edges, key).select(key, own.alias("e"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by")).alias("next"), "corner"))
    at = _cut(named.select(key, "e", F.col("next").alias("to"), F.least("e", "next").alias("ring")))
    while True:
        ahead = at.select(key, F.col("e").alias("to"), F.col("to").alias("then"), F.col("ring").alias("low"))
        now = at.join(ahead, [key, "to"]).select(key, "e", F.col("then").alias("to"), F.least("ring", "low").alias("ring"), (F.col("low") < F.col("ring")).alias("moved"))
        now = _cut(now)
        at = now.drop("moved")
        if not now.filter("moved").head(1):
            break
    # steps: how many edges of the ring come before, up to its first one.
    before = named.select(key, F.col("next").alias("e"), F.col("e").alias("previous"))
    first = F.col("e") == F.col("ring")
    walk = at.select(key, "e", "ring").join(named.select(key, "e", "corner"), [key, "e"]).join(before, [key, "e"])
    # Edges whose way is counted leave the rounds; each of the others meets where it points to, be that counted or not.
    walk = _cut(walk.select(key, "e", "ring", "corner", F.when(~first, F.col("previous")).alias("to"), (~first).cast("long").alias("steps")))
    done, walk = walk.filter("to IS NULL"), walk.filter("to IS NOT NULL")
    while walk.head(1):
        ahead = walk.unionByName(done).select(key, F.col("e").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        now = _cut(walk.join(ahead, [key, "to"]).select(key, "e", "ring", "corner", F.col("then").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
        done, walk = done.unionByName(now.filter("to IS NULL")), now.filter("to IS NOT NULL")
    walk = done
    return walk.select(key, "ring", F.col("steps").alias("place"), "e.*", "corner")


def dissolve(rings: DataFrame, key: str, ring: str = "ring", grid: float = 1.0) -> DataFrame:
    """The rings (key, ring, place, ax, ay, bx, by, corner) of all polygons of a key joined; a row is an edge. Polygons with a null
    key or ring are left out."""
    edges = directed_edges(rings.filter(F.col(key).isNotNull()).select(key, ring), ring, grid)
    return chained(dissolved_edges(edges, key), key)


def ring_measures(chains: DataFrame, key: str) -> DataFrame:
    """(key, ring, edges, corners, twice_area, length, is_hole) of the rings of dissolve, in steps of the grid. Areas of holes are
    negative, so a key's sum to the area of its members."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    step = F.sqrt(F.pow((F.col("bx") - F.col("ax")).cast("double"), 2) + F.pow((F.col("by") - F.col("ay")).cast("double"), 2))
    out = chains.groupBy(key, "ring").agg(F.count("*").alias("edges"), F.sum(F.col("corner").cast("long")).alias("corners"), F.sum(cross).alias("twice_area"), F.sum(step).alias("length"))
    return out.withColumn("is_hole", F.col("twice_area") < 0)


# --- Buffers and shares of overlap -----------------------------------------------------------------------------------------


def buffered(ring: Column, reach: Column, sides: int = 16) -> Column:
    """The convex ring (turning left) widened by reach on all sides: its Minkowski sum with a regular polygon of that radius.

    The sum's edges are those of both, in the order of their directions, from the lowest point of both. A ring that isn't convex
    ends the job; its hull would be another shape.
    """
    close = P._edges(ring)
    after = F.concat(F.slice(close, 2, F.greatest(F.lit(0), F.size(close) - 1)), F.slice(close, 1, 1))
    turn = F.zip_with(close, after, lambda e, f: (e["bx"] - e["ax"]) * (f["by"] - f["ay"]) - (e["by"] - e["ay"]) * (f["bx"] - f["ax"]))
    checked = F.when(F.exists(turn, lambda t: t < 0), F.raise_error(F.lit("only convex rings that turn left can be widened")).cast("array<struct<angle:double,dx:double,dy:double>>"))
    angle = lambda dx, dy: F.when(F.atan2(dy, dx) < 0, F.atan2(dy, dx) + 2 * math.pi).otherwise(F.atan2(dy, dx))
    own = F.transform(close, lambda e: F.struct(angle(e["bx"] - e["ax"], e["by"] - e["ay"]).alias("angle"), (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy")))
    at = [(math.sin(2 * math.pi * k / sides), -math.cos(2 * math.pi * k / sides)) for k in range(sides)]  # from the lowest point on
    steps = [(at[(k + 1) % sides][0] - at[k][0], at[(k + 1) % sides][1] - at[k][1]) for k in range(sides)]
    wide = F.array(*[F.struct(F.lit(math.atan2(dy, dx) % (2 * math.pi)).alias("angle"), (reach * dx).alias("dx"), (reach * dy).alias("dy")) for dx, dy in steps])
    edges = F.coalesce(checked, F.array_sort(F.concat(own, wide)))
    low = F.array_min(F.transform(ring, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    start = F.array(F.struct(low["x"].alias("x"), (low["y"] - reach).alias("y")))
    step = lambda done, e: F.concat(done, F.array(F.struct((F.element_at(done, -1)["x"] + e["dx"]).alias("x"), (F.element_at(done, -1)["y"] + e["dy"]).alias("y"))))
    return F.when(ring.isNotNull() & reach.isNotNull(), F.aggregate(F.slice(edges, 1, F.size(edges) - 1), start, step))


def clipped(ring: Column, window: Column) -> Column:
    """The part of a ring inside a convex window (both turn left): each edge of the window cuts off what lies on its right."""
    return _cut_off(ring, P._edges(window))


def _cut_off(ring: Column, edges: Column) -> Column:
    """The part of a ring on the left of all edges, which come in the order of a convex window that turns left."""

    def cut(points: Column, e: Column) -> Column:
        side = lambda p: (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) - (e["by"] - e["ay"]) * (p["x"] - e["ax"])
        pairs = P._edges(points)

        def kept(s: Column) -> Column:
            a, b = F.struct(s["ax"].alias("x"), s["ay"].alias("y")), F.struct(s["bx"].alias("x"), s["by"].alias("y"))
            da, db = side(a), side(b)
            share = da / (da - db)
            crossing = F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))
            return F.when((da >= 0) & (db >= 0), F.array(b)).when(da >= 0, F.array(crossing)).when(db >= 0, F.array(crossing, b)).otherwise(F.slice(F.array(a), 1, 0))

        return F.flatten(F.transform(pairs, kept))

    return F.aggregate(edges, ring, cut)


def covers(window: Column, x: Column, y: Column) -> Column:
    """Whether a convex window (turning left) holds a point, its edge included."""
    return F.forall(P._edges(window), lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]) >= 0)


def overlap_shares(absorbers: DataFrame, units: DataFrame, within: str, radii: list[float], cell: float, least: float, decimals: int = 4, sides: int = 16) -> DataFrame:
    """(absorber, radius, unit, share, seat_inside): for each absorber (absorber, within, ring, convex) and radius, the share of
    each unit (unit, within, ring, seat_x, seat_y) that the widened absorber covers, and whether it holds the unit's seat.

    Only rows that say something are kept: a share of at least `least`, or a seat inside. An absorber is no candidate of itself,
    and both must agree in `within`. Boxes meet on grid cells by an equi-join; a pair is kept in the first cell that both touch,
    so none is met twice and no side is crossed with the other.
    """

    def boxed(df: DataFrame, ring: str, name: str) -> DataFrame:
        for c, places in (("x", F.transform(ring, lambda p: p["x"])), ("y", F.transform(ring, lambda p: p["y"]))):
            low, high = (F.floor(f(places) / cell).cast("long") for f in (F.array_min, F.array_max))
            df = df.withColumn(f"{name}_min_{c}", low).withColumn(f"__{c}", F.explode(F.sequence(low, high)))
            df = df.withColumn(f"{name}_low_{c}", F.array_min(places)).withColumn(f"{name}_high_{c}", F.array_max(places))
        return df

    wide = absorbers.filter(F.col("ring").isNotNull()).select("absorber", within, F.col("ring").alias("core")).withColumn("radius", F.explode(F.array(*map(F.lit, map(float, radii)))))
    wide = boxed(wide.withColumn("window", buffered(F.col("core"), F.col("radius"), sides)).drop("core"), "window", "w")
    own = boxed(units.filter(F.col("ring").isNotNull()).select("unit", within, "ring", "seat_x", "seat_y"), "ring", "u")
    met = wide.join(own, [within, "__x", "__y"]).filter("absorber <> unit AND __x = greatest(w_min_x, u_min_x) AND __y = greatest(w_min_y, u_min_y)")
    met = met.filter("u_low_x <= w_high_x AND w_low_x <= u_high_x AND u_low_y <= w_high_y AND w_low_y <= u_high_y")
    # Generators keep Spark from working out once more what they hold: the window's edges, those of them that some of the ring lies
    # beyond (a few, and no other cuts anything off), and the share.
    side = lambda e, p: (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) - (e["by"] - e["ay"]) * (p["x"] - e["ax"])
    met = met.select("absorber", "radius", "unit", "ring", "seat_x", "seat_y", F.explode(F.array(P._edges(F.col("window")))).alias("__e"))
    seat = F.coalesce(F.forall("__e", lambda e: side(e, {"x": F.col("seat_x"), "y": F.col("seat_y")}) >= 0), F.lit(False))
    cuts = F.filter("__e", lambda e: F.exists("ring", lambda p: side(e, p) < 0))
    met = met.select("absorber", "radius", "unit", "ring", seat.alias("seat_inside"), F.explode(F.array(cuts)).alias("__e"))
    part = F.abs(P.signed_area(_cut_off(F.col("ring"), F.col("__e")))) / F.abs(P.signed_area(F.col("ring")))
    share = F.explode(F.array(F.when(F.size("__e") == 0, 1.0).otherwise(F.round(part, decimals))))
    out = met.select("absorber", "radius", "unit", share.alias("share"), "seat_inside")
    return out.filter((F.col("share") >= least) | F.col("seat_inside"))


# --- Lines that cross, and clusters of places --------------------------------------------------------------------------------


def crossings(lines: DataFrame, cell: float) -> DataFrame:
    """(a, b, x, y): where segments (line, x1, y1, x2, y2) of different lines cross or touch; lines that run along one another
    cross at the ends of the common stretch, where they part. Segments meet on the grid cells that their boxes touch; a point
    that several pairs of segments share is given once for each pair of lines."""

    def boxed(df: DataFrame, name: str) -> DataFrame:
        for c in "xy":
            low, high = F.least(f"{name}{c}1", f"{name}{c}2"), F.greatest(f"{name}{c}1", f"{name}{c}2")
            df = df.withColumn(f"{name}low{c}", F.floor(low / cell).cast("long")).withColumn(f"__{c}", F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))))
        return df

    s, t = (boxed(lines.select(F.col("line").alias(f"{n}line"), *[F.col(c).cast("double").alias(f"{n}{c}") for c in ("x1", "y1", "x2", "y2")]), n) for n in ("s", "t"))
    met = s.join(t, ["__x", "__y"]).filter("sline < tline AND __x = greatest(slowx, tlowx) AND __y = greatest(slowy, tlowy)")
    c = F.col
    dx, dy, ex, ey = c("sx2") - c("sx1"), c("sy2") - c("sy1"), c("tx2") - c("tx1"), c("ty2") - c("ty1")
    gx, gy = c("tx1") - c("sx1"), c("ty1") - c("sy1")
    cross = dx * ey - dy * ex
    u, v = (gx * ey - gy * ex) / cross, (gx * dy - gy * dx) / cross
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    # Along one line: the ends of either that the other's stretch holds.
    along = lambda x, y, n: (F.abs((c(f"{n}x2") - c(f"{n}x1")) * (y - c(f"{n}y1")) - (c(f"{n}y2") - c(f"{n}y1")) * (x - c(f"{n}x1"))) == 0) & x.between(F.least(f"{n}x1", f"{n}x2"), F.greatest(f"{n}x1", f"{n}x2")) & y.between(F.least(f"{n}y1", f"{n}y2"), F.greatest(f"{n}y1", f"{n}y2"))
    ends = [F.when(along(c(f"{m}x{k}"), c(f"{m}y{k}"), n), point(c(f"{m}x{k}"), c(f"{m}y{k}"))) for m, n in (("s", "t"), ("t", "s")) for k in (1, 2)]
    inside = (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
    found = F.when(cross != 0, F.array(F.when(inside, point(c("sx1") + u * dx, c("sy1") + u * dy)))).otherwise(F.array(*ends))
    out = met.select(c("sline").alias("a"), c("tline").alias("b"), F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p"))
    return out.select("a", "b", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")).distinct()


def clustered(points: DataFrame, reach: float) -> DataFrame:
    """points (id, x, y) with cluster, the smallest id that steps of at most reach lead to, an isolated point's own.

    Points are dealt to square cells whose diagonal is reach: those of a cell are one cluster, so a cell needs a single name.
    Only different cells meet, each with the few around it, and a pair of cells is joined by one edge; so a crowd in one cell
    never makes pairs of points within it.
    """
    from .graph import components

    side = reach / math.sqrt(2)
    at = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("cx", F.floor(F.col("x") / side).cast("long")).withColumn("cy", F.floor(F.col("y") / side).cast("long"))
    at = _cut(at.select("id", "x", "y", "cx", "cy"))
    cells = _cut(at.groupBy("cx", "cy").agg(F.min("id").alias("node")))
    # Cells up to two steps away hold points within reach; each pair once.
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)])
    around = cells.withColumn("s", F.explode(steps)).select("cx", "cy", "node", (F.col("cx") + F.col("s.a")).alias("ox"), (F.col("cy") + F.col("s.b")).alias("oy"))
    pairs = _cut(around.join(cells.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("node").alias("other")), ["ox", "oy"]))
    # Of a cell only the points whose neighbour cell is inhabited go on; distinct places of a cell meet those of its neighbours.
    place = at.select("cx", "cy", "x", "y").distinct()
    left = pairs.join(place, ["cx", "cy"])
    right = place.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = left.join(right, ["ox", "oy"]).filter(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= reach * reach)
    edges = near.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    named = components(edges, cells.select("node"))
    of = cells.join(named, "node").select("cx", "cy", F.col("component").alias("cluster"))
    return at.join(of, ["cx", "cy"]).select("id", "x", "y", "cluster")


def cluster_centres(clusters: DataFrame) -> DataFrame:
    """(cluster, points, x, y): a place for each cluster, the mean of its points."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def snapped(points: DataFrame, polygons: DataFrame, nodes: DataFrame, cell: float, reach: float) -> DataFrame:
    """(id, node, step, metres): the node that each point (id, county, home, x, y) is snapped to, and by which step: own_polygon,
    its polygon (node, county, ring) being its home; containing_polygon, another of its county; home_centroid, the node (node,
    county, x, y) of its home; nearest_node of its county; none. A step sees only the points that none before it has settled.
    Points need a value in id; ties go to the smaller node; nodes farther than reach are looked for in doubled cells, round by
    round, until every point whose county has a node has one."""
    inside = P.within(points.select("id", "county", "home", "x", "y"), polygons.select(F.col("node").alias("ring_id"), F.col("county").alias("__c"), "ring"), cell)
    inside = inside.filter(F.col("county") == F.col("__c"))
    first = inside.groupBy("id").agg(F.min(F.struct((~F.coalesce(F.col("ring_id") == F.col("home"), F.lit(False))).alias("other"), F.col("ring_id").alias("node"))).alias("m"))
    found = _cut(first.select("id", "m.node", F.when(F.col("m.other"), "containing_polygon").otherwise("own_polygon").alias("step")))
    rest = points.join(found, "id", "left_anti")
    homes = rest.join(nodes.select(F.col("node").alias("home")).distinct(), "home").select("id", F.col("home").alias("node"), F.lit("home_centroid").alias("step")).distinct()
    found = _cut(found.unionByName(homes))
    rest = _cut(points.join(found, "id", "left_anti").join(nodes.select("county").distinct(), "county").select("id", "county", "x", "y").filter("x IS NOT NULL AND y IS NOT NULL"))
    while rest.head(1):
        around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        spread = nodes.select("county", "node", F.col("x").alias("nx"), F.col("y").alias("ny")).withColumn("s", F.explode(around))
        spread = spread.withColumn("cx", F.floor(F.col("nx") / reach).cast("long") + F.col("s.a")).withColumn("cy", F.floor(F.col("ny") / reach).cast("long") + F.col("s.b"))
        met = rest.withColumn("cx", F.floor(F.col("x") / reach).cast("long")).withColumn("cy", F.floor(F.col("y") / reach).cast("long")).join(spread, ["county", "cx", "cy"])
        met = met.withColumn("m", P.planar(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).filter(F.col("m") <= reach)
        near = _cut(met.groupBy("id").agg(F.min(F.struct("m", "node")).alias("n")).select("id", "n.node", F.lit("nearest_node").alias("step")))
        found, reach = found.unionByName(near), 2 * reach
        rest = _cut(rest.join(near, "id", "left_anti"))
    at = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"))
    out = points.select("id", "x", "y").join(found, "id", "left").join(at, "node", "left")
    return out.select("id", "node", F.coalesce("step", F.lit("none")).alias("step"), P.planar(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("metres"))


def holding(points: DataFrame, edges: DataFrame, key: str, cell: float, grid: float = 1.0) -> DataFrame:
    """points (id, x, y) with each key of edges (key, ax, ay, bx, by, in steps of grid) whose area holds them: those from whom a ray to
    the right crosses an odd number of its edges. Outer rings and holes need no telling apart, nor any ring to be in one place.

    An edge meets the points of the bands of height cell that it runs through; the count of crossings is an aggregate. A point on
    an edge belongs to one side of it."""
    e = edges.select(key, *[(F.col(c) * grid).alias(c) for c in _END]).filter("ay <> by")
    band = lambda y: F.floor(y / cell).cast("long")
    spread = e.withColumn("__b", F.explode(F.sequence(band(F.least("ay", "by")), band(F.greatest("ay", "by")))))
    at = points.filter("x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y", band(F.col("y")).alias("__b")).distinct()
    met = at.join(spread, "__b").filter(((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")))
    return met.groupBy("id", key).agg(F.count("*").alias("__n")).filter("__n % 2 = 1").select("id", key)


def meets(a: Column, b: Column) -> Column:
    """Whether two convex rings (turning left) have a point in common: unless all of one lies beyond an edge of the other."""

    def apart(ring: Column, other: Column) -> Column:
        return F.exists(P._edges(ring), lambda e: F.forall(other, lambda q: (e["bx"] - e["ax"]) * (q["y"] - e["ay"]) - (e["by"] - e["ay"]) * (q["x"] - e["ax"]) < 0))

    return ~apart(a, b) & ~apart(b, a)


def meeting(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(a, b) of the convex polygons of left (a, ring) and right (b, ring) that have a point in common, met in the first grid cell
    that the boxes of both touch."""

    def boxed(df: DataFrame, name: str) -> DataFrame:
        df = df.filter(F.col("ring").isNotNull()).select(name, F.col("ring").alias(f"{name}_ring"))
        for c, places in (("x", F.transform(f"{name}_ring", lambda p: p["x"])), ("y", F.transform(f"{name}_ring", lambda p: p["y"]))):
            low, high = (F.floor(f(places) / cell).cast("long") for f in (F.array_min, F.array_max))
            df = df.withColumn(f"{name}_{c}", low).withColumn(f"__{c}", F.explode(F.sequence(low, high)))
        return df

    met = boxed(left, "a").join(boxed(right, "b"), ["__x", "__y"]).filter("__x = greatest(a_x, b_x) AND __y = greatest(a_y, b_y)")
    return met.filter(meets(F.col("a_ring"), F.col("b_ring"))).select("a", "b")


def reached(*reaches: DataFrame) -> DataFrame:
    """(source, node, ways): what each source reaches by any of several ways (source, node), and by how many of them."""
    rows = None
    for k, df in enumerate(reaches):
        own = df.select("source", "node", F.lit(1 << k).alias("__w"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("source", "node").agg(F.bit_count(F.bit_or("__w")).cast("int").alias("ways"))
