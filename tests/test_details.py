"""Holes, marks, refusals, offsets, prefixes, mart records and meeting polygons on fixtures worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from polis.functions import places as P
from polis.functions import text as X
from polis.operators import marts as MA
from polis.operators import matching as MT
from polis.operators import models as M
from polis.operators import polygons as PG
from polis.sources import tables as T

RING = "array<struct<x: double, y: double>>"


def square(x, y, w=1.0, h=1.0):
    return [tuple(map(float, p)) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def test_points_in_holes_are_outside(spark):
    frame = [("f", square(x, y)) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("g", square(10, 0))]
    edges = PG.dissolved_edges(PG.directed_edges(spark.createDataFrame(frame, f"key string, ring {RING}")), "key")
    points = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.5, 1.5), (4, 10.5, 0.5), (5, 5.0, 1.0), (6, None, 1.0), (7, 1.5, 0.5), (8, -1.0, 1.5)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    for cell in (0.7, 1.0, 50.0):
        assert sorted(map(tuple, PG.holding(df, edges, "key", cell).collect())) == [(1, "f"), (3, "f"), (4, "g"), (7, "f")]
    assert PG.holding(df, edges.limit(0), "key", 1.0).count() == 0


def test_survival_marks_interpolate(spark):
    table = [("a", 0, 0.8), ("a", 1, 0.4), ("a", 2, 0.4), ("a", 3, 0.1), ("b", 1, 0.9), ("c", 0, 0.0), ("d", 3, 0.2)]
    out = {r.g: r for r in M.table_marks(spark.createDataFrame(table, "g string, bin long, survival double"), ["g"], [0, 10, 20, 40], 30, [5, 20, 30, 35, 50]).collect()}
    a = out["a"]
    assert (a.done_5, a.done_20, a.done_30) == pytest.approx((0.1, 0.6, 0.6)) and a.done_35 is None and a.done_50 is None and a["median"] == pytest.approx(17.5)
    assert out["b"]["median"] is None and (out["b"].done_5, out["b"].done_20) == pytest.approx((0.0, 0.1))
    assert out["c"]["median"] == pytest.approx(5.0) and "d" not in out  # only in the open bin


def test_joins_refuse_what_is_not_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, l string")
    assert sorted(map(tuple, MT.joined_one_to_one(left, spark.createDataFrame([(1, "x"), (2, "y")], "k long, r string"), "k").collect())) == [(1, "a", "x"), (2, "b", "y")]
    for rows, why in (([(1, "x"), (1, "y"), (2, "z")], "1 repeated_right"), ([(1, "x"), (3, "y")], "1 left_only, 1 right_only"), ([(1, "x"), (2, "y"), (None, "z")], "1 right_only")):
        with pytest.raises(MT.NotOneToOne, match=why):
            MT.joined_one_to_one(left, spark.createDataFrame(rows, "k long, r string"), "k")
    assert MT.joined_one_to_one(left, spark.createDataFrame([(1, "x"), (3, "y")], "k long, r string"), "k", complete=False).count() == 1


def test_offsets_and_projections(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), ("c", 1), ("b", 3)], "g string, v long")
    assert sorted(map(tuple, MT.row_offsets(df, "g", ["g"]).collect())) == [("a", 0, 1, 1), ("b", 1, 4, 3), ("c", 4, 5, 1)]
    order = spark.createDataFrame([("c", 0), ("z", 1), ("a", 2)], "g string, place long")
    mart = spark.createDataFrame([("a", 5), ("c", 6), ("q", 7)], "g string, v long")
    assert [tuple(r) for r in MT.projected(mart, order, "g", "place").orderBy("place").collect()] == [("c", 0, 6), ("z", 1, None), ("a", 2, 5)]


def test_prefixes_and_dimensions(spark):
    known = F.create_map(*[F.lit(x) for x in ("6", "six", "60", "sixty", "601", "more")])
    df = spark.createDataFrame([("60",), ("6012",), ("61",), ("7",), (None,)], "c string")
    assert [r.v for r in df.select(X.best_prefix(known, F.col("c")).alias("v")).collect()] == ["sixty", "more", "six", None, None]
    dims = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    row = spark.range(1).select(*[X.has_dimensions(dims, w).alias(n) for n, w in (("p", {"a": "1"}), ("q", {"a": "1", "b": "3"}), ("r", {"z": "1"}), ("s", {}))]).head()
    assert tuple(row) == (True, False, False, True)


def test_web_map_and_back(spark):
    df = spark.createDataFrame([(25.1, 44.4), (-180.0, -84.0), (0.0, 0.0)], "lon double, lat double")
    out = df.select("lon", "lat", P.unprojected_lon(P.mercator_x(F.col("lon"))).alias("a"), P.unprojected_lat(P.mercator_y(F.col("lat"))).alias("b")).collect()
    assert all((r.a, r.b) == pytest.approx((r.lon, r.lat)) for r in out)


def test_mart_records(spark):
    lines = "unit long, year int, code string, amount long"
    revenue = spark.createDataFrame([(1, 2020, "04.02", 10), (1, 2020, "37", 5), (1, 2020, None, 3), (2, 2020, "04", None)], lines)
    spending = spark.createDataFrame([(1, 2020, "10.1", 8), (1, 2020, "100", 4), (1, 2021, "10", 6)], lines)
    people = spark.createDataFrame([(1, 2020, 2), (2, 2020, 0)], "unit long, year int, population long")
    measures = [MA.Measure("all", "revenue"), MA.Measure("shared", "revenue", ("04",)), MA.Measure("own", "revenue", (), ("04", "37")), MA.Measure("staff", "spending", ("10",))]
    out = {(r.unit, r.year): r.asDict() for r in MA.mart_records({"revenue": revenue, "spending": spending}, measures, people, ["all", "staff"], {"staff_share": ("staff", "all")}).collect()}
    assert out[1, 2020] == {"unit": 1, "year": 2020, "lines_revenue": 3, "lines_spending": 2, "all": 18, "shared": 10, "own": 3, "staff": 8, "all_per_person": 9.0, "staff_per_person": 4.0, "staff_share": 8 / 18, "population": 2}
    assert (out[1, 2021]["staff"], out[1, 2021]["staff_share"], out[1, 2021]["staff_per_person"]) == (6, None, None)
    assert (out[2, 2020]["all"], out[2, 2020]["shared"], out[2, 2020]["all_per_person"]) == (0, 0, None)
    clusters = spark.createDataFrame([("a", "x", 1, None), ("a", "x", 2, 5), ("a", None, 3, 5), ("b", None, None, 1)], "g string, o string, c long, d long")
    assert sorted(map(tuple, MA.cluster_summary(clusters, ["g"], "o", ["c", "d"]).collect())) == [("a", 3, 1, 6, 3, None, 2), ("b", 1, 0, None, 0, 1, 1)]


def test_meeting_polygons_and_reaches(spark):
    left = spark.createDataFrame([(1, square(0, 0, 4, 4)), (2, square(9, 9)), (3, None)], f"a long, ring {RING}")
    right = spark.createDataFrame([(1, square(1, 1)), (2, square(4, 4)), (3, square(4.01, 0)), (4, [(3.0, 5.0), (5.0, 3.0), (6.0, 6.0)]), (5, [(3.9, 5.0), (5.0, 3.9), (6.0, 6.0)])], f"b long, ring {RING}")
    for cell in (0.6, 3.0, 100.0):
        assert sorted(map(tuple, PG.meeting(left, right, cell).collect())) == [(1, 1), (1, 2), (1, 4)]
    ways = [spark.createDataFrame(r, "source long, node string") for r in ([(1, "a"), (1, "a"), (1, "b")], [(1, "b"), (2, "c")])]
    assert sorted(map(tuple, PG.reached(*ways).collect())) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]


def test_documents_by_line_or_file(spark, tmp_path):
    docs = [{"county": "AB", "items": [{"v": 1}, {"v": 2}]}, {"county": "CJ", "items": []}, {"county": "DJ", "items": [{"v": 3}]}]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "d.json").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "files").mkdir()
    for d in docs:
        (tmp_path / "files" / f"{d['county']}.json").write_text(json.dumps(d, indent=1))
    for name, lines in (("lines", True), ("files", False)):
        out = T.documents(spark, f"file://{tmp_path}/{name}", "county string, items array<struct<v: long>>", "items", lines)
        assert sorted(map(tuple, out.collect())) == [("AB", 1), ("AB", 2), ("DJ", 3)]
