"""Titles, compared registers, curves, nested and landed files, gates, streams: on fixtures worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from polis.functions import text as X
from polis.operators import aggregates as A
from polis.operators import joins as J
from polis.operators import windows as W
from polis.sources import sinks as K
from polis.sources import tables as T
from polis.sources.shared import shared_path
from polis.streaming import events as E

HEADS = "DIRECTOR|SEF|INSPECTOR|ASISTENT|TEHNICIAN|COSMETICIAN|INSTITUTOR|MAISTRU|SECRETAR|COMISAR"


@pytest.mark.parametrize(
    "cell, kind, titles, qualifier",
    [
        ("Director;  șef compartiment;  inspector şef; ", "semicolon", ["Director", "șef compartiment", "inspector şef"], None),
        ("Inspector şcolar de specialitate, inspector şcolar", "comma", ["Inspector şcolar de specialitate", "inspector şcolar"], None),
        ("Secretar general adjunct/comisar general", "slash", ["Secretar general adjunct", "comisar general"], None),
        ("Institutor; maistru instructor, studii superioare lungi", "mixed", ["Institutor", "maistru instructor"], "studii superioare lungi"),
        ("Asistent medical; radiologie; cosmetician", "needs_review", ["Asistent medical; radiologie; cosmetician"], None),
        ("Auditor", "single", ["Auditor"], None),
        ("Auditor, clasa I", "single", ["Auditor, clasa I"], None),
        ("Director;", "single", ["Director"], None),
        ("director/adjunct", "single", ["director/adjunct"], None),
        ("Directoral; sef", "needs_review", ["Directoral; sef"], None),
        (" ; ", "single", [], None),
        ("", "single", [], None),
        (None, "single", [], None),
    ],
)
def test_titles(spark, cell, kind, titles, qualifier):
    t = spark.createDataFrame([(cell,)], "c string").select(X.titles(F.col("c"), HEADS).alias("t")).head().t
    assert (t.kind, t.titles, t.qualifier) == (kind, titles, qualifier)


def test_compared_registers_share_the_matched_only(spark):
    left = spark.createDataFrame([("Judecătoria ADJUD", 30), ("Tribunalul Cluj", 70), ("Judecătoria Nowhere", 900), (None, 5), ("...", 4)], "name string, v long")
    right = spark.createDataFrame([("JudecatoriaAdjud", 1), ("judecatoria adjud", 1), ("TRIBUNALUL SPECIALIZAT CLUJ", 0), ("Elsewhere", 7)], "name string, v long")
    out = {r.key: r for r in J.compared_registers(left, right, "name", "v", "v", {"TRIBUNALULSPECIALIZATCLUJ": "TRIBUNALULCLUJ"}).collect()}
    assert {k: r.status for k, r in out.items()} == {"JUDECATORIAADJUD": "matched", "TRIBUNALULCLUJ": "matched", "JUDECATORIANOWHERE": "left_only", "ELSEWHERE": "right_only"}
    adjud, cluj = out["JUDECATORIAADJUD"], out["TRIBUNALULCLUJ"]
    assert (adjud.left, adjud.right, adjud.ratio, adjud.left_share, adjud.right_share) == (30, 2, 15.0, 0.3, 1.0) and adjud.divergence == pytest.approx(-0.7)
    assert cluj.ratio is None and cluj.right_share == 0.0 and out["ELSEWHERE"].right_share is None
    assert J.compared_registers(left.limit(0), right.limit(0), "name", "v", "v").count() == 0


def test_priority_curve(spark):
    df = spark.createDataFrame([("a", 10, 5), ("b", 10, 10), ("c", 5, 5), ("d", 1, 0), ("e", None, 4), ("f", 9, None)], "k string, cost long, hours long")
    out = [tuple(r) for r in W.priority_curve(df, [], "k", "cost", "hours").orderBy("place").select("k", "each", "place", "cost_so_far", "benefit_so_far", "share").collect()]
    assert out == [("b", 1.0, 1, 10, 10, 0.5), ("c", 1.0, 2, 15, 15, 0.75), ("a", 2.0, 3, 25, 20, 1.0)]


def test_before_after_and_decile_spread(spark):
    df = spark.createDataFrame([(None, 4, 2), (None, 6, 6), ("x", 0, 0), ("x", None, 3), ("y", 1, 1), ("y", 2, 0), ("y", 9, 5)], "g string, b long, a long")
    out = {r.g: tuple(r)[1:] for r in A.before_after(df, ["g"], "b", "a").collect()}
    assert out == {None: (2, 10, 8, 2, 0.8, 5.0, 4.0), "x": (1, 0, 0, 0, None, 0.0, 0.0), "y": (3, 12, 6, 6, 0.5, 2.0, 1.0)}
    assert tuple(A.before_after(df, [], "b", "a").head())[:3] == (6, 22, 14)
    import statistics

    values = [3, 8, 1, 12, 5, 7, 7, 30, 2, 11]
    cuts = statistics.quantiles(values, n=10, method="exclusive")
    row = A.decile_spread(spark.createDataFrame([("g", v) for v in values] + [("small", 1), ("g", None)], "g string, v long"), ["g"], "v").collect()
    assert [tuple(r)[:2] for r in row] == [("g", 10)] and [row[0].p10, row[0].p50, row[0].p90] == pytest.approx([cuts[0], cuts[4], cuts[8]])
    assert row[0].most_to_least == 30.0


def test_shredded_elements(spark):
    xml = ["<x><key>1</key><s>a</s><p><n>u</n></p><p><n>v</n><h><d>5</d></h><h><d>6</d></h></p></x>", "<x><key>2</key><s>b</s></x>", "<x><s>keyless</s></x>", "not xml", None]
    t = T.shredded(spark.createDataFrame([(x,) for x in xml], "xml string"), "xml", "key long, s string, p array<struct<n: string, h: array<struct<d: long>>>>", ["key"], {"p": "p", "h": "p.h"}, ["s"])
    assert sorted(map(tuple, t["root"].collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, t["p"].collect())) == [(1, 0, "u"), (1, 1, "v")]
    assert sorted(map(tuple, t["h"].collect())) == [(1, 1, 0, 5), (1, 1, 1, 6)]


def test_newest_files_reads_no_others(spark):
    path = shared_path(spark, "editions")
    for county, year, n in (("a b", 2020, 1), ("a b", 2021, 2), ("c+d", 2019, 3)):
        spark.range(n).write.parquet(f"{path}/{county}-{year}")
    out = T.newest_files(spark, path, "/([a-z +]+)-([0-9]{4})/")
    assert sorted(map(tuple, out.groupBy("key", "edition").count().collect())) == [("a b", "2021", 2), ("c+d", "2019", 3)]
    assert not [f for f in out.inputFiles() if "2020" in f]
    with pytest.raises(T.EmptySource):
        T.newest_files(spark, path, "/(nothing)-([0-9]{4})/")


REPORT = "shard int, since date, complete boolean, unit string, unit_complete boolean, cases long, calls long"


def test_merged_coverage(spark):
    day = dt.date(2026, 1, 1)
    rows = [(0, day, True, "a", True, 5, 2), (0, day, True, "b", True, 1, 1), (1, day, True, "c", None, 4, 9), (1, day, True, "c", None, 4, 9)]
    out = K.merged_coverage(spark.createDataFrame(rows, REPORT), 2).head()
    assert tuple(out) == (2, 2, True, day, 3, 10, 12, 1)
    assert not K.merged_coverage(spark.createDataFrame(rows, REPORT), 3).head().complete
    assert not K.merged_coverage(spark.createDataFrame([*rows[:2], (1, day, None, "c", True, 1, 1)], REPORT), 2).head().complete
    with pytest.raises(K.MixedWindows):
        K.merged_coverage(spark.createDataFrame([*rows, (2, dt.date(2026, 2, 1), True, "d", True, 1, 1)], REPORT), 3)
    with pytest.raises(ValueError, match="no coverage"):
        K.merged_coverage(spark.createDataFrame([], REPORT), 1)


def test_gate_and_limitations(spark):
    df = spark.createDataFrame([(1, "official"), (2, "assumed")], "id long, basis string")
    sound = {"basis": (F.col("basis") != "assumed", False), "id": (F.col("id") > 0, True)}
    assert K.gate(df, "id long, basis string", sound).count() == 2
    with pytest.raises(ValueError, match=r"refused: basis \(1 rows\)"):
        K.gate(df, "id long, basis string", {"basis": (F.col("basis") != "assumed", True)})
    with pytest.raises(ValueError, match="extra"):
        K.gate(df.withColumn("extra", F.lit(1)), "id long, basis string", {})
    with pytest.raises(ValueError, match="id"):
        K.gate(df, "id int, basis string", {})
    out = K.with_limitations(df, [("m", "*", "t"), ("b", "basis", "u"), ("z", "absent", "v")]).head()
    assert [tuple(x) for x in out.limitations] == [("m", "*", "t"), ("b", "basis", "u")]
    assert K.with_limitations(df, []).head().limitations == []


def test_upserts_of_a_replayed_batch_agree_with_the_batch(spark):
    path, key, order = shared_path(spark, "log"), ["k"], ["t", "v"]
    rows = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, None), ("a", 2, "z"), ("b", 2, "w"), ("c", None, "q")]
    df = spark.createDataFrame(rows, "k string, t long, v string")
    write = E.upsert(path, key, order)
    for number, (lo, hi) in enumerate(((0, 2), (2, 4), (4, 6))):
        write(spark.createDataFrame(rows[lo:hi], df.schema), number)
    write(spark.createDataFrame(rows[2:4], df.schema), 1)  # again
    out = sorted(map(tuple, E.upserted(spark, path, key, order).collect()), key=repr)
    assert out == sorted(map(tuple, J.keep_last(df, key, order).collect()), key=repr)
    assert spark.read.parquet(path).count() == 5


def test_snapshots_are_applied_in_place(spark):
    path = shared_path(spark, "mart")
    schema = "unit long, year int, people long, amount long, per_person double, taken date"
    mart = [(1, 2020, 10, 0, None, None), (2, 2020, 0, 0, None, None), (1, 2021, 10, 7, 0.7, dt.date(2021, 6, 30))]
    spark.createDataFrame(mart, schema).write.partitionBy("year").parquet(path)
    write = E.apply_snapshots(path, "unit", "amount", "people")
    june, december = dt.date(2020, 6, 30), dt.date(2020, 12, 31)
    take = lambda rows: spark.createDataFrame(rows, "unit long, year int, taken date, amount long")

    def now():
        return {(r.unit, r.year): (r.amount, r.per_person, r.taken) for r in spark.read.schema(schema).parquet(path).collect()}

    kept = {(1, 2021): (7, 0.7, dt.date(2021, 6, 30))}
    write(take([(1, 2020, june, 50), (1, 2020, june, 50), (2, 2020, june, 9), (99, 2020, june, 1), (5, None, june, 1)]), 0)
    assert now() == kept | {(1, 2020): (100, 10.0, june), (2, 2020): (9, None, june)}
    write(take([(2, 2020, december, 3)]), 1)
    assert now() == kept | {(1, 2020): (0, 0.0, december), (2, 2020): (3, None, december)}
    write(take([(1, 2020, june, 50)]), 0)  # again, and too old
    write(take([]), 2)
    assert now() == kept | {(1, 2020): (0, 0.0, december), (2, 2020): (3, None, december)}


def test_seen_set_of_a_stream(spark):
    path = shared_path(spark, "seen")
    rows = [("a", 1, dt.datetime(2026, 1, 1)), ("a", 1, dt.datetime(2026, 1, 2)), ("b", 1, dt.datetime(2026, 1, 1)), ("a", 1, dt.datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "court string, number long, ts timestamp")
    df.repartition(3).write.parquet(path)
    out = shared_path(spark, "first")
    stream = E.first_seen(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), ["court", "number"], "ts", "900 days")
    stream.writeStream.format("parquet").option("checkpointLocation", shared_path(spark, "progress")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.court, r.number) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1)] == sorted((r.court, r.number) for r in E.first_seen(df, ["court", "number"], "ts", "1 day").collect())


def test_bands_breaks_and_collapsed_matches(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 15.0), ("a", 99.0), ("a", -1.0), ("a", None), ("b", None)], "g string, v double")
    bands = [tuple(r) for r in A.band_shares(df, ["g"], "v", [0, 10, 20]).orderBy("g", "band").collect()]
    assert bands == [("a", 0, 1, pytest.approx(1 / 3), pytest.approx(1 / 3)), ("a", 1, 1, pytest.approx(1 / 3), pytest.approx(2 / 3)), ("a", 2, 1, pytest.approx(1 / 3), 1.0)]
    assert [tuple(r) for r in A.colour_breaks(df, ["g"], "v").collect()] == [("a", 3, 10.0, 15.0, 57.0)]
    rows = spark.createDataFrame([(1, 9.0, 5, 100), (1, 2.0, 6, 50), (1, 2.0, 4, None), (2, None, 3, None)], "id long, d double, length long, aadt long")
    assert sorted(map(tuple, A.collapsed(rows, ["id"], ["d", "length"], ["length"], ["aadt"]).collect())) == [(1, 4, 100, 3), (2, 3, None, 1)]


def test_rates_are_pinned_or_of_the_day(spark):
    from polis.functions import numbers as N

    rows = spark.createDataFrame([(1, "EUR", 5), (2, "EUR", 1), (3, "USD", 5), (4, None, 5), (5, "EUR", None)], "id long, c string, day long")
    rates = spark.createDataFrame([("EUR", 2, 4.0), ("EUR", 2, 5.0), ("EUR", 6, 6.0), ("USD", 1, 9.0), (None, 1, 1.0)], "currency string, quoted long, rate double")
    out = {r.id: (r.rate, r.rate_source) for r in J.with_rates(rows, rates, "c", "day", {"USD": 3.5}).collect()}
    assert out == {1: (5.0, "live"), 2: (None, None), 3: (3.5, "pinned"), 4: (None, None), 5: (None, None)}
    row = spark.range(1).select(N.square_metres(F.lit(1.5)).alias("m"), N.exchanged(F.lit(10.0), F.lit(4.0)).alias("e"), N.exchanged(F.lit(10.0), F.lit(0.0)).alias("z")).head()
    assert tuple(row) == (15_000.0, 2.5, None)
