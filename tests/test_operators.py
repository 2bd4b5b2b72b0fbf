"""Operators on small fixtures whose results are worked out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from polis.functions import numbers as N
from polis.functions import places as P
from polis.functions import text as X
from polis.operators import aggregates as A
from polis.operators import graph as G
from polis.operators import joins as J
from polis.operators import matching as MT
from polis.operators import models as M
from polis.operators import ranges as R
from polis.operators import windows as W
from polis.sources import sinks, tables
from polis.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("a", None)], "k string, v double")
    row = A.quantiles(df, ["k"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).head()
    assert (row.n, row.p25, row.p50, row.p75) == (4, 1.75, 2.5, 3.25)


def test_histogram_has_empty_bins_and_an_open_last(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 6, 7, 13, 14, 27, 28, 900)], "k string, v double")
    assert [r.n for r in A.histogram(df, ["k"], "v", [0, 7, 14, 28]).orderBy("bin").collect()] == [2, 2, 2, 2]
    low = spark.createDataFrame([("a", -1.0), ("a", -30.0), ("a", 3.0)], "k string, v double")
    assert [r.n for r in A.histogram(low, ["k"], "v", [0, 7, 14, 28]).orderBy("bin").collect()] == [1, 0, 0, 0]


def test_mode_ties_to_the_smaller(spark):
    df = spark.createDataFrame([("a", v) for v in "yxyxz"] + [("a", None)], "k string, v string")
    row = A.mode(df, ["k"], "v").head()
    assert (row["mode"], row["n"]) == ("x", 2)


def test_strict_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    assert {r.k: r.s for r in df.groupBy("k").agg(A.strict_sum(F.col("v")).alias("s")).collect()} == {"a": None, "b": 2}


def test_as_of_falls_back_to_null_and_takes_the_last_of_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, 1, "old"), (1, 5, 2, "new"), (1, 6, 3, "late")], "k int, t int, o int, v string")
    out = {(r.k, r.t): r.v for r in J.as_of(left, right, "k", "t", "t", "o", ["v"]).collect()}
    assert out == {(1, 5): "new", (1, 1): None, (2, 9): None}


def test_keep_last_and_reconcile(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in J.keep_last(df, ["k"], ["t"]).collect()) == [("a", "y"), ("b", None)]
    out = J.reconcile(df.select("k"), spark.createDataFrame([("b",), ("c",)], "k string"), "k")
    assert sorted(map(tuple, out.collect())) == [("a", True, False), ("b", True, True), ("c", False, True)]


@pytest.mark.parametrize("least", [0.1, 0.5, 0.75, 1.0])
def test_token_overlap_has_pairs_of_frequent_tokens(spark, least):
    rows = [(k, [f"t{(k * j) % (1 + 7 * j)}" for j in range(k % 9)] + ["every"] * (k % 3) + [None] * (k % 11 == 1)) for k in range(60)]
    left = spark.createDataFrame(rows, "a int, w array<string>")
    got = {(r.a, r.b): r.score for r in J.token_overlap(left, left.withColumnRenamed("a", "b"), "a", "b", "w", least, 3).collect()}
    sets, want = {k: set(w) for k, w in rows}, {}
    for x in sets:
        for y in sets:
            if sets[x] & sets[y] - {None} and len(sets[x] & sets[y]) / min(len(sets[x]), len(sets[y])) >= least:
                want[x, y] = len(sets[x] & sets[y]) / min(len(sets[x]), len(sets[y]))
    assert got == pytest.approx(want)


def test_token_overlap_past_the_number_of_a_common_token(spark):
    rows = spark.range(1001).select(F.col("id").alias("a"), F.when(F.col("id") < 2, F.array(F.lit("every"))).otherwise(F.array(F.lit("every"), *[F.concat(F.lit(f"{j}x"), "id") for j in range(4)])).alias("w"))
    out = J.token_overlap(rows, rows.withColumnRenamed("a", "b"), "a", "b", "w", 0.5)
    assert out.filter("a <> b").count() == 2 * 999 * 2 + 2


def test_ledger_and_cut_points(spark):
    df = spark.createDataFrame([("p", 1, 10, True), ("p", 2, 5, True), ("p", 3, 12, False)], "p string, k int, v long, cut boolean")
    assert sorted(map(tuple, W.fifo_ledger(df, "p", ["k"], "k", "v", "cut").collect())) == [("p", 3, 1, 10), ("p", 3, 2, 2)]
    points = spark.createDataFrame([("g", k, v) for k, v in ((1, 50), (2, 30), (3, 20))], "g string, k int, v int")
    assert {r.mark: r.keys for r in W.cut_points(points, "g", "k", "v", [0.5, 0.75, 1.0]).collect()} == {0.5: 1, 0.75: 2, 1.0: 3}


def test_compound_rounds_down_at_every_step(spark):
    df = spark.createDataFrame([("a", 1, 0.015), ("a", 2, 0.015)], "k string, o int, r double")
    assert W.compound(df, "k", ["o"], 101.0, "r").head().amount == 103.0


def test_survival_ends_at_zero(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", -1, True)], "k string, t int, e boolean")
    out = {r.time: r.survival for r in M.kaplan_meier(df, ["k"], "t", "e").collect()}
    assert out[1] == pytest.approx(2 / 3) and out[2] == pytest.approx(2 / 3) and out[3] == 0.0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 10), (2, 3, 50), (4, 4, 1)], "a long, b long, cost long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "node long")
    assert {r.node: r.component for r in G.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    tree = G.nearest_source(edges, spark.createDataFrame([(1, 0)], "node long, cost long"))
    assert {r.node: (r.cost, r.parent) for r in tree.collect()} == {1: (0, None), 2: (10, 1), 3: (20, 2)}
    assert {r.leaf: (r.hops, r.cost) for r in G.route_cost(tree, spark.createDataFrame([(3,)], "node long")).collect()} == {3: (2, 20)}
    assert {r.node: r.degree for r in G.degrees(edges, nodes).collect()} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0}


def test_text(spark):
    assert one(spark, X.fold(F.lit(" Ștefan cel Mare "))) == "STEFAN CEL MARE"
    assert one(spark, X.strip_code(F.lit("00123.0"))) == "123"
    assert one(spark, X.strip_suffix(F.lit("12/3/2020/a1"))) == "12/3/2020"
    assert one(spark, X.significant_tokens(F.lit("La Școala din Sat, Școala"), 4)) == ["SCOALA"]
    assert one(spark, X.first_prefix(F.lit("ab1"), [("ab", "x"), ("a", "y")])) == "x"


def test_numbers(spark):
    assert one(spark, N.locale_number(F.lit("1.234,5"))) == 1234.5
    assert one(spark, N.locale_number(F.lit("-"))) == 0.0 and one(spark, N.locale_number(F.lit(" "))) is None
    assert one(spark, N.step_round(F.lit(1024590.0), 100, "ceil")) == 1024600
    assert one(spark, N.step_round(F.lit(33018718.5), 100, "halfUp")) == 33018700
    assert [one(spark, N.step_round(F.lit(v), 1, "halfEven")) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, N.clock_minutes(F.lit("07.35"))) == 455
    assert one(spark, N.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111194.9, abs=1)


def test_sources_refuse_nothing(spark, tmp_path):
    (tmp_path / "t").mkdir()
    pd.DataFrame({"k": [1], "v": ["a"]}).to_parquet(tmp_path / "t" / "x-1.parquet")
    assert tables.shards(spark, str(tmp_path / "t"), "x", required=["k"]).count() == 1
    with pytest.raises(tables.EmptySource):
        tables.shards(spark, str(tmp_path / "t"), "x", required=["missing"])
    (tmp_path / "a.csv").write_text("k;v\n 1 ; \n")
    assert tables.delimited(spark, str(tmp_path / "a.csv"), ["k"], ";").collect()[0] == ("1", None)
    (tmp_path / "d.json").write_text('{"county": "X", "rows": [{"n": 1}, {"n": 2}]}')
    assert tables.documents(spark, str(tmp_path / "d.json"), "county string, rows array<struct<n:int>>", "rows").count() == 2
    cube = spark.createDataFrame([([1.0, None, 3.0, 4.0],)], "v array<double>")
    assert sorted(map(tuple, tables.hypercube(cube, [("r", 2), ("c", 2)], "v").collect())) == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    tags = spark.createDataFrame([('"ref"=>"DN1","maxspeed"=>"50"',)], "t string")
    assert tags.select(tables.key_values("t").alias("m")).head().m == {"ref": "DN1", "maxspeed": "50"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "k string, v int")
    coded, values = sinks.interned(df, "k")
    assert {r.v: r.k for r in coded.collect()} == {1: 1, 2: 0, 3: None} and values.count() == 2
    assert sinks.check_report(df, {"has key": F.col("k").isNotNull(), "positive": F.col("v") > 0}).collect() == [("has key", 3, 1), ("positive", 3, 0)]
    sinks.parquet(df, str(tmp_path / "mart"), ["v"])
    assert spark.read.parquet(str(tmp_path / "mart")).count() == 3


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    events = tables.table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = E.tumbling(stream, "ts", "1 day", ["event_type"], "value", late="1 day")
    run = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    key = ["window_start", "event_type", "n"]
    got = sorted(map(tuple, spark.table("tumbled").select(key).collect()))
    assert got == sorted(map(tuple, E.tumbling(events, "ts", "1 day", ["event_type"], "value").select(key).collect()))


def test_as_of_matches_no_nulls(spark):
    left = spark.createDataFrame([(None, 1), (1, None), (1, 5)], "k int, t int")
    right = spark.createDataFrame([(None, 0, 1, "a"), (1, None, 2, "b"), (1, 5, 3, "c")], "k int, t int, o int, v string")
    assert {(r.k, r.t): r.v for r in J.as_of(left, right, "k", "t", "t", "o", ["v"]).collect()} == {(None, 1): None, (1, None): None, (1, 5): "c"}


def test_longest_contained_takes_names_of_any_length(spark):
    texts = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", None), (3, "b c", "x"), (4, None, "x"), (5, "", None)]
    names = spark.createDataFrame([("b c d e",), ("b c",), ("c d",), ("zz",), (None,)], "n string")
    out = MT.longest_contained(spark.createDataFrame(texts, "id int, t string, o string"), names, "t", "n")
    assert sorted((r.id, r.n) for r in out.filter("n IS NOT NULL").collect()) == [(1, "b c d e"), (1, "b c d e"), (2, "b c d e"), (3, "b c")]
    assert out.count() == 6
    assert MT.longest_contained(out.drop("n"), names.limit(0), "t", "n").filter("n IS NULL").count() == 6


def test_dispersion_counts_isolated_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 3.0), (3, 100.0, 0.0), (4, None, 1.0)], "id int, x double, y double")
    row = P.clark_evans(points, 10_000.0, 1.0).head()
    assert (row.n, row["mean"]) == (3, pytest.approx((3 + 3 + 100) / 3)) and row.dispersion == pytest.approx(row["mean"] / (0.5 * (10_000 / 3) ** 0.5))
    assert tuple(P.clark_evans(points.limit(1), 1.0, 1.0).head())[:2] == (1, None) and P.clark_evans(points.limit(0), 1.0, 1.0).head().n == 0


def test_clock_texts_that_are_no_times_are_null(spark):
    df = spark.createDataFrame([("08:30",), ("7.05 h",), ("closed",), ("",), (None,)], "t string")
    assert [r.m for r in df.select(N.clock_minutes(F.col("t")).alias("m")).collect()] == [510, 425, None, None, None]


@pytest.mark.parametrize("hot", [0.0, 0.95])
def test_placed_ranks_and_sums_hot_groups(spark, hot):
    import random

    rng = random.Random(7)
    rows = [(None if rng.random() < 0.05 else "h" if rng.random() < hot else rng.choice("ab"), rng.randint(0, 20), k, rng.randint(1, 9)) for k in range(400)]
    out = R.placed(spark.createDataFrame(rows, "g string, v int, id int, w int").repartition(7), ["g"], [F.desc("v"), F.col("id")], {"w": "run"}).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        before = [sum(r[3] for r in own[:k]) for k in range(len(own))]
        got = {r.id: (r.place, r.run, r.run_all, r.rows) for r in out if r.g == g}
        assert got == {r[2]: (k + 1, before[k], sum(x[3] for x in own), len(own)) for k, r in enumerate(own)}
    assert [r.place for r in R.placed(spark.createDataFrame([("b",), ("a",)], "v string"), [], [F.col("v")]).orderBy("v").collect()] == [1, 2]
    assert R.placed(spark.createDataFrame([], "v string"), [], [F.col("v")]).count() == 0


def test_regret_and_one_option(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 1, 4)], "k string, o int, c int")
    assert sorted(map(tuple, W.regret(df, "k", "o", "c").collect())) == [("a", 1, 0), ("b", 1, None)]


def test_route_cost_ends_on_cycles(spark):
    tree = spark.createDataFrame([(1, None, 0), (2, 1, 4), (3, 2, 9), (4, 5, 1), (5, 4, 1), (6, 5, 1)], "node long, parent long, cost long")
    out = G.route_cost(tree, spark.createDataFrame([(3,), (1,), (6,)], "node long"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0), (3, 2, 9)]


def test_grids_of_long_code_lists_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 5)], "r string, c long, v long")
    rows, columns = df.select("r"), spark.range(3).withColumnRenamed("id", "c")
    assert sorted(map(tuple, J.complete_grid(df, rows, columns, ["r", "c"]).collect()), key=repr) == [("a", 0, None), ("a", 1, 5), ("a", 2, None)]
    with pytest.raises(ValueError, match="more than 2"):
        J.complete_grid(df, rows, columns, ["r", "c"], most=2)
