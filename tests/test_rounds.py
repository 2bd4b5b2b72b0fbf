"""Steps whose cost must not grow faster than the tables."""

import random

from pyspark.sql import functions as F

from polis.functions import numbers as N
from polis.functions import places as P
from polis.operators import assignment as AS
from polis.operators import graph as G
from polis.operators import joins as J
from polis.operators import matching as T
from polis.operators import models as M
from polis.operators import windows as W
from polis.operators.graph import _cut

from test_assignment import walk


def planned(df):
    """The size in bytes that Spark expects of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_rounds_that_join_a_table_with_itself_keep_its_size(spark):  # F1
    way = _cut(spark.range(100).select("id", ((F.col("id") + 1) % 100).alias("to")))
    for _ in range(5):
        way = _cut(way.join(way.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")))
    assert planned(way) < 1e6 and way.filter("to = (id + 32) % 100").count() == 100


def test_matched_sets_are_those_of_the_walk_over_all_pairs(spark):  # F2
    rng = random.Random(5)
    kinds = [list(map(str, rng.sample(range(9), rng.choice([3, 4, 5])))) for _ in range(12)]
    side = lambda n, seed: [(k, random.Random(seed + k).choice(kinds)) for k in range(n)]
    a, b = (spark.createDataFrame(side(n, seed) + [(900, None), (901, [])], f"{c} long, tokens array<string>") for c, n, seed in (("a", 60, 0), ("b", 50, 1000)))
    left, right, want = set(), set(), []
    pairs = [(-len(set(s) & set(t)) / min(len(s), len(t)), x, y) for x, s in side(60, 0) for y, t in side(50, 1000) if len(set(s) & set(t)) >= 0.6 * min(len(s), len(t))]
    for score, x, y in sorted(pairs):
        if x not in left and y not in right:
            left.add(x), right.add(y), want.append((x, y, -score))
    assert sorted(map(tuple, T.greedy_sets(a, b, "a", "b", "tokens", 0.6).collect())) == sorted(want)
    assert T.greedy_sets(a.limit(0), b, "a", "b", "tokens", 0.6).count() == 0


def test_copies_are_compared_as_one_set(spark, monkeypatch):  # F2
    met = []
    monkeypatch.setattr(T, "token_overlap", lambda *args: met.append(J.token_overlap(*args)) or met[-1])
    copies = lambda c: spark.range(300).select(F.col("id").alias(c), F.array(F.lit("x"), F.lit("y")).alias("tokens"))
    out = T.greedy_sets(copies("a"), copies("b"), "a", "b", "tokens", 0.7)
    assert out.filter("a = b AND score = 1").count() == 300 and met[0].count() == 1


def test_keys_of_a_profile_meet_the_options_once(spark):  # F3
    keys = [(k, k % 2, size) for k, size in [(1, 5), (2, 5), (3, 5), (4, None), (5, 9), (5, 9), (7, 3)]]
    options = [(1, 10), (1, 11), (1, 6), (0, 4)]
    cost = F.abs(F.col("size") - F.col("o") % 10)
    keys, options = spark.createDataFrame(keys, "k long, g int, size int"), spark.createDataFrame(options, "g int, o long")
    out = W.shared_regret(keys, options, "k", "g", "size", "o", cost)
    want = W.regret(keys.join(options, "g").withColumn("c", cost), "k", "o", "c")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and want.count() == 6
    assert spark.createDataFrame([(k, 0, 1) for k in range(1000)], "k long, g int, size int").transform(lambda df: W.shared_regret(df, options, "k", "g", "size", "o", cost)).count() == 1000


def test_places_compared_once_for_all_their_points(spark):  # F4
    rng = random.Random(3)
    places = [(rng.uniform(-45, 45), rng.choice([-179.9, 179.9, 0.0]) + rng.random()) for _ in range(30)]
    rows = [(k, *places[0 if k < 60 else rng.randrange(30)]) for k in range(120)] + [(500, None, 1.0), (None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    pair = points.alias("p").join(points.alias("q"), F.expr("p.id < q.id")).withColumn("metres", F.round(N.haversine_m(*[F.col(c) for c in ("p.lat", "p.lon", "q.lat", "q.lon")]), 3))
    want = pair.filter("metres <= 500000").select("p.id", "q.id", "metres")
    out = P.great_circle_pairs(points, 500_000, block=7)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() > 60 * 59 / 2


def test_levels_of_a_tree_are_not_sent_through_the_driver(spark, monkeypatch):  # F9
    plans = []
    monkeypatch.setattr(M, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or _cut(df))
    out = M.parent_chains(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (8, 9), (9, 8)], "node long, parent long")).collect()
    assert sorted(map(tuple, out)) == [(1, "1", 0), (2, "1>2", 1), (3, "1>2>3", 2), (4, "1>4", 1)]
    assert not any("Broadcast" in p for p in plans)


def test_rounds_carry_only_the_options_asked_for(spark, monkeypatch):  # F5
    kept = []
    monkeypatch.setattr(AS, "_cut", lambda df: kept.append(_cut(df)) or kept[-1])
    # 200 items of 40 options each; a second one is asked for by those whose first site is full, and the crowd of site 0 by many more.
    rows = [(i, s, 100 + (s * 7 + i) % 50 if s else (1 if i % 10 == 0 else 500), 1) for i in range(200) for s in range(40)]
    out = {r.item: (r.site, r.cost) for r in AS.assign_under_ceiling(spark.createDataFrame(rows, "item long, site long, cost long, weight long"), 6.0).collect()}
    assert out == walk(rows, 6.0) and len({s for s, _ in out.values()}) > 30
    sizes = [df.count() for df in kept]
    assert sizes[0] == 8000 and max(sizes[1:]) < 2000


def test_rounds_move_only_nodes_that_became_cheaper(spark, monkeypatch):  # F7
    rows = []
    monkeypatch.setattr(G, "_cut", lambda df, *to: rows.append(_cut(df, *to)) or rows[-1])
    # A crowd of 500 around the first source, which is settled at once, and a line of 12 from it.
    edges = [(0, k, 1) for k in range(1, 501)] + [(k, k + 1, 2) for k in range(1000, 1012)] + [(0, 1000, 1), (1012, 2000, 2)]
    out = G.nearest_source(spark.createDataFrame(edges, "a long, b long, cost long"), spark.createDataFrame([(0, 0), (2000, 5), (1005, 30)], "node long, cost long"), runs=100)
    found = {r.node: (r.source, r.cost, r.parent) for r in out.collect()}
    line = {k: (0, 1 + 2 * (k - 1000), k - 1 if k > 1000 else 0) if 1 + 2 * (k - 1000) <= 5 + 2 * (1013 - k) else (2000, 5 + 2 * (1013 - k), k + 1 if k < 1012 else 2000) for k in range(1000, 1013)}
    assert found == {0: (0, 0, None), 2000: (2000, 5, None)} | {k: (0, 1, 0) for k in range(1, 501)} | line
    assert sum(df.count() for df in rows) < 6 * 1028  # its 1,028 steps and a few rows for each node, not all nodes each round


def test_nearest_sources_are_those_of_the_walk(spark):  # F7
    rng = random.Random(7)
    edges = [(a, rng.randrange(60), rng.choice([1, 1, 2, 5, 9])) for a in range(60) for _ in range(2)]
    sources = {k: rng.choice([0, 0, 3, 20]) for k in (3, 17, 29, 41)}
    best = {k: (c, k) for k, c in sources.items()}
    both = [(a, b, c) for a, b, c in edges if a != b] + [(b, a, c) for a, b, c in edges if a != b]
    for _ in range(60):
        for a, b, c in both:
            if a in best and (best[a][0] + c, best[a][1]) < best.get(b, (1 << 60, 0)):
                best[b] = (best[a][0] + c, best[a][1])
    own = {k for k, c in sources.items() if best[k] == (c, k)}
    want = {k: (s, c, None if k in own else min(a for a, b, w in both if b == k and a in best and (best[a][0] + w, best[a][1]) == (c, s))) for k, (c, s) in best.items()}
    out = G.nearest_source(spark.createDataFrame(edges, "a long, b long, cost long"), spark.createDataFrame(list(sources.items()), "node long, cost long"), runs=2)
    assert {r.node: (r.source, r.cost, r.parent) for r in out.collect()} == want


def test_neighbours_are_sought_in_tasks_of_so_many_rows(spark, monkeypatch):  # F8
    plans = []
    monkeypatch.setattr(G, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or _cut(df))
    rng = random.Random(8)
    rows = [(k, float(rng.randrange(200)), float(rng.randrange(200))) for k in range(300)] + [(900, 5000.0, 5000.0), (901, None, 1.0), (None, 1.0, 1.0)]
    out = P.clark_evans(spark.createDataFrame(rows, "id long, x double, y double"), 40_000.0, 10.0, rows=100).head()
    points = [r for r in rows if None not in r]
    ways = [min(((x - p) ** 2 + (y - q) ** 2) ** 0.5 for j, p, q in points if j != k) for k, x, y in points]
    assert out.n == 301 and abs(out["mean"] - sum(ways) / 301) < 1e-9
    assert not any("Broadcast" in p for p in plans)
    assert any("SortMergeJoin [__cx" in p and "hashpartitioning(__cx" in p and ", 31), REPARTITION_BY_NUM" in p for p in plans)


def greedy_walk(a, b, least):
    """The matches of a walk down all pairs of two lists (id, tokens)."""
    left, right, out = set(), set(), []
    pairs = [(-len(set(s) & set(t)) / min(len(s), len(t)), x, y) for x, s in a for y, t in b if len(set(s) & set(t)) >= least * min(len(s), len(t))]
    for score, x, y in sorted(pairs):
        if x not in left and y not in right:
            left.add(x), right.add(y), out.append((x, y, -score))
    return sorted(out)


def test_interleaved_copies_are_matched_in_few_rounds(spark, monkeypatch):  # round 4, F1
    kept = []
    monkeypatch.setattr(T, "_cut", lambda df: kept.append(_cut(df)) or kept[-1])
    # 70 copies of one set tie with two kinds of sets that take turns, and each of these with a set of its own.
    a = [(k, ["p", "q", "r", "x"]) for k in range(70)] + [(1000 + k, ["p", "q", "s", "u" if k % 3 else "v"]) for k in range(40)]
    b = [(k, ["p", "q", "s", "u"] if k % 2 else ["p", "q", "r", "y"]) for k in range(90)] + [(500 + k, ["p", "r", "x", "z"]) for k in range(9)]
    sides = [spark.createDataFrame(rows, f"{c} long, tokens array<string>") for c, rows in (("a", a), ("b", b))]
    assert sorted(map(tuple, T.greedy_sets(*sides, "a", "b", "tokens", 0.72).collect())) == greedy_walk(a, b, 0.72)
    assert sorted(map(tuple, T.greedy_sets(*sides, "a", "b", "tokens", 0.5).collect())) == greedy_walk(a, b, 0.5)
    assert len(kept) < 60


def test_walked_components_and_rounds_match_alike(spark):  # round 4, F1
    rng = random.Random(11)
    kinds = [[str(t) for t in rng.sample(range(12), rng.choice([3, 4, 5, 6, 10]))] for _ in range(40)]
    # The ids are strings on the left, and beyond 2**53 on the right.
    a = [(f"{k * 7919 % 1000:03}", rng.choice(kinds)) for k in range(90)]
    b = [(2**60 + k, rng.choice(kinds)) for k in range(80)]
    sides = spark.createDataFrame(a, "a string, tokens array<string>"), spark.createDataFrame(b, "b long, tokens array<string>")
    want = greedy_walk(a, b, 0.72)
    for most in (2, 30, 1_000_000):
        assert sorted(map(tuple, T.greedy_sets(*sides, "a", "b", "tokens", 0.72, most).collect())) == want


def test_small_sets_meet_on_several_tokens_at_once(spark):  # round 4, F1
    rng = random.Random(4)
    rows = lambda: [(k, [f"{name}{rng.randrange(n)}" for name, n in (("s", 50), ("p", 40), ("b", 10), ("t", 3), ("n", 4), ("m", 2))]) for k in range(400)]
    a, b = rows(), rows()
    left, right = spark.createDataFrame(a, "a long, w array<string>"), spark.createDataFrame(b, "b long, w array<string>")
    want = {(x, y) for x, s in a for y, t in b if len(set(s) & set(t)) >= 5}
    assert {(r.a, r.b) for r in J.token_overlap(left, right, "a", "b", "w", 0.72).collect()} == want
    # On one of the two rarest tokens of a set of six, 7,079 pairs meet.
    met = J.met_on_tokens(left, right, "a", "b", "w", 0.72)
    assert want <= {(r.a, r.b) for r in met.collect()} and met.count() < 800


def test_sets_of_all_sizes_meet(spark):  # round 4, F1
    rng = random.Random(6)
    side = lambda n: [(k, rng.sample([*"abcdefghijkl", None], rng.randrange(13))) for k in range(n)]
    a, b = side(60), side(50)
    left, right = spark.createDataFrame(a, "a long, w array<string>"), spark.createDataFrame(b, "b long, w array<string>")
    for least in (0.3, 0.6, 0.72, 0.9):
        share = lambda s, t: len(set(s) & set(t)) / min(len(s), len(t))
        want = {(x, y) for x, s in a for y, t in b if s and t and set(s) & set(t) - {None} and share(s, t) >= least}
        for common_most in (3, 1000):
            assert {(r.a, r.b) for r in J.token_overlap(left, right, "a", "b", "w", least, common_most).collect()} == want
