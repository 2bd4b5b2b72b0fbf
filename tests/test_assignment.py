"""Assignments under a ceiling, shards and hub routes against plain sequential walks."""

import heapq
import random

import pytest

from polis.operators import assignment as AS
from polis.operators import routes as RT

OPTION = "item long, site long, cost long, weight long"


def walk(options, ceiling, loads=()):
    by = {}
    for item, site, cost, weight in options:
        if None not in (item, site, cost):
            by.setdefault(item, {})[site] = (cost, weight or 0)
    load, out = dict(loads), {}
    ranked = {k: sorted((c, s) for s, (c, _) in v.items()) for k, v in by.items()}
    for item in sorted(by, key=lambda k: (-(ranked[k][1][0] - ranked[k][0][0] if len(ranked[k]) > 1 else 0), k)):
        w = next(iter(by[item].values()))[1]
        cost, site = next(((c, s) for c, s in ranked[item] if load.get(s, 0) + w <= ceiling), ranked[item][0])
        load[site] = load.get(site, 0) + w
        out[item] = (site, cost)
    return out


def options(seed, items, sites, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(items):
        w = rng.choice([1, 1, 2, 3, 10])
        for s in rng.sample(range(sites), rng.randint(1, sites)):
            rows.append((i, s, 0 if s == 0 and rng.random() < hot else rng.randint(1, 50), w))
    return rows


@pytest.mark.parametrize("seed, tight, hot", [(1, 1.05, 0.0), (2, 1.3, 0.0), (3, 0.7, 0.0), (4, 1.1, 0.9), (5, 1e9, 0.0)])
def test_assignment_is_the_sorted_walk(spark, seed, tight, hot):
    rows = options(seed, 120, 6, hot)
    ceiling = tight * sum({r[0]: r[3] for r in rows}.values()) / 6
    out = {r.item: (r.site, r.cost) for r in AS.assign_under_ceiling(spark.createDataFrame(rows, OPTION), ceiling).collect()}
    assert out == walk(rows, ceiling)
    if tight > 1e6:  # no ceiling moves nobody
        assert all(c == min(r[2] for r in rows if r[0] == i) for i, (_, c) in out.items())


def test_assignment_edges(spark):
    rows = [(1, 1, 5, 2), (1, 1, 5, 2), (1, 2, 6, 2), (2, 1, 1, 2), (None, 1, 1, 1), (3, None, 1, 1), (4, 1, None, 1), (5, 2, 1, None)]
    df = spark.createDataFrame(rows, OPTION)
    loads = spark.createDataFrame([(1, 3), (1, 1), (None, 9)], "site long, load long")
    out = {r.item: (r.site, r.cost) for r in AS.assign_under_ceiling(df, 4, loads).collect()}
    assert out == walk(rows, 4, {1: 4}) == {1: (2, 6), 2: (1, 1), 5: (2, 1)}
    assert AS.assign_under_ceiling(df.limit(0), 4).count() == 0


def shards_walk(items, shards):
    known = sorted(w for _, w in items if w and w > 0)
    middle = known[len(known) // 2] if known else 1
    weigh = lambda w: w if w and w > 0 else middle
    totals, out = [0] * shards, {}
    for item, w in sorted(items, key=lambda r: (-weigh(r[1]), r[0] is None, r[0] or 0)):
        s = min(range(shards), key=lambda k: (totals[k], k))
        totals[s] += weigh(w)
        out[item] = s
    return out


@pytest.mark.parametrize("seed, shards", [(1, 1), (2, 3), (3, 12)])
def test_shards_are_the_greedy_walk(spark, seed, shards):
    rng = random.Random(seed)
    items = [(k, rng.choice([None, 0, -3, 1, 1, 1, 7, 40, rng.randint(1, 900)])) for k in range(300)] + [(None, 5)]
    df = spark.createDataFrame(items, "item long, weight long")
    placed = AS.shards_by_weight(df, shards)
    assert {r.item: r.shard for r in placed.collect()} == shards_walk(items, shards)
    assert shards == 1 or AS.imbalance(placed).collect()[0].spread < 1.2


def test_shards_with_more_weights_than_levels(spark):
    rng = random.Random(9)
    items = [(k, rng.randint(1, 10**9)) for k in range(400)]
    placed = AS.shards_by_weight(spark.createDataFrame(items, "item long, weight long"), 4, levels=60)
    assert placed.count() == 400 and AS.imbalance(placed).collect()[0].spread < 1.2
    assert {r.item: r.weight for r in placed.collect()} == dict(items)
    none = spark.createDataFrame([(1, None), (2, None)], "item long, weight long")
    assert {r.item: r.shard for r in AS.shards_by_weight(none, 2).collect()} == {1: 0, 2: 1}
    assert AS.shards_by_weight(none.limit(0), 2).count() == 0


# --- Routes -----------------------------------------------------------------------------------------------------------------


def tree_walk(edges, hub):
    near = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    cost, queue = {hub: 0}, [(0, hub)]
    while queue:
        so_far, here = heapq.heappop(queue)
        if so_far > cost[here]:
            continue
        for to, c in near.get(here, ()):
            if so_far + c < cost.get(to, 1 << 60):
                cost[to] = so_far + c
                heapq.heappush(queue, (so_far + c, to))
    parent = {n: min(((cost[a], a) for a, c in near[n] if a in cost and cost[a] + c == cost[n]), default=(0, None))[1] if n != hub else None for n in cost}
    return cost, parent


def test_trees_and_routes_match_a_walk(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 59), rng.randint(0, 59), rng.randint(1, 9)) for _ in range(90)]
    edges = [(a, b, c) for a, b, c in edges if a != b and 25 not in (a, b)]
    df = spark.createDataFrame(edges + [(None, 1, 1)], "a long, b long, cost long")
    hubs = [0, 7, 31]
    trees = RT.hub_trees(df, spark.createDataFrame([(h,) for h in [*hubs, 0]], "hub long")).collect()
    want = {(h, n): (c, tree_walk(edges, h)[1][n]) for h in hubs for n, c in tree_walk(edges, h)[0].items()}
    assert {(r.hub, r.node): (r.cost, r.parent) for r in trees} == want
    members = {n: n if n in hubs else hubs[n % 3] for n in range(60)}
    people = {n: rng.choice([0, 5, 10, 20]) for n in range(60) if n % 7}
    tree_df = spark.createDataFrame(trees)
    out = RT.leaf_routes(tree_df, spark.createDataFrame([(n, h) for n, h in members.items()], "node long, hub long"), spark.createDataFrame(list(people.items()), "node long, population long"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.place):
        got.setdefault((r.hub, r.leaf), ([], []))[0].append(r.stop)
        if r.serves:
            got[r.hub, r.leaf][1].append(r.stop)
    expected = {}
    for h in hubs:
        parent = {n: p for (hub, n), (_, p) in want.items() if hub == h}

        def chain(n):
            return [n] if parent[n] is None else [n, *chain(parent[n])]

        own = {n for n, hub in members.items() if hub == h and n != h and n in parent}
        passed = {s for n in own for s in chain(n)[1:]}
        served = set()
        for leaf in sorted(own - passed, key=lambda n: (-people.get(n, 0), n)):
            new = [s for s in chain(leaf) if s in own and s not in served]
            served.update(new)
            expected[h, leaf] = (chain(leaf), new)
    assert got == expected
    served = [s for _, new in got.values() for s in new]
    assert len(served) == len(set(served)) and not set(served) & set(hubs)
    assert all(stops[-1] == h for (h, _), (stops, _) in got.items())


def test_chains_leave_out_cycles(spark):
    trees = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 5), (1, 5, 6), (1, 6, 4), (1, 7, 6), (1, 8, 99)], "hub long, node long, parent long")
    ways = {}
    for r in sorted(RT.chains(trees).collect(), key=lambda r: r.place):
        ways.setdefault(r.node, []).append(r.stop)
    assert {k: ways[k] for k in (1, 2, 3)} == {1: [1], 2: [2, 1], 3: [3, 2, 1]}
    assert not {4, 5, 6, 7} & set(ways)


def test_path_metres_are_unknown_where_a_step_is(spark):
    stops = [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "b"), (2, 1, "d"), (3, 0, "a")]
    lengths = spark.createDataFrame([("b", "a", 5), ("b", "c", 7), ("c", "b", 6)], "a string, b string, metres long")
    out = {r.route: (r.stops, r.metres) for r in RT.path_metres(spark.createDataFrame(stops, "route long, place long, stop string"), lengths, ["route"]).collect()}
    assert out == {1: (3, 11), 2: (2, None), 3: (1, 0)}


def test_zones_bound_the_ways(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1)], "a long, b long, cost long")
    zones = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, None)], "node long, zone string")
    trees = RT.hub_trees(RT.zone_edges(edges, zones), spark.createDataFrame([(1,)], "hub long"))
    assert sorted(r.node for r in trees.collect()) == [1, 2]
    assert sorted(r.node for r in RT.hub_trees(edges, spark.createDataFrame([(1,)], "hub long"), limit=2).collect()) == [1, 2, 3]
