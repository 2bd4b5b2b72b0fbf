"""Assignments: items to sites under a ceiling, weights to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def assign_under_ceiling(options: DataFrame, ceiling: float, loads: DataFrame | None = None) -> DataFrame:
    """(item, site, cost, place): the site of each item of options (item, site, cost, weight), place 1 being its cheapest.

    Items choose one after the other, those with the most regret (what their second option costs more) first, then the smaller
    item; each takes its cheapest site (ties to the smaller) whose load stays within the ceiling with it, or, where none has
    room, its cheapest. loads (site, load) are there before. Weights and loads are whole numbers; an item has one weight. Null
    items, sites or costs take no part, and of equal options one does.

    The walk is done in rounds that look at all items at once: an item takes the first option that has room beside what those
    before it chose in the round before. In every round at least one more item of the order is settled for good, so the rounds
    end, with the walk's result; as a choice touches few sites they are few. What stands before an item is a sum within a range
    of the order and a sum of ranges, so a site that many want is not one task's work.

    Rounds carry only the options that an item has asked for: its cheapest at first, and when none of those has room, about as
    many again, until one has or all were asked for. So they move little more than a row an item, however many options there are.
    """
    rows = options.filter("item IS NOT NULL AND site IS NOT NULL AND cost IS NOT NULL").select("item", "site", "cost", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    # Dealt by item once; the aggregate and the windows find an item's options together.
    rows = rows.repartition("item").groupBy("item", "site").agg(F.min("cost").alias("cost"), F.max("weight").alias("weight"))
    if loads is not None:
        rows = rows.join(loads.groupBy("site").agg(F.sum("load").cast("long").alias("before")), "site", "left")
    else:
        rows = rows.withColumn("before", F.lit(None).cast("long"))
    cheapest, own = Window.partitionBy("item").orderBy("cost", "site"), Window.partitionBy("item")
    rows = rows.withColumn("place", F.row_number().over(cheapest)).withColumn("second", F.lead("cost").over(cheapest))
    regret = F.max(F.when(F.col("place") == 1, F.col("second") - F.col("cost"))).over(own)
    every = _cut(rows.withColumn("order", -F.coalesce(regret, F.lit(0))).withColumn("options", F.count("*").over(own)).drop("second"))
    rows = every.filter("place = 1").repartitionByRange("order", "item").withColumn("range", F.spark_partition_id())
    rows = _cut(rows.withColumn("chosen", F.lit(True)))
    within = Window.partitionBy("site", "range").orderBy("order", "item").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.when(F.col("chosen"), F.col("weight")).otherwise(0)
    while True:
        ranges = rows.groupBy("site", "range").agg(F.sum(taken).alias("load"))
        earlier = Window.partitionBy("site").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select("site", "range", F.coalesce(F.sum("load").over(earlier), F.lit(0)).alias("earlier"))
        laid = rows.join(ranges.hint("merge"), ["site", "range"]).withColumn("there", F.coalesce("before", F.lit(0)) + F.col("earlier") + F.coalesce(F.sum(taken).over(within), F.lit(0)))
        fits = F.when(F.col("there") + F.col("weight") <= ceiling, F.col("place"))
        asked = F.max("place").over(own)
        # Null: none of those asked for has room, and there are more.
        pick = F.coalesce(F.min(fits).over(own), F.when(asked == F.col("options"), F.lit(1)))
        now = _cut(laid.withColumn("pick", pick).withColumn("asked", asked).select(*rows.columns, "pick", "asked"))
        if not now.filter("pick IS NULL OR chosen <> (place = pick)").head(1):
            return now.filter("chosen").select("item", "site", "cost", "place")
        rows = now.withColumn("chosen", F.coalesce(F.col("place") == F.col("pick"), F.lit(False))).drop("pick", "asked")
        turned = _cut(now.filter("pick IS NULL AND place = 1").select("item", "range", "asked"))
        if turned.head(1):
            more = every.join(turned, "item").filter("place > asked AND place <= 2 * asked + 1")
            more = more.withColumn("chosen", F.col("place") == F.col("asked") + 1).select(*rows.columns)
            rows = rows.unionByName(_cut(more))


def _picks(totals: list[int], weight: int, count: int) -> tuple[list[int], list[int]]:
    """(first picks, the turn that then repeats) of `count` items of one weight, each to the lightest shard, ties to the first.
    Once no shard is a weight lighter than the heaviest, they take turns. totals are brought up to date."""
    n = len(totals)
    heap = [(t, s) for s, t in enumerate(totals)]
    heapq.heapify(heap)
    first, top = [], max(totals)
    while len(first) < count and heap[0][0] + weight <= top:
        t, s = heap[0]
        first.append(s)
        heapq.heapreplace(heap, (t + weight, s))
    turn = [s for _, s in sorted(heap)]
    left = count - len(first)
    for t, s in heap:
        totals[s] = t
    for k, s in enumerate(turn):
        totals[s] += weight * (left // n + (k < left % n))
    return first, turn


def shards_by_weight(items: DataFrame, shards: int, levels: int = 2000) -> DataFrame:
    """(item, weight, shard) of items (item, weight): the heaviest first (ties to the smaller item), each to the shard that is
    lightest by then, ties to the first. A weight that is null or not above 0 counts as the upper middle one of the others, or 1
    without any. Weights are whole numbers; of repeated items each is placed. A null item comes last of its weight.

    Which shard the k-th item of a weight gets depends on the weights alone, so the driver only sees how many items each weight
    has. Where more than `levels` weights differ, weights are rounded up to as many leading digits as leave no more, for the order
    and the totals alike. Items of one weight are numbered over ranges of their order, so a weight that most items share is no
    single task's work.
    """
    w = F.col("weight").cast("long")
    known = items.filter(w > 0).groupBy(w.alias("weight")).agg(F.count("*").alias("n"))
    known = _cut(known)
    total = known.agg(F.sum("n")).head()[0] or 0
    middle = 1
    if total:
        ranked = known.repartitionByRange("weight").withColumn("range", F.spark_partition_id())
        ranked = _cut(ranked)
        at, want = 0, total // 2
        for r in sorted(ranked.groupBy("range").agg(F.sum("n").alias("n")).collect()):
            if at + r["n"] > want:
                run = F.sum("n").over(Window.partitionBy("range").orderBy("weight"))
                own = ranked.filter(F.col("range") == r["range"]).withColumn("run", run)
                middle = own.filter(F.col("run") > want - at).agg(F.min("weight")).head()[0]
                break
            at += r["n"]
    rows = items.select("item", F.when(w > 0, w).otherwise(F.lit(middle)).alias("weight"))
    digits, level = 19, F.col("weight")
    while digits > 1 and rows.select(level.alias("level")).distinct().limit(levels + 1).count() > levels:
        digits = min(digits - 1, 6)
        unit = F.pow(F.lit(10), F.greatest(F.lit(0), F.length(F.col("weight").cast("string")) - digits)).cast("long")
        level = (F.ceil(F.col("weight") / unit) * unit).cast("long")
    rows = _cut(rows.withColumn("level", level).repartitionByRange(F.desc("level"), F.asc_nulls_last("item")).withColumn("range", F.spark_partition_id()))
    sizes = rows.groupBy("level", "range").agg(F.count("*").alias("n")).collect()  # levels + ranges numbers at most
    totals, plan, starts, count = [0] * shards, {}, {}, {}
    for r in sorted(sizes, key=lambda r: (-r["level"], r["range"])):
        starts[r["level"], r["range"]] = count.get(r["level"], 0)
        count[r["level"]] = count.get(r["level"], 0) + r["n"]
    for lv in sorted(count, reverse=True):
        plan[lv] = _picks(totals, lv, count[lv])
    spark = items.sparkSession
    own = spark.createDataFrame([(lv, rg, start, *plan[lv]) for (lv, rg), start in starts.items()], "level long, range int, start long, first array<int>, turn array<int>")
    k = F.col("start") + F.row_number().over(Window.partitionBy("level", "range").orderBy(F.asc_nulls_last("item"))) - 1
    place = rows.join(own, ["level", "range"]).withColumn("k", k)
    later = F.element_at("turn", ((F.col("k") - F.size("first")) % shards + 1).cast("int"))
    shard = F.when(F.col("k") < F.size("first"), F.get("first", F.col("k").cast("int"))).otherwise(F.when(F.col("k") >= F.size("first"), later))
    return place.select("item", "weight", shard.alias("shard"))


def imbalance(placed: DataFrame) -> DataFrame:
    """(shards, lightest, heaviest, spread) of items with shard and weight: the heaviest shard as a multiple of the lightest."""
    sums = placed.groupBy("shard").agg(F.sum("weight").alias("load"))
    return sums.agg(F.count("*").alias("shards"), F.min("load").alias("lightest"), F.max("load").alias("heaviest"), (F.max("load") / F.min("load")).alias("spread"))
