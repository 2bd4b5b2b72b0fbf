"""Windows within keys: gaps, running sums, cut-points, ledgers, effective values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import placed


def gaps(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """df with gap_s, the seconds since the row before of the same key."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn("gap_s", (micros - F.lag(micros).over(Window.partitionBy(key).orderBy(time, order))) / 1e6)


def cut_points(df: DataFrame, by: str, key: str, benefit: str, marks: list[float]) -> DataFrame:
    """(by, mark, keys): how many keys, the largest benefit first, reach each share of the group's benefit."""
    ranked = placed(df.select(by, key, benefit), [by], [F.desc(benefit), F.col(key)], {benefit: "run"})
    first = [F.min(F.when(F.col("run") + F.col(benefit) >= F.lit(m) * F.col("run_all"), F.col("place"))).alias(f"m{k}") for k, m in enumerate(marks)]
    at = F.inline(F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"m{k}").alias("keys")) for k, m in enumerate(marks)]))
    return ranked.groupBy(by).agg(*first).select(by, at).filter("keys IS NOT NULL")


def fifo_ledger(df: DataFrame, by: str, order: list[str], key: str, amount: str, is_cut: str) -> DataFrame:
    """(by, increase, cut, amount): which increase is paid by which cut when cuts are consumed in order. Both sides are laid
    out on one axis of running amounts and matched where their stretches overlap, each stretch with the few it meets."""
    run = F.sum(amount).over(Window.partitionBy(by, is_cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    laid = df.select(by, F.col(key).alias("k"), F.col(is_cut).alias("cut"), (run - F.col(amount)).alias("lo"), run.alias("hi")).filter("hi > lo")
    # Every boundary of either side splits the axis; within a piece the increase and the cut are those that started last.
    at = laid.select(by, F.col("lo").alias("x"), F.when(~F.col("cut"), F.struct("k", "hi")).alias("i"), F.when(F.col("cut"), F.struct("k", "hi")).alias("c"))
    ends = laid.groupBy(by, "cut").agg(F.max("hi").alias("x")).select(by, "x", F.lit(None).cast(at.schema["i"].dataType).alias("i"), F.lit(None).cast(at.schema["c"].dataType).alias("c"))
    points = at.unionByName(ends).groupBy(by, "x").agg(F.max("i").alias("i"), F.max("c").alias("c"))
    w = Window.partitionBy(by).orderBy("x")
    pieces = points.select(by, "x", F.lead("x").over(w).alias("to"), *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("i", "c")])
    both = pieces.filter((F.col("i.hi") > F.col("x")) & (F.col("c.hi") > F.col("x")) & F.col("to").isNotNull())
    return both.groupBy(by, F.col("i.k").alias("increase"), F.col("c.k").alias("cut")).agg(F.sum(F.col("to") - F.col("x")).alias("amount"))


def regret(df: DataFrame, key: str, option: str, cost: str) -> DataFrame:
    """The cheapest option of each key and what the second cheapest costs more; null with one option."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(cost, option))
    two = df.select(key, option, cost).withColumn("__p", place).filter("__p <= 2")  # each task hands on two of a key at most
    at = lambda k, c: F.max(F.when(F.col("__p") == k, F.col(c)))
    return two.groupBy(key).agg(at(1, option).alias("best"), (at(2, cost) - at(1, cost)).alias("regret"))


def shared_regret(keys: DataFrame, options: DataFrame, key: str, on: str, profile: str, option: str, cost: Column) -> DataFrame:
    """regret of keys (key, on, profile) over the options with the same `on`, where cost sees of a key nothing but its profile. So
    each profile meets the options once, and its two cheapest are those of all its keys."""
    kinds = keys.select(on, profile).distinct().join(options, on).withColumn("__c", cost)
    two = kinds.withColumn("__p", F.row_number().over(Window.partitionBy(on, profile).orderBy("__c", option))).filter("__p <= 2")
    two = two.select(on, F.col(profile).alias("__profile"), option, "__c")
    met = keys.join(two.withColumnRenamed(on, "__on"), (F.col(on) == F.col("__on")) & F.col(profile).eqNullSafe(F.col("__profile")))
    return regret(met, key, option, "__c")


def effective_value(df: DataFrame, date: str, series: list[tuple[str, float]]) -> DataFrame:
    """df with value, of the last step that starts up to the date, or the first step's before any."""
    out = F.lit(series[0][1])
    for start, value in series:
        out = F.when(F.col(date) >= F.lit(start).cast("timestamp_ntz"), F.lit(value)).otherwise(out)
    return df.withColumn("value", out)


def compound(df: DataFrame, key: str, order: list[str], start: float, rate: str) -> DataFrame:
    """The amount of each key after all rates in order, rounded down to whole units at every step."""
    rates = F.transform(F.array_sort(F.collect_list(F.struct(*order, rate))), lambda s: s[rate])
    return df.groupBy(key).agg(F.count("*").alias("n"), F.aggregate(rates, F.lit(float(start)), lambda total, r: F.floor(total * (1 + r)).cast("double")).alias("amount"))


def priority_curve(df: DataFrame, by: list[str], key: str, cost: str, benefit: str) -> DataFrame:
    """(by, key, cost, benefit, each, place, cost_so_far, benefit_so_far, share): what a unit of benefit costs, the cheapest first
    (ties to the smaller key), with running sums and the share of all benefit that is reached by then. Rows without a benefit
    above 0, or without a cost, are on no curve."""
    rows = df.filter((F.col(benefit) > 0) & F.col(cost).isNotNull()).select(*by, key, cost, benefit, (F.col(cost) / F.col(benefit)).alias("each"))
    laid = placed(rows, by, [F.col("each"), F.col(key)], {cost: "__c", benefit: "__b"})
    so_far = [(F.col("__c") + F.col(cost)).alias("cost_so_far"), (F.col("__b") + F.col(benefit)).alias("benefit_so_far"), ((F.col("__b") + F.col(benefit)) / F.col("__b_all")).alias("share")]
    return laid.select(*by, key, cost, benefit, "each", "place", *so_far)
