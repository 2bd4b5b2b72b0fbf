"""Grouped summaries: quantiles of several kinds, shares, modes, histograms and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import placed


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group with how many rows lie below and up to them: groups shrink to their distinct values, and
    ranges of these are laid end to end, so a group is no single task's work."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    laid = placed(counts, by, [F.col(value)], {"__n": "__from"})
    return laid.withColumn("__to", F.col("__from") + F.col("__n")).withColumnRenamed("__from_all", "__all")


def _at(index: Column, value: str) -> Column:
    """The value at a place, counted from 0."""
    return F.max(F.when((F.col("__from") <= index) & (index < F.col("__to")), F.col(value)))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column for each name in at, and the number n of values. Groups without a
    value give no row. No buffer holds a group's values: they are sorted, which spills."""

    def quantile(p: float) -> Column:
        place = (F.col("__all") - 1) * F.lit(float(p))
        low, high = _at(F.floor(place), value), _at(F.ceil(place), value)
        return low + (high - low) * F.max(place - F.floor(place))

    return _ranked(df, by, value).groupBy(*by).agg(F.max("__all").alias("n"), *[quantile(p).alias(name) for name, p in at.items()])


def order_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """upper: the upper middle value; integer: the middle two's mean rounded down; p90: the value at the floor of 0.9 (n - 1)."""
    n = F.col("__all")
    ranked = _ranked(df, by, value)
    low, high = _at(F.floor((n - 1) / 2), value), _at(F.floor(n / 2), value)
    return ranked.groupBy(*by).agg(
        F.max("__all").alias("n"), high.alias("upper"), F.floor((low + high) / 2).alias("integer"), _at(F.floor(F.lit(0.9) * (n - 1)), value).alias("p90"),
    )


def exclusive_quartiles(df: DataFrame, by: list[str], value: str, least: int = 4) -> DataFrame:
    """Quartiles with places at multiples of n + 1, of groups of at least `least` rows."""
    n, ranked = F.col("__all"), _ranked(df, by, value)

    def quartile(k: int) -> Column:
        place = (n + 1) * k / 4
        j = F.greatest(F.lit(1), F.least(F.floor(place), n - 1))
        return _at(j - 1, value) + (_at(j, value) - _at(j - 1, value)) * F.max(place - j)

    return ranked.filter(n >= least).groupBy(*by).agg(F.max(n).alias("n"), *[quartile(k).alias(f"q{k}") for k in (1, 2, 3)])


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half of all."""
    sums = placed(df.filter(F.col(weight) > 0).groupBy(*by, value).agg(F.sum(weight).alias("__w")), by, [F.col(value)], {"__w": "__run"})
    return sums.filter(F.col("__run") + F.col("__w") >= F.col("__run_all") / 2).groupBy(*by).agg(F.min(value).alias("median"))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value, ties to the smaller; its count and the share of non-null rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b"), F.sum("__n").alias("total")).select(*by, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("n"), (-F.col("b.n") / F.col("total")).alias("share"))


def shares(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Rows of each group, and their share of the rows of the groups that agree in `within`."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def top_share(df: DataFrame, by: list[str], key: str, value: str, fraction: float) -> DataFrame:
    """The share of a group's sum that its largest keys have, a fraction of them (one at least); ties to the smaller key."""
    sums = placed(df.groupBy(*by, key).agg(F.sum(value).alias("__v")), by, [F.desc("__v"), F.col(key)])
    keep = F.greatest(F.lit(1), F.floor(F.col("rows") * fraction))
    return sums.groupBy(*by).agg(F.max(keep).alias("keys"), (F.sum(F.when(F.col("place") <= keep, F.col("__v"))) / F.sum("__v")).alias("share"))


def histogram(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """(by, bin, n) for every bin, empty ones too: bin k holds edges[k] <= value < edges[k + 1], the last is open; values below
    the first edge are left out."""
    number = sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0)) - 1
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(*[F.sum((number == k).cast("long")).alias(f"b{k}") for k in range(len(edges))])
    return counts.select(*by, F.posexplode(F.array(*[f"b{k}" for k in range(len(edges))])).alias("bin", "n"))


def binned_quantile(bins: DataFrame, by: list[str], edges: list[float], p: float) -> DataFrame:
    """The quantile that binned counts imply, even within a bin; in the open last bin its edge, flagged as a floor."""
    w = Window.partitionBy(*by).orderBy("bin")
    run = bins.filter("n > 0").withColumn("__to", F.sum("n").over(w)).withColumn("__all", F.sum("n").over(Window.partitionBy(*by)))
    hit = run.filter(F.col("__to") >= F.lit(p) * F.col("__all")).groupBy(*by).agg(F.min(F.struct("bin", "n", "__to", "__all")).alias("h"))
    low = F.element_at(F.array(*map(F.lit, map(float, edges))), F.col("h.bin") + 1)
    high = F.element_at(F.array(*map(F.lit, map(float, [*edges[1:], edges[-1]]))), F.col("h.bin") + 1)
    inside = (F.lit(p) * F.col("h.__all") - (F.col("h.__to") - F.col("h.n"))) / F.col("h.n")
    is_open = F.col("h.bin") == len(edges) - 1
    return hit.select(*by, F.when(is_open, low).otherwise(low + (high - low) * inside).alias("quantile"), is_open.alias("is_floor"))


def distinct_buckets(df: DataFrame, key: str, counted: str) -> DataFrame:
    """How many keys have 1, 2, 3-4, 5-9 or more distinct values."""
    n = df.groupBy(key).agg(F.count_distinct(counted).alias("n")).filter("n > 0")
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 4, "3-4").when(F.col("n") <= 9, "5-9").otherwise("10+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"))


def head_counts(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group with rank and count, ties to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def strict_sum(value: Column) -> Column:
    """A sum that is null if any member is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def before_after(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """(by, n, before, after, saved, ratio, median_before, median_after) of the rows that have both: totals, what is saved, the ratio
    of the sums (null where before sums to 0) and both medians."""
    rows = df.filter(F.col(before).isNotNull() & F.col(after).isNotNull())
    b, a = F.sum(before), F.sum(after)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), b.alias("before"), a.alias("after"), (b - a).alias("saved"), F.when(b != 0, a.cast("double") / b.cast("double")).alias("ratio"))
    for value, name in ((before, "median_before"), (after, "median_after")):
        of = [f"__{c}" for c in by]
        middle = quantiles(rows, by, value, {name: 0.5}).drop("n").withColumnsRenamed(dict(zip(by, of)))
        on = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(by, of)]
        out = (out.join(middle, on) if on else out.join(F.broadcast(middle))).drop(*of)  # without groups one row
    return out


def decile_spread(df: DataFrame, by: list[str], value: str, least: int = 9) -> DataFrame:
    """(by, n, p10, p50, p90, most_to_least, p90_to_p10) by exclusive quantiles, whose places are multiples of n + 1, of groups of at
    least `least` values; ratios are null where the lower value is 0."""
    n, ranked = F.col("__all"), _ranked(df, by, value)

    def decile(k: int) -> Column:
        place = (n + 1) * k / 10
        j = F.greatest(F.lit(1), F.least(F.floor(place), n - 1))
        return _at(j - 1, value) + (_at(j, value) - _at(j - 1, value)) * F.max(place - j)

    sums = ranked.filter(n >= least).groupBy(*by).agg(F.max(n).alias("n"), *[decile(k).alias(f"p{k}0") for k in (1, 5, 9)], F.max(value).alias("__most"), F.min(value).alias("__least"))
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return sums.select(*by, "n", "p10", "p50", "p90", over("__most", "__least").alias("most_to_least"), over("p90", "p10").alias("p90_to_p10"))


def band_shares(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """(by, band, n, share, up_to) for every band in order, empty ones too: the share of a group's values in it, and in it and those
    below. Bands are as in histogram."""
    bins = histogram(df, by, value, edges)
    every, until = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")  # as many rows as bands
    total = F.sum("n").over(every)
    share = lambda n: F.when(total > 0, n / total)
    return bins.select(*by, F.col("bin").alias("band"), "n", share(F.col("n")).alias("share"), share(F.sum("n").over(until)).alias("up_to"))


def colour_breaks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, b1, b2, b3): the quartiles of the values above 0, where a map changes its colours."""
    return quantiles(df.filter(F.col(value) > 0), by, value, {"b1": 0.25, "b2": 0.5, "b3": 0.75})


def collapsed(df: DataFrame, key: list[str], order: list[str], first: list[str], most: list[str]) -> DataFrame:
    """A row for each key that several matches have: the columns `first` of the first match in order, the largest of each of
    `most`, and how many matches there are."""
    head = F.min_by(F.struct(*first), F.struct(*order))
    out = df.groupBy(*key).agg(head.alias("__f"), *[F.max(c).alias(c) for c in most], F.count("*").alias("matches"))
    return out.select(*key, *[F.col(f"__f.{c}").alias(c) for c in first], *most, "matches")
