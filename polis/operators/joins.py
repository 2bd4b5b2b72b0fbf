"""Joins: as-of, keep-last, reconciliation of registers, crosswalks, fuzzy matches."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_key


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, right_order: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of the latest right row of the same key up to its time; of equal times the largest
    right_order. A null key or time matches nothing. Both sides meet in one sorted stream for each key, so no pair is ever built."""
    value = F.struct(*take)
    right = right.filter(F.col(by).isNotNull() & F.col(right_time).isNotNull())
    rows = left.select(F.col(by).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__o"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__r"))
    more = right.select(F.col(by).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(right_order).cast("long").alias("__o"), F.lit(None).cast(rows.schema["__l"].dataType).alias("__l"), value.alias("__r"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(more).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in take])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so repeated keys combine before they shuffle."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(last.alias("__last")).select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right): every key of either side, once."""
    a = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    return a.unionByName(b).groupBy(key).agg((F.max("l") == 1).alias("in_left"), (F.max("r") == 1).alias("in_right"))


def crosswalk(df: DataFrame, registry: DataFrame, code: str, registry_code: str, target: str) -> DataFrame:
    """df with the target of its code and how it was found: unique, ambiguous (several targets: none is taken) or unmatched."""
    known = registry.groupBy(F.col(registry_code).alias("__c")).agg(F.count_distinct(target).alias("__n"), F.min(target).alias("__t"))
    status = F.when(F.col("__n") == 1, "unique").when(F.col("__n") > 1, "ambiguous").otherwise("unmatched")
    out = df.join(known, F.col(code) == F.col("__c"), "left")
    return out.select(*df.columns, F.when(F.col("__n") == 1, F.col("__t")).alias(target), status.alias("status"))


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, least: float, common_most: int = 1000) -> DataFrame:
    """(left_id, right_id, score): pairs with a common token whose share of common tokens of the smaller set reaches `least`.

    Pairs come from met_on_tokens, and full sets decide.
    """
    pairs = met_on_tokens(left, right, left_id, right_id, tokens, least, common_most)
    pairs = pairs.join(left.select(left_id, F.col(tokens).alias("__a")), left_id).join(right.select(right_id, F.col(tokens).alias("__b")), right_id)
    score = F.size(F.array_intersect("__a", "__b")) / F.least(F.size(F.array_distinct("__a")), F.size(F.array_distinct("__b")))
    return pairs.select(left_id, right_id, score.alias("score")).filter(F.col("score") >= least)


def met_on_tokens(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, least: float, common_most: int = 1000, small: int = 8) -> DataFrame:
    """(left_id, right_id): distinct pairs among which are all that token_overlap keeps.

    Of the need = ceil(least m) tokens that a smaller set of m must share, k are among the rarest size - need + k of either set. Sets
    of at most `small` tokens, of which two or more must be shared, meet on two or three at once, for each size of a smaller set
    that there is; `small` bounds these combinations. All others meet on one of the rarest tokens of the smaller set. What more than
    common_most rows on the right have is dealt over as many groups as hold that many each.
    """
    n, size, ordered = F.col("__n"), F.col("__size"), F.col("__o")
    need = lambda m: max(1, math.ceil(m * float(least) - 1e-9))
    several = [m for m in range(1, small + 1) if need(m) > 1]
    tight = size.isin(several) if several else F.lit(False)
    counts = right.select(F.explode(F.array_distinct(tokens)).alias("__t")).groupBy("__t").agg(F.count("*").alias("__n"))

    def sizes(df: DataFrame) -> list[int]:
        found = df.select(F.size(F.array_distinct(tokens)).alias("__size")).filter(tight).distinct().collect()
        return sorted(r["__size"] for r in found)

    def sets(df: DataFrame, key: str) -> DataFrame:
        """(__id, __o, __size): the distinct tokens of each set, the rarest first. Nulls come last: they count, but no pair meets on them alone."""
        own = df.select(F.col(key).alias("__id"), F.array_distinct(tokens).alias("__s")).distinct()
        rows = own.select("__id", F.xxhash64("__s").alias("__set"), F.explode("__s").alias("__t")).join(counts, "__t", "left")
        token = F.struct(F.col("__t").isNull().alias("none"), F.coalesce(n, F.lit(0)).alias("n"), F.col("__t").alias("t"))
        own = rows.groupBy("__id", "__set").agg(F.array_sort(F.collect_list(token)).alias("__o"))
        return own.select("__id", F.transform("__o", lambda e: e["t"]).alias("__o"), F.size("__o").alias("__size"))

    def single(kind: int, when: Column) -> Column:
        rare = size - F.greatest(F.lit(1), F.ceil(size * F.lit(float(least)) - 1e-9))
        return F.transform(F.filter(F.array_compact(ordered), lambda t: when), lambda t, i: F.struct(F.xxhash64(F.lit(kind), t).alias("on"), (i <= rare).alias("rare")))

    def at_once(role: int, m: int, when: Column) -> Column:
        # Ordered by their last place, the combinations of the first places of a set are the first of all.
        k = min(need(m), 3)
        every = F.expr(f"array({', '.join(f'array{c}' for c in sorted(combinations(range(small), k), key=lambda c: c[::-1]))})")
        many = F.get(F.expr(f"array{tuple(math.comb(p, k) for p in range(small + 1))}"), F.greatest(F.lit(0), size - need(m) + k))
        these = F.slice(every, F.lit(1), F.when(tight & when, many).otherwise(0))
        return F.transform(these, lambda c: F.struct(F.xxhash64(F.lit(2 + role), F.lit(m), F.transform(c, lambda i: F.get(ordered, i))).alias("on"), F.lit(True).alias("rare")))

    def meeting(df: DataFrame, kinds: list[Column]) -> DataFrame:
        each = df.select("__id", "__size", F.explode(F.flatten(F.array(*kinds))).alias("__m"))
        return each.select("__id", "__size", F.col("__m.on").alias("__on"), F.col("__m.rare").alias("__rare"))

    # The left set is the smaller one or as large in role 0, the right one is smaller in role 1.
    x_sizes, y_sizes = sizes(left), sizes(right)
    a = [single(0, F.lit(True)), single(1, ~tight)] + [at_once(0, m, size == m) for m in x_sizes] + [at_once(1, m, size > m) for m in y_sizes]
    b = [single(0, ~tight), single(1, tight)] + [at_once(0, m, size >= m) for m in x_sizes] + [at_once(1, m, size == m) for m in y_sizes]
    a, b = meeting(sets(left, left_id), a), meeting(sets(right, right_id), b)
    dealt = b.groupBy("__on").agg(F.count("*").alias("__n")).filter(n > common_most).select("__on", F.ceil(n / common_most).cast("int").alias("__groups"))
    groups = F.coalesce("__groups", F.lit(1))
    a = a.join(dealt, "__on", "left").withColumn("__g", F.explode(F.sequence(F.lit(0), groups - 1)))
    b = b.join(dealt, "__on", "left").withColumn("__g", F.pmod(F.xxhash64("__id"), groups).cast("int"))
    a = a.select("__on", "__g", F.col("__id").alias("__x"), F.col("__size").alias("__xs"), F.col("__rare").alias("__xr"))
    b = b.select("__on", "__g", F.col("__id").alias("__y"), F.col("__size").alias("__ys"), F.col("__rare").alias("__yr"))
    met = a.join(b, ["__on", "__g"]).filter("(__xr AND __xs <= __ys) OR (__yr AND __ys <= __xs)")
    return met.select(F.col("__x").alias(left_id), F.col("__y").alias(right_id)).distinct()


def complete_grid(df: DataFrame, rows: DataFrame, columns: DataFrame, on: list[str], most: int = 10_000) -> DataFrame:
    """df with a row for each combination of a row of rows and one of columns; absent ones have nulls. columns is a code list of at
    most `most` entries, which is checked; a longer one is refused, as the grid would have that many times the rows."""
    if columns.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} columns for a grid")
    return rows.join(F.broadcast(columns)).join(df, on, "left")


def in_bands(df: DataFrame, value: Column, bands: list[tuple[float, float | None, str]]) -> Column:
    """The label of the half-open band that holds the value; an open upper bound is None."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        inside = (value >= low) if high is None else (value >= low) & (value < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def compared_registers(left: DataFrame, right: DataFrame, name: str, left_measure: str, right_measure: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(key, status, left, right, ratio, left_share, right_share, divergence) of two registers whose names are spelled differently:
    both are folded to one key, with aliases, and summed by it. status is matched, left_only or right_only.

    Shares are of the matched keys' totals alone, so that no unmatched one makes all others too small; divergence is how much
    larger the left share is. ratio is left over right, null where right is 0. Null names match nothing and are left out.
    """
    side = lambda df, measure, of: df.select(join_key(F.col(name), aliases).alias("key"), F.col(measure).alias("v")).filter("key <> ''").groupBy("key").agg(F.coalesce(F.sum("v"), F.lit(0)).alias(of))
    both = side(left, left_measure, "left").join(side(right, right_measure, "right"), "key", "full")
    matched = F.col("left").isNotNull() & F.col("right").isNotNull()
    totals = both.filter(matched).agg(F.sum("left").alias("__l"), F.sum("right").alias("__r"))
    share = lambda of, total: F.when(matched & (F.col(total) != 0), F.col(of) / F.col(total))
    status = F.when(matched, "matched").when(F.col("left").isNotNull(), "left_only").otherwise("right_only")
    out = both.join(F.broadcast(totals)).withColumn("left_share", share("left", "__l")).withColumn("right_share", share("right", "__r"))  # one row
    ratio = F.when(matched & (F.col("right") != 0), F.col("left") / F.col("right"))
    return out.select("key", status.alias("status"), "left", "right", ratio.alias("ratio"), "left_share", "right_share", (F.col("left_share") - F.col("right_share")).alias("divergence"))


def with_rates(df: DataFrame, rates: DataFrame, currency: str, day: str, pinned: dict[str, float] | None = None) -> DataFrame:
    """df with rate and rate_source: the pinned rate of its currency where there is one, else the latest of rates (currency, quoted,
    rate) up to its day, else null. Of rates quoted on one day the largest counts. A pinned currency never looks at live rates, so
    what is computed with it stays."""
    live = as_of(df, rates.groupBy("currency", "quoted").agg(F.max("rate").alias("rate")).withColumnRenamed("currency", currency).withColumn("__o", F.lit(0)), currency, day, "quoted", "__o", ["rate"])
    fixed = F.lit(None).cast("double")
    for name, rate in (pinned or {}).items():
        fixed = F.when(F.col(currency) == name, F.lit(float(rate))).otherwise(fixed)
    source = F.when(fixed.isNotNull(), "pinned").when(F.col("rate").isNotNull(), "live")
    return live.withColumn("rate_source", source).withColumn("rate", F.coalesce(fixed, F.col("rate")))
