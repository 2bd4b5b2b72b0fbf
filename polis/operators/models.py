"""Survival, regressions, apportionment and other small models, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import quantiles
from .graph import _cut


def kaplan_meier(df: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """(by, time, at_risk, events, survival). Rows with a negative or null time take no part; at one time events come before
    censorings. Groups shrink to their distinct times before the window."""
    counts = df.filter(F.col(time) >= 0).groupBy(*by, F.col(time).alias("time")).agg(F.count("*").alias("leave"), F.sum(F.col(event).cast("long")).alias("events"))
    later = Window.partitionBy(*by).orderBy(F.desc("time"))
    run = Window.partitionBy(*by).orderBy("time")
    counts = counts.withColumn("at_risk", F.sum("leave").over(later))
    left = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    ended = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(run)
    survival = F.when(ended == 1, 0.0).otherwise(F.exp(F.sum(left).over(run)))
    return counts.select(*by, "time", "at_risk", "events", survival.alias("survival"))


def life_table(bins: DataFrame, by: list[str]) -> DataFrame:
    """Survival to the end of each bin from (by, bin, events, censored); the censored count half of their bin at risk."""
    later = Window.partitionBy(*by).orderBy(F.desc("bin"))
    at_risk = F.sum(F.col("events") + F.col("censored")).over(later) - F.col("censored") / 2
    rows = bins.withColumn("at_risk", at_risk)
    rate = F.when((F.col("at_risk") > 0) & (F.col("events") < F.col("at_risk")), F.log(1 - F.col("events") / F.col("at_risk"))).when(F.col("events") == 0, 0.0)
    rows = rows.withColumn("__l", rate)
    run = Window.partitionBy(*by).orderBy("bin")
    gone = F.max(F.col("__l").isNull().cast("int")).over(run)
    return rows.select(*by, "bin", "at_risk", F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(F.coalesce("__l", F.lit(0.0))).over(run))).alias("survival"))


def log_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 of ln y on ln x over rows where both are positive."""
    rows = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(*by, F.log(x).alias("lx"), F.log(y).alias("ly"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"))


def leave_one_out(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The spread factor exp(sd) of each value's log against the mean log of the others of its group, in groups of two or more."""
    # A log less the mean of the n - 1 others is n / (n - 1) times its distance to the mean of all.
    n, log = F.count("*"), F.log(value)
    return df.filter(F.col(value) > 0).groupBy(*by).agg(n.alias("n"), F.exp(F.stddev_pop(log) * n / (n - 1)).alias("factor")).filter("n > 1")


def apportion(totals: DataFrame, members: DataFrame, key: str, member: str, weight: str, volume: str) -> DataFrame:
    """Whole units of each total to its members by weight, largest remainders first, ties to the smaller member."""
    w = Window.partitionBy(key)
    rows = members.join(totals, key).withColumn("__q", F.col(volume) * F.col(weight) / F.sum(weight).over(w)).withColumn("__f", F.floor("__q"))
    left = F.col(volume) - F.sum("__f").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("__q") - F.col("__f"), 9)), member))
    return rows.select(key, member, (F.col("__f") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("units"))


def seats(votes: DataFrame, by: str, party: str, n: str, total: int, threshold: float) -> DataFrame:
    """Seats by electoral quotient, then by largest unused votes, among parties that reach the threshold."""
    w = Window.partitionBy(by)
    fit = votes.withColumn("__s", F.col(n) / F.sum(n).over(w)).filter(F.col("__s") >= threshold)
    whole = F.floor(F.sum(n).over(w) / total)
    fit = fit.withColumn("__q", F.greatest(whole, F.lit(1))).withColumn("__f", F.floor(F.col(n) / F.col("__q"))).withColumn("__u", F.col(n) - F.col("__f") * F.col("__q"))
    left = F.lit(total) - F.sum("__f").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("__u"), party))
    return fit.select(by, party, (F.col("__f") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("seats"))


def quarantine(df: DataFrame, by: str, value: str, times: float) -> DataFrame:
    """df with suspect: the value is over `times` the group's median. The medians, a row for each group, join back."""
    medians = quantiles(df, [by], value, {"__m": 0.5}).drop("n")
    return df.join(medians, by, "left").withColumn("suspect", F.col(value) > times * F.col("__m")).drop("__m")


def geometric_transfer(df: DataFrame, by: str, value: str, base: str, least: int, bias: float) -> DataFrame:
    """(by, n, factor, verdict): the geometric mean of value / base of groups of `least` or more; biased where its log is over `bias`."""
    log = F.ln(value) - F.ln(base)
    n, mean = F.count("*"), F.avg(log)
    verdict = F.when(n < least, "too few").when(F.abs(mean) <= bias, "pass").otherwise("biased")
    return df.groupBy(by).agg(n.alias("n"), F.when(n >= least, F.round(F.exp(mean), 6)).alias("factor"), verdict.alias("verdict"))


def survival_marks(df: DataFrame, by: list[str], time: str, event: str, marks: list[int]) -> DataFrame:
    """(by, n, median, at_<mark>...): the first time at which half or fewer are left, null where none is, and the share left at
    each mark, null past the last follow-up. A group without a sound time has no row."""
    curve = kaplan_meier(df, by, time, event)
    n, last = F.max("at_risk"), F.max("time")
    at = [F.when(last >= m, F.round(F.coalesce(F.min(F.when(F.col("time") <= m, F.col("survival"))), F.lit(1.0)), 9)).alias(f"at_{m}") for m in marks]
    return curve.groupBy(*by).agg(n.alias("n"), F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).cast("long").alias("median"), *at)


def parent_chains(tree: DataFrame) -> DataFrame:
    """(node, path, hops) of each node of a forest (node, parent) that a root reaches, the root first. Sorted sides meet in
    each round: a broadcast would send every level through the driver."""
    tree = _cut(tree.select("node", "parent"))
    fresh = _cut(tree.filter("parent IS NULL").select("node", F.col("node").cast("string").alias("path"), F.lit(0).cast("long").alias("hops")))
    found = fresh
    while fresh.head(1):
        down = tree.join(fresh.withColumnRenamed("node", "parent").hint("merge"), "parent")
        fresh = _cut(down.select("node", F.concat_ws(">", "path", "node").alias("path"), (F.col("hops") + 1).alias("hops")))
        found = found.unionByName(fresh)
    return found


def table_marks(table: DataFrame, by: list[str], edges: list[float], follow_up: float, marks: list[float]) -> DataFrame:
    """(by, median, and done_<mark> for each mark) of a life table (by, bin, survival; bin k ends at edges[k + 1]): when half are
    done, and which share is by each mark, even between the ends of bins. The last bin is open: nothing is said beyond the last
    edge, nor beyond follow_up, and a median that is not reached is null. A missing bin changes nothing, so the curve stays level."""
    points = table.filter(F.col("bin") < len(edges) - 1)
    curve = F.array_sort(F.collect_list(F.struct("bin", "survival")))  # as many entries as bins
    rows = points.groupBy(*by).agg(curve.alias("c"))
    at = F.lit([float(e) for e in edges])

    def alive(k: int) -> Column:
        """Survival at edges[k]."""
        known = F.filter("c", lambda p: p["bin"] < k)
        return F.when(F.size(known) > 0, F.element_at(known, -1)["survival"]).otherwise(1.0) if k else F.lit(1.0)

    rows = rows.withColumn("s", F.array(*[alive(k) for k in range(len(edges))]))
    s = F.col("s")

    def done(mark: float) -> Column:
        k = next((k for k in range(1, len(edges)) if edges[k] >= mark), None)
        if k is None or mark > follow_up:
            return F.lit(None).cast("double")
        share = (mark - edges[k - 1]) / (edges[k] - edges[k - 1])
        return 1 - (s[k - 1] + share * (s[k] - s[k - 1]))

    falls = [F.when((s[k] <= 0.5) & (s[k - 1] > 0.5), at[k - 1] + (s[k - 1] - 0.5) / (s[k - 1] - s[k]) * (edges[k] - edges[k - 1])) for k in range(1, len(edges))]
    return rows.select(*by, F.coalesce(*falls).alias("median"), *[done(m).alias(f"done_{m:g}") for m in marks])
