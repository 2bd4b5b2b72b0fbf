"""Queries of measures, texts, dates, maps and places, each with DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import places as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import models as M
from ..operators import windows as W
from .queries import _DURATIONS, _durations, cents, query

# --- Measures --------------------------------------------------------------------------------------------------------------


@query("""
SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS returned_cents, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
FROM lineitem GROUP BY 1
""")
def footprint(read):
    """Many measures of one unit: rows, distinct sets, money, first and last day (AG-19, AG-15)."""
    back = F.sum(F.when(F.col("l_returnflag") == "R", cents("l_extendedprice")).otherwise(0))
    return read("lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.sum(cents("l_extendedprice")).alias("cents"),
        back.cast("long").alias("returned_cents"), F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_shipdate").cast("date").alias("last_day"),
    )


@query("""
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS month, o_orderstatus AS s, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY ALL)
SELECT year, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(CASE WHEN s = 'F' THEN n ELSE 0 END) AS BIGINT) AS closed, count(DISTINCT month) AS months_reported, count(DISTINCT month) = 12 AS whole_year FROM y GROUP BY 1
""")
def yearly_summary(read):
    """Monthly counts summed to years, with how many months were reported (AG-16, AG-57, NF-10)."""
    closed = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("long")
    months = F.count_distinct(F.month("o_orderdate"))
    return read("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.sum(cents("o_totalprice")).alias("cents"), closed.alias("closed"), months.alias("months_reported"), (months == 12).alias("whole_year"))


@query("""
SELECT c_mktsegment, count(*) AS n, count(CASE WHEN c_acctbal >= 0 THEN 1 END) AS with_value, min(c_acctbal) FILTER (c_acctbal >= 0) AS least, quantile_cont(c_acctbal, 0.5) FILTER (c_acctbal >= 0) AS median, max(c_acctbal) FILTER (c_acctbal >= 0) AS most FROM customer GROUP BY 1
""")
def compensation_summary(read):
    """How many have a value, and its least, median and most (AG-20)."""
    value = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    rows = read("customer").withColumn("v", value)
    sums = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("v").alias("with_value"), F.min("v").alias("least"), F.max("v").alias("most"))
    middle = A.quantiles(rows, ["c_mktsegment"], "v", {"median": 0.5}).drop("n").withColumnRenamed("c_mktsegment", "of")
    return sums.join(middle, F.col("c_mktsegment").eqNullSafe(F.col("of")), "left").drop("of")


@query("""
WITH g AS (SELECT n_regionkey, c_nationkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT n_regionkey AS region, string_agg(c_nationkey || ':' || n, ' ' ORDER BY n DESC, c_nationkey) AS members, CAST(sum(n) AS BIGINT) AS total, count(*) AS groups FROM g GROUP BY 1
""")
def nested_groups(read):
    """Groups nested as arrays, the largest first (AG-22, AM-01)."""
    g = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c_nationkey")))
    text = F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["c_nationkey"], -s["m"])), " ")
    return g.groupBy(F.col("n_regionkey").alias("region")).agg(text.alias("members"), F.sum("n").alias("total"), F.count("*").alias("groups"))


@query("""
SELECT o_orderpriority, CAST(sum(w * d) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS weighted_mean, CAST(sum(CASE WHEN d > 30 THEN w ELSE 0 END) AS BIGINT) AS beyond_30, CAST(sum(CASE WHEN d > 90 THEN w ELSE 0 END) AS BIGINT) AS beyond_90
FROM (SELECT o_orderpriority, CAST(l_quantity AS BIGINT) AS w, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1
""")
def weighted_access(read):
    """A mean weighed by people, and how many live beyond thresholds (AG-28, AG-35)."""
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", F.col("l_quantity").cast("long").alias("w"), F.datediff("l_shipdate", "o_orderdate").alias("d"))
    beyond = lambda k: F.sum(F.when(F.col("d") > k, F.col("w")).otherwise(0)).cast("long").alias(f"beyond_{k}")
    return rows.groupBy("o_orderpriority").agg((F.sum(F.col("w") * F.col("d")).cast("double") / F.sum("w").cast("double")).alias("weighted_mean"), beyond(30), beyond(90))


@query("""
WITH t AS (SELECT c_nationkey AS nation, c_mktsegment AS party, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT *, n * 100 >= 18 * sum(n) OVER (PARTITION BY nation) AS big FROM t)
SELECT nation, CASE WHEN big THEN party ELSE 'other' END AS party, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2
""")
def folded_parties(read):
    """Totals by party, those below a share of their unit folded into other (AG-40)."""
    t = read("customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("party")).agg(F.count("*").alias("n"))
    big = F.col("n") * 100 >= 18 * F.sum("n").over(Window.partitionBy("nation"))
    return t.withColumn("party", F.when(big, F.col("party")).otherwise("other")).groupBy("nation", "party").agg(F.sum("n").alias("n"))


@query("""
WITH m AS (SELECT c_nationkey AS unit, n_regionkey AS region, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cost FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT region, count(*) AS units, string_agg(CAST(unit AS VARCHAR), ',' ORDER BY unit) AS members, CAST(sum(cost) - max(cost) AS BIGINT) AS savings, arg_max(unit, {'c': cost, 'u': -unit}) AS seat FROM m GROUP BY 1
""")
def region_savings(read):
    """Units and members of a region, and what it saves: all members' cost less the seat's (AG-43, AG-21)."""
    m = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_nationkey").alias("unit"), F.col("n_regionkey").alias("region")).agg(F.sum(cents("c_acctbal")).alias("cost"))
    members = F.array_join(F.transform(F.array_sort(F.collect_list("unit")), lambda u: u.cast("string")), ",")
    return m.groupBy("region").agg(F.count("*").alias("units"), members.alias("members"), (F.sum("cost") - F.max("cost")).alias("savings"), F.max_by("unit", F.struct("cost", -F.col("unit"))).alias("seat"))


@query("""
WITH v AS (SELECT l_linenumber, CASE WHEN c % 100 = 0 THEN 0 WHEN c % 10 = 0 THEN 1 ELSE 2 END AS decimals FROM (SELECT l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem))
SELECT l_linenumber, decimals, count(*) AS n FROM v GROUP BY 1, 2
""")
def decimal_places(read):
    """How many decimals values have (AG-44)."""
    c = cents("l_extendedprice")
    return read("lineitem").groupBy("l_linenumber", F.when(c % 100 == 0, 0).when(c % 10 == 0, 1).otherwise(2).alias("decimals")).agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT c_mktsegment, n_regionkey, floor((c_acctbal + 1000) / 2200) AS bin, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY c_mktsegment, n_regionkey) AS share FROM h)
SELECT c_mktsegment, CAST(bin AS BIGINT) AS bin, round(sum((n_regionkey + 1) * share) / 15, 9) AS share FROM f GROUP BY 1, 2
""")
def blended_histograms(read):
    """Histograms as fractions, blended by weights of their groups (AG-37, AM-05)."""
    h = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("c_mktsegment", "n_regionkey", F.floor((F.col("c_acctbal") + 1000) / 2200).alias("bin")).agg(F.count("*").alias("n"))
    f = h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment", "n_regionkey")))
    return f.groupBy("c_mktsegment", "bin").agg(F.round(F.sum((F.col("n_regionkey") + 1) * F.col("share")) / 15, 9).alias("share"))


@query("""
WITH b AS (SELECT l_suppkey, CAST(sum(c * 9) AS BIGINT) AS low, CAST(sum(c * 10) AS BIGINT) AS central, CAST(sum(c * 12) AS BIGINT) AS high, CAST(sum(q) AS BIGINT) AS q FROM (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1)
SELECT l_suppkey, low, central, high, CAST(low AS DOUBLE) / q AS low_per_unit, CAST(central AS DOUBLE) / q AS central_per_unit, CAST(high AS DOUBLE) / q AS high_per_unit FROM b
""")
def band_sums(read):
    """Sums of low, central and high estimates, and ratios formed anew from the sums (AG-39)."""
    c = cents("l_extendedprice")
    sums = [F.sum(c * k).alias(name) for name, k in (("low", 9), ("central", 10), ("high", 12))]
    b = read("lineitem").groupBy("l_suppkey").agg(*sums, F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return b.select("l_suppkey", "low", "central", "high", *[N.ratio(F.col(x).cast("double"), F.col("q")).alias(f"{x}_per_unit") for x in ("low", "central", "high")])


@query("""
WITH p AS (SELECT c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS a, CASE WHEN c_custkey % 7 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) + c_custkey END AS b FROM customer)
SELECT nation, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS complete, CAST(sum(b) FILTER (a IS NOT NULL) AS DOUBLE) / CAST(sum(a) FILTER (b IS NOT NULL) AS DOUBLE) AS ratio, avg(CAST(b AS DOUBLE)) AS mean_b, CASE WHEN count(b) = count(*) THEN CAST(sum(b) AS BIGINT) END AS strict_sum FROM p GROUP BY 1
""")
def complete_pairs(read):
    """A ratio of sums over rows where both are known, a mean over those known, a sum that any null spoils (AG-54, AG-55)."""
    a = cents("c_acctbal")
    p = read("customer").select(F.col("c_nationkey").alias("nation"), a.alias("a"), F.when(F.col("c_custkey") % 7 != 0, a + F.col("c_custkey")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    own = lambda c: F.sum(F.when(both, F.col(c))).cast("double")
    return p.groupBy("nation").agg(F.count(F.when(both, 1)).alias("complete"), (own("b") / own("a")).alias("ratio"), F.avg(F.col("b").cast("double")).alias("mean_b"), A.strict_sum(F.col("b")).alias("strict_sum"))


@query("""
SELECT 'national' AS scope, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders UNION ALL
SELECT o_orderstatus, count(*), CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders GROUP BY 1 UNION ALL
SELECT 'selected', count(*), CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders WHERE o_orderstatus <> 'P'
""")
def scope_views(read):
    """The whole, each unit and a selection in one shape; each row counts once for each scope that holds it (AG-56, PF-23)."""
    status = F.col("o_orderstatus")
    scope = F.explode(F.array_compact(F.array(F.lit("national"), status, F.when(status != "P", "selected"))))
    return read("orders").select(scope.alias("scope"), cents("o_totalprice").alias("c")).groupBy("scope").agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("""
WITH b AS (SELECT n_regionkey AS region, c_custkey % 10 AS hours, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT region, CAST(sum(n * hours) AS BIGINT) AS before, CAST(sum(n * greatest(0, hours - 3)) AS BIGINT) AS after, CAST(sum(n * hours) - sum(n * greatest(0, hours - 3)) AS BIGINT) AS saved, CAST(sum(n * greatest(0, hours - 3)) AS DOUBLE) / CAST(sum(n * hours) AS DOUBLE) AS ratio FROM b GROUP BY 1
""")
def hours_saved(read):
    """Totals before and after, what is saved, and the ratio of sums (AG-51)."""
    h = F.col("c_custkey") % 10
    rows = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("region"), h.alias("h"), F.greatest(F.lit(0), h - 3).alias("g"))
    before, after = F.sum("h"), F.sum("g")
    return rows.groupBy("region").agg(before.alias("before"), after.alias("after"), (before - after).alias("saved"), (after.cast("double") / before.cast("double")).alias("ratio"))


@query(f"""
WITH {_DURATIONS}, c AS (SELECT l_returnflag, t, count(*) AS leave, count(CASE WHEN e THEN 1 END) AS events FROM d WHERE t >= 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(leave) OVER (PARTITION BY l_returnflag ORDER BY t DESC) AS BIGINT) AS at_risk FROM c),
s AS (SELECT *, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0.0 END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY l_returnflag ORDER BY t))
SELECT l_returnflag, CAST(sum(leave) AS BIGINT) AS n, CAST(min(t) FILTER (survival <= 0.5) AS BIGINT) AS median,
  CASE WHEN max(t) >= 30 THEN round(coalesce(min(survival) FILTER (t <= 30), 1.0), 9) END AS at_30, CASE WHEN max(t) >= 100 THEN round(coalesce(min(survival) FILTER (t <= 100), 1.0), 9) END AS at_100, CASE WHEN max(t) >= 5000 THEN round(coalesce(min(survival) FILTER (t <= 5000), 1.0), 9) END AS at_5000
FROM s GROUP BY 1
""")
def survival_summary(read):
    """Median and marks of a survival curve; marks past the last follow-up are null (MO-01)."""
    return M.survival_marks(_durations(read), ["l_returnflag"], "t", "e", [30, 100, 5000])


@query("""
WITH r AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_partkey, l_discount) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(d) AS BIGINT) AS n, list_reduce(list_prepend(1000000.0, d), lambda a, x: floor(a * (1 + x))) AS amount FROM r
""")
def compounded(read):
    """An amount raised step by step, rounded down at every step (WN-13)."""
    return W.compound(read("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], 1_000_000.0, "l_discount")


@query("""
WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, count(*) AS n FROM orders GROUP BY ALL), y AS (SELECT DISTINCT year FROM p), k AS (SELECT DISTINCT o_custkey FROM orders)
SELECT y.year, k.o_custkey, last_value(n IGNORE NULLS) OVER (PARTITION BY k.o_custkey ORDER BY y.year ROWS UNBOUNDED PRECEDING) AS carried FROM y CROSS JOIN k LEFT JOIN p ON p.year = y.year AND p.o_custkey = k.o_custkey
""")
def carried_forward(read):
    """How many orders a customer had in each year, the last known number carried forward where a year has none (WN-12)."""
    orders = read("orders").withColumn("year", F.year("o_orderdate"))
    own = orders.groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    years = sorted(r.year for r in own.select("year").distinct().collect())  # as few as years
    grid = own.select("o_custkey").distinct().withColumn("year", F.explode(F.lit(years)))
    w = Window.partitionBy("o_custkey").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(own, ["o_custkey", "year"], "left").select("year", "o_custkey", F.last("n", ignorenulls=True).over(w).alias("carried"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 10 <= 5 THEN p_size - p_size % 10 ELSE p_size - p_size % 10 + 10 END AS snapped, p_size BETWEEN 8 AND 40 AND p_retailprice <= 950 AS valid FROM part
""")
def snapped_values(read):
    """Values at their nearest grid point, ties to the lower, and whether they lie in their valid range (PF-24, PF-12)."""
    low = F.col("p_size") - F.col("p_size") % 10
    return read("part").select("p_partkey", F.when(F.col("p_size") - low <= 5, low).otherwise(low + 10).alias("snapped"), (F.col("p_size").between(8, 40) & (F.col("p_retailprice") <= 950)).alias("valid"))


# --- Texts, dates, numbers -------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 5 AS k FROM orders), m AS (SELECT ['ianuarie', 'februarie', 'martie', 'aprilie', 'mai', 'iunie', 'iulie', 'august', 'septembrie', 'octombrie', 'noiembrie', 'decembrie'] AS names)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d.%m.%Y') WHEN 2 THEN strftime(d, '%d%m%Y') WHEN 3 THEN CAST(day(d) AS VARCHAR) || ' ' || names[month(d)] || ' ' || CAST(year(d) AS VARCHAR) ELSE '31.02.' || CAST(year(d) AS VARCHAR) END AS text,
  CASE WHEN k < 4 THEN CAST(d AS DATE) END AS day, CASE WHEN k = 0 THEN month(d) END AS month FROM t, m
""")
def parsed_dates(read):
    """Dates in four forms, none where there is no such day; periods as year and month (NF-05, NF-06, NF-07)."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    name = F.element_at(F.array(*map(F.lit, D.MONTHS)), F.month(d))
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, F.date_format(d, "ddMMyyyy")).when(k == 3, F.concat_ws(" ", F.dayofmonth(d), name, F.year(d))).otherwise(F.concat(F.lit("31.02."), F.year(d)))
    rows = read("orders").select("o_orderkey", text.alias("text"))
    month = D.period(F.when(F.col("text").rlike("^[0-9]{4}-"), F.substring("text", 1, 7)))["month"]
    return rows.select("o_orderkey", "text", D.any_date(F.col("text")).alias("day"), month.alias("month"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 100 WHEN l_linenumber % 3 = 2 AND round(l_discount * 100) <= 1 THEN round(l_discount * 100) * 100 ELSE round(l_discount * 100) END AS percent FROM lineitem
""")
def parsed_percents(read):
    """Percents written as a share, with a sign or with a decimal comma; a number up to 1 without a sign is a share (NF-02)."""
    whole = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount").cast("string")).when(F.col("l_linenumber") % 3 == 1, F.concat(whole, F.lit(" %"))).otherwise(F.concat(whole, F.lit(",0")))
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.percent(text).alias("percent"))


@query("""
SELECT event_id, (hour(ts) * 60 + minute(ts)) AS start_minute, ((hour(ts) * 60 + minute(ts) + 500) % 1440 - (hour(ts) * 60 + minute(ts)) + 1440) % 1440 AS minutes FROM events
""")
def clock_minutes(read):
    """Clock times in minutes, and how long it is from one to another, past midnight too (NF-09)."""
    end = (F.hour("ts") * 60 + F.minute("ts") + 500) % 1440
    clock = F.format_string("%02d.%02d", F.floor(end / 60), end % 60)
    rows = read("events").select("event_id", N.clock_minutes(F.date_format("ts", "HH:mm")).alias("start_minute"), N.clock_minutes(clock).alias("end"))
    return rows.select("event_id", "start_minute", D.wrapped_minutes(F.col("start_minute"), F.col("end")).alias("minutes"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' ' || p_name), '^(economy|standard) ', ''), '\\bsmall\\b', 'sm.', 'g') AS key, replace(lower(p_brand), '#', '-') || '-' || replace(p_name, ' ', '-') AS slug,
  CASE p_size % 5 WHEN 0 THEN 'V' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' ELSE 'IV' END AS rank FROM part
""")
def stripped_names(read):
    """Names without their kind, abbreviated, as slugs, with ranks in Roman numerals (SF-05, SF-06, SF-17)."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", "p_type", "p_name")), "^(economy|standard) ", ""), "\\bsmall\\b", "sm.")
    rank = F.element_at(F.array(*map(F.lit, ("V", "I", "II", "III", "IV"))), F.col("p_size") % 5 + 1)
    return read("part").select("p_partkey", key.alias("key"), X.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), rank.alias("rank"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'art. ' || CAST(o_custkey AS VARCHAR) || ' C.pen.' WHEN 1 THEN 'art.' || CAST(o_custkey AS VARCHAR) || ' alin. 2 Legea nr. ' || CAST(o_orderkey % 300 AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN 'art. 244 NCP' ELSE o_orderpriority END AS text FROM orders)
SELECT o_orderkey, CASE WHEN text LIKE '%Legea%' THEN regexp_extract(text, 'nr\\. ([0-9]+/[0-9]{4})', 1) WHEN text LIKE '%C.pen.%' OR text LIKE '%NCP%' THEN 'penal code' END AS source, CASE WHEN text LIKE 'art%' THEN CAST(regexp_extract(text, '^art\\. ?([0-9]+)', 1) AS INTEGER) END AS article FROM t
""")
def statutes(read):
    """A charge's statute: a code or a law by number and year, and the article (SF-07)."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("art. "), F.col("o_custkey"), F.lit(" C.pen."))).when(k % 4 == 1, F.concat(F.lit("art."), F.col("o_custkey"), F.lit(" alin. 2 Legea nr. "), k % 300, F.lit("/"), F.year("o_orderdate")))
        .when(k % 4 == 2, "art. 244 NCP").otherwise(F.col("o_orderpriority"))
    )
    return read("orders").select("o_orderkey", text.alias("text")).select("o_orderkey", X.statute_source(F.col("text")).alias("source"), X.statute_article(F.col("text")).alias("article"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN true ELSE false END AS is_address FROM customer
""")
def street_addresses(read):
    """Which texts are street addresses: a kind of street, or a number after a name (SF-13)."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Str. Lalelelor "), k)).when(k % 3 == 1, F.concat(F.lit("B-dul Unirii nr. "), k)).otherwise(F.col("c_mktsegment"))
    return read("customer").select("c_custkey", X.is_address(text).alias("is_address"))


# --- Maps and arrays ---------------------------------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT l_suppkey AS k, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY 1)
SELECT k AS l_suppkey, 'A' AS code, a - r AS net FROM m UNION ALL SELECT k, 'N', n - r FROM m UNION ALL SELECT k, 'R', 0 FROM m
""")
def map_arithmetic(read):
    """Values by category as a map, arithmetic on it, and back to rows (AM-02, AM-06)."""
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "q"))))
    m = read("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).groupBy("l_suppkey").agg(each.alias("m"))
    full = F.map_zip_with("m", F.create_map(*[x for k in "ANR" for x in (F.lit(k), F.lit(0).cast("long"))]), lambda k, a, b: F.coalesce(a, b))
    m = m.withColumn("m", full)
    return m.select("l_suppkey", F.explode(F.transform_values("m", lambda k, v: v - F.col("m")["R"])).alias("code", "net"))


@query("""
WITH v AS (SELECT DISTINCT p_brand, p_type, p_size % 3 AS s FROM part), n AS (SELECT p_brand, count(*) AS variants, count(DISTINCT p_type) AS types FROM v GROUP BY 1)
SELECT p_brand, variants, types, CAST((SELECT count(*) FROM part p WHERE p.p_brand = n.p_brand) AS BIGINT) - variants AS repeated FROM n
""")
def variant_dedup(read):
    """Variants told apart by their dimensions; repeated ones are counted (AM-07)."""
    dims = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), (F.col("p_size") % 3).cast("string"))
    own = F.to_json(dims)
    return read("part").groupBy("p_brand").agg(F.count_distinct(own).alias("variants"), F.count_distinct(F.get_json_object(own, "$.type")).alias("types"), (F.count("*") - F.count_distinct(own)).alias("repeated"))


@query("""
WITH RECURSIVE t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 2 END AS parent FROM customer),
r AS (SELECT node, CAST(node AS VARCHAR) AS path, CAST(0 AS BIGINT) AS hops FROM t WHERE parent IS NULL UNION ALL SELECT t.node, path || '>' || CAST(t.node AS VARCHAR), hops + 1 FROM t JOIN r ON t.parent = r.node)
SELECT node, path, hops FROM r
""")
def parent_paths(read):
    """The chain from the root to each node, from pointers to parents (AM-09)."""
    k = F.col("c_custkey").cast("long")
    tree = read("customer").select(k.alias("node"), F.when(k > 0, F.floor((k - 1) / 2)).cast("long").alias("parent"))
    return M.parent_chains(tree)


# --- Places ------------------------------------------------------------------------------------------------------------------

#: Places in a strip 1,000 wide that grows with the tables, so that no square holds more of them in a larger one.
_POINTS = "p AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer)"
_RINGS = "n AS (SELECT s_suppkey AS ring_id, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS cx, 15.0 * s_suppkey AS cy, 60.0 + s_suppkey % 25 AS r FROM supplier)"


def _points(read):
    return read("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("x"), F.col("c_custkey").cast("double").alias("y"))


def _rings(read):
    """A diamond around each supplier."""
    s = F.col("s_suppkey")
    cx, cy, r = (s * 53 % 1000).cast("double"), 15.0 * s, (60 + s % 25).cast("double")
    at = lambda dx, dy: F.struct((cx + dx * r).alias("x"), (cy + dy * r).alias("y"))
    return read("supplier").select(s.alias("ring_id"), F.array(at(1, 0), at(0, 1), at(-1, 0), at(0, -1)).alias("ring"))


@query(f"""
WITH {_POINTS}, {_RINGS}
SELECT id, ring_id FROM p JOIN n ON abs(x + 0.5 - cx) + abs(y + 0.25 - cy) < r
""")
def points_in_polygons(read):
    """Which polygons hold which points, met on grid cells (SP-05, SP-08)."""
    points = _points(read).withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.25})  # none lies on an edge
    return P.within(points, _rings(read), 100.0).select("id", "ring_id")


@query(f"WITH {_RINGS} SELECT ring_id, 2.0 * r * r AS area, cx AS x, cy AS y, round(pi() * 8 * r * r / pow(4 * sqrt(2.0) * r, 2), 9) AS compactness FROM n")
def polygon_measures(read):
    """Area, centroid and compactness of polygons (SP-04, SP-12)."""
    ring = F.col("ring")
    c = P.centroid(ring)
    return _rings(read).select("ring_id", F.round(P.signed_area(ring), 6).alias("area"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"), F.round(P.compactness(P.signed_area(ring), P.perimeter(ring)), 9).alias("compactness"))


@query(f"""
WITH {_POINTS}, s AS (SELECT s_suppkey AS site, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS sx, 15.0 * s_suppkey AS sy FROM supplier),
d AS (SELECT id, site, sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) AS metres FROM p, s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, site) AS place FROM d WHERE metres <= 250)
SELECT id, site, round(metres, 6) AS metres, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5
""")
def nearest_sites(read):
    """The five nearest sites within reach of each point (SP-02, SP-07, SP-09, TK-05)."""
    sites = read("supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 53 % 1000).cast("double").alias("sx"), (15.0 * F.col("s_suppkey")).alias("sy"))
    return P.nearest(_points(read), sites, 5, 250.0).withColumn("metres", F.round("metres", 6))


@query("""
SELECT s_suppkey, round(radians(CAST(s_suppkey * 7 % 360 AS DOUBLE) - 180) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(CAST(s_suppkey % 80 AS DOUBLE)) / 2)) * 6378137.0, 4) AS y, (s_suppkey * 7 % 360) - 180 BETWEEN 20 AND 30 AND s_suppkey % 80 BETWEEN 43 AND 49 AS inside FROM supplier
""")
def projected_places(read):
    """Places on a web map, and whether they lie in the country's box (SP-03, PF-13)."""
    lon, lat = (F.col("s_suppkey") * 7 % 360).cast("double") - 180, (F.col("s_suppkey") % 80).cast("double")
    return read("supplier").select("s_suppkey", F.round(P.mercator_x(lon), 4).alias("x"), F.round(P.mercator_y(lat), 4).alias("y"), (lon.between(20, 30) & lat.between(43, 49)).alias("inside"))
