"""Queries of offices' registers: titles, joined vocabularies, priorities, landed and streamed marts, gates; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources import sinks as K
from ..sources import tables as T
from ..sources.shared import shared_path
from ..streaming import events as E
from .queries import cents, query
from .shapes import _LINES, _SHARDS, _lines, _sharded

# --- Titles and vocabularies -------------------------------------------------------------------------------------------------

_HEADS = "SMALL|RED|BLUE|HOT|COLD|LARGE|NEW"
#: DuckDB's form of the parts of a text at a separator, trimmed, without empty ones.
_PARTS = "list_filter(list_transform(string_split(raw, '{0}'), lambda t: regexp_replace(t, '^[ .;,/]+|[ .;,/]+$', '', 'g')), lambda t: t <> '')"
_IS = f"regexp_matches(upper({{0}}), '^(?:{_HEADS})\\b')"


@query(f"""
WITH n AS (SELECT p_brand, p_size, p_name, min(p_type) AS type FROM part GROUP BY ALL),
c AS (SELECT p_brand, p_size, replace(string_agg(p_name, ';  ' ORDER BY p_name), ';  ', CASE p_size % 3 WHEN 0 THEN ';  ' WHEN 1 THEN ', ' ELSE '/' END) || CASE WHEN p_size % 6 = 0 THEN ', ' || lower(min(type)) ELSE '' END AS cell FROM n GROUP BY 1, 2),
r AS (SELECT *, trim(regexp_replace(trim(regexp_replace(cell, '\\s+', ' ', 'g')), '^[;,\\s]+|[;,\\s]+$', '', 'g')) AS raw FROM c),
p AS (SELECT *, {_PARTS.format(";")} AS s, {_PARTS.format(",")} AS k, {_PARTS.format("/")} AS l FROM r),
q AS (SELECT *, trim(split_part(s[-1], ',', 1)) AS head, trim(regexp_replace(s[-1], '^[^,]*,', '')) AS tail FROM p),
h AS (SELECT *, contains(s[-1], ',') AND {_IS.format("head")} AND NOT {_IS.format("tail")} AS qualified FROM q),
o AS (SELECT *, CASE WHEN qualified THEN list_append(s[:-2], head) ELSE s END AS own FROM h),
a AS (SELECT *, len(own) > 1 AND len(list_filter(own, lambda t: NOT {_IS.format("t")})) = 0 AS all_s, len(k) > 1 AND len(list_filter(k, lambda t: NOT {_IS.format("t")})) = 0 AS all_k, len(l) > 1 AND len(list_filter(l, lambda t: NOT {_IS.format("t")})) = 0 AS all_l FROM o),
t AS (SELECT *, CASE WHEN contains(raw, ';') THEN CASE WHEN len(s) < 2 THEN 'single' WHEN NOT all_s THEN 'needs_review' WHEN qualified THEN 'mixed' ELSE 'semicolon' END
  WHEN contains(raw, ',') THEN CASE WHEN all_k THEN 'comma' ELSE 'single' END WHEN contains(raw, '/') AND all_l THEN 'slash' ELSE 'single' END AS kind FROM a)
SELECT p_brand, p_size, kind, array_to_string(CASE kind WHEN 'mixed' THEN own WHEN 'semicolon' THEN own WHEN 'comma' THEN k WHEN 'slash' THEN l ELSE [raw] END, '|') AS titles, CASE WHEN kind = 'mixed' THEN tail END AS qualifier FROM t
""")
def title_cells(read):
    """Cells that list several titles, in the separators of different offices, split to titles and their common qualifier; what
    must not be split is marked (SF-16)."""
    names = read("part").groupBy("p_brand", "p_size", "p_name").agg(F.min("p_type").alias("type"))
    joined = F.array_join(F.array_sort(F.collect_list("p_name")), ";  ")
    cells = names.groupBy("p_brand", "p_size").agg(joined.alias("names"), F.min("type").alias("type"))
    k = F.col("p_size") % 3
    cell = F.concat(F.when(k == 0, F.col("names")).when(k == 1, F.replace("names", F.lit(";  "), F.lit(", "))).otherwise(F.replace("names", F.lit(";  "), F.lit("/"))), F.when(F.col("p_size") % 6 == 0, F.concat(F.lit(", "), F.lower("type"))).otherwise(""))
    out = cells.select("p_brand", "p_size", X.titles(cell, _HEADS).alias("t"))
    return out.select("p_brand", "p_size", "t.kind", F.array_join("t.titles", "|").alias("titles"), "t.qualifier")


@query("""
WITH a AS (SELECT regexp_replace(upper(p_brand || p_type), '[^A-Z0-9]', '', 'g') AS key, count(*) AS v FROM part GROUP BY 1),
l AS (SELECT regexp_replace(upper(CASE p_type WHEN 'SMALL' THEN 'S' WHEN 'PROMO' THEN p_type || 'X' ELSE p_type END || ''), '[^A-Z0-9]', '', 'g') AS t, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS b, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
r AS (SELECT b || CASE WHEN t = 'S' AND b IN ('BRAND1', 'BRAND2', 'BRAND3') THEN 'SMALL' ELSE t END AS key, v FROM l),
j AS (SELECT coalesce(a.key, r.key) AS key, a.v AS "left", r.v AS "right", a.key IS NOT NULL AND r.key IS NOT NULL AS m FROM a FULL JOIN r ON a.key = r.key),
t AS (SELECT sum("left") AS l, sum("right") AS r FROM j WHERE m)
SELECT key, CASE WHEN m THEN 'matched' WHEN "left" IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status, "left", "right", CASE WHEN m AND "right" <> 0 THEN CAST("left" AS DOUBLE) / "right" END AS ratio,
  CASE WHEN m THEN CAST("left" AS DOUBLE) / CAST(l AS DOUBLE) END AS left_share, CASE WHEN m THEN CAST("right" AS DOUBLE) / CAST(r AS DOUBLE) END AS right_share, CASE WHEN m THEN CAST("left" AS DOUBLE) / CAST(l AS DOUBLE) - CAST("right" AS DOUBLE) / CAST(r AS DOUBLE) END AS divergence FROM j, t
""")
def compared_offices(read):
    """The register of brands and kinds against what was sold, named differently: a folded key with aliases, shares of the matched
    alone, and what only one of them has (JN-08, SF-04)."""
    left = read("part").groupBy(F.concat("p_brand", F.lit(" "), F.lower("p_type")).alias("name")).agg(F.count("*").alias("v"))
    kind = F.when(F.col("p_type") == "SMALL", "S").when(F.col("p_type") == "PROMO", "Promo-X").otherwise(F.initcap("p_type"))
    sold = read("lineitem").join(read("part"), F.col("p_partkey") == F.col("l_partkey"))
    right = sold.groupBy(F.concat(F.upper("p_brand"), F.lit("/ "), kind).alias("name")).agg(F.sum("l_quantity").cast("long").alias("v"))
    aliases = {f"BRAND{k}S": f"BRAND{k}SMALL" for k in (1, 2, 3)}
    return J.compared_registers(left, right, "name", "v", "v", aliases)


# --- Measures ----------------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cost, CAST(sum(l_quantity * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS hours FROM lineitem GROUP BY 1),
e AS (SELECT *, CAST(cost AS DOUBLE) / hours AS each FROM s WHERE hours > 0), w AS (SELECT *, row_number() OVER o AS place, CAST(sum(cost) OVER o AS BIGINT) AS cost_so_far, CAST(sum(hours) OVER o AS BIGINT) AS benefit_so_far, sum(hours) OVER () AS t FROM e WINDOW o AS (ORDER BY each, l_suppkey))
SELECT l_suppkey, cost, hours, each, place, cost_so_far, benefit_so_far, CAST(benefit_so_far AS DOUBLE) / CAST(t AS DOUBLE) AS share FROM w
""")
def cost_per_hour(read):
    """What an hour saved costs with each supplier, the cheapest first, and how far the money goes (MO-13)."""
    hours = F.sum((F.col("l_quantity") * F.round(F.col("l_discount") * 100)).cast("long"))
    sums = read("lineitem").groupBy("l_suppkey").agg(F.sum(cents("l_extendedprice")).alias("cost"), hours.alias("hours"))
    return W.priority_curve(sums, [], "l_suppkey", "cost", "hours")


@query("""
WITH t AS (SELECT n_regionkey AS region, c_custkey % 97 + c_custkey % 10 AS h, greatest(0, c_custkey % 97 - 3) AS g FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT region, count(*) AS n, CAST(sum(h) AS BIGINT) AS before, CAST(sum(g) AS BIGINT) AS after, CAST(sum(h) - sum(g) AS BIGINT) AS saved, CAST(sum(g) AS DOUBLE) / CAST(sum(h) AS DOUBLE) AS ratio, quantile_cont(h, 0.5) AS median_before, quantile_cont(g, 0.5) AS median_after FROM t GROUP BY 1
""")
def times_compared(read):
    """Hours before and after: totals, what is saved, the ratio of sums and both medians (AG-51)."""
    k = F.col("c_custkey")
    rows = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("region"), (k % 97 + k % 10).alias("h"), F.greatest(F.lit(0), k % 97 - 3).alias("g"))
    return A.before_after(rows, ["region"], "h", "g")


@query("""
WITH o AS (SELECT o_orderpriority AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(round(o_totalprice * 100) AS BIGINT)) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
d AS (SELECT p, n, q, (n + 1) * q / 10.0 AS spot, greatest(1, least(CAST(floor((n + 1) * q / 10.0) AS BIGINT), n - 1)) AS j FROM (SELECT DISTINCT p, n FROM o), (SELECT unnest([1, 5, 9]) AS q) WHERE n >= 9),
x AS (SELECT d.p, d.n, q, a.v + (b.v - a.v) * CAST(spot - j AS DOUBLE) AS v FROM d JOIN o a ON a.p = d.p AND a.k = j JOIN o b ON b.p = d.p AND b.k = j + 1),
y AS (SELECT p, n, max(v) FILTER (q = 1) AS p10, max(v) FILTER (q = 5) AS p50, max(v) FILTER (q = 9) AS p90 FROM x GROUP BY 1, 2)
SELECT p AS o_orderpriority, n, p10, p50, p90, CAST((SELECT max(v) FROM o WHERE o.p = y.p) AS DOUBLE) / (SELECT min(v) FROM o WHERE o.p = y.p) AS most_to_least, p90 / p10 AS p90_to_p10 FROM y
""")
def price_deciles(read):
    """The spread of a group by exclusive deciles: the most to the least, and the ninth to the first (AG-29)."""
    return A.decile_spread(read("orders").select("o_orderpriority", cents("o_totalprice").alias("v")), ["o_orderpriority"], "v")


@query("""
WITH v AS (SELECT o_orderpriority, CASE WHEN o_totalprice >= 400000 THEN 4 WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS band FROM orders),
g AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT g.o_orderpriority, t.b AS band, count(v.band) AS n FROM g CROSS JOIN range(5) t(b) LEFT JOIN v ON v.o_orderpriority = g.o_orderpriority AND v.band = t.b GROUP BY 1, 2)
SELECT o_orderpriority, CAST(band AS INTEGER) AS band, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY o_orderpriority) AS share, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY band) AS DOUBLE) / sum(n) OVER (PARTITION BY o_orderpriority) AS up_to FROM c
""")
def capped_bands(read):
    """How much of each section lies in and below each band of prices (AG-45)."""
    return A.band_shares(read("orders"), ["o_orderpriority"], "o_totalprice", [0, 100_000, 200_000, 300_000, 400_000])


@query("SELECT c_nationkey, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS b1, quantile_cont(c_acctbal, 0.5) AS b2, quantile_cont(c_acctbal, 0.75) AS b3 FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def map_breaks(read):
    """Quartiles of the positive values of each nation (AG-50)."""
    return A.colour_breaks(read("customer"), ["c_nationkey"], "c_acctbal")


@query("""
SELECT l_orderkey, arg_min(l_partkey, {'d': l_shipdate, 'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS l_partkey, max(l_extendedprice) AS l_extendedprice, count(*) AS matches FROM lineitem GROUP BY 1
""")
def collapsed_matches(read):
    """The first of an order's lines, and the largest price of all (AG-42, AG-41)."""
    return A.collapsed(read("lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"], ["l_extendedprice"])


@query(f"""
WITH {_LINES}, c AS (SELECT CASE WHEN abs(x2 - x1) >= 2 * abs(y2 - y1) THEN 'east-west' WHEN abs(y2 - y1) >= 2 * abs(x2 - x1) THEN 'north-south' ELSE 'diagonal' END AS class, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS metres FROM l)
SELECT class, count(*) AS lines, round(sum(metres), 3) AS metres, round(sum(metres) / (SELECT sum(metres) FROM c), 9) AS share FROM c GROUP BY 1
""")
def line_classes(read):
    """Lengths of lines by class, and each class's share of all (AG-52, AG-35)."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    kind = F.when(dx >= 2 * dy, "east-west").when(dy >= 2 * dx, "north-south").otherwise("diagonal")
    rows = _lines(read).select(kind.alias("class"), F.sqrt(dx * dx + dy * dy).alias("metres"))
    sums = rows.groupBy("class").agg(F.count("*").alias("lines"), F.sum("metres").alias("m"))
    total = sums.agg(F.sum("m").alias("__all"))  # one row
    return sums.join(F.broadcast(total)).select("class", "lines", F.round("m", 3).alias("metres"), F.round(F.col("m") / F.col("__all"), 9).alias("share"))


@query("""
WITH q AS (SELECT 'C' || (user_id % 3) AS currency, CAST(ts AS DATE) + INTERVAL 0 DAY AS quoted, max(value) AS rate FROM events WHERE value > 0 GROUP BY 1, 2),
o AS (SELECT o_orderkey, o_totalprice, 'C' || (o_custkey % 4) AS currency, o_orderdate + INTERVAL 25 YEAR AS day FROM orders),
r AS (SELECT o.*, q.rate FROM o ASOF LEFT JOIN q ON o.currency = q.currency AND o.day >= q.quoted)
SELECT o_orderkey, currency, CASE WHEN currency = 'C1' THEN 4.9 ELSE rate END AS rate, CASE WHEN currency = 'C1' THEN 'pinned' WHEN rate IS NOT NULL THEN 'live' END AS rate_source, round(o_totalprice / CASE WHEN currency = 'C1' THEN 4.9 ELSE rate END, 2) AS exchanged FROM r
""")
def exchanged_totals(read):
    """Amounts in other currencies by the rate of their day, or by the pinned one (NF-12, NF-13)."""
    rates = read("events").filter("value > 0").select(F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("currency"), F.col("ts").cast("date").cast("timestamp_ntz").alias("quoted"), F.col("value").alias("rate"))
    rows = read("orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("C"), (F.col("o_custkey") % 4).cast("string")).alias("currency"), F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL 25 YEAR").alias("day"))
    out = J.with_rates(rows, rates, "currency", "day", {"C1": 4.9})
    return out.select("o_orderkey", "currency", "rate", "rate_source", N.exchanged(F.col("o_totalprice"), F.col("rate")).alias("exchanged"))


# --- Landed and nested files -------------------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
SELECT 'case' AS "table", o_orderkey AS key, CAST(NULL AS BIGINT) AS place_line, CAST(NULL AS BIGINT) AS place_stage, o_orderstatus AS text, o_custkey AS number FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'line', l_orderkey, place, NULL, CAST(l_partkey AS VARCHAR), quantity FROM l
UNION ALL SELECT 'stage', l_orderkey, place, s, CASE s WHEN 0 THEN 'part' ELSE 'supplier' END, CASE s WHEN 0 THEN l_partkey ELSE l_suppkey END FROM l, range(2) t(s)
UNION ALL SELECT 'party', o_orderkey, 0, NULL, 'customer', o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def shredded_cases(read):
    """Cases as XML elements with lines, their stages and parties, parsed once to four flat tables (SC-12)."""
    stage = F.array(F.struct(F.lit("part").alias("what"), F.col("l_partkey").alias("who")), F.struct(F.lit("supplier").alias("what"), F.col("l_suppkey").alias("who")))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), stage.alias("stage")).alias("x"))
    lines = read("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["x"]).alias("line"))
    party = F.array(F.struct(F.lit("customer").alias("role"), F.col("o_custkey").alias("id"))).alias("party")
    cases = read("orders").join(lines, F.col("o_orderkey") == F.col("key")).select(F.to_xml(F.struct("key", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"), party, "line")).alias("xml"))
    schema = "key long, status string, owner long, party array<struct<role: string, id: long>>, line array<struct<part: long, quantity: long, stage: array<struct<what: string, who: long>>>>"
    t = T.shredded(cases, "xml", schema, ["key"], {"line": "line", "stage": "line.stage", "party": "party"}, ["status", "owner"])
    none = F.lit(None).cast("long")
    flat = lambda name, table, place_line, place_stage, text, number: t[table].select(F.lit(name).alias("table"), "key", place_line.cast("long").alias("place_line"), place_stage.cast("long").alias("place_stage"), F.col(text).cast("string").alias("text"), F.col(number).alias("number"))
    out = flat("case", "root", none, none, "status", "owner").unionByName(flat("line", "line", F.col("place_line"), none, "part", "quantity"))
    out = out.unionByName(flat("stage", "stage", F.col("place_line"), F.col("place_stage"), "what", "who"))
    return out.unionByName(flat("party", "party", F.col("place_party"), none, "role", "id"))


@query("""
WITH e AS (SELECT o_orderpriority AS key, max(year(o_orderdate)) AS y FROM orders GROUP BY 1)
SELECT o_orderpriority AS key, CAST(year(o_orderdate) AS VARCHAR) AS edition, o_orderkey FROM orders JOIN e ON key = o_orderpriority AND y = year(o_orderdate)
""")
def newest_editions(read):
    """Yearly editions of each section as zstd Parquet files, of which the newest are found by their paths and read back, no others
    (SC-04, SC-05, SK-01)."""
    rows = read("orders").select("o_orderkey", F.col("o_orderpriority").alias("section"), F.year("o_orderdate").alias("y"))
    path = shared_path(rows.sparkSession, "editions")
    K.parquet(rows, path, ["section", "y"])
    return T.newest_files(rows.sparkSession, path, "section=([^/]+)/y=([0-9]{4})/").select("key", "edition", "o_orderkey")


@query("SELECT c_custkey, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer")
def delimited_customers(read):
    """Delimited text with padded fields written and read back: required columns are there, fields are trimmed, blanks null (SC-06)."""
    rows = read("customer").select(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" ")).alias(" c_custkey "), F.concat(F.col("c_mktsegment"), F.lit("  ")).alias("c_mktsegment"), cents("c_acctbal").cast("string").alias("balance"), F.lit("   ").alias("blank"))
    path = shared_path(rows.sparkSession, "delimited")
    rows.write.option("header", True).option("sep", ";").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = T.delimited(rows.sparkSession, path, ["c_custkey", "balance"], ";")
    return back.filter("blank IS NULL").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", F.col("balance").cast("long").alias("balance"))


@query("""
WITH d AS (SELECT DISTINCT c_mktsegment AS v FROM customer), k AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM d)
SELECT c_custkey, code, v AS value FROM customer LEFT JOIN k ON v = c_mktsegment
""")
def interned_segments(read):
    """A column as codes and the list of its values, written as a mart and put together again (SK-03)."""
    coded, values = K.interned(read("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    spark = coded.sparkSession
    rows, words = shared_path(spark, "coded"), shared_path(spark, "values")
    K.parquet(coded, rows)
    K.parquet(values, words)
    return spark.read.parquet(rows).withColumnRenamed("c_mktsegment", "code").join(spark.read.parquet(words), "code", "left").select("c_custkey", "code", "value")


@query("""
WITH g AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_orderstatus, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, 'model|*|cents are rounded' || chr(10) || 'scope|cents|open cases count in full' AS limitations FROM g GROUP BY 1
""")
def gated_mart(read):
    """A mart that passes its schema and its fatal rules, with the limitations that travel with it (DQ-01, DQ-02, DQ-05)."""
    rows = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("cents"))
    rules = {"keyed": (F.col("o_orderkey").isNotNull(), True), "priced": (F.col("cents") > 0, True), "settled": (F.col("o_orderstatus") != "P", False)}
    K.gate(rows, "o_orderkey long, o_custkey long, o_orderstatus string, cents long", rules)
    sums = rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    out = K.with_limitations(sums, [("model", "*", "cents are rounded"), ("scope", "cents", "open cases count in full"), ("other", "absent", "never travels")])
    lines = F.transform("limitations", lambda x: F.concat_ws("|", x["id"], x["affects"], x["text"]))
    return out.withColumn("limitations", F.array_join(lines, "\n"))


@query(f"""
WITH RECURSIVE {_SHARDS} SELECT count(DISTINCT shard) AS collected, CAST(12 AS BIGINT) AS expected, false AS complete, DATE '1992-01-01' AS since, count(DISTINCT item) AS units, CAST(sum(weight) AS BIGINT) AS cases, CAST(sum(1 + weight // 10) AS BIGINT) AS calls, count(CASE WHEN weight > 14 THEN 1 END) AS incomplete FROM walk JOIN q USING (i)
""")
def shard_coverage(read):
    """The reports of twelve shards as one, complete only if all are; units cut short are counted (SK-07)."""
    own = _sharded(read).select("shard", F.lit("1992-01-01").cast("date").alias("since"), F.col("item").alias("unit"), F.col("weight").alias("cases"), (1 + F.floor(F.col("weight") / 10)).alias("calls"), (F.col("weight") <= 14).alias("unit_complete"))
    each = own.groupBy("shard").agg(F.bool_and("unit_complete").alias("complete")).withColumnRenamed("shard", "of")
    return K.merged_coverage(own.join(each, F.col("shard") == F.col("of")).drop("of"), 12)


# --- Streams -----------------------------------------------------------------------------------------------------------------


def _streamed(rows, name: str, each, files: int = 4) -> None:
    """Rows as files of a folder, read as a stream of several batches, each given to `each`; twice, as after a restart without
    its checkpoint."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
        stream.writeStream.foreachBatch(each).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()


@query("""
SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
""")
def streamed_last_events(read):
    """The last event of each person and type from a stream in batches that are run twice: the same as from the whole table
    (SM-02, SM-03)."""
    rows = read("events").select("user_id", "event_type", "event_id", "ts")
    path = shared_path(rows.sparkSession, "last_events")
    _streamed(rows, "events", E.upsert(path, ["user_id", "event_type"], ["ts", "event_id"]))
    out = E.upserted(rows.sparkSession, path, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
WITH m AS (SELECT DISTINCT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey % 7 AS people FROM orders),
s AS (SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN month(o_orderdate) <= 6 THEN make_date(year(o_orderdate), 6, 30) ELSE make_date(year(o_orderdate), 12, 31) END AS taken, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders WHERE o_orderstatus = 'P'),
n AS (SELECT year, max(taken) AS taken FROM s GROUP BY 1), a AS (SELECT s.year, unit, CAST(sum(amount) AS BIGINT) AS amount FROM s JOIN n ON n.year = s.year AND n.taken = s.taken GROUP BY 1, 2)
SELECT m.unit, m.year, people, CASE WHEN n.taken IS NULL THEN 0 ELSE coalesce(amount, 0) END AS amount, CASE WHEN n.taken IS NOT NULL AND people > 0 THEN CAST(coalesce(amount, 0) AS DOUBLE) / people END AS per_person, n.taken FROM m LEFT JOIN n USING (year) LEFT JOIN a ON a.year = m.year AND a.unit = m.unit
""")
def arrears_in_place(read):
    """Half-yearly snapshots of arrears brought into the years of a mart in place as they come, the latest of a year whole (SM-08)."""
    k, year = F.col("o_custkey"), F.year("o_orderdate").alias("year")
    mart = read("orders").select(k.alias("unit"), year, (k % 7).alias("people")).distinct().select("unit", "year", "people", F.lit(0).cast("long").alias("amount"), F.lit(None).cast("double").alias("per_person"), F.lit(None).cast("date").alias("taken"))
    spark = mart.sparkSession
    path = shared_path(spark, "arrears")
    mart.write.partitionBy("year").parquet(path)
    half = F.when(F.month("o_orderdate") <= 6, F.make_date(F.year("o_orderdate"), F.lit(6), F.lit(30))).otherwise(F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)))
    taken = read("orders").filter("o_orderstatus = 'P'").select(k.alias("unit"), year, half.alias("taken"), cents("o_totalprice").alias("amount"))
    # A snapshot comes in one piece: all of its rows are in one folder, and a batch takes whole folders.
    landed = shared_path(spark, "snapshots")
    taken.withColumn("half", F.col("taken")).repartition("half").write.partitionBy("half").parquet(landed)
    for _ in range(2):
        stream = spark.readStream.schema(taken.schema).option("maxFilesPerTrigger", 3).parquet(landed)
        stream.writeStream.foreachBatch(E.apply_snapshots(path, "unit", "amount", "people")).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(mart.schema).parquet(path)
