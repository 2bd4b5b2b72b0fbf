"""Queries of smaller operators: holes, marks, refusals, projections, prefixes, landed shards and documents; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as X
from ..operators import marts as MA
from ..operators import matching as MT
from ..operators import models as M
from ..operators import polygons as PG
from ..operators import ranges as R
from ..sources import sinks as K
from ..sources import tables as T
from ..sources.shared import shared_path
from .queries import _DURATIONS, _durations, cents, query
from .shapes import _NODES, _PARCELS, _homes, _parcels


@query(f"""
WITH {_PARCELS}, {_NODES}
SELECT q.id, CASE WHEN balance < 0 THEN 'debit' ELSE 'credit' END AS region FROM q JOIN parcel ON len(list_filter(range(1, 5), lambda s: (parcel.ring[s][2] > q.y) <> (parcel.ring[s % 4 + 1][2] > q.y)
  AND q.x < (parcel.ring[s % 4 + 1][1] - parcel.ring[s][1]) * (q.y - parcel.ring[s][2]) / (parcel.ring[s % 4 + 1][2] - parcel.ring[s][2]) + parcel.ring[s][1])) % 2 = 1
""")
def points_in_regions(read):
    """Which dissolved region, with its holes, holds each supplier; the SQL asks single parcels (SP-05)."""
    own = _parcels(read).select(F.when(F.col("balance") < 0, "debit").otherwise("credit").alias("region"), "ring")
    edges = PG.dissolved_edges(PG.directed_edges(own), "region")
    return PG.holding(_homes(read).select("id", "x", "y"), edges, "region", 1000.0)


@query(f"""
WITH {_DURATIONS}, b AS (SELECT l_returnflag, least(5, t // 30) AS bin, count(CASE WHEN e THEN 1 END) AS events, count(CASE WHEN NOT e THEN 1 END) AS censored FROM d WHERE t >= 0 GROUP BY 1, 2),
r AS (SELECT *, sum(events + censored) OVER (PARTITION BY l_returnflag ORDER BY bin DESC) - censored / 2 AS at_risk FROM b),
s AS (SELECT l_returnflag, bin, CASE WHEN max(CASE WHEN events >= at_risk AND events > 0 THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0.0 END) OVER w) END AS s FROM r WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin)),
k AS (SELECT l_returnflag, [1.0] || list_transform(range(0, 5), lambda b: coalesce(list_last(list_filter(c, lambda p: p.b <= b)).s, 1.0)) AS s FROM (SELECT l_returnflag, list({{'b': bin, 's': s}} ORDER BY bin) AS c FROM s WHERE bin < 5 GROUP BY 1))
SELECT l_returnflag, round((SELECT min((i - 1) * 30 + (s[i] - 0.5) / (s[i] - s[i + 1]) * 30) FROM range(1, 6) t(i) WHERE s[i + 1] <= 0.5 AND s[i] > 0.5), 6) AS median, round(1 - (s[1] + (s[2] - s[1]) * 0.5), 9) AS done_15, round(1 - s[4], 9) AS done_90, CAST(NULL AS DOUBLE) AS done_200 FROM k
""")
def survival_at_marks(read):
    """Which share is done by each mark, and when half are, between the ends of a life table's bins (MO-02)."""
    rows = _durations(read).filter("t >= 0").withColumn("bin", F.least(F.lit(5), F.floor(F.col("t") / 30)).cast("long"))
    bins = rows.groupBy("l_returnflag", "bin").agg(F.count(F.when(F.col("e"), 1)).alias("events"), F.count(F.when(~F.col("e"), 1)).alias("censored"))
    out = M.table_marks(M.life_table(bins, ["l_returnflag"]), ["l_returnflag"], [0, 30, 60, 90, 120, 150], 150, [15, 90, 200])
    return out.select("l_returnflag", F.round("median", 6).alias("median"), *[F.round(c, 9).alias(c) for c in ("done_15", "done_90", "done_200")])


@query("""
WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment, coalesce(orders, 0) AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def validated_join(read):
    """Customers joined one to one with their orders, which is refused where a key is repeated or lacks (JN-01)."""
    load = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    every = read("customer").select("c_custkey").join(load, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))
    return MT.joined_one_to_one(read("customer").select("c_custkey", "c_mktsegment"), every, "c_custkey")


@query("""
WITH p AS (SELECT c_nationkey, count(*) AS entries FROM customer GROUP BY 1)
SELECT c_nationkey, CAST(sum(entries) OVER (ORDER BY c_nationkey) - entries AS BIGINT) AS start, CAST(sum(entries) OVER (ORDER BY c_nationkey) AS BIGINT) AS stop, entries FROM p
""")
def nation_offsets(read):
    """Where each nation's customers lie in a payload that holds them one after another (AM-04)."""
    return MT.row_offsets(read("customer"), "c_nationkey", ["c_nationkey"])


@query("""
WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS place FROM customer), m AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT place, k.c_custkey, cents FROM k LEFT JOIN m ON o_custkey = k.c_custkey
""")
def canonical_projection(read):
    """A mart's values in the canonical order of customers, nulls where it has none (SK-05)."""
    order = R.placed(read("customer").select("c_nationkey", "c_custkey"), [], [F.col("c_nationkey"), F.col("c_custkey")]).select("c_custkey", (F.col("place") - 1).alias("place"))
    mart = read("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(cents("o_totalprice")).alias("cents"))
    return MT.projected(mart, order, "c_custkey", "place").select("place", "c_custkey", "cents")


@query("""
SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#12') THEN 'twelve' WHEN starts_with(p_brand, 'Brand#1') THEN 'one' WHEN starts_with(p_brand, 'Brand#') THEN 'any' END AS best, p_type = 'ECONOMY' AND p_size % 3 = 1 AS wanted FROM part
""")
def prefixes_and_dimensions(read):
    """The value of the longest key that a code begins with, and whether a map has all wanted dimensions (AM-03, AM-06)."""
    known = F.create_map(*[F.lit(x) for x in ("Brand#", "any", "Brand#1", "one", "Brand#12", "twelve")])
    dims = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), (F.col("p_size") % 3).cast("string"))
    return read("part").select("p_partkey", X.best_prefix(known, F.col("p_brand")).alias("best"), X.has_dimensions(dims, {"type": "ECONOMY", "size": "1"}).alias("wanted"))


@query("SELECT c_custkey, round(c_custkey * 7 % 360 - 180.0, 8) AS lon, round(c_custkey % 160 - 80.0, 8) AS lat FROM customer")
def unprojected_places(read):
    """Places on a web map taken back to degrees (SP-03)."""
    lon, lat = (F.col("c_custkey") * 7 % 360 - 180).cast("double"), (F.col("c_custkey") % 160 - 80).cast("double")
    there = read("customer").select("c_custkey", P.mercator_x(lon).alias("x"), P.mercator_y(lat).alias("y"))
    return there.select("c_custkey", F.round(P.unprojected_lon(F.col("x")), 8).alias("lon"), F.round(P.unprojected_lat(F.col("y")), 8).alias("lat"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2
""")
def landed_shards(read):
    """Shards written and read back as one table by their prefix, with the columns that are needed (SC-01, ST-01, SK-01)."""
    rows = read("lineitem").select("l_returnflag", "l_linestatus", cents("l_extendedprice").alias("cents"))
    path = shared_path(rows.sparkSession, "shards")
    K.parquet(rows, path)
    back = T.shards(rows.sparkSession, path, "part", required=["l_returnflag", "cents"])
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("SELECT o_custkey AS customer, o_orderkey AS key, o_orderstatus AS status FROM orders")
def json_documents(read):
    """A JSON document for each customer with its orders, sorted, written and read back a row for each entry (SC-03, SK-02)."""
    entry = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    docs = read("orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.array_sort(F.collect_list(entry)).alias("orders"))
    path = shared_path(docs.sparkSession, "documents")
    K.json_lines(docs, path, ["customer"])
    return T.documents(docs.sparkSession, path, "customer long, orders array<struct<key: long, status: string>>", "orders", lines=True)


@query("""
WITH s AS (SELECT unnest(['F', 'O', 'P']) AS status, unnest(range(3)) AS s), p AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS priority, unnest(range(5)) AS p)
SELECT c_nationkey, CAST(p AS INTEGER) AS priority, CAST(s AS INTEGER) AS status, count(*) AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN s ON s.status = o_orderstatus JOIN p ON p.priority = o_orderpriority GROUP BY ALL
""")
def hypercubes(read):
    """Flat arrays of counts by priority and status as JSON, one for each nation, read as cubes (SC-13)."""
    places = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "o_orderstatus": ["F", "O", "P"]}
    rows = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey"))
    count = [F.nullif(F.count(F.when((F.col("o_orderpriority") == p) & (F.col("o_orderstatus") == s), 1)), F.lit(0)) for p in places["o_orderpriority"] for s in places["o_orderstatus"]]
    text = rows.groupBy("c_nationkey").agg(F.to_json(F.array(*count), {"ignoreNullFields": "false"}).alias("json"))
    cubes = text.select("c_nationkey", F.from_json("json", "array<long>").alias("values"))
    return T.hypercube(cubes, [("priority", 5), ("status", 3)], "values", ["c_nationkey"])


# --- Marts and reaches -------------------------------------------------------------------------------------------------------

_MEASURES = [
    MA.Measure("revenue", "revenue"), MA.Measure("own_revenue", "revenue", (), ("4",)), MA.Measure("urgent_revenue", "revenue", ("1",)), MA.Measure("transfers", "revenue", ("4",)),
    MA.Measure("spending", "spending"), MA.Measure("returned", "spending", ("R",)), MA.Measure("open_spending", "spending", ("N.O",)), MA.Measure("kept", "spending", (), ("R", "N.F")),
    MA.Measure("development", "development"), MA.Measure("discounts", "development", ("d",)), MA.Measure("levies", "development", ("t",)),
]


@query("""
WITH u AS (SELECT o_orderkey, c_nationkey AS unit, year(o_orderdate) AS year, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT unit, year, 'r' AS k, p || '.' || s AS code, cents AS amount FROM u),
l AS (SELECT unit, year, l_returnflag || '.' || l_linestatus AS code, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem JOIN u ON o_orderkey = l_orderkey),
a AS (SELECT * FROM r UNION ALL SELECT unit, year, 's', code, amount FROM l UNION ALL SELECT unit, year, 'd', 'd.' || code, d FROM l UNION ALL SELECT unit, year, 'd', 't.' || code, t FROM l),
m AS (SELECT unit, year, count(*) FILTER (k = 'r') AS lines_revenue, count(*) FILTER (k = 's') AS lines_spending, count(*) FILTER (k = 'd') AS lines_development,
  coalesce(sum(amount) FILTER (k = 'r'), 0)::BIGINT AS revenue, coalesce(sum(amount) FILTER (k = 'r' AND NOT starts_with(code, '4.')), 0)::BIGINT AS own_revenue, coalesce(sum(amount) FILTER (k = 'r' AND starts_with(code, '1.')), 0)::BIGINT AS urgent_revenue, coalesce(sum(amount) FILTER (k = 'r' AND starts_with(code, '4.')), 0)::BIGINT AS transfers,
  coalesce(sum(amount) FILTER (k = 's'), 0)::BIGINT AS spending, coalesce(sum(amount) FILTER (k = 's' AND starts_with(code, 'R.')), 0)::BIGINT AS returned, coalesce(sum(amount) FILTER (k = 's' AND code = 'N.O'), 0)::BIGINT AS open_spending, coalesce(sum(amount) FILTER (k = 's' AND NOT starts_with(code, 'R.') AND code <> 'N.F'), 0)::BIGINT AS kept,
  coalesce(sum(amount) FILTER (k = 'd'), 0)::BIGINT AS development, coalesce(sum(amount) FILTER (k = 'd' AND starts_with(code, 'd.')), 0)::BIGINT AS discounts, coalesce(sum(amount) FILTER (k = 'd' AND starts_with(code, 't.')), 0)::BIGINT AS levies FROM a GROUP BY 1, 2),
p AS (SELECT c_nationkey AS unit, count(*) AS population FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT m.*, CAST(revenue AS DOUBLE) / population AS revenue_per_person, CAST(spending AS DOUBLE) / population AS spending_per_person, CAST(levies AS DOUBLE) / population AS levies_per_person,
  CASE WHEN revenue <> 0 THEN CAST(own_revenue AS DOUBLE) / revenue END AS own_share, CASE WHEN spending <> 0 THEN CAST(kept AS DOUBLE) / spending END AS kept_share, CASE WHEN revenue <> 0 THEN CAST(spending AS DOUBLE) / revenue END AS spent_share, population
FROM m LEFT JOIN p USING (unit)
""")
def mart_years(read):
    """Records of 20 measures for each nation and year from three sets of lines, by code prefixes, per person and as shares (AG-15,
    SM-08)."""
    k = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").alias("unit"), F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority", "o_orderstatus", cents("o_totalprice").alias("amount"))
    revenue = k.select("unit", "year", F.concat(F.substring("o_orderpriority", 1, 1), F.lit("."), "o_orderstatus").alias("code"), "amount")
    each = read("lineitem").join(k.select("o_orderkey", "unit", "year"), F.col("o_orderkey") == F.col("l_orderkey"))
    code = F.concat("l_returnflag", F.lit("."), "l_linestatus")
    both = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{x}."), code).alias("code"), F.round(F.col(c) * 100).cast("long").alias("amount")) for x, c in (("d", "l_discount"), ("t", "l_tax"))]))
    lines = {"revenue": revenue, "spending": each.select("unit", "year", code.alias("code"), cents("l_extendedprice").alias("amount")), "development": each.select("unit", "year", both.alias("x")).select("unit", "year", "x.*")}
    known = read("customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("unit")).agg(F.count("*").alias("population"))
    people = k.select("unit", "year").distinct().join(known, "unit")
    return MA.mart_records(lines, _MEASURES, people, ["revenue", "spending", "levies"], {"own_share": ("own_revenue", "revenue"), "kept_share": ("kept", "spending"), "spent_share": ("spending", "revenue")})


@query(f"""
WITH {_PARCELS}, p AS (SELECT j // 5 AS block, nation, CASE WHEN balance > -900 THEN CAST(round(balance * 100) AS BIGINT) END AS cents, CASE WHEN segment <> 'MACHINERY' THEN i END AS place FROM parcel)
SELECT block, count(*) AS members, count(DISTINCT nation) AS owners, CASE WHEN count(cents) = count(*) THEN CAST(sum(cents) AS BIGINT) END AS cents, count(cents) AS cents_known, CASE WHEN count(place) = count(*) THEN CAST(sum(place) AS BIGINT) END AS place, count(place) AS place_known FROM p GROUP BY 1
""")
def parcel_blocks(read):
    """Blocks of parcels: members, distinct owners, and sums that are null where a member's value is (AG-21)."""
    rows = _parcels(read).select(F.floor(F.col("j") / 5).alias("block"), "nation", F.when(F.col("balance") > -900, cents("balance")).alias("cents"), F.when(F.col("segment") != "MACHINERY", F.col("i")).alias("place"))
    return MA.cluster_summary(rows, ["block"], "nation", ["cents", "place"])


_SQUARES = "sq AS (SELECT s_suppkey AS b, 15 * s_suppkey % 40 * 1000.0 AS x, (15 * s_suppkey // 40) * 1000.0 AS y, 700.0 + s_suppkey % 5 * 300 AS w FROM supplier)"


def _squares(read):
    s = F.col("s_suppkey")
    x, y, w = (15 * s % 40 * 1000).cast("double"), (F.floor(15 * s / 40) * 1000).cast("double"), 700.0 + s % 5 * 300
    at = lambda dx, dy: F.struct((x + w * dx).alias("x"), (y + w * dy).alias("y"))
    return read("supplier").select(s.alias("b"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


@query(f"""
WITH {_PARCELS}, {_SQUARES}, c AS (SELECT unit AS a, b, ring, [[x, y], [x + w, y], [x + w, y + w], [x, y + w]] AS box FROM parcel, sq WHERE abs(1000.0 * parcel.i - x) < 4000 AND abs(1000.0 * parcel.j - y) < 4000),
d AS (SELECT a, b, list_bool_or(list_transform(range(1, 5), lambda s: list_bool_and(list_transform(box, lambda q: (ring[s % 4 + 1][1] - ring[s][1]) * (q[2] - ring[s][2]) - (ring[s % 4 + 1][2] - ring[s][2]) * (q[1] - ring[s][1]) < 0)))) AS one,
  list_bool_or(list_transform(range(1, 5), lambda s: list_bool_and(list_transform(ring, lambda q: (box[s % 4 + 1][1] - box[s][1]) * (q[2] - box[s][2]) - (box[s % 4 + 1][2] - box[s][2]) * (q[1] - box[s][1]) < 0)))) AS two FROM c)
SELECT a, b FROM d WHERE NOT one AND NOT two
""")
def meeting_polygons(read):
    """Which parcels meet which suppliers' squares (SP-08)."""
    return PG.meeting(_parcels(read).select(F.col("unit").alias("a"), "ring"), _squares(read), 1000.0)


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS source, o_orderpriority AS node FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT s_nationkey AS source, o_orderpriority AS node FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT source, node, CAST(count(*) AS INTEGER) AS ways FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
""")
def reach_sets(read):
    """What each nation reaches as a buyer or as a seller, and by how many of both (ST-04)."""
    bought = read("orders").filter("o_orderstatus = 'F'").join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("source"), F.col("o_orderpriority").alias("node"))
    sold = read("lineitem").filter("l_returnflag = 'R'").join(read("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return PG.reached(bought, sold.select(F.col("s_nationkey").alias("source"), F.col("o_orderpriority").alias("node")))
