"""Queries of landed files, codes, registers and places, each with DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import places as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import matching as MT
from ..sources import tables as T
from .measures import _POINTS, _points
from .queries import cents, query

# --- Landed files ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS number, CAST(l_partkey AS BIGINT) AS part FROM lineitem")
def xml_lines(read):
    """XML elements with repeated children, shredded to rows (SC-12)."""
    line = F.struct(F.col("l_linenumber").cast("long").alias("number"), F.col("l_partkey").cast("long").alias("part"))
    files = read("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(line)).alias("line"))
    return T.xml_rows(files.select(F.to_xml(F.struct("key", "line")).alias("xml")), "xml", "key long, line array<struct<number: long, part: long>>", "line")


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'cp1250' ELSE 'iso-8859-2' END AS charset, n_name || ' ţară' || CASE WHEN n_nationkey % 4 = 3 THEN chr(129) ELSE '' END AS name FROM nation
""")
def decoded_names(read):
    """Bytes of unknown charset by a cascade (SC-08)."""
    k, plain, eastern = F.col("n_nationkey") % 4, F.encode(F.concat("n_name", F.lit(" ţară")), "UTF-8"), F.unhex(F.lit("20FE6172E3"))
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(k == 1, plain).when(k == 2, F.concat(F.encode("n_name", "UTF-8"), eastern)).otherwise(F.concat(F.encode("n_name", "UTF-8"), eastern, F.unhex(F.lit("81"))))
    return read("nation").select("n_nationkey", raw.alias("raw")).select("n_nationkey", X.charset(F.col("raw")).alias("charset"), X.decoded(F.col("raw")).alias("name"))


@query("""
SELECT n_nationkey, '50' AS maxspeed, 'DN' || n_nationkey AS ref, CASE WHEN n_nationkey % 2 = 0 THEN '2' END AS lanes FROM nation
""")
def way_tags(read):
    """Keys and values of a tag text (SC-22)."""
    tags = F.concat(F.lit('"maxspeed"=>"50","ref"=>"DN'), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, '","lanes"=>"2"').otherwise('"'))
    own = read("nation").select("n_nationkey", tags.alias("tags")).withColumn("m", T.key_values("tags"))
    return own.select("n_nationkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("maxspeed", "ref", "lanes")])


@query("""
SELECT l_orderkey, count(*) AS pairs, sha256(string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey)) AS checksum FROM lineitem GROUP BY 1
""")
def pair_checksums(read):
    """A digest of each unit's ordered pairs (AM-10, NF-15)."""
    pairs = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["l_partkey"], p["l_suppkey"])), ",")
    return read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sha2(text, 256).alias("checksum"))


# --- Codes and cohorts -----------------------------------------------------------------------------------------------------

_CODES = "c AS (SELECT p_brand, CAST(p_size % 3 AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.' || p_size END AS code, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)"


@query(f"""
WITH {_CODES} SELECT p_brand, CAST(sum(CASE WHEN code = '1' OR starts_with(code, '1.') THEN cents ELSE 0 END) AS BIGINT) AS below_1, CAST(sum(CASE WHEN starts_with(code, '1.1') THEN 0 ELSE cents END) AS BIGINT) AS without_transfers FROM c GROUP BY 1
""")
def code_hierarchy(read):
    """Sums below a dotted code, and without the codes of a raw prefix (PF-02, PF-03)."""
    code = F.concat((F.col("p_size") % 3).cast("string"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_size").cast("string"))))
    own = read("part").select("p_brand", code.alias("code"), cents("p_retailprice").alias("cents"))
    total = lambda keep: F.sum(F.when(keep, F.col("cents")).otherwise(0)).cast("long")
    return own.groupBy("p_brand").agg(total(X.has_code_prefix(F.col("code"), "1")).alias("below_1"), total(~F.col("code").startswith("1.1")).alias("without_transfers"))


@query("""
SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS code, n_name AS scrubbed, CAST(n_nationkey * 1000 + 0.5 AS DOUBLE) AS amount FROM nation
""")
def clean_fields(read):
    """Codes without decimal tail and leading zeros, text without illegal characters, amounts with a decimal comma (SF-14, SF-15, NF-01)."""
    key = F.col("n_nationkey").cast("string")
    code, dirty = X.strip_code(F.concat(F.lit("00"), key, F.lit(".0"))), F.concat(F.lit("\x01"), "n_name", F.lit("\x0b"))
    amount = F.when(F.col("n_nationkey") == 0, "0,5").otherwise(F.concat(key, F.lit(".000,5")))
    return read("nation").select("n_nationkey", code.alias("code"), X.scrub(dirty).alias("scrubbed"), N.locale_number(amount).cast("double").alias("amount"))


@query("""
WITH b AS (SELECT o_orderstatus, CASE WHEN o_custkey % 5 > 1 THEN o_orderpriority WHEN o_custkey % 5 = 1 THEN '  ' END AS section FROM orders)
SELECT o_orderstatus, nullif(trim(section), '') AS section, count(*) AS n FROM b GROUP BY 1, 2
""")
def blank_sections(read):
    """Blanks become null before they are grouped; nulls are a group of their own (PF-06, AG-13)."""
    k = F.col("o_custkey") % 5
    own = read("orders").select("o_orderstatus", F.when(k > 1, F.col("o_orderpriority")).when(k == 1, "  ").alias("section"))
    return own.groupBy("o_orderstatus", X.null_if_blank(F.col("section")).alias("section")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders)
SELECT datesub('month', CAST(o_orderdate AS DATE), last) AS months, count(*) AS n FROM orders, m WHERE CAST(o_orderdate AS DATE) >= last - INTERVAL 24 MONTH GROUP BY 1
""")
def recent_cohorts(read):
    """The cohorts of the last 24 months, by whole months of age (PF-11, NF-08)."""
    rows = read("orders").select(F.col("o_orderdate").cast("date").alias("day"))
    last = F.lit(rows.agg(F.max("day")).head()[0])
    return rows.filter(F.col("day") >= F.add_months(last, -24)).groupBy(F.timestamp_diff("MONTH", F.col("day").cast("timestamp"), last.cast("timestamp")).alias("months")).agg(F.count("*").alias("n"))


@query("""
SELECT p_brand AS family, p_type AS kind, CAST(sum(p_size) AS BIGINT) AS posts, CAST(sum(p_size * CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(p_size * CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(p_size) * 200000 AS DOUBLE) AS of_cap FROM part GROUP BY ROLLUP (p_brand, p_type)
""")
def headcounts(read):
    """Pay times posts in all, by family and by kind, with its share of a cap (AG-23)."""
    posts, pay = F.sum("p_size").cast("long"), F.sum(F.col("p_size") * cents("p_retailprice")).cast("long")
    return read("part").rollup(F.col("p_brand").alias("family"), F.col("p_type").alias("kind")).agg(posts.alias("posts"), pay.alias("cents"), N.ratio(pay.cast("double"), (posts * 200_000).cast("double")).alias("of_cap"))


@query("""
WITH r AS (SELECT l_returnflag, l_linestatus, CAST(round(l_extendedprice * 100) AS BIGINT) AS value, l_quantity * 100000.0 AS base FROM lineitem)
SELECT l_returnflag, l_linestatus, quantile_cont(value / base, 0.5) AS median_multiple, CAST(sum(value) AS DOUBLE) / sum(base) AS weighted_multiple FROM r GROUP BY 1, 2
""")
def market_multiples(read):
    """The median of ratios beside the ratio of sums (MO-12)."""
    by = ["l_returnflag", "l_linestatus"]
    rows = read("lineitem").select(*by, cents("l_extendedprice").alias("value"), (F.col("l_quantity") * 100_000.0).cast("double").alias("base")).withColumn("multiple", F.col("value") / F.col("base"))
    whole = rows.groupBy(*by).agg((F.sum("value").cast("double") / F.sum("base")).alias("weighted_multiple"))
    return A.quantiles(rows, by, "multiple", {"median_multiple": 0.5}).drop("n").join(whole, by)


@query("SELECT p_partkey, CASE WHEN p_size >= 10 THEN CAST(round(p_retailprice * 100) AS DOUBLE) / p_size END AS rate FROM part")
def measured_rates(read):
    """A value by area, null below the least area (MO-06)."""
    return read("part").select("p_partkey", F.when(F.col("p_size") >= 10, N.ratio(cents("p_retailprice").cast("double"), F.col("p_size"))).alias("rate"))


@query("""
WITH i AS (SELECT count(*) AS rows_in FROM orders), o AS (SELECT count(*) AS rows_out FROM orders SEMI JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0), u AS (SELECT count(*) AS unreachable FROM orders ANTI JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0)
SELECT rows_in, rows_out, unreachable, rows_out + unreachable = rows_in AS holds FROM i, o, u
""")
def conservation(read):
    """What goes out and what can't be reached add up to what came in (AG-46)."""
    served = read("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("served")).distinct()
    out = read("orders").join(served, "o_custkey", "left").agg(F.count("*").alias("rows_in"), F.count("served").alias("rows_out"), F.sum(F.col("served").isNull().cast("long")).alias("unreachable"))
    return out.withColumn("holds", F.col("rows_out") + F.col("unreachable") == F.col("rows_in"))


@query("""
WITH g AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS people FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey AS region, CAST(sum(CASE WHEN people < 5 THEN 3 WHEN people < 60 THEN 5 ELSE 9 END) AS BIGINT) AS seats_before, CASE WHEN sum(people) < 5 THEN 3 WHEN sum(people) < 60 THEN 5 ELSE 9 END AS seats_after FROM g GROUP BY 1
""")
def council_seats(read):
    """Seats by steps of population, of the members and of their union (RG-17)."""
    seats = lambda people: F.element_at(F.array(*map(F.lit, (3, 5, 9))), N.band(people, [0, 5, 60]) + 1)
    own = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    own = read("nation").join(own, "n_nationkey", "left").select("n_regionkey", F.coalesce("n", F.lit(0)).alias("people"))
    return own.groupBy(F.col("n_regionkey").alias("region")).agg(F.sum(seats(F.col("people"))).alias("seats_before"), seats(F.sum("people")).alias("seats_after"))


# --- Registers -------------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT s_suppkey % 13 AS alias, s_nationkey AS county, s_suppkey AS id FROM supplier), q AS (SELECT c_custkey, c_custkey % 17 AS alias, c_nationkey AS county FROM customer),
a AS (SELECT alias, count(*) AS n, min(id) AS id FROM r GROUP BY 1), b AS (SELECT alias, county, count(*) AS m, min(id) AS own FROM r GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN n = 1 THEN a.id WHEN m = 1 THEN own END AS id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' WHEN m = 1 THEN 'narrowed' ELSE 'ambiguous' END AS status
FROM q LEFT JOIN a ON a.alias = q.alias LEFT JOIN b ON b.alias = q.alias AND b.county = q.county
""")
def alias_resolution(read):
    """Names that resolve at once, within their county, or not (JN-11)."""
    register = read("supplier").select((F.col("s_suppkey") % 13).alias("alias"), F.col("s_nationkey").alias("county"), F.col("s_suppkey").alias("id"))
    return MT.resolve(read("customer").select("c_custkey", (F.col("c_custkey") % 17).alias("alias"), F.col("c_nationkey").alias("county")), register, "alias", "county", "id").select("c_custkey", "id", "status")


@query("""
WITH l AS (SELECT n_nationkey AS left_key, replace(n_name, 'A', 'Â') AS name FROM nation), r AS (SELECT n_nationkey AS right_key, CASE WHEN n_nationkey % 2 = 0 THEN replace(n_name, 'A', 'I') ELSE n_name END AS name FROM nation)
SELECT left_key, right_key FROM l JOIN r ON r.name IN (replace(l.name, 'Â', 'A'), replace(l.name, 'Â', 'I'))
""")
def tolerant_names(read):
    """Names meet whichever plain letter their accented one was flattened to (JN-17)."""
    left = read("nation").select(F.col("n_nationkey").alias("left_key"), F.explode(X.flattened(F.replace("n_name", F.lit("A"), F.lit("Â")))).alias("name"))
    right = read("nation").select(F.col("n_nationkey").alias("right_key"), F.when(F.col("n_nationkey") % 2 == 0, F.replace("n_name", F.lit("A"), F.lit("I"))).otherwise(F.col("n_name")).alias("name"))
    return left.join(right, "name").select("left_key", "right_key").distinct()


# --- Places ----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {_POINTS}, d AS (SELECT a.id, min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS metres FROM p a JOIN p b ON a.id <> b.id GROUP BY 1)
SELECT count(*) AS n, round(avg(metres), 6) AS mean, round(avg(metres) / (0.5 * sqrt(1000.0 * (SELECT max(y) + 1 FROM p) / count(*))), 6) AS dispersion FROM d
""")
def dispersion(read):
    """The mean way to the nearest neighbour against that of random points (SP-13)."""
    area = 1000.0 * (_points(read).agg(F.max("y")).head()[0] + 1)
    return P.clark_evans(_points(read), area, 25.0).select("n", F.round("mean", 6).alias("mean"), F.round("dispersion", 6).alias("dispersion"))


@query("""
WITH l AS (SELECT c_custkey % 40 + 0.2 AS x1, c_nationkey + 0.3 AS y1, (c_custkey + 1) % 40 - 0.1 AS x2, c_nationkey % 7 + 0.4 AS y2 FROM customer),
k AS (SELECT CAST(round(x1) AS BIGINT) || ',' || CAST(round(y1) AS BIGINT) AS a, CAST(round(x2) AS BIGINT) || ',' || CAST(round(y2) AS BIGINT) AS b, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS cost FROM l),
u AS (SELECT a, b, cost FROM k UNION ALL SELECT b, a, cost FROM k)
SELECT a, b, round(min(cost), 6) AS cost FROM u WHERE a <> b GROUP BY 1, 2
""")
def line_graph(read):
    """A graph of lines whose ends meet on a grid of one metre (GR-05)."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lines = read("customer").select((k % 40 + 0.2).alias("x1"), (n + 0.3).alias("y1"), ((k + 1) % 40 - 0.1).alias("x2"), (n % 7 + 0.4).alias("y2"))
    return G.of_lines(lines, 1.0).select("a", "b", F.round("cost", 6).alias("cost"))
