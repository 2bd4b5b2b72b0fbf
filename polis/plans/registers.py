"""Queries that match and check registers, each with DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from ..operators import matching as T
from ..operators import ranges as R
from ..operators import models as M
from .queries import _EDGES, _edges, cents, query

# --- Joins ----------------------------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, coalesce((max({'d': d, 'k': k}) FILTER (d <= o_orderdate)).k, min({'d': d, 'k': k}).k) AS registration, coalesce(bool_or(d <= o_orderdate), false) AS in_time
FROM f LEFT JOIN o ON o_custkey = c GROUP BY o_orderkey
""")
def asof_or_first(read):
    """The latest registration up to a hearing, or the earliest of the case where all are later (JN-04)."""
    orders = read("orders")
    hearings = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    known = orders.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    found = J.as_of(hearings, known, "o_custkey", "o_orderdate", "d", "k", ["k"])
    first = known.groupBy("o_custkey").agg(F.min_by("k", F.struct("d", "k")).alias("first"))
    return found.join(first, "o_custkey", "left").select("o_orderkey", F.coalesce("k", "first").alias("registration"), F.col("k").isNotNull().alias("in_time"))


_CLOSE = """c AS (SELECT s_suppkey, c_custkey, CAST(10000 - abs(CAST(round(s_acctbal * 100) AS BIGINT) - CAST(round(c_acctbal * 100) AS BIGINT)) // 100 AS BIGINT) AS score
  FROM supplier JOIN customer ON s_nationkey = c_nationkey)"""


_TWO_REGISTERS = """a AS (SELECT p_partkey AS a, list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), p_brand, 'size ' || p_size, 'price ' || CAST(floor(p_retailprice) AS BIGINT)])) AS s FROM part),
b AS (SELECT p_partkey AS b, list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE p_brand END, 'size ' || (p_size + CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END), 'price ' || CAST(floor(p_retailprice) AS BIGINT)])) AS t FROM part),
m AS (SELECT a, b, CAST(len(list_intersect(s, t)) AS DOUBLE) / least(len(s), len(t)) AS score FROM a JOIN b ON len(list_intersect(s, t)) >= 0.72 * least(len(s), len(t)))"""


def _two_registers(read):
    """The parts as one office lists them, and as another does, which lacks some brands and differs in some sizes."""
    k, price = F.col("p_partkey"), F.concat(F.lit("price "), F.floor("p_retailprice").cast("string"))
    tokens = lambda brand, size: F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), brand, F.concat(F.lit("size "), size.cast("string")), price))
    a = read("part").select(k.alias("a"), tokens(F.col("p_brand"), F.col("p_size")).alias("tokens"))
    brand, size = F.when(k % 3 == 0, "unknown").otherwise(F.col("p_brand")), F.col("p_size") + F.when(k % 4 == 1, 1).otherwise(0)
    return a, read("part").select(k.alias("b"), tokens(brand, size).alias("tokens"))


@query(f"""
WITH RECURSIVE {_TWO_REGISTERS}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM m),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS x, CAST([] AS BIGINT[]) AS y UNION ALL
  SELECT p.i, CASE WHEN list_contains(x, a) OR list_contains(y, b) THEN x ELSE list_append(x, a) END, CASE WHEN list_contains(x, a) OR list_contains(y, b) THEN y ELSE list_append(y, b) END FROM w JOIN p ON p.i = w.i + 1),
l AS (SELECT x, y FROM w ORDER BY i DESC LIMIT 1), u AS (SELECT unnest(x) AS a, unnest(y) AS b FROM l)
SELECT u.a, u.b, score FROM u JOIN p USING (a, b)
""")
def greedy_match(read):
    """Two registers matched one to one by the share of common words, at least 0.72, the best first (JN-13)."""
    a, b = _two_registers(read)
    return T.greedy_sets(a, b, "a", "b", "tokens", 0.72)


@query("""
WITH k AS (SELECT DISTINCT p_type, split_part(p_name, ' ', 1) AS key FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, max(key) AS key FROM part JOIN k ON k.p_type = part.p_type AND starts_with(p_name, key || ' ') WHERE p_partkey % 2 = 1 GROUP BY 1
""")
def prefix_extension(read):
    """Names that extend a known key by more words, in the same group (JN-12)."""
    keys = read("part").filter("p_partkey % 2 = 0").select("p_type", F.split("p_name", " ")[0].alias("key"))
    return T.prefix_extensions(keys, read("part").filter("p_partkey % 2 = 1").select("p_partkey", "p_type", "p_name"), "p_type", "key", "p_name").select("p_partkey", "key")


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 10 UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_size > 40),
t AS (SELECT p_partkey, lower(p_type) || ' ' || p_name || ' ' || p_brand AS text FROM part)
SELECT p_partkey, CASE WHEN min({'l': -length(name), 'n': name}) IS NOT NULL THEN min({'l': -length(name), 'n': name}).n END AS name
FROM t LEFT JOIN n ON contains(' ' || text || ' ', ' ' || name || ' ') GROUP BY 1
""")
def longest_contained(read):
    """The longest known name inside a longer one, on word boundaries (JN-15)."""
    names = read("part").filter("p_size < 10").select(F.col("p_name").alias("name")).unionByName(read("part").filter("p_size > 40").select(F.split("p_name", " ")[1].alias("name")))
    texts = read("part").select("p_partkey", F.concat_ws(" ", F.lower("p_type"), "p_name", "p_brand").alias("text"))
    return T.longest_contained(texts, names, "text", "name").select("p_partkey", "name")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS l FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS r FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN r IS NULL THEN 'left_only' WHEN l IS NULL THEN 'right_only' WHEN l > 1 THEN 'repeated_left' WHEN r > 1 THEN 'repeated_right' ELSE 'one_to_one' END AS status FROM a FULL JOIN b ON a.k = b.k
""")
def one_to_one_join(read):
    """Which keys a one-to-one join would take, and why it refuses the others (JN-01, ST-09)."""
    return T.one_to_one(read("orders").filter("o_orderstatus = 'P'"), read("orders").filter("o_orderpriority = '1-URGENT'"), "o_custkey")


@query("""
WITH a AS (SELECT n_nationkey AS k, CAST(n_regionkey AS BIGINT) AS v FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1), c AS (SELECT s_nationkey AS k, count(*) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k, c.k) AS nation, max(a.v) AS region, max(b.v) AS customers, max(c.v) AS suppliers FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k) GROUP BY 1
""")
def aligned_series(read):
    """Several series laid side by side on their key (JN-03)."""
    count = lambda t, c: read(t).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("value"))
    return T.align({"region": read("nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("long").alias("value")), "customers": count("customer", "c_nationkey"), "suppliers": count("supplier", "s_nationkey")}, "nation")


@query(f"WITH {_EDGES} SELECT a, b, cost FROM u")
def symmetric_edges(read):
    """Paired endpoints as edges of both directions, the cheapest of parallel ones (JN-18)."""
    return G.both_ways(_edges(read))


@query("""
WITH b AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, b.n AS n_base, o.n AS n_other, b.cents AS cents_base, o.cents AS cents_other, o.cents - b.cents AS difference, abs(o.cents - b.cents) * 20 <= b.cents AS within FROM b JOIN o USING (o_custkey)
""")
def compared_runs(read):
    """Two runs of the same measure side by side, their difference, and whether it is within 5 % (JN-19, JN-20)."""
    run = lambda s, name: read("orders").filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias(f"n_{name}"), F.sum(cents("o_totalprice")).alias(f"cents_{name}"))
    gap = F.col("cents_other") - F.col("cents_base")
    return run("F", "base").join(run("O", "other"), "o_custkey").withColumn("difference", gap).withColumn("within", F.abs(gap) * 20 <= F.col("cents_base"))


@query("""
WITH l AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), a AS (SELECT o_custkey, count(*) AS n FROM l GROUP BY 1), b AS (SELECT day, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS links, count(CASE WHEN a.n = 1 AND b.n = 1 THEN 1 END) AS single, count(CASE WHEN a.n > 1 OR b.n > 1 THEN 1 END) AS set_aside FROM l JOIN a USING (o_custkey) JOIN b USING (day)
""")
def single_links(read):
    """Links of a link table that are one to one, and how many are set aside (JN-23)."""
    links = read("orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    marked = T.single_links(links, "o_custkey", "day")
    return marked.agg(F.count("*").alias("links"), F.count(F.when(F.col("single"), 1)).alias("single"), F.count(F.when(~F.col("single"), 1)).alias("set_aside"))


@query("""
WITH a AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), b AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1)
SELECT nation, n, 'first' AS origin FROM a UNION ALL SELECT nation, n, 'second' FROM b WHERE nation NOT IN (SELECT nation FROM a)
""")
def complemented(read):
    """A second source only where the first has nothing (JN-24, ST-07)."""
    first = read("supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return T.complement(first, read("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")), ["nation"])


@query("""
WITH e AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE v END AS value, CASE WHEN c_acctbal > 0 THEN 'registry' WHEN v IS NOT NULL THEN 'roster' END AS origin FROM customer LEFT JOIN e ON user_id = c_custkey
""")
def fallback_value(read):
    """The registry's value, else the roster's, else none, with its origin (PF-25)."""
    roster = read("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("v"))
    own = F.col("c_acctbal") > 0
    return read("customer").join(roster, "c_custkey", "left").select("c_custkey", F.when(own, F.col("c_acctbal")).otherwise(F.col("v")).alias("value"), F.when(own, "registry").when(F.col("v").isNotNull(), "roster").alias("origin"))


# --- Sets and checks ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates_reported(read):
    """Keys that stand more than once, with what they hold (ST-06)."""
    return read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("cents")).filter("n > 1")


@query("""
WITH b AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O')
SELECT k AS o_custkey, p AS lost FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE k IN (SELECT k FROM a)
""")
def seats_lost(read):
    """What a key had before and has no more, among keys that are still there (ST-05)."""
    own = lambda s: read("orders").filter(F.col("o_orderstatus") == s).select("o_custkey", F.col("o_orderpriority").alias("lost")).distinct()
    return own("F").subtract(own("O")).join(own("O").select("o_custkey").distinct(), "o_custkey", "left_semi")


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS listed, count(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 END) AS covered FROM customer GROUP BY 1)
SELECT nation, listed, covered, covered * 100 >= listed * 90 AS passes, CASE WHEN covered * 100 >= listed * 90 THEN 'ok' ELSE 'gap of ' || CAST(listed - covered AS VARCHAR) END AS detail FROM c
""")
def coverage_check(read):
    """Coverage of a register by its source, at least 90 %, with the gaps named (DQ-08, DQ-02)."""
    seen = read("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("seen")).distinct()
    c = read("customer").join(seen, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("listed"), F.count("seen").alias("covered"))
    passes = F.col("covered") * 100 >= F.col("listed") * 90
    return c.withColumn("passes", passes).withColumn("detail", F.when(passes, "ok").otherwise(F.concat(F.lit("gap of "), (F.col("listed") - F.col("covered")).cast("string"))))


@query("""
WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS a FROM orders), b AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS b FROM lineitem GROUP BY 1)
SELECT o_orderkey, a AS first_cents, b AS second_cents, CASE WHEN b IS NULL THEN 'one source' WHEN abs(a - b) * 20 <= greatest(a, b) THEN 'agree' ELSE 'disagree' END AS verdict FROM a LEFT JOIN b ON o_orderkey = l_orderkey
""")
def two_sources(read):
    """Two sources of one amount reconciled within 5 % (DQ-04)."""
    lines = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("second_cents"))
    a, b = F.col("first_cents"), F.col("second_cents")
    verdict = F.when(b.isNull(), "one source").when(F.abs(a - b) * 20 <= F.greatest(a, b), "agree").otherwise("disagree")
    return read("orders").select("o_orderkey", cents("o_totalprice").alias("first_cents")).join(lines, "o_orderkey", "left").withColumn("verdict", verdict)


@query("""
WITH t AS (SELECT l_returnflag AS flag, count(*) AS total, count(CASE WHEN l_quantity > 25 THEN 1 END) AS part, count(CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 1 END) AS inner_part FROM lineitem GROUP BY 1)
SELECT flag, total, part, inner_part, inner_part <= part AND part <= total AS nested, total BETWEEN 100 AND 1000000000 AS plausible FROM t
""")
def plausibility(read):
    """Totals within their bands, and series that must nest (DQ-03)."""
    big, deep = F.col("l_quantity") > 25, (F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05)
    t = read("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("total"), F.count(F.when(big, 1)).alias("part"), F.count(F.when(deep, 1)).alias("inner_part"))
    return t.withColumn("nested", F.expr("inner_part <= part AND part <= total")).withColumn("plausible", F.col("total").between(100, 1_000_000_000))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS keys, count(c_custkey) AS known, count(CASE WHEN c_custkey IS NULL THEN 1 END) AS unknown, CAST(coalesce(sum(CASE WHEN c_custkey IS NULL THEN n END), 0) AS BIGINT) AS orphan_rows FROM o LEFT JOIN customer ON o_custkey = c_custkey
""")
def referential_check(read):
    """Keys of a table that its register lacks (DQ-07)."""
    o = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(read("customer").select(F.col("c_custkey")), F.col("o_custkey") == F.col("c_custkey"), "left")
    gone = F.col("c_custkey").isNull()
    return o.agg(F.count("*").alias("keys"), F.count("c_custkey").alias("known"), F.count(F.when(gone, 1)).alias("unknown"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).cast("long").alias("orphan_rows"))


@query("""
WITH u AS (SELECT c_nationkey AS nation, list(CAST(c_custkey AS BIGINT) ORDER BY c_custkey) AS a FROM customer GROUP BY 1), o AS (SELECT c_nationkey AS nation, list(CAST(c_custkey AS BIGINT) ORDER BY c_custkey) AS b FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT nation, CAST(len(a) AS BIGINT) AS length, coalesce(CAST(len(b) AS BIGINT), 0) AS other_length, coalesce(a = b, false) AS aligned FROM u LEFT JOIN o USING (nation)
""")
def aligned_payloads(read):
    """Whether two payloads, each in the order of its keys, have the same keys (DQ-06). They are compared key by key: no payload is
    collected."""
    side = lambda df, a, b: df.select(F.col("c_nationkey").alias("nation"), "c_custkey", F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side(read("customer"), 1, 0).unionByName(side(read("customer").filter("c_acctbal > 0"), 0, 1))
    keys = both.groupBy("nation", "c_custkey").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = keys.groupBy("nation").agg(F.sum("a").alias("length"), F.sum("b").alias("other_length"), F.bool_and(F.col("a") == F.col("b")).alias("aligned"))
    return out.filter("length > 0")


# --- Graphs, assignment, gates ----------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT c_custkey AS node, c_custkey AS source, CAST(0 AS BIGINT) AS cost FROM customer WHERE c_acctbal >= 9000
  UNION SELECT u.b, r.source, r.cost + u.cost FROM r JOIN u ON r.node = u.a WHERE r.cost + u.cost <= 12)
SELECT source, node, min(cost) AS cost FROM r GROUP BY 1, 2
""")
def distance_matrix(read):
    """Distances from each source to each node within a limit (GR-03, GR-04)."""
    sources = read("customer").filter("c_acctbal >= 9000").select(F.col("c_custkey").cast("long").alias("node"))
    return G.distances(_edges(read), sources, limit=12)


@query("""
WITH s AS (SELECT l_orderkey AS k, max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), t AS (SELECT o_custkey, max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS top FROM orders GROUP BY 1)
SELECT o_orderpriority, count(*) AS cases, count(CASE WHEN t.top > CAST(substr(o_orderpriority, 1, 1) AS INTEGER) THEN 1 END) AS went_on FROM orders JOIN t USING (o_custkey) GROUP BY 1
""")
def appeal_floor(read):
    """How many cases of a stage are known to have gone on to a later one (MO-10)."""
    rank = F.substring("o_orderpriority", 1, 1).try_cast("int")
    top = read("orders").groupBy("o_custkey").agg(F.max(rank).alias("top"))
    return read("orders").join(top, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("cases"), F.count(F.when(F.col("top") > rank, 1)).alias("went_on"))


@query("""
WITH d AS (SELECT o_orderpriority, greatest(0, date_diff('day', o_orderdate, min(l_shipdate))) AS wait FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate)
SELECT o_orderpriority, count(*) AS n, quantile_cont(wait, 0.25) AS p25, quantile_cont(wait, 0.5) AS p50, quantile_cont(wait, 0.75) AS p75 FROM d GROUP BY 1
""")
def first_event_wait(read):
    """Days from registration to the first event of a case, not below 0 (AG-47)."""
    first = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    waits = read("orders").join(first, "o_orderkey").select("o_orderpriority", F.greatest(F.lit(0), F.datediff("first", "o_orderdate")).alias("wait"))
    return A.quantiles(waits, ["o_orderpriority"], "wait", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


@query("""
WITH l AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1), d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, date_diff('day', o_orderdate, last) AS days FROM orders JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
SELECT year, count(*) AS n, quantile_cont(days, 0.5) AS median FROM d GROUP BY 1 HAVING count(*) >= 100
""")
def closed_median(read):
    """The plain median duration of closed cases by year of registration, for groups of 100 or more (AG-48)."""
    last = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    days = read("orders").filter("o_orderstatus = 'F'").join(last, "o_orderkey").select(F.year("o_orderdate").alias("year"), F.datediff("last", "o_orderdate").alias("days"))
    return A.quantiles(days, ["year"], "days", {"median": 0.5}).filter("n >= 100")


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 50000 THEN 'too small' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'wrong kind' WHEN c_acctbal < 0 THEN 'in debt' END AS refusal FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT coalesce(refusal, 'eligible') AS outcome, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM a GROUP BY 1
""")
def refusal_reasons(read):
    """Eligibility with the first reason that speaks against it (PF-18, PF-21)."""
    reason = F.when(F.col("o_totalprice") < 50000, "too small").when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "wrong kind").when(F.col("c_acctbal") < 0, "in debt").otherwise("eligible")
    return read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""
WITH e AS (SELECT n_regionkey AS g, ln(c_acctbal) - ln(s_acctbal) AS r FROM customer JOIN supplier ON c_custkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND s_acctbal > 0)
SELECT g AS region, count(*) AS n, CASE WHEN count(*) >= 8 THEN round(exp(avg(r)), 6) END AS factor, CASE WHEN count(*) < 8 THEN 'too few' WHEN abs(avg(r)) <= 0.25 THEN 'pass' ELSE 'biased' END AS verdict FROM e GROUP BY 1
""")
def geometric_transfer(read):
    """The geometric mean of ratios where there are 8 or more, and the gate's verdict (MO-05, MO-14, NF-11)."""
    return M.geometric_transfer(
        read("customer").join(read("supplier"), F.col("c_custkey") == F.col("s_suppkey")).join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).filter("c_acctbal > 0 AND s_acctbal > 0").withColumnRenamed("n_regionkey", "region"),
        "region", "c_acctbal", "s_acctbal", least=8, bias=0.25,
    )


@query("""
WITH v AS (SELECT c_nationkey AS nation, count(*) AS volume FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, count(*) AS posts FROM supplier GROUP BY 1), t AS (SELECT nation, volume, coalesce(posts, 0) AS posts, greatest(1, CAST(floor(volume / 13 + 0.5) AS BIGINT)) AS fair FROM v LEFT JOIN s USING (nation))
SELECT nation, volume, posts, fair, greatest(0, fair - posts) AS arrivals, greatest(0, posts - fair) AS departures FROM t
""")
def equalised_staffing(read):
    """Posts by volume, one at least, and who would come and go (MO-09)."""
    volume = read("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("volume"))
    posts = read("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("posts"))
    t = volume.join(posts, "nation", "left").withColumn("posts", F.coalesce("posts", F.lit(0)).cast("long")).withColumn("fair", F.greatest(F.lit(1), F.floor(F.col("volume") / 13 + 0.5)).cast("long"))
    zero = F.lit(0).cast("long")
    return t.withColumn("arrivals", F.greatest(zero, F.col("fair") - F.col("posts"))).withColumn("departures", F.greatest(zero, F.col("posts") - F.col("fair")))


@query("""
SELECT c_mktsegment, c_custkey AS seat, absorbed FROM (SELECT c_mktsegment, c_nationkey, c_custkey, count(*) OVER w - 1 AS absorbed, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey)) WHERE k = 1
""")
def kept_seats(read):
    """One seat for each family and county, the largest; the others are absorbed (WN-09, WN-05, WN-06)."""
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    return read("customer").groupBy("c_mktsegment", "c_nationkey").agg(best.alias("seat"), (F.count("*") - 1).alias("absorbed")).drop("c_nationkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def largest_orders(read):
    """The 50 largest of all, ties to the smaller key; a report's limit (TK-01)."""
    return read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT p_brand, CAST(row_number() OVER (ORDER BY TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) NULLS FIRST, p_brand) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)
""")
def natural_order(read):
    """Codes in the order of their numbers, not of their digits; those without a number come first (TK-02)."""
    number = F.regexp_extract("p_brand", "[0-9]+", 0).try_cast("int")
    codes = R.placed(read("part").select("p_brand").distinct(), [], [number, F.col("p_brand")])
    return codes.select("p_brand", F.col("place").cast("int").alias("place"))


@query("""
WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, max({'d': o_orderdate, 'k': o_orderkey}) AS last, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, month, last.k AS o_orderkey, n - 1 AS older FROM m
""")
def newest_of_month(read):
    """The newest snapshot of each month; older ones are counted (TK-07)."""
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return read("orders").groupBy("o_custkey", month).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), (F.count("*") - 1).alias("older"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'industry' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE 'other' END AS role,
  regexp_matches(c_name, '[02468]$') AND NOT regexp_matches(c_name, '00[0-9]$') AS flagged FROM customer
""")
def folded_roles(read):
    """Groups by membership after folding, and a flag by one pattern but not another (PF-04, PF-05, PF-19, PF-20)."""
    folded = X.squeeze(F.col("c_mktsegment"))
    role = F.when(folded.isin("automobile", "machinery"), "industry").when(folded.isin("household", "furniture"), "home").otherwise("other")
    return read("customer").select("c_custkey", role.alias("role"), (F.col("c_name").rlike("[02468]$") & ~F.col("c_name").rlike("00[0-9]$")).alias("flagged"))
