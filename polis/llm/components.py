"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of each vertex of an edge; component is the smallest id that it reaches.

    Each step is a join with the smallest neighbour and is written out; edges stay distributed and never grow in number.
    The steps end when one changes nothing. No edges give no rows; loops and repeated edges do no harm.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    now = common.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        last, seen = seen, mark(now)
        if seen == last:
            break
    # Every vertex but a root now has one edge, to its root.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
