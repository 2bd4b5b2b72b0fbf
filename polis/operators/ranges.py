"""Ranks and running sums of groups that are too large for one task: ranges of the order are laid end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut


def placed(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """df with place, each row's rank in its group from 1 on, and rows, how many the group has. For each column: name in sums also
    name, the sum of what comes before the row, and name_all, the group's.

    Rows are dealt out by ranges of (group, order), so a group of most rows is many tasks' work. Of each range only the number of
    rows and the sums go on, which say what comes before a range; a window then sees one range of one group. The order must tell
    the rows of a group apart where their ranks matter. A null group is a group.
    """
    sums = sums or {}
    rows = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id())
    rows = _cut(rows)
    ranges = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{name}") for c, name in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    names = [f"__of{k}" for k in range(len(by))]
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    laid = ranges.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__range").alias("__at"), before("__n").alias("__before"), F.sum("__n").over(every).alias("rows"),
        *[x for name in sums.values() for x in (before(f"__s_{name}").alias(f"__b_{name}"), F.sum(f"__s_{name}").over(every).alias(f"{name}_all"))],
    )
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)], F.col("__range") == F.col("__at"))
    within = Window.partitionBy(*by, "__range").orderBy(*order)
    until = within.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(laid, on)
    return out.select(
        *df.columns, (F.col("__before") + F.row_number().over(within)).alias("place"), "rows",
        *[x for c, name in sums.items() for x in ((F.col(f"__b_{name}") + F.coalesce(F.sum(c).over(until), F.lit(0))).alias(name), F.col(f"{name}_all"))],
    )
