"""Mart records: measures of several line sets for each unit and year, by code prefixes, with what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """A sum of the amounts of one line set whose code is one of `prefixes` or lies below it, none meaning all, and is not, nor lies
    below, one of `without`."""

    name: str
    lines: str
    prefixes: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


def _below(code: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (code == p) | F.startswith(code, F.lit(p + "."))
    return out


def mart_records(lines: dict[str, DataFrame], measures: list[Measure], people: DataFrame, per_person: list[str], shares: dict[str, tuple[str, str]]) -> DataFrame:
    """(unit, year, lines_<set> for each set, the measures, <measure>_per_person, the shares, population) for each unit and year that any
    set of lines (unit, year, code, amount) has.

    The sets are stacked and summed once, so no set is joined with another, and lines combine before they shuffle. A measure of
    lines that a unit doesn't have is 0; a null amount is 0 and a null code matches no prefix. people (unit, year, population) gives
    what a person has, null without people; a share is one measure over another, null where that is 0.
    """
    stacked = None
    for name, df in lines.items():
        rows = df.select("unit", "year", F.col("code").cast("string").alias("code"), F.coalesce("amount", F.lit(0)).alias("amount"), F.lit(name).alias("__set"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    code = F.coalesce("code", F.lit(""))

    def total(m: Measure) -> Column:
        mine = (F.col("__set") == m.lines) & (_below(code, m.prefixes) if m.prefixes else F.lit(True)) & ~_below(code, m.without)
        return F.coalesce(F.sum(F.when(mine, F.col("amount"))), F.lit(0)).alias(m.name)

    counts = [F.count(F.when(F.col("__set") == name, 1)).alias(f"lines_{name}") for name in lines]
    sums = stacked.groupBy("unit", "year").agg(*counts, *map(total, measures))
    known = people.groupBy("unit", "year").agg(F.max("population").alias("population"))
    out = sums.join(known, ["unit", "year"], "left")
    each = [F.when(F.col("population") > 0, F.col(m) / F.col("population")).alias(f"{m}_per_person") for m in per_person]
    ratios = [F.when(F.col(b) != 0, F.col(a) / F.col(b)).alias(name) for name, (a, b) in shares.items()]
    return out.select(*sums.columns, *each, *ratios, "population")


def cluster_summary(df: DataFrame, by: list[str], owner: str, counters: list[str]) -> DataFrame:
    """(by, members, owners, and for each counter its sum, null if a member's is, and <counter>_known, how many members have it).
    Owners are the distinct ones, null not among them."""
    sums = [x for c in counters for x in (F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c), F.count(c).alias(f"{c}_known"))]
    return df.groupBy(*by).agg(F.count("*").alias("members"), F.count_distinct(owner).alias("owners"), *sums)
