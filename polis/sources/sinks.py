"""Sinks: marts as Parquet or JSON, interned columns, reports of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import placed


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A mart as zstd Parquet, dealt by its partition columns so that each folder is written by few tasks."""
    rows = df.repartition(*by) if by else df
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON record on each line, sorted across files by range."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def interned(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(df with the column's codes, (code, value)): codes count up in the order of the values, which are a vocabulary."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    codes = placed(values, [], [F.col("value")]).select("value", (F.col("place") - 1).cast("int").alias("code"))
    out = df.join(codes.withColumnRenamed("value", "__v"), F.col(column) == F.col("__v"), "left").drop(column, "__v")
    return out.withColumnRenamed("code", column), codes.select("code", "value")


def check_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, rows, failures) from conditions that every row should meet; null counts as a failure. One pass."""
    sums = df.agg(F.count("*").alias("rows"), *[F.sum(F.when(c, 0).otherwise(1)).alias(f"c{k}") for k, c in enumerate(checks.values())])
    entries = [F.struct(F.lit(name).alias("check"), F.col("rows"), F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("long").alias("failures")) for k, name in enumerate(checks)]
    return sums.select(F.inline(F.array(*entries)))


class MixedWindows(ValueError):
    """Reports of different windows, whose sum describes no period."""


def merged_coverage(reports: DataFrame, expected: int) -> DataFrame:
    """One report from those of shards (shard, since, complete, unit, unit_complete, cases, calls; a row for each unit): collected,
    expected, complete, since, units, cases, calls, and incomplete, how many units are not. Complete is what all expected shards
    say they are. Reports of different windows, or none at all, are refused; a repeated row counts once."""
    rows = reports.distinct()
    windows = [r["since"] for r in rows.select("since").distinct().limit(2).collect()]
    if not windows:
        raise ValueError("no coverage reports to merge")
    if len(windows) > 1:
        raise MixedWindows("shards read different windows")
    shards = F.count_distinct("shard")
    every = (shards == expected) & F.bool_and(F.coalesce("complete", F.lit(False)))
    return rows.agg(
        shards.alias("collected"), F.lit(expected).cast("long").alias("expected"), every.alias("complete"), F.min("since").alias("since"), F.count_distinct("unit").alias("units"),
        F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count_if(~F.coalesce("unit_complete", F.lit(False))).alias("incomplete"),
    )


def gate(df: DataFrame, schema: str, rules: dict[str, tuple[Column, bool]]) -> DataFrame:
    """df where it may be published: it has exactly the fields of schema, of these types, and no row fails a rule that is fatal.
    rules: a condition, and whether it is fatal, by name; null fails. What is refused says why."""
    from pyspark.sql import types as T

    want = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = sorted(set(want) ^ set(have)) + sorted(c for c in set(want) & set(have) if want[c] != have[c])
    if wrong:
        raise ValueError(f"fields missing, unknown or of another type: {', '.join(wrong)}")
    fatal = {name: rule for name, (rule, stops) in rules.items() if stops}
    if fatal:
        failed = [f"{r['check']} ({r['failures']} rows)" for r in check_report(df, fatal).collect() if r["failures"]]
        if failed:
            raise ValueError(f"refused: {', '.join(failed)}")
    return df


def with_limitations(df: DataFrame, limitations: list[tuple[str, str, str]]) -> DataFrame:
    """df with limitations, an array of (id, affects, text) that travels with every row: those whose `affects` is * or a column of
    df."""
    own = [x for x in limitations if x[1] == "*" or x[1] in df.columns]
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "affects", "text"), x)]) for x in own]
    return df.withColumn("limitations", F.array(*entries) if entries else F.array().cast("array<struct<id:string,affects:string,text:string>>"))
