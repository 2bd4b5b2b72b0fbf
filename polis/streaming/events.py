"""Event streams: windows with watermarks, sessions, deduplication. Each function takes a batch or a stream alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import _cut


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if late else rows


def tumbling(df: DataFrame, time: str, every: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """(window_start, by, n, total) of windows side by side."""
    out = _timed(df, time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(df: DataFrame, time: str, length: str, every: str, by: list[str], late: str | None = None) -> DataFrame:
    """(window_start, by, n) of overlapping windows."""
    out = _timed(df, time, late).groupBy(F.window(time, length, every), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """(by, session_start, session_end, n): runs of events each less than a gap after the one before; the end is the last
    event plus the gap."""
    out = _timed(df, time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key; a stream forgets keys after the watermark."""
    if df.isStreaming:
        return _timed(df, time, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time]))
    return df.groupBy(*keys).agg(first.alias("__f")).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])


def upsert(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keep each batch's last row of a key in a folder of the batch's number, so a batch that is run again takes
    its own place. See upserted."""
    from ..operators.joins import keep_last

    def write(batch: DataFrame, number: int) -> None:
        keep_last(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upserted(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The table that upsert has written: the last row of each key over all batches, as keep_last of all rows at once would be."""
    from ..operators.joins import keep_last

    return keep_last(spark.read.parquet(path).drop("batch"), key, order)


def apply_snapshots(path: str, unit: str, amount: str, people: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: bring snapshots (unit, year, taken, amount) into a mart (unit, year, people, amount, per_person) that lies
    in path, parted by year, in place. Of several snapshots of a year the latest counts, whole: a unit that it doesn't name has 0.
    Only years with a snapshot are written anew; others, and units that the mart lacks, stay as they are. A snapshot that comes
    again, or after a later one of its year, changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mart = spark.read.parquet(path)
        newest = batch.filter("year IS NOT NULL AND taken IS NOT NULL").groupBy("year").agg(F.max("taken").alias("newest"))
        kept = mart.groupBy("year").agg(F.max("taken").alias("had"))
        due = newest.join(kept, "year", "left").filter("had IS NULL OR newest > had").select("year", "newest")
        own = batch.join(due, "year").filter("taken = newest").groupBy("year", unit).agg(F.sum(amount).alias("__amount"))
        rows = mart.join(due, "year").join(own, ["year", unit], "left")
        fresh = F.coalesce("__amount", F.lit(0)).cast(mart.schema[amount].dataType)
        each = F.when(F.col(people) > 0, fresh / F.col(people)).cast(mart.schema["per_person"].dataType)
        new = {amount: fresh, "per_person": each, "taken": F.col("newest")}
        done = rows.select(*[new.get(c, F.col(c)).alias(c) for c in mart.columns])
        _cut(done).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)

    return write
