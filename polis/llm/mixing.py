"""Operator 6: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of a document's place that name its slice, so that a hot source is spread over 4,096 groups.
SLICE_DIGITS = 3


def source_targets(sizes: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights` in turn and share all sizes. In each round the sources whose
    share exceeds `epochs` times their size are clamped there and the excess goes to the others by weight; a round clamps
    every source above, so the rounds end when none is. Sources without words get 0.
    """
    # Sources are sorted by ranges, so many of them are many tasks' work; only the ranges' sizes come to the driver.
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    parts = common.cut(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before, starts = 0, [F.lit(-1), F.lit(0)]
    for r in sorted(parts.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["n"]
    rank = F.element_at(F.create_map(*starts), F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ranked = common.cut(parts.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * epochs).drop("part"), "sources")
    total = ranked.agg(F.sum("source_size")).head()[0] or 0
    level, taken_out = 0.0, -1
    while True:
        # Clamped are the sources whose cap lies at or below the present water level.
        clamped = F.col("cap") <= F.col("weight") * level
        fixed, free, n = ranked.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))), F.sum(clamped.cast("long"))
        ).head()
        if n == taken_out or not free:
            level = level if free else float("inf")
            break
        taken_out = n
        level = max(level, (total - fixed) / free)
    share = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.col("weight") * level)
    return ranked.select("source", "source_size", share.alias("target"))


def mix(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 6, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs_taken for each row of docs; with carry also row, a struct of all columns
    of docs.

    Every document of a source is taken whole floor(target / source size) times. The rest of the target is a fractional
    repetition: documents in seeded order are taken once more until the words left run out, the last of them in part; so a
    source's taken words are its target rounded down. Reruns agree. Null text has size 0 and is taken 0 times over; a very long
    text counts whole; a null source is a source of its own, ranked last; equal rows share their place in the order and differ
    by at most one document's words; an empty table gives no rows; other columns, whatever their names, are left out or carried.
    """
    words = F.size(F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"))
    extra = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)
    # The seeded place of a document in its source: a slice, then the rest of the digest.
    place = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.select("doc_id", "source", words.cast("long").alias("size"), place.alias("place"), F.xxhash64("text").alias("tie"), *(["row"] if carry else []))
    rows = common.cut(rows.withColumn("slice", F.substring("place", 1, SLICE_DIGITS)), "sizes")
    slices = common.cut(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = common.cut(source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), epochs, weights), "targets")
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    laid = slices.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "slice_size")
    laid = laid.withColumnsRenamed({"source": "of", "slice": "of_slice"})
    rows = rows.join(laid, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("of_slice"))).drop("of", "of_slice")
    within = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("start", start).withColumn("whole", F.least(whole, F.lit(epochs)).cast("long"))
    left = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    extra_words = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start")))
    out = rows.withColumn("taken", (F.col("whole") * F.col("size") + extra_words).cast("long"))
    out = out.withColumn("epochs_taken", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))
    return out.select("doc_id", "size", "source_size", "target", "taken", "epochs_taken", *(["row"] if carry else []))
