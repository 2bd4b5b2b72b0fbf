"""A training corpus from raw documents: what is toxic, copied, repeated or part of a benchmark goes; sources are then mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and gives it, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polis.llm import common
from polis.llm.decontamination import decontaminate
from polis.llm.mixing import mix
from polis.llm.near_dedup import near_duplicates
from polis.llm.suffix_dedup import dedup_substrings
from polis.llm.toxicity import score_toxicity
from polis.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is 0, whole. Rows with null text or doc_id are judged like any other; repeated rows stay
    or go together; an empty table stays empty; other columns pass through."""
    ship(spark)
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.filter("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; of rows with one doc_id, the first by the hash of the text. Rows
    without doc_id, and texts without words, stay; very long texts count whole; an empty table stays empty; columns of any name
    pass through."""
    ship(spark)
    kept = near_duplicates(docs, numerator=80, denominator=100, words=5).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    # The join has brought rows of one doc_id together, so this sorts without another shuffle.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    own = own.withColumn("__place", first).filter("__place = 1").drop("__place")
    return own.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of 100-byte strings that also start earlier; halves of characters at the edges of a
    removed run go too, and nothing else. n_chars is counted anew. A text that repeats others throughout becomes empty, null stays
    null; of repeated rows the later ones lose what they repeat; very long texts count whole; an empty table stays empty; columns
    of any name pass through."""
    ship(spark)
    out = dedup_substrings(docs, length=100, carry=True)
    text = F.when(F.col("row.text").isNotNull(), F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.col("kept_text")))
    fresh = {"text": text, "n_chars": F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length(text))}
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay; repeated rows stay or go together; an empty
    table stays empty; other columns pass through."""
    ship(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.filter("NOT contaminated").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how many of their words the mix takes and how often it repeats them (epochs_taken). Columns of docs
    that are called as one of the mix's are left out; an empty table gives no rows; repeated rows are taken each."""
    ship(spark)
    mixed = mix(docs, carry=True)
    own = [c for c in mixed.columns if c != "row"]
    return mixed.select(*own, *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in own])


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can express neither the network nor the sort of suffixes; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return docs
