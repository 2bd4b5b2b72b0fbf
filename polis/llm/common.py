"""What the operators share: the shared folder, cut lineage, blocks of documents and column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text of a block that one task holds at once.
BLOCK_BYTES = 12_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="polis-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation of what came before."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learns(column: str, folds: int, held_out: int) -> Column:
    """True for the rows to learn from: crc32 of the id as text, modulo folds, is not the held-out remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds != held_out


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text); other columns, whatever their names, go. Null text is empty."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def shape(rows: DataFrame, columns: str) -> T.StructType:
    """The type of rows of doc_id, columns and, if rows has it, the carried row, whatever its columns are called."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField("doc_id", kinds["doc_id"]), *T.StructType.fromDDL(columns).fields])
    return out.add("row", kinds["row"]) if "row" in kinds else out


def blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about block_bytes hold the texts of df."""
    total = df.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def by_block(df: DataFrame, n: int) -> DataFrame:
    """df with a column block in 0..n-1, which depends on doc_id alone."""
    return df.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the highest counts, at most limit of them: rows of one count are all in or all out, so no task ranks them.
    Only where more than limit rows share the highest counts are they ranked."""
    top = 100_000
    sizes = sorted(df.groupBy(F.least(F.col(count), F.lit(top)).alias("c")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["c"])
    least, total = None, 0
    for r in sizes:
        total += r["rows"]
        if total > limit:
            break
        least = r["c"]
    if least is None:
        return df.orderBy(F.desc(count), *[c for c in df.columns if c != count and not df.schema[c].dataType.typeName() == "map"]).limit(limit)
    return df.filter(F.col(count) >= least)
