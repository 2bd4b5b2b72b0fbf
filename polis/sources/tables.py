"""Sources: guarded readers that return DataFrames and refuse to go on with nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmptySource(ValueError):
    """A source without rows, or without a column that is needed."""


def _guarded(df: DataFrame, what: str, required: list[str] | None) -> DataFrame:
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise EmptySource(f"{what} lacks {', '.join(missing)}")
    if not df.head(1):
        raise EmptySource(f"{what} has no rows")
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the star schema."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shards(spark: SparkSession, folder: str, prefix: str, schema: T.StructType | None = None, required: list[str] | None = None) -> DataFrame:
    """All Parquet shards of a prefix as one table."""
    reader = spark.read.schema(schema) if schema else spark.read
    return _guarded(reader.option("pathGlobFilter", f"{prefix}-*.parquet").parquet(folder), f"{folder}/{prefix}-*.parquet", required)


def delimited(spark: SparkSession, path: str, required: list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header; every column is a trimmed string, blanks are null."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    df = df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))).alias(c.strip().lstrip("﻿")) for c in df.columns])
    return _guarded(df, path, required)


def documents(spark: SparkSession, path: str, schema: str, items: str, lines: bool = False) -> DataFrame:
    """JSON documents, one in a file or (lines) one on each line, with a row for each entry of their array `items` beside the
    document's other fields."""
    df = spark.read.schema(schema).json(path, multiLine=not lines)
    rest = [c for c in df.columns if c != items]
    return _guarded(df.select(*rest, F.inline(items)), path, None)


def latest_edition(df: DataFrame, key: str, edition: str) -> DataFrame:
    """The rows of the last edition of each key; ties stay together."""
    last = df.groupBy(F.col(key).alias("__k")).agg(F.max(edition).alias("__e"))
    return df.join(last, (F.col(key) == F.col("__k")) & (F.col(edition) == F.col("__e"))).drop("__k", "__e")


def hypercube(df: DataFrame, sizes: list[tuple[str, int]], values: str, keep: list[str] | None = None) -> DataFrame:
    """(keep, each dimension's place, value) of a flat array in row-major order; missing values are left out."""
    keep = keep or []
    out = df.select(*keep, F.posexplode(values).alias("__i", "value")).filter("value IS NOT NULL")
    stride, columns = 1, []
    for name, size in reversed(sizes):
        columns.insert(0, (F.floor(F.col("__i") / stride) % size).cast("int").alias(name))
        stride *= size
    return out.select(*keep, *columns, "value")


def key_values(text: str) -> Column:
    """A map of `"k"=>"v"` pairs."""
    pairs = F.regexp_extract_all(F.col(text), F.lit('"([^"]+)"=>"([^"]*)"'), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, '"([^"]+)"=>', 1).alias("key"), F.regexp_extract(p, '=>"([^"]*)"', 1).alias("value"))))


def xml_rows(df: DataFrame, column: str, schema: str, items: str) -> DataFrame:
    """A row for each entry of the repeated child `items` of an XML element, beside the element's other fields."""
    rows = df.select(F.from_xml(column, schema).alias("x")).select("x.*")
    return rows.select(*[c for c in rows.columns if c != items], F.inline(items))


def shredded(df: DataFrame, column: str, schema: str, key: list[str], children: dict[str, str], root: list[str]) -> dict[str, DataFrame]:
    """Flat tables of nested XML elements, each parsed once: "root" has key and the fields `root`; each child, named by where its
    array lies in the element ("line", or "line.event" for an array in each entry of another), has key, the place (from 0) of every
    entry on the way, as place_<name>, and the entry's plain fields. Elements that can't be parsed or lack a key are left out of all; absent
    children give no rows. The parsed elements are kept in the shared folder, so the tables don't parse them again."""
    from ..operators.graph import _cut

    parsed = _cut(df.select(F.from_xml(column, schema).alias("x")).select("x.*").filter(F.coalesce(*[F.col(c).cast("string") for c in key]).isNotNull()))
    out = {"root": parsed.select(*key, *root)}
    for name, path in children.items():
        rows, at, places = parsed, "", []
        for step in path.split("."):
            entry = f"__{step}"
            rows = rows.select(*[c for c in rows.columns if c in key or c in places], F.posexplode(f"{at}{step}").alias(f"place_{step}", entry))
            places, at = [*places, f"place_{step}"], f"{entry}."
        plain = [f for f in rows.schema[entry].dataType.fields if f.dataType.typeName() not in ("array", "struct", "map")]
        out[name] = rows.select(*key, *places, *[F.col(f"{entry}.{f.name}").alias(f.name) for f in plain])
    return out


def newest_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The rows of the newest edition of each key among the Parquet files below a folder, whose paths say what they hold: pattern is a
    regular expression with two groups, the key and the edition, the newest of which is the greatest as text. Rows have key and
    edition. The files are listed first, and only those of the newest editions are read; files that do not match are no
    edition. All files of one key and edition belong together."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    plain = lambda path: F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    named = lambda path: [F.regexp_extract(plain(path), pattern, k).alias(n) for k, n in ((1, "key"), (2, "edition"))]
    known = files.select("path", *named(F.col("path"))).filter("key <> '' AND edition <> ''")
    paths = sorted(r["path"] for r in latest_edition(known, "key", "edition").select("path").collect())  # names of files, which Spark lists anyway
    if not paths:
        raise EmptySource(f"{folder} has no file like {pattern}")
    return _guarded(spark.read.parquet(*paths).select("*", *named(F.input_file_name())), folder, None)
