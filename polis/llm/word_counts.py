"""Counts of words over a corpus, combined in the tasks before they shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task holds before it hands its counts on.
HELD = 400_000


def word_counts(rows: DataFrame, words: Callable[[str], list[str] | list[bytes]], label: str | None = None, text: str = "text") -> DataFrame:
    """(word, label, n): how often each word stands in the texts of each label (null without one). Null text is empty;
    words may be given in UTF-8."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([name] * len(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "label", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column("label").to_pylist(), batch.column("text")):
                held.setdefault(name, Counter()).update(words(t.as_py() or ""))
                if sum(map(len, held.values())) > HELD:
                    yield from flush()
        yield from flush()

    own = F.col(label).cast("string") if label else F.lit(None).cast("string")
    counted = rows.select(own.alias("label"), F.col(text).alias("text")).mapInArrow(count, "word string, label string, n long")
    return counted.groupBy("word", "label").agg(F.sum("n").alias("n"))
