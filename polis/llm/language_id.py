"""Operator 2: language identification by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_counts import HELD, word_counts

#: Numbers that each task holds of the most frequent words, which are scored in the tasks; all other words are joined with
#: their scores. The split changes no result.
HELD_NUMBERS = 600_000
#: Lengths of character n-grams, the longest first.
LENGTHS = (5, 4, 3, 2, 1)
#: Added to each count.
ADDED = 0.1

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters (category L) in lower case."""
    words = _LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # The pattern also takes numerals other than digits, as fractions.
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its edges marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def gram_counts(counts: DataFrame) -> DataFrame:
    """(word, label, n) of the n-grams of all LENGTHS of the words of counts, combined in the tasks before they shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([name] * len(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "label", "n"])
            held.clear()

        for batch in batches:
            for word, name, times in zip(*(batch.column(c).to_pylist() for c in ("word", "label", "n"))):
                own = held.setdefault(name, {})
                for n in LENGTHS:
                    for g in grams(word, n):
                        own[g] = own.get(g, 0) + times
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    pieces = counts.select("word", "label", "n").mapInArrow(count, "word string, label string, n long")
    return pieces.groupBy("word", "label").agg(F.sum("n").alias("n"))


def log_frequencies(counts: DataFrame, languages: list[str]) -> DataFrame:
    """(word, total, v): v is the log of (n + ADDED) / (all n + ADDED * distinct words) by language, from (word, label, n)."""
    own = [F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)) for x in languages]
    table = common.cut(counts.groupBy("word").agg(F.array(*own).alias("by")), "frequencies")
    size, *sums = table.agg(F.count("*"), *[F.sum(F.col("by")[i]) for i in range(len(languages))]).head()
    logs = [F.log((F.col("by")[i] + ADDED) / F.lit((n or 0) + ADDED * size)) for i, n in enumerate(sums)]
    return table.select("word", sum((F.col("by")[i] for i in range(1, len(languages))), F.col("by")[0]).alias("total"), F.array(*logs).alias("v"))


def backoff(words: DataFrame, by_length: dict[int, DataFrame], width: int) -> DataFrame:
    """(word, v) of distinct unseen words: the mean over their known n-grams, repeats included, of the longest length of which
    one is known. Words for which a length knows nothing go on to the next."""
    found = None
    for n in LENGTHS:
        gram = F.expr(f"transform(sequence(1, char_length(word) + 3 - {n}), i -> substring(concat('<', word, '>'), i, {n}))")
        parts = words.filter(F.char_length("word") + 2 >= n).select(F.col("word").alias("of"), F.explode(gram).alias("word"))
        own = parts.join(by_length[n], "word").groupBy("of").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(width)]).alias("v"))
        own = common.cut(own.withColumnRenamed("of", "word"), "backed_off")
        found = own if found is None else found.unionByName(own)
        words = common.cut(words.join(own.select("word"), "word", "left_anti"), "unseen")
        if not words.head(1):
            break
    return found


class Learned:
    """What was learned: languages, log prior, and tables (word, total, v) of words and of n-grams by length."""

    def __init__(self, rows: DataFrame, language: str = "lang", text: str = "text"):
        # The columns are named anew: docs may have others of these names.
        counts = common.cut(word_counts(rows.filter(F.col(language).isNotNull()), letter_words, language, text), "words")
        totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        self.languages = sorted(totals)
        if self.languages:
            n = np.array([totals[x] for x in self.languages], float)
            self.prior = np.log((n + 1) / (n + 1).sum())
            self.words = log_frequencies(counts, self.languages)
            # n-grams of words count once for each occurrence of the word; the length of an n-gram tells its n.
            gram = common.cut(gram_counts(counts), "grams")
            self.by_length = {n: log_frequencies(gram.filter(F.char_length("word") == n), self.languages) for n in LENGTHS}


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, without a shuffle of texts.

    Words are runs of letters (category L) in lower case. A word of the training texts scores its log frequency in each
    language, any other the mean log frequency of its n-grams of the longest length of which one is known; a text scores the
    prior and the sum of its words, and score is the posterior of the best language. Counts cover all training texts and whole
    texts, very long ones too. The most frequent words are scored in the tasks, the others are joined, word by word.

    Learns from the rows that common.learns picks and whose language is not null; a null doc_id is in no fold and is neither
    learned from nor held out. Null and empty texts, and those without a letter, are und with score 0, as is every text where
    nothing was learned. Languages that tie go by code point. Repeated rows give repeated rows, an empty table no rows; other
    columns are left out.
    """
    learned = Learned(docs.filter(F.coalesce(common.learns(key, folds, held_out), F.lit(False))), language, text)
    rows = common.texts(docs, key, text).withColumn("held_out", F.coalesce(~common.learns("doc_id", folds, held_out), F.lit(False)))
    width = len(learned.languages)
    if not width:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    top = common.most_frequent(learned.words, "total", HELD_NUMBERS // width).select("word", "v").toArrow()
    matrix = np.array(top.column("v").combine_chunks().flatten(), float).reshape(-1, width) if top.num_rows else np.zeros((0, width))
    sent = docs.sparkSession.sparkContext.broadcast((top.column("word").to_pylist(), matrix))
    shape = common.shape(rows, "held_out boolean, number long, n_words long, v array<double>, rare array<string>, times array<long>")

    def held_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        place = {w: i for i, w in enumerate(names)}
        table = np.vstack([table, np.zeros(width)])  # the last row is for words that are not held
        for batch in batches:
            n, sums, rare, times = [], [], [], []
            for t in batch.column("text"):
                words = letter_words(t.as_py())
                at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                other = Counter(words[i] for i in np.flatnonzero(at < 0))
                n.append(len(words))
                sums.append(table[at].sum(0))
                rare.append(list(other))
                times.append(list(other.values()))
            fresh = [pa.array(x, k) for x, k in ((n, pa.int64()), (map(np.ndarray.tolist, sums), pa.list_(pa.float64())), (rare, pa.list_(pa.string())), (times, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "number")), *fresh], names=shape.names)

    numbered = rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("number"), "text")
    scored = common.cut(numbered.mapInArrow(held_words, shape), "scored")
    rare = scored.select("number", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("number", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    distinct = common.cut(rare.select("word").distinct().join(learned.words.select("word", "v"), "word", "left"), "rare_words")
    known, unseen = distinct.filter("v IS NOT NULL"), distinct.filter("v IS NULL").select("word")
    table = known.unionByName(backoff(unseen, learned.by_length, width)) if unseen.head(1) else known
    more = rare.join(table, "word").groupBy("number").agg(*[F.sum(F.col("times") * F.col("v")[i]).alias(f"more{i}") for i in range(width)])
    score = F.array(*[F.col("v")[i] + F.coalesce(f"more{i}", F.lit(0.0)) + float(learned.prior[i]) for i in range(width)])
    best = F.array_max("scores")
    posterior = 1 / F.aggregate("scores", F.lit(0.0), lambda total, x: total + F.exp(x - best))
    names = F.array(*map(F.lit, learned.languages))
    return scored.join(more, "number", "left").withColumn("scores", score).select(
        "doc_id", "held_out", F.when(F.col("n_words") > 0, F.element_at(names, F.array_position("scores", best).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(F.col("n_words") > 0, posterior).otherwise(0.0).alias("score"),
    )
