"""Operator 7: benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a seed, which is the shortest match too, and the share of an item's words that must be tiled.
SEED_WORDS, COVERAGE = 5, 0.8
#: Bytes of benchmark text that a task holds; a larger benchmark is taken in several passes over the documents.
BENCHMARK_BYTES = 8 << 20

_BASE, _MASK = 1_000_003, (1 << 61) - 1


def _hashes(tokens: list[int], marked: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each window of s unmarked tokens, by a rolling Karp-Rabin hash."""
    h, run, top = 0, 0, pow(_BASE, s, _MASK)
    for i, t in enumerate(tokens):
        if marked[i] or t < 0:
            h = run = 0
            continue
        h, run = (h * _BASE + t + 1) % _MASK, run + 1
        if run > s:
            h = (h - (tokens[i - s] + 1) * top) % _MASK
        if run >= s:
            yield i - s + 1, h


def tile(item: list[int], doc: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles: again and again the longest matches that overlap no tile, down to
    `shortest` tokens. Negative tokens match nothing."""
    a, b = [False] * len(item), [False] * len(doc)
    tiles, s = [], max(shortest, len(item))
    while True:
        seen = defaultdict(list)
        for j, h in _hashes(doc, b, s):
            seen[h].append(j)
        longest, found = 0, []
        for i, h in _hashes(item, a, s) if seen else ():
            for j in seen.get(h, ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] >= 0 and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= s:
                    longest = max(longest, n)
                    found.append((-n, i, j))
        if longest >= 2 * s:
            s = longest
            continue
        before = len(tiles)
        for n, i, j in sorted(found):  # the longest first
            if not any(a[i : i - n]) and not any(b[j : j - n]):
                a[i : i - n] = [True] * -n
                b[j : j - n] = [True] * -n
                tiles.append((i, j, -n))
        # What a tile of this pass has cut short may still be long enough.
        if s == shortest and len(tiles) == before:
            return tiles
        s = max(shortest, s // 2)


class Benchmark:
    """The items of a block of the benchmark, with the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int):
        self.words: dict[bytes, int] = {}
        self.items: dict[int, np.ndarray] = {}
        self.by_seed: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, text in items:
            words = text.encode().lower().split()
            if words:
                self.items[item] = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64)
        for n in sorted({min(seed_words, len(x)) for x in self.items.values()}):
            seeds = defaultdict(list)
            for item, x in self.items.items():
                if min(seed_words, len(x)) == n:
                    for i, h in enumerate(self.seeds(x, n)):
                        seeds[int(h)].append((item, i))
            self.by_seed[n] = dict(seeds)
        self.sorted = {n: np.array(sorted(s), np.uint64) for n, s in self.by_seed.items()}

    @staticmethod
    def seeds(x: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n words; 0 where a word is not in the benchmark."""
        m = len(x) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        h, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for k in range(n):
            part = x[k : k + m]
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known &= part > 0
        return np.where(known, h | np.uint64(1), np.uint64(0))

    def covered(self, text: str, needed: float) -> list[tuple[int, float]]:
        """(item, share of its words tiled) of the items whose shared seeds leave room for `needed`."""
        get = self.words.get
        x = np.array([get(w, 0) for w in text.encode().lower().split()], np.int64)
        out = []
        for n, seeds in self.by_seed.items():
            h, known = self.seeds(x, n), self.sorted[n]
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(h) else ()
            hits: dict[int, tuple[set[int], list[int]]] = {}
            for j in at:
                for item, i in seeds[int(h[j])]:
                    own = hits.setdefault(item, (set(), []))
                    own[0].update(range(i, i + n))
                    if not own[1] or own[1][-1] != j:
                        own[1].append(int(j))
            for item, (places, starts) in hits.items():
                size = len(self.items[item])
                if len(places) < needed * size:  # no tiling can cover more than the words of shared seeds
                    continue
                doc, end = [], -1  # the parts of the text that shared seeds cover, kept apart
                for j in starts:
                    if j > end and doc:
                        doc.append(-1)
                    doc += x[max(j, end) : j + n].tolist()
                    end = j + n
                tiles = tile(self.items[item].tolist(), doc, n)
                out.append((item, sum(t[2] for t in tiles) / size))
        return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", carry: bool = False
) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, coverage for each row of docs, without a shuffle of texts; with carry also row, a
    struct of all columns of docs.

    Words are runs of other than ASCII white space, with A-Z in lower case. An item is found in a document when tiles of at
    least seed_words words (the whole item, if it has fewer) cover `coverage` of its words, in whatever order the passages
    stand. n_items counts such items; item_id and coverage are of the best covered one (ties: the smaller id), null and 0
    where no item is found. Null and empty texts, of documents or items, match nothing; repeated items are counted once;
    repeated documents give repeated rows; other columns are left out.

    The benchmark goes to the tasks in blocks of a bounded size, one pass over the rows after the other.
    """
    items = common.cut(
        benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter("item_id IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text")), "benchmark"
    )
    n = common.blocks(items, BENCHMARK_BYTES)
    extra = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    start = [F.lit(False).alias("contaminated"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage")]
    rows = docs.select(F.col(key).alias("doc_id"), *start, F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)

    def passed(rows: DataFrame, block: int) -> DataFrame:
        held = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).orderBy("item_id").collect()]
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Benchmark(sent.value, seed_words)
            for batch in batches:
                out = []
                for t, count, best, covered in zip(*(batch.column(c) for c in ("text", "n_items", "item_id", "coverage"))):
                    found = [(-c, i) for i, c in tests.covered(t.as_py(), coverage) if c >= coverage]
                    least = min(found + ([(-covered.as_py(), best.as_py())] if best.as_py() is not None else []), default=(0.0, None))
                    out.append((least[1] is not None, count.as_py() + len(found), least[1], -least[0] + 0.0))
                columns = list(zip(*out)) or [()] * 4
                fresh = [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *fresh, *batch.columns[5:]], names=batch.schema.names)

        return rows.mapInArrow(scan, rows.schema)

    for block in range(n):
        rows = passed(rows, block)
    return rows.drop("text")
