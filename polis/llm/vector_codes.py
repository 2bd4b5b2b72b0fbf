"""Operator 13: product codes of vectors, whose nearest entries are screened by float32 matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of scaled vectors lie within this, so float32 holds each exactly and int64 every squared distance.
LARGEST = 1 << 24
#: Rows that a task codes at once.
ROWS = 8192
#: Unit roundoff of float32.
ROUNDING = 2.0**-24


def scaled(vectors: DataFrame, scale: int, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): components become floor(scale * x), x as double, held within LARGEST. Rows whose vector is null or
    holds a null or non-finite component go."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    sound = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e12)), F.lit(-1e12)) * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.filter(F.coalesce(sound, F.lit(False))).select("vec_id", "label", F.transform("x", lambda x: held(x).cast("int")).alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of the entry of book that is nearest each row of x (both whole numbers), ties to the lower index.

    |c|^2 / 2 - x.c orders the entries. In float32 with roundoff u a product of w terms is off by at most w u / (1 - w u) |x| |c|
    in whatever order it is summed, the half norm by u |c|^2 / 2, and their difference by u times its size: together less than
    1.01 (w + 2) u (|x| |c| + |c|^2 / 2). Every entry whose interval overlaps that of the best is evaluated again in int64.
    """
    half = (book.astype(np.float64) ** 2).sum(1) / 2
    low = half.astype(np.float32)[None, :] - x.astype(np.float32) @ book.astype(np.float32).T
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    error = 1.01 * (x.shape[1] + 2) * ROUNDING * (length * np.sqrt(2 * half.max()) + half.max())
    near = low <= (low.min(1).astype(np.float64) + 2 * error)[:, None]
    out = near.argmax(1)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    if len(open_rows):
        row, entry = np.nonzero(near[open_rows])
        exact = ((x[open_rows[row]] - book[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == best[row])
        _, lowest = np.unique(row[hits], return_index=True)
        out[open_rows] = entry[hits[lowest]]
    return out


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as int64, shorter ones padded with zeros."""
    lists = batch.column("v")
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(part, width)


def train(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (part, entry, place) after some rounds. A round is one pass over rows; each task hands on the counts and
    sums of its parts by entry, so only as many numbers as the codebooks have reach the driver."""
    parts, entries, size = books.shape
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
            for _, x in _parts(batches, parts * size):
                for p in range(parts):
                    own = x[:, p * size : (p + 1) * size]
                    code = nearest(own, books[p])
                    n[p] += np.bincount(code, minlength=entries)
                    order = np.argsort(code, kind="stable")
                    first = np.flatnonzero(np.diff(code[order], prepend=-1))
                    total[p, code[order[first]]] += np.add.reduceat(own[order], first, axis=0)
            used = np.flatnonzero(n.ravel())
            if len(used):
                place = np.tile(np.arange(size, dtype=np.int32), len(used))
                columns = [np.repeat(used, size), place, np.repeat(n.ravel()[used], size), total.reshape(-1, size)[used].ravel()]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["entry", "place", "n", "total"])

        found = rows.select("v").mapInArrow(sums, "entry long, place int, n long, total long")
        found = found.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        books = books.copy()
        for r in found:
            books[r["entry"] // entries, r["entry"] % entries, r["place"]] = int(r["total"]) // r["n"]  # floors go down
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of vectors that can be coded.

    Vectors are scaled to whole numbers and cut into equal parts; each part is coded by its nearest entry of a codebook that
    starts as that part of the first vectors by vec_id and is moved to its members' mean, rounded down, in each round.

    Rows whose vector is null or holds a null or non-finite component take no part. Shorter vectors, and those whose length is
    no multiple of parts, are padded with zeros; components beyond +-LARGEST after scaling are held there; sums of errors beyond
    a long are held at its largest value. Null vec_ids come last when the codebook starts; repeated rows are coded each, and rows
    of one vec_id are ordered by vector; null labels are summed together. With fewer vectors than entries a codebook has as many
    entries as there are vectors. An empty table gives no rows. Other columns are left out.
    """
    rows = common.cut(scaled(vectors, scale, key, vector, label), "vectors")
    width = max(rows.agg(F.max(F.size("v"))).head()[0] or 0, 1)
    size = -(-width // parts)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = np.zeros((len(start), parts * size), np.int64)
    for i, r in enumerate(start):
        first[i, : len(r["v"])] = r["v"]
    books = first.reshape(len(start), parts, size).transpose(1, 0, 2)
    books = train(rows, books, rounds) if len(start) else books
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _parts(batches, parts * size):
            codes = np.empty((len(x), parts), np.int64)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                codes[:, p] = nearest(own, books[p])
                error += ((own - books[p][codes[:, p]]) ** 2).sum(1)
            shown = ["".join(f"{c:02x}" for c in r) for r in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(shown), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = common.cut(rows.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
