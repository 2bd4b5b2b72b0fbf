"""Operator 12: SimHash near-duplicates by a grid join of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Fingerprints of a cell that are compared in one go; cells of more are split.
CELL, BLOCK = 4096, 2048
#: Groups of a cell up to this size are compared together with all others of the batch.
SMALL = 8
#: Hashes whose bits are counted at once.
COUNTED = 1 << 15

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x5555555555555555)
_HALF = np.uint64((1 << 32) - 1)
#: Segments of two bits, of which a half has 16.
SEGMENTS = 16


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `words` words joined by spaces, repeats included; of the whole sequence where there are fewer."""
    own = text.encode().translate(_LOWER).split()
    joined = b" ".join(own)
    n, digest = min(words, len(own)), xxhash.xxh64_intdigest
    if not n:
        return []
    start, ends, starts = 0, [], []
    for w in own:
        starts.append(start)
        start += len(w) + 1
        ends.append(start - 1)
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :])]


def fingerprints(texts: list[str], words: int) -> np.ndarray:
    """A bit of a fingerprint is 1 if it is set in over half of the text's hashes; without words all are 0."""
    out = np.zeros(len(texts), np.uint64)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, t in enumerate(texts):
        hashes = np.array(shingle_hashes(t, words), "<u8")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), COUNTED):
            part = hashes[at : at + COUNTED]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = bit[2 * ones > len(hashes)].sum(dtype=np.uint64)
    return out


def bit_counts(prints: np.ndarray) -> np.ndarray:
    """The embedding: how many bits are set in each of 32 segments of two bits, each count in the place of its segment."""
    return prints - ((prints >> np.uint64(1)) & _ODD)


def _steps(owner: np.ndarray, cell: np.ndarray, up_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(owner, cell), and the cells at a Manhattan distance of one, upwards or both ways, within the counts 0 to 2."""
    owners, cells = [owner], [cell]
    for s in range(SEGMENTS):
        one = np.uint64(1 << 2 * s)
        count = (cell >> np.uint64(2 * s)) & np.uint64(3)
        for may, moved in ((count < 2, cell + one), (count > 0, cell - one))[: 1 if up_only else 2]:
            owners.append(owner[may])
            cells.append(moved[may])
    return np.concatenate(owners), np.concatenate(cells)


def cells(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in prints, cell): two fingerprints that differ in at most `bits` bits share a cell.

    The Manhattan distance of the bit counts is at most the number of differing bits. Of two halves of the segments, either
    the first lies within bits // 2 or the second within what is left of bits, less one. Within an even distance 2r two
    points share a cell of the unit grid at r steps from each; within 2r + 1 they do once cells one step up are added.
    """
    counts, found = bit_counts(prints), []
    for half, reach in ((0, bits // 2), (1, bits - 1 - bits // 2)):
        if reach < 0:
            continue
        owner, cell = np.arange(len(prints)), (counts >> np.uint64(32 * half)) & _HALF
        for up_only in (*[False] * (reach // 2), *[True] * (reach % 2)):
            owner, cell = _steps(owner, cell, up_only)
            if reach > 2:  # several steps may lead to one cell
                owner, cell = np.unique(np.stack([owner.astype(np.uint64), cell]), axis=1)
                owner = owner.astype(np.int64)
        found.append((owner, cell | np.uint64(half << 32)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


def spanning(prints: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(a, b): edges of a spanning forest of the links of all of prints with one another."""
    a, b, left = [], [], prints
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                new = left[near]
                a.append(np.full(len(new), x))
                b.append(new)
                left = left[~near]
                stack.extend(new)
    return a, b


FOUND = "a long, b long, cell long"


def _found(a: list[np.ndarray], b: list[np.ndarray], large: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Edges (a, b, null), and (fingerprint, null, cell) of cells too large for one go."""
    none_yet = np.empty(0, np.uint64)
    edges = np.unique(np.stack([np.concatenate([*x, none_yet]) for x in (a, b)]), axis=1).view(np.int64)
    kept = [np.concatenate([x[k] for x in large]) if large else np.empty(0, np.int64) for k in (0, 1)]
    none = pa.nulls(len(kept[0]), pa.int64())
    parts = [(pa.array(edges[0]), pa.array(kept[0])), (pa.array(edges[1]), none), (pa.nulls(edges.shape[1], pa.int64()), pa.array(kept[1]))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in parts], names=["a", "b", "cell"])


def compare_cells(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within cells of rows (cell, print) that are sorted by cell. A cell of over CELL rows passes through, row by row."""
    cell, prints, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in _with_end(batches):
        if batch is not None:
            cell = np.r_[cell, batch.column("cell").to_numpy()]
            prints = np.r_[prints, batch.column("print").to_numpy().view(np.uint64)]
        if not len(cell):
            continue
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        open_from = len(cell) if batch is None else int(starts[-1])
        a, b, large = [], [], []
        whole = starts < open_from
        sizes_of, at = sizes[whole], starts[whole]
        if over is not None and len(at) and cell[at[0]] == over:  # the rest of a large cell
            large.append((prints[at[0] : at[0] + sizes_of[0]].view(np.int64), cell[at[0] : at[0] + sizes_of[0]]))
            at, sizes_of = at[1:], sizes_of[1:]
        small = (sizes_of > 1) & (sizes_of <= SMALL)
        for s in range(1, SMALL):
            first = at[small & (sizes_of > s)]
            room = sizes_of[small & (sizes_of > s)] - s
            if not len(first):
                break
            i = np.repeat(first, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
            near = np.bitwise_count(prints[i] ^ prints[i + s]) <= bits
            a.append(prints[i[near]])
            b.append(prints[i[near] + s])
        for k in np.flatnonzero(sizes_of > SMALL):
            own = slice(at[k], at[k] + sizes_of[k])
            if sizes_of[k] > CELL:
                large.append((prints[own].view(np.int64), cell[own]))
            else:
                more = spanning(prints[own], bits)
                a += more[0]
                b += more[1]
        cell, prints = cell[open_from:], prints[open_from:]
        if len(cell) and (len(cell) > CELL or cell[0] == over):
            over = int(cell[0])
            large.append((prints.view(np.int64), cell))
            cell, prints = cell[:0], prints[:0]
        if a or large:
            yield _found(a, b, large)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _split_cells(large: DataFrame, bits: int) -> DataFrame:
    """Edges within large cells. Their segments are cut into bits + 1 groups, so two fingerprints that differ in at most `bits`
    bits have equal counts in one group; what a cell and a group share is compared in pairs of blocks."""
    bounds = [64 * k // (bits + 1) // 2 * 2 for k in range(bits + 2)]
    masks = [np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1)) for lo, hi in zip(bounds, bounds[1:])]

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = bit_counts(batch.column("print").to_numpy().view(np.uint64))
            n = len(masks)
            part = pa.array(np.tile(np.arange(n, dtype=np.int32), len(counts)))
            again = pa.array(np.repeat(np.arange(len(counts)), n))
            own = np.stack([counts & m for m in masks], 1).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cell").take(again), part, pa.array(own), batch.column("print").take(again)], names=["cell", "part", "counts", "print"])

    key = ["cell", "part", "counts"]
    rows = common.cut(large.mapInArrow(finer, "cell long, part int, counts long, print long"), "finer_cells")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("print"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [*key, "lo", "hi"]
    rows = rows.select(*key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            table = held if batch is None else pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            if table is None or not table.num_rows:
                continue
            change = np.zeros(table.num_rows, bool)
            for c in group:
                v = table.column(c).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            ends = [0, *np.flatnonzero(change).tolist(), *([table.num_rows] if batch is None else [])]
            prints, a, b = table.column("print").to_numpy().view(np.uint64), [], []
            for lo, hi in zip(ends, ends[1:]):
                more = spanning(np.unique(prints[lo:hi]), bits)
                a += more[0]
                b += more[1]
            held = table.slice(ends[-1]).combine_chunks()
            if a:
                yield _found(a, b, [])

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, FOUND).select("a", "b")


def simhash_duplicates(docs: DataFrame, bits: int = 4, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    Fingerprints link where they differ in at most `bits` of 64 bits; component_id is the smallest doc_id that links lead to.
    Equal fingerprints are collapsed first. The others meet in cells of a grid of per-segment bit counts, whose Manhattan
    distance bounds the differing bits from below, and are verified exactly. Cells of over CELL fingerprints are split by further
    segments and compared in pairs of blocks; a spanning forest of the links leaves each cell.

    Null and empty texts, and those without words, have fingerprint zero and link like any other. A null doc_id takes part in no
    link and keeps a null component. Very long texts count whole. Repeated rows give repeated rows; an empty table gives no rows;
    other columns are left out.
    """
    rows = common.texts(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints = fingerprints(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.column("print").slice(at, 1000)
                owner, cell = cells(own.to_numpy().view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(cell), own.take(pa.array(owner))], names=["cell", "print"])

    signed = common.cut(rows.mapInArrow(sign, "doc_id long, print long"), "signed")
    classes = common.cut(signed.filter("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    placed = classes.select("print").mapInArrow(place, "cell long, print long")
    found = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: compare_cells(batches, bits), FOUND)
    found = common.cut(found, "links")
    edges, large = found.filter("cell IS NULL").select("a", "b"), found.filter("cell IS NOT NULL").select("cell", F.col("a").alias("print"))
    if large.head(1):
        edges = edges.unionByName(_split_cells(large, bits))
    linked = components(edges).withColumnRenamed("id", "print")
    members = common.cut(linked.join(classes, "print"), "members")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of = members.join(least, "component").select("print", "component_id")
    of = classes.join(of, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    out = signed.join(of, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
