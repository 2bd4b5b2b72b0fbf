"""Operator 3: near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

#: Minwise tokens of a set; a sketch keeps one byte of each.
TOKENS = 96
#: Tokens chosen along a path before a node is first looked at, and before it is looked at again if it is large.
DEPTHS = (3, 8)
#: Documents that are compared with one another in one node or block.
NODE, BLOCK = 512, 256
#: Recall of all depths together for a pair at the threshold itself, over the choice of trees and of minwise tokens.
RECALL = 0.9999
#: Representatives of a large class that each of its sets is compared with in a round, and the share of the sets that a round
#: must settle for another to follow.
REPRESENTATIVES, SETTLED = 16, 0.25
#: Columns of shingles that a block's comparison holds at once.
COLUMNS = 4096

_FACTORS = np.random.default_rng(3).integers(1, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = np.random.default_rng(33).integers(0, 1 << 31, TOKENS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes."""
    out = []
    for t in texts:
        data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
        out.append(hashing.shingles(hashing.words(data)[1], n) if len(data) else np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of each of the minwise tokens of each (non-empty) set."""
    out = np.empty((len(sets), TOKENS), np.uint8)
    at = 0
    while at < len(sets):  # runs of sets that stay in cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(TOKENS):
            least = np.minimum.reduceat(x * _FACTORS[k] + _OFFSETS[k], starts)
            out[at:end, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
        at = end
    return out


def paths(sketch: np.ndarray, trees: int, depth: int, first: int = 0) -> np.ndarray:
    """The node of each set in each tree, from tree `first` on, at a depth. Which token a node branches by depends on the node, that is on the
    tree and the tokens chosen before."""
    node = hashing.mix(np.arange(first + 1, first + trees + 1, dtype=np.uint64) * hashing.BASE)[None, :].repeat(len(sketch), 0)
    row = np.arange(len(sketch))[:, None]
    for _ in range(depth):
        token = sketch[row, (node >> np.uint64(20)) % np.uint64(TOKENS)]
        node = hashing.mix(node + (token.astype(np.uint64) + np.uint64(1)) * hashing.INVERSE)
    return node.view(np.int64)


def trees_for(threshold: float, depth: int, miss: float) -> int:
    """The least number of trees in which a pair at the threshold shares no node of a depth with a probability of at most miss.

    All trees choose from the same TOKENS places, so the mean is over how many of these agree.
    """
    k = np.arange(TOKENS + 1)
    chance = np.array([math.comb(TOKENS, int(i)) for i in k], float) * threshold**k * (1 - threshold) ** (TOKENS - k)
    apart = 1 - (k / TOKENS) ** depth
    low, high = 0, 1
    while high < 1 << 20 and chance @ apart**high > miss:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if chance @ apart**mid > miss else (low, mid)
    return high


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix."""
    n, out = len(linked), []
    seen = np.zeros(n, bool)
    for root in range(n):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            stack += new.tolist()
    return out


def alike(sketch: np.ndarray, least: int) -> np.ndarray:
    """Which sketches agree in at least `least` places."""
    out = np.zeros((len(sketch), len(sketch)), bool)
    for i in range(len(sketch)):
        out[i] = (sketch == sketch[i]).sum(1) >= least
    return out


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(intersection sizes, union sizes) of all sets with one another."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.full(len(count), -1)
    shared[count > 1] = np.arange((count > 1).sum())
    column = shared[column]
    common_size = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int((count > 1).sum()), COLUMNS):
        part = (column >= at) & (column < at + COLUMNS)
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[part], column[part] - at] = 1
        common_size += m @ m.T
    size = np.array(list(map(len, sets)), np.float64)
    return common_size, size[:, None] + size[None, :] - common_size


def linked(sets: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Which sets have denominator * intersection >= numerator * union, from their full sizes and intersections."""
    both, either = overlaps(sets)
    return denominator * both >= numerator * either


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of at least two rows of batches that are sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        change = np.zeros(table.num_rows, bool)
        for c in range(keys):
            v = table.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield table.slice(a, b - a)
        held = table.slice(cuts[-1]).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


EDGE = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _in_turn(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held = []
    for p in pairs:
        held.append(p)
        if len(held) >= 20_000:
            yield _edges(held)
            held = []
    if held:
        yield _edges(held)


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect all sets which some tree finds alike by their sketches; at most one less than a node's sets
    leave a node.

    Sets of large nodes go on, whole, to fresh trees of the next depth, as many as that depth needs. A pair that meets in large
    nodes only thus has another chance at each depth, and the depths share what may be missed.
    """
    # Five standard deviations below the mean of agreeing places at the threshold.
    least = math.floor(TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold)))

    def nodes(depth: int, trees: int, first: int):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, 25_000 // trees)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    sketch = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in part.column("sketch")])
                    node = paths(sketch, trees, depth, first)
                    again = pa.array(np.repeat(np.arange(len(node)), trees))
                    yield pa.RecordBatch.from_arrays([pa.array(node.ravel()), part.column("doc_id").take(again), part.column("sketch").take(again)], names=["node", "doc_id", "sketch"])

        return walk

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for group in _grouped(batches, 1):
                ids = group.column("doc_id").to_pylist()
                sketch = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in group.column("sketch")])
                for i, j in _spanning(alike(sketch, least)):
                    yield ids[i], ids[j]

        return _in_turn(each())

    found, sets, first = None, reps.select("doc_id", "sketch"), 0
    for level, depth in enumerate(DEPTHS):
        trees = trees_for(threshold, depth, (1 - RECALL) / len(DEPTHS))
        rows = sets.mapInArrow(nodes(depth, trees, first), "node long, doc_id long, sketch binary")
        first += trees
        large = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).filter(F.col("n") > NODE)
        large = common.cut(large, "large_nodes")
        some = bool(large.head(1))
        small = rows.join(large, "node", "left_anti") if some else rows
        edges = small.select("node", "doc_id", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(compare, EDGE)
        found = edges if found is None else found.unionByName(edges)
        if not some:
            break
        held = rows.join(large, "node")
        if level == len(DEPTHS) - 1:
            # Sets that share so many chosen tokens are taken as one class of candidates; full sets decide.
            found = found.unionByName(held.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
        else:
            sets = common.cut(held.select("doc_id", "sketch").distinct(), "sets")
    return found.filter("a != b").distinct()


def near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Two documents are linked when denominator * |A & B| >= numerator * |A | B| for their sets of word shingles; component_id
    is the smallest doc_id that links lead to. Equal sets are collapsed first. Trees of chosen minwise tokens bring alike
    sets together with a recall of RECALL for a pair at the threshold, in large nodes too, candidate classes are the connected sets, and within a
    class the full sets decide every link. A class of more than NODE sets is first compared with representatives: sets linked to
    one form its ball, and by the triangle inequality of the Jaccard distance a ball need only meet the sets within twice the
    distance of a link. What no ball takes is compared in pairs of blocks of BLOCK sets; no task holds a whole class.

    Null and empty texts, and those without words, have no shingles and are linked with nothing. A null doc_id takes part in
    no link and keeps a null component. Very long texts have all their shingles. Repeated rows give repeated rows; an empty
    table gives no rows; other columns are left out.
    """
    rows = common.texts(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    shape = "doc_id long, n_shingles long, print binary, sketch binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("text"), words)
                full = [s for s in sets if len(s)]
                sketch = iter(sketches(full)) if full else iter(())
                signs = [next(sketch).tobytes() if len(s) else None for s in sets]
                prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "print", "sketch"])

    signed = common.cut(rows.mapInArrow(sign, shape), "signed")
    classes = signed.filter("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    reps = common.cut(classes, "classes")
    threshold = numerator / denominator
    members = common.cut(components(_candidates(reps, threshold)), "members")
    links = _links(rows, members, numerator, denominator, words)
    final = components(links)
    of = reps.select("print", F.col("doc_id").alias("rep")).join(final.withColumnRenamed("id", "rep"), "rep", "left")
    of = of.select("print", F.coalesce("component", "rep").alias("component"))
    out = signed.join(of, "print", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(rows: DataFrame, members: DataFrame, numerator: int, denominator: int, words: int) -> DataFrame:
    """A spanning forest of the links within each candidate class."""
    sizes = common.cut(members.groupBy("component").agg(F.count("*").alias("n")), "class_sizes")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), pa.array(sets, pa.binary())], names=["component", "id", "shingles"])

    def sets_of(own: DataFrame) -> DataFrame:
        return own.select("component", "id", "text").mapInArrow(full, "component long, id long, shingles binary")

    # Texts move once, to their classes; what follows works on the members' alone.
    texts = rows.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    own = common.cut(texts.join(members.join(sizes, "component").hint("merge"), "id").select("component", "id", "n", "text"), "member_texts")
    zero = [F.lit(0).alias(c) for c in ("ball", "lo", "hi", "side")]
    pairs = sets_of(own.filter(F.col("n") <= NODE)).select("component", *zero, "id", "shingles")
    edges = []
    large = own.filter(F.col("n") > NODE)
    if large.head(1):
        left = common.cut(sets_of(large), "large_classes")
        left, edges, more = _balls(left, numerator, denominator)
        for p in more:
            pairs = pairs.unionByName(p)
        # A block meets every block of what is left of its class, itself included, in a group (component, lo, hi).
        placed = left.join(left.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "component")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.unionByName(placed.select("component", F.lit(-1).alias("ball"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.lit(0).alias("side"), "id", "shingles"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for group in _grouped(batches, 4):
                held = dict(zip(group.column("id").to_pylist(), zip(group.column("shingles"), group.column("side").to_pylist())))  # repeated rows once
                ids, side = list(held), np.array([v[1] for v in held.values()])
                yes = linked([np.frombuffer(v[0].as_py(), np.uint64) for v in held.values()], numerator, denominator)
                if side.any():  # a ball and those near it: links within either are known or found elsewhere
                    yes &= side[:, None] != side[None, :]
                for i, j in _spanning(yes):
                    yield ids[i], ids[j]

        return _in_turn(each())

    key = ["component", "ball", "lo", "hi"]
    found = pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(decide, EDGE)
    for e in edges:
        found = found.unionByName(e)
    return found


def _balls(left: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(sets that no ball takes, links to representatives, (component, ball, lo, hi, side, id, shingles) that balls must meet)
    of the sets (component, id, shingles) of large classes.

    A set belongs to the ball of its first representative that it is linked to. A later set whose distance to that
    representative is over twice that of a link can't be linked to the ball. Rounds go on while they settle SETTLED of the sets.
    """
    near = 2 * numerator - denominator

    def assess(own: pa.Table, reps: pa.Table) -> pa.Table:
        reps = reps.sort_by("rep")
        ids, n = own.column("id").to_pylist(), own.num_rows
        both, either = overlaps([np.frombuffer(x.as_py(), np.uint64) for c in (own, reps) for x in c.column("shingles")])
        both, either = both[:n, n:], either[:n, n:]
        link, close = denominator * both >= numerator * either, denominator * both >= near * either
        names = reps.column("id").to_pylist()
        ball = np.where(link.any(1), link.argmax(1), -1)
        rings = [[r for r in np.flatnonzero(close[i]).tolist() if ball[i] < 0 or r < ball[i]] for i in range(n)]
        numbers = reps.column("rep").to_pylist()
        return pa.table(
            [own.column("component"), pa.array(ids, pa.int64()), pa.array([numbers[b] if b >= 0 else -1 for b in ball], pa.int32()), pa.array([names[b] if b >= 0 else None for b in ball], pa.int64()), pa.array([[numbers[r] for r in x] for x in rings], pa.list_(pa.int32()))],
            names=["component", "id", "ball", "center", "rings"],
        )

    edges, meetings, turn = [], [], 0
    while True:
        sizes = common.cut(left.groupBy("component").agg(F.count("*").alias("n")), "class_sizes")
        if not sizes.filter(F.col("n") > NODE).head(1):
            return left, edges, meetings
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        numbered = left.select("component", "id", F.xxhash64("id", F.lit(turn)).alias("h"))
        first = numbered.groupBy("component", F.pmod("h", F.lit(REPRESENTATIVES)).cast("int").alias("rep")).agg(F.min_by("id", "h").alias("id"))
        # Numbers of representatives tell rounds apart.
        reps = first.join(left, ["component", "id"]).join(sizes, "component").withColumn("rep", F.col("rep") + turn * REPRESENTATIVES).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
        reps = common.cut(reps, "representatives")
        own = left.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")).drop("n")
        out = own.groupBy("component", "part").cogroup(reps.groupBy("component", "part")).applyInArrow(assess, "component long, id long, ball int, center long, rings array<int>")
        out = common.cut(out.distinct(), "balls")  # repeated rows of one id agree, or are told apart no more
        edges.append(out.filter("ball >= 0 AND id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")))
        inside, around = out.filter("ball >= 0").select("component", "ball", "id"), out.select("component", F.explode("rings").alias("ball"), "id")
        blocks = lambda df, name: df.groupBy("component", "ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        counts = common.cut(blocks(inside, "n0").join(blocks(around, "n1"), ["component", "ball"]), "meetings")

        def side(df: DataFrame, k: int) -> DataFrame:
            mine, others = (("lo", "n0"), ("hi", "n1"))[:: 1 - 2 * k]
            df = df.join(counts, ["component", "ball"]).withColumn(mine[0], F.pmod(F.xxhash64("id"), F.col(mine[1])).cast("int"))
            return df.withColumn(others[0], F.explode(F.sequence(F.lit(0), F.col(others[1]) - 1))).withColumn("side", F.lit(k))

        met = side(inside, 0).unionByName(side(around, 1))
        meetings.append(met.join(left.select("id", "shingles"), "id").select("component", "ball", "lo", "hi", "side", "id", "shingles"))
        rest = common.cut(left.join(out.filter("ball < 0").select("id"), "id", "left_semi").select("component", "id", "shingles"), "left")
        before, after = (df.agg(F.count("*")).head()[0] for df in (left, rest))
        left, turn = rest, turn + 1
        if after > (1 - SETTLED) * before:
            return left, edges, meetings
