"""Operator 5: removal of repeated strings by deep-shallow sorting of a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: Bytes of the gram that a window of the full length is found by.
GRAM = 32
#: Suffixes of one gram that are sorted together; those of a more frequent gram are parted by longer grams first.
LARGE = 2000
#: Tasks over which the rows of one string are spread where they meet its first place.
SALT = 16
#: Bytes of text that a bucket of grams stands for, and open suffixes that a bucket sorts.
BUCKET_BYTES, BUCKET_ROWS = 48_000_000, 60_000
#: Bytes of text that are hashed at once.
RUN_BYTES = 1 << 20
#: Window starts of a longer text that are hashed at once.
PART_BYTES = 1 << 23
#: Bytes beyond the gram to which multikey passes sort before blind tries take over.
SHALLOW = 16

_PLACE = np.uint64((1 << 24) - 1)
FOUND = "kind int, doc long, at long, lo int, hi int, key long, part binary"
OPEN = "doc long, at long, lo int, hi int, key long, part binary"
PLACES = "doc long, start long, stop long"


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash, hash of what the windows cover) for runs of windows with one anchor.

    The anchor of a window is the leftmost gram of least hash in it, so equal windows have their anchors at equal places.
    """
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    if len(data) < length or not (ends - starts >= length).any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    sums, inverse = hashing.prefixes(data), hashing.powers("inverse", len(data) + 1)
    h = hashing.mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    low, size, w = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    inside = np.zeros(len(data) + 1, np.int8)  # windows that end within their document
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    p = np.flatnonzero(np.cumsum(inside[: len(low)], dtype=np.int8))
    own = (low[p] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    anchor, first, last = own[cut], p[cut], p[np.r_[cut[1:] - 1, len(p) - 1]]
    cover = hashing.mix(hashing.spans(sums, first, last + length) + (anchor - first).astype(np.uint64))
    return anchor, first, last, h[anchor], cover


class Block:
    """The documents of a block in order, as one run of bytes; rows of one doc_id are parts of one document."""

    def __init__(self, table: pa.Table):
        key, text = table.column("doc").to_numpy(), table.column("text").to_pylist()
        raw = [t.encode() for t in text]
        self.order = sorted(range(len(raw)), key=lambda i: (key[i], raw[i]))
        self.raw = [raw[i] for i in self.order]
        self.doc = key[self.order].astype(np.int64)
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.ends = np.cumsum(self.size)
        start = self.ends - self.size
        # Where each part starts within its document.
        head = np.flatnonzero(np.r_[True, self.doc[1:] != self.doc[:-1]]) if len(raw) else np.empty(0, np.int64)
        self.base = start - np.repeat(start[head], np.diff(np.r_[head, len(raw)]))
        self.start = start

    def runs(self):
        """(first row, last row + 1) of runs of about RUN_BYTES."""
        at = 0
        while at < len(self.raw):
            end, size = at, 0
            while end < len(self.raw) and (end == at or size + self.size[end] <= RUN_BYTES):
                size += self.size[end]
                end += 1
            yield at, end
            at = end

    def anchors(self, length: int, gram: int, size: int) -> dict[str, np.ndarray]:
        """Anchors of the block in order; new is False where the same cover stands earlier in the block, byte by byte.

        A longer text goes in parts of size bytes and the length - 1 after them, so each window starts in one part only.
        """
        parts = []
        for a, b in self.runs():
            whole = np.frombuffer(b"".join(self.raw[a:b]), np.uint8)
            for lo in range(0, max(1, len(whole)), size):
                data = whole[lo : lo + size + length - 1]
                ends = np.clip(self.ends[a:b] - self.start[a] - lo, 0, len(data))
                anchor, first, last, gram_hash, cover = anchors(data, ends, length, gram)
                row = a + np.searchsorted(ends, first, "right")
                at = self.start[a] + lo - self.start[row] + self.base[row]
                parts.append((row, anchor + at, first + at, last + at, gram_hash, cover))
        out = dict(zip(("row", "anchor", "first", "last", "gram", "cover"), map(np.concatenate, zip(*parts)))) if parts else {}
        if out:
            _, index, inverse = np.unique(out["cover"], return_index=True, return_inverse=True)
            out["new"] = np.zeros(len(out["row"]), bool)
            out["new"][index] = True
            again = np.flatnonzero(~out["new"])
            base = self.base[out["row"]]
            row, lo, hi = out["row"].tolist(), (out["first"] - base).tolist(), (out["last"] - base + length).tolist()
            for i, j in zip(again.tolist(), index[inverse[again]].tolist()):
                if self.raw[row[i]][lo[i] : hi[i]] != self.raw[row[j]][lo[j] : hi[j]]:  # the hashes agree by chance
                    out["new"][i] = True
        return out


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans in order, those that touch made one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    change = np.r_[True, doc[1:] != doc[:-1]]
    shift = np.cumsum(change) * (int(stop.max()) + 1)  # so that the furthest stop so far is a document's own
    furthest = np.maximum.accumulate(stop + shift) - shift
    new = change | np.r_[True, start[1:] > furthest[:-1]]
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(stop, head)


def _grams(length: int, gram: int, buckets: int, size: int):
    def of(table: pa.Table) -> pa.Table:
        found = Block(table).anchors(length, gram, size)
        rows = []
        if found:
            grams, count = np.unique(found["gram"][found["new"]], return_counts=True)
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(order) else np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]), len(order)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    own = order[lo:hi]
                    rows.append((int(bucket[own[0]]), table.column("block")[0].as_py(), grams[own].tobytes(), count[own].astype(np.uint32).tobytes()))
        columns = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "grams", "counts"])

    return of


def _repeated(large: int):
    """Of a bucket's grams those seen more than once, for each block that has them."""

    def of(table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
        block = np.repeat(table.column("block").to_numpy(), list(map(len, grams)))
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        again = total > 1
        rows, all_grams = [], np.concatenate(grams)[again]
        block, hot = block[again], (total[again] > large).astype(np.uint8)
        order = np.lexsort((all_grams, block))
        block, all_grams, hot = block[order], all_grams[order], hot[order]
        edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)] if len(block) else [0]
        for lo, hi in zip(edges, edges[1:]):
            rows.append((int(block[lo]), all_grams[lo:hi].tobytes(), hot[lo:hi].tobytes()))
        columns = list(zip(*rows)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["block", "grams", "hot"])

    return of


def _open(length: int, gram: int, size: int):
    """What a block knows of repeats: removed spans (kind 0), suffixes to sort (1) and suffixes of frequent grams (2)."""

    def of(table: pa.Table, known: pa.Table) -> pa.Table:
        shape = [("kind", pa.int32()), ("doc", pa.int64()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("part", pa.binary())]
        out: list[list] = [[] for _ in shape]

        def add(kind, doc, at, lo, hi, key, part=None):
            n = len(doc)
            for k, v in enumerate((np.full(n, kind) if isinstance(kind, int) else kind, doc, at, lo, hi, key)):
                out[k].append(v)
            out[6].extend(part if part is not None else [None] * n)

        block = Block(table)
        found = block.anchors(length, gram, size)
        if found:
            doc = block.doc[found["row"]]
            gone = ~found["new"]
            spans = [(doc[gone], found["first"][gone], found["last"][gone] + length)]
            if known.num_rows:
                grams = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in known.column("grams")])
                hot = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in known.column("hot")])
                order = np.argsort(grams)
                grams, hot = grams[order], hot[order]
                at = np.minimum(np.searchsorted(grams, found["gram"]), len(grams) - 1)
                again = found["new"] & (grams[at] == found["gram"])
                i = np.flatnonzero(again)
                base = block.base[found["row"][i]]
                lo, hi = found["first"][i] - base, found["last"][i] - base + length
                part = [block.raw[r][a:b] for r, a, b in zip(found["row"][i].tolist(), lo.tolist(), hi.tolist())]
                add(1 + (hot[at[i]] > 0), doc[i], found["anchor"][i], found["anchor"][i] - found["last"][i], found["anchor"][i] - found["first"][i], found["gram"][i].view(np.int64), part)
            a, b, c = _joined(*map(np.concatenate, zip(*spans)))
            add(0, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), c)
        arrays = [pa.array(np.concatenate(c) if c else [], t) for c, (_, t) in zip(out[:6], shape)]
        return pa.table([*arrays, pa.array(out[6], pa.binary())], names=[n for n, _ in shape])

    return of


def _longer(length: int, gram: int, whole: bool):
    """Suffixes of a gram as suffixes of longer grams: of about half of what the windows hold beside the gram, on its left for
    windows that start far before the anchor and on its right for the others; or, whole, as single windows."""
    left = (length - gram) // 2

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, lo, hi, part in zip(*(batch.column(c).to_pylist() for c in ("doc", "at", "lo", "hi", "part"))):
                ranges = [(d, d) for d in range(lo, hi + 1)] if whole else [(max(lo, left), hi), (lo, min(hi, left - 1))]
                for a, b in ranges:
                    if a <= b:
                        if whole:
                            known = part[hi - a : hi - a + length]
                        else:
                            known = b"<" + part[hi - left : hi + gram] if a >= left else b">" + part[hi : hi + length - left + 1]
                        rows.append((doc, at, a, b, xxhash.xxh3_64_intdigest(known) - (1 << 63), part[hi - b : hi - a + length]))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc", "at", "lo", "hi", "key", "part"])

    return split


def _parted(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """(suffixes to sort, removed spans) of the suffixes of frequent grams.

    Suffixes whose windows are the same bytes keep only the first of them; what is left of a gram goes to the sort, by longer
    grams where it is still too much for a task, and in the end by whole windows, which the first step settles alone.
    """
    ready, gone = None, []
    for level in range(3):
        same = ["key", "lo", "hi", "part"]
        first = common.cut(rows.groupBy(*same).agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")), "first")
        # A frequent string has one first place, given to each of the tasks that its rows are spread over.
        salted = first.filter("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALT)).cast("int")).join(salted, [*same, "salt"])
        later = met.filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
        gone.append(later.select("doc", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("stop")))
        distinct = first.select("first.doc", "first.at", "lo", "hi", "key", "part")
        sizes = distinct.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        sized = common.cut(distinct.join(sizes, "key"), "sized")
        own = sized.filter(F.col("size") <= LARGE).drop("size").select("doc", "at", "lo", "hi", "key", "part")
        ready = own if ready is None else ready.unionByName(own)
        rows = sized.filter(F.col("size") > LARGE)
        if level == 2 or not rows.head(1):
            break
        rows = common.cut(rows.select("doc", "at", "lo", "hi", "part").mapInArrow(_longer(length, gram, level == 1), OPEN), "longer")
    return ready, gone


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of strings of one length, which agree before at."""
    end = len(a)
    while at < end:
        mid = (at + end + 1) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            end = mid - 1
    return at


def blind_trie(strings: list[bytes], depth: int) -> list[tuple[int, int]]:
    """(index, common prefix with the one before) of distinct strings of one length in order; all agree before depth.

    A node is [place of the byte that it branches by, children by byte]; the descent looks at no other bytes, and one
    comparison with the leaf that it reaches tells where the new string leaves the trie.
    """
    root: list | int = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        at = _common(s, strings[node], depth)
        other, above, node = strings[node], None, root
        while not isinstance(node, int) and node[0] < at:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == at:
            node[1][s[at]] = i
            continue
        new = [at, {s[at]: i, other[at]: node}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out, stack = [], [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, int):
            out.append((node, shared))
            continue
        children = sorted(node[1].items(), reverse=True)
        stack += [(child, node[0]) for _, child in children[:-1]]
        stack.append((children[-1][1], shared))
    return out


def deep_shallow(group: np.ndarray, strings: list[bytes], width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of strings, short ones padded with zeros, within groups; -1 where a group starts.

    Multikey passes take eight bytes as a key and part the strings that still agree, to a shallow depth; blind tries order
    those that agree beyond it.
    """
    width = -(-max(width, 1) // 8) * 8
    strings = [s.ljust(width, b"\0") for s in strings]
    keys = np.frombuffer(b"".join(strings), ">u8").reshape(len(strings), width // 8)
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    lcp = np.where(new, -1, width)
    passes = min(-(-shallow // 8), width // 8)
    for c in range(passes):
        part = np.cumsum(new)
        tied = np.flatnonzero(np.bincount(part)[part] > 1)
        if not len(tied):
            break
        key, part = keys[order[tied], c].astype(np.uint64), part[tied]
        by = np.lexsort((key, part))
        order[tied], key = order[tied][by], key[by]
        split = np.flatnonzero((part[1:] == part[:-1]) & (key[1:] != key[:-1])) + 1
        apart = key[split] ^ key[split - 1]
        lcp[tied[split]] = 8 * c + sum((apart < np.uint64(1 << (8 * b))).astype(np.int64) for b in range(1, 8))
        new[tied[split]] = True
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(order)])
    for at, n in zip(heads[size > 1].tolist(), size[size > 1].tolist()):
        same: dict[bytes, list[int]] = {}
        for i in order[at : at + n].tolist():
            same.setdefault(strings[i], []).append(i)
        if len(same) == 1:
            continue
        distinct, put, before = list(same), at, lcp[at]
        for k, shared in blind_trie(distinct, 8 * passes):
            own = same[distinct[k]]
            order[put : put + len(own)] = own
            lcp[put] = shared
            lcp[put + 1 : put + len(own)] = width
            put += len(own)
        lcp[at] = before
    return order, lcp


def _settled(length: int, gram: int, shallow: int):
    """Windows of a bucket's suffixes that also start earlier."""

    def of(table: pa.Table) -> pa.Table:
        doc, at = table.column("doc").to_numpy(), table.column("at").to_numpy()
        order = np.lexsort((at, doc))
        table = table.take(pa.array(order))
        doc, at = doc[order], at[order]
        lo, hi, key = (table.column(c).to_numpy() for c in ("lo", "hi", "key"))
        part = table.column("part").to_pylist()
        widest = length - gram
        right, right_lcp = deep_shallow(key, [s[h:] for s, h in zip(part, hi.tolist())], length, gram + shallow)
        left, left_lcp = deep_shallow(key, [s[h - 1 :: -1] if h else b"" for s, h in zip(part, hi.tolist())], widest, shallow)
        again = np.zeros((len(doc), widest + 3), bool)
        after, before = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        for d in range(widest + 1):  # windows that start d bytes before their anchor
            own = np.flatnonzero((lo <= d) & (d <= hi))
            if len(own) < 2:
                continue
            after[right], before[left] = np.cumsum(right_lcp < length - d), np.cumsum(left_lcp < d)
            _, first = np.unique(after[own] * (len(doc) + 1) + before[own], return_index=True)
            dup = np.ones(len(own), bool)
            dup[first] = False
            again[own[dup], d + 1] = True
        edge = np.diff(again.astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)  # windows low .. high - 1 bytes before the anchor
        spans = _joined(doc[row], at[row] - (high - 1), at[row] - low + length)
        return pa.table([pa.array(x, pa.int64()) for x in spans], names=["doc", "start", "stop"])

    return of


def dedup_substrings(docs: DataFrame, length: int = 100, gram: int = GRAM, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, stop>>, kept binary for each row of docs; with carry also kept_text, the kept
    bytes without the halves of characters at the edges of a removed run, and row, a struct of all columns of docs.

    A byte goes when a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or earlier
    in the same one. Strings are judged on the input and never cross documents. Spans are the maximal removed runs.

    Blocks of documents find the anchor gram of each window; grams that stand once in the corpus can't be part of a repeat and
    stay where they are. The suffixes at repeated anchors, forwards and backwards, are sorted bucket by bucket. Of the suffixes
    of a gram more frequent than LARGE, those of equal bytes first keep only their first, and longer grams part the rest, so no
    task holds a frequent gram. Hashes only bring candidates together: every removed string is compared byte by byte.

    Null text is empty. Rows without doc_id come after all others, in the order of their text's hash. Rows of one doc_id are
    parts of one document, in the order of their bytes. Very long texts go in parts, and matches cross these. An empty table
    gives no rows; other columns, whatever their names, are left out or carried.
    """
    if not 0 < gram < length:
        raise ValueError("gram must be shorter than length")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n, buckets = max(1, -(-total // common.BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int").alias("block")
    blocked = rows.select("doc", "text", block).repartition(n, "block")
    grams = blocked.groupBy("block").applyInArrow(_grams(length, gram, buckets, PART_BYTES), "bucket int, block int, grams binary, counts binary")
    known = grams.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_repeated(LARGE), "block int, grams binary, hot binary")
    found = blocked.groupBy("block").cogroup(known.repartition(n, "block").groupBy("block")).applyInArrow(_open(length, gram, PART_BYTES), FOUND)
    found = common.cut(found, "suffixes")
    suffixes, gone = found.filter("kind = 1").select("doc", "at", "lo", "hi", "key", "part"), [found.filter("kind = 0").select("doc", F.col("at").alias("start"), F.col("key").alias("stop"))]
    frequent = found.filter("kind = 2")
    if frequent.head(1):
        ready, later = _parted(frequent.select("doc", "at", "lo", "hi", "key", "part"), length, gram)
        suffixes, gone = suffixes.unionByName(ready), gone + later
    n_buckets = max(1, -(-suffixes.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(n_buckets)).alias("bucket")
    gone.append(suffixes.select("*", bucket).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_settled(length, gram, SHALLOW), PLACES))
    spans = gone[0]
    for other in gone[1:]:
        spans = spans.unionByName(other)
    shape = common.shape(rows, "n_bytes long, spans array<struct<start:long,stop:long>>, kept binary" + (", kept_text string" if carry else ""))

    def finish(table: pa.Table, spans: pa.Table) -> pa.Table:
        held = Block(table)
        doc, start, stop = _joined(*(spans.column(c).to_numpy() for c in ("doc", "start", "stop")))
        lo, hi = np.searchsorted(doc, held.doc), np.searchsorted(doc, held.doc, "right")
        kept, whole, places = [], [], []
        for i, raw in enumerate(held.raw):
            base, own = int(held.base[i]), []
            for a, b in zip(start[lo[i] : hi[i]].tolist(), stop[lo[i] : hi[i]].tolist()):
                a, b = max(0, a - base), min(len(raw), b - base)
                if a < b:
                    own.append({"start": a, "stop": b})
            edges = [0, *(x for s in own for x in (s["start"], s["stop"])), len(raw)]
            pieces = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
            kept.append(b"".join(pieces))
            if carry:  # the input is UTF-8, so only the ends of pieces can be broken
                whole.append("".join(p.decode(errors="ignore") for p in pieces))
            places.append(own)
        order = pa.array(held.order, pa.int64())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [table.column("doc_id").take(order), pa.array(held.size, pa.int64()), pa.array(places, span), pa.array(kept, pa.binary())]
        names = ["doc_id", "n_bytes", "spans", "kept"]
        if carry:
            columns, names = [*columns, pa.array(whole, pa.string()), table.column("row").take(order)], [*names, "kept_text", "row"]
        return pa.table(columns, names=names)

    whole = rows.select("*", block).repartition(n, "block").groupBy("block")
    return whole.cogroup(spans.select("*", block).repartition(n, "block").groupBy("block")).applyInArrow(finish, shape)
