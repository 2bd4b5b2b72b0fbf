"""Operator 11: alignment of two tokenizers by a dangling-suffix transducer."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pieces of text after which a worker lets go of those that were not used since as many before, and transitions of the
#: transducer, after which it starts afresh.
REMEMBERED, MOVES = 150_000, 400_000
#: The most frequent id pairs, whose counts go to every task; the others are joined.
HELD = 500_000
#: Links of a task that are counted together.
COUNTED = 4_000_000

#: Letters of the Latin blocks, and marks that stand in no piece of the second vocabulary after one of them.
_LETTER, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,"
#: Stands before a full stop or comma that ends a word, while a text is cut.
_TAIL = "\ue000"
_ENDING = re.compile(rf"([{_LETTER}])([{_MARKS}])(?=[ \n]|\Z)")
#: A single space, or line end, between two characters that are no white space, and what ends a word: both vocabularies begin a
#: token there, whatever surrounds it. The space goes, as both put one before a piece; the line end stays, a token of its own in both.
_PLAIN = r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)"
_BOUNDARY, _CUT = re.compile(_PLAIN), re.compile(f"{_PLAIN}|(?={_TAIL})")

_aligners: dict[tuple[str, str], Aligner] = {}


def byte_level_names() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Transducer:
    """Walks two token sequences of the same bytes. A state is the side that leads and the bytes that the other side still owes;
    the next token is always the lagging side's. Transitions are remembered by state and token."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self._reset()

    def _reset(self) -> None:
        self.names: list[tuple[int, bytes]] = [(1, b"")]  # as if B led by nothing: A's token comes next
        self.numbers, self.known = {self.names[0]: 0}, 0
        self.lead: list[int] = [1]  # the side that leads in each state
        self.moves: list[dict[int, int]] = [{}]  # by state, then by token

    def _learn(self, state: int, token: int) -> int:
        """The state after the lagging side's token, from now on remembered; -1 where its bytes contradict those owed."""
        self.known += 1
        self.moves[state][token] = after = self._move(state, token)
        return after

    def _move(self, state: int, token: int) -> int:
        lead, owed = self.names[state]
        own = self.bytes[1 - lead][token]
        if owed.startswith(own):
            after = (lead, owed[len(own) :])
        elif own.startswith(owed):
            after = (1 - lead, own[len(owed) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.numbers:
            self.numbers[after] = len(self.names)
            self.names.append(after)
            self.lead.append(after[0])
            self.moves.append({})
        return self.numbers[after]

    def align(self, a: list[int], b: list[int], shown: tuple[list[str], list[str]], width: int) -> tuple[bytes, list[int]] | None:
        """(the groups as text, the links) of a piece: a group ends where nothing is owed, and its last tokens
        are its link, a * width + b. None if the bytes differ."""
        if self.known > MOVES:
            self._reset()
        moves, lead = self.moves, self.lead
        out, links, state, i, j, from_i, from_j, n, m = [], [], 0, 0, 0, 0, 0, len(a), len(b)
        a_shown, b_shown = shown
        while i < n or j < m:
            if lead[state]:  # B leads, so A's token comes next
                if i == n:
                    return None
                token = a[i]
                i += 1
            else:
                if j == m:
                    return None
                token = b[j]
                j += 1
            after = moves[state].get(token)
            state = self._learn(state, token) if after is None else after
            if not state:
                last = a[i - 1], b[j - 1]
                head = a_shown[last[0]] if i - from_i == 1 else ",".join([a_shown[x] for x in a[from_i:i]])
                tail = b_shown[last[1]] if j - from_j == 1 else ",".join([b_shown[x] for x in b[from_j:j]])
                out.append(f"{head}|{tail}")
                links.append(last[0] * width + last[1])
                from_i, from_j = i, j
            elif state < 0:
                return None
        return (";".join(out).encode(), links) if state == 0 else None


class Aligner:
    """Both tokenizers, what each id stands for in bytes, and the alignments of pieces seen before."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        place = lambda f: f if os.path.isabs(f) else public_tokenizers.path(f)
        self.a = Tokenizer.from_file(place(a_file))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(b_file))
        names = byte_level_names()
        entries = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            a_bytes[k] = bytes(names[c] for c in entry) if all(c in names for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError(f"{b_file} has pieces that join words or lines")
        if any(re.search(f"[{_LETTER}][{_MARKS}]", p) for p in pieces):
            raise ValueError(f"{b_file} has pieces that join words and the marks after them")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.transducer, self.width = Transducer(a_bytes, b_bytes), len(b_bytes)
        self.kind = np.dtype("<i4") if len(a_bytes) * len(b_bytes) < 1 << 31 else np.dtype("<i8")
        self.code = "i" if self.kind.itemsize == 4 else "q"
        self.shown = list(map(str, range(len(a_bytes)))), list(map(str, range(len(b_bytes))))
        self.known: dict[str | tuple[str], tuple | None] = {}
        self.older: dict[str | tuple[str], tuple | None] = {}

    def _learn(self, keys: list[str | tuple[str]]) -> None:
        """Align pieces. One that goes on after a line end starts with it, one that ends a word with _TAIL; neither has a space
        before it. All others do, among them those given as a tuple, whatever they start with."""
        a_bytes, own, known = self.transducer.bytes[0], self.transducer.align, self.known
        wholes, given, skip = [], [], []
        for k in keys:
            if type(k) is tuple:
                k, kind = k[0], ""
            else:
                kind = k[0]
            if kind == "\n":  # B puts a space before
                wholes.append(k), given.append((k, k)), skip.append((0, 1))
            elif kind == _TAIL:  # behind a line end, which is a token of its own
                wholes.append(k[1:]), given.append(("\n" + k[1:],) * 2), skip.append((1, 2))
            else:
                wholes.append(" " + k), given.append((" " + k, k)), skip.append((0, 0))
        a_found = self.a.encode_batch_fast([g[0] for g in given], add_special_tokens=False)
        b_found = self.b.encode([g[1] for g in given], num_threads=1)
        for key, whole, (i, j), a, b in zip(keys, wholes, skip, a_found, b_found):
            a, b = a.ids[i:], b[j:]
            found = own(a, b, self.shown, self.width)
            # B's bytes are A's where they align.
            if found is None or b"".join([a_bytes[x] for x in a]) != whole.encode():
                known[key] = None
            else:
                known[key] = (len(a) << 32 | len(b), found[0], array(self.code, found[1]).tobytes())

    def _cut(self, text: str) -> list[str | tuple[str]]:
        if not text:
            return []
        if _TAIL in text:
            pieces = [(p,) if p[0] == _TAIL else p for p in _BOUNDARY.split(text)]
        else:
            pieces = _CUT.split(_ENDING.sub(rf"\1{_TAIL}\2", text))
        if text[0] == "\n":  # before a text there is a space, though not before what else follows a line end
            pieces[0] = (pieces[0],)
        return pieces

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, digest, links as bytes) of each text."""
        split = [self._cut(t) for t in texts]
        if len(self.known) > REMEMBERED:  # what is still in use comes back from there
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        pieces = []
        for p in set().union(*split) - known.keys():
            if p in older:
                known[p] = older[p]
            else:
                pieces.append(p)
        for at in range(0, len(pieces), 5000):
            self._learn(pieces[at : at + 5000])
        get, size, out = known.__getitem__, self.kind.itemsize, []
        for own in split:
            found = list(map(get, own))
            if not found or None in found:
                out.append((0, 0, 0, "", b""))
                continue
            counts, shown, links = zip(*found)
            n, links = sum(counts), b"".join(links)
            out.append((n >> 32, n & 0xFFFFFFFF, len(links) // size, hashlib.sha256(b";".join(shown)).hexdigest(), links))
        return out


def _aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _aligners:
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all links of the batch, how many each row has)."""
    lists = batch.column("links")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def _pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether that is the most of its B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_links(batch)[0])
            size += len(held[-1])
            if size > COUNTED:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = common.cut(counts.withColumn("b", F.col("pair") % width), "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return common.cut(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def align(docs: DataFrame, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens are plain text.
    Texts are cut at single spaces and line ends between other characters and before what ends a word, where both vocabularies begin a token, so the alignment of a text
    is that of its pieces one after the other. A group ends where tokens of both end; these two are its link. n_best and
    count_sum look at the counts of id pairs over all links of docs: the `held` most frequent pairs are looked up in the tasks,
    all others are joined.

    Null and empty texts, and those that either tokenizer doesn't give back byte for byte (as with U+2581), have zeros and an
    empty digest. A null doc_id stays null; repeated rows give repeated rows, each of which counts; very long texts are aligned
    whole; an empty table gives no rows; other columns of docs are left out.
    """
    spark = docs.sparkSession
    rows = common.texts(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = _aligner(a_file, b_file)
    width, links_type, links_of = own.width, "int" if own.kind.itemsize == 4 else "bigint", pa.list_(pa.int32() if own.kind.itemsize == 4 else pa.int64())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = aligner.align(part.column("text").to_pylist())
                n = [np.array([f[k] for f in found], np.int64) for k in range(3)]
                flat = np.frombuffer(b"".join(f[4] for f in found), aligner.kind)
                links = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[2])].astype(np.int32)), pa.array(flat)).cast(links_of)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, n), links, pa.array([f[3] for f in found])], names=["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"])

    aligned = rows.mapInArrow(encode, f"doc_id {kind}, n_a long, n_b long, n_groups long, links array<{links_type}>, groups_sha256 string")
    aligned = common.cut(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = _pair_counts(aligned, width)
    frequent = common.cut(common.most_frequent(counts, "n", held), "frequent_pairs")
    table = frequent.toPandas().sort_values("pair")  # at most `held` rows
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            links, sizes = _links(batch)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            known = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)
            total, highest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner[known], n[at[known]])
            np.add.at(highest, owner[known], best[at[known]].astype(np.int64))
            rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner[~known], minlength=batch.num_rows))].astype(np.int32)), pa.array(links[~known]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups")), pa.array(highest), pa.array(total), batch.column("groups_sha256"), rest], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256", "rest"])

    out = aligned.mapInArrow(look_up, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, rest array<long>")
    best, total = F.col("n_best"), F.col("count_sum")
    rare = counts.join(frequent.select("pair"), "pair", "left_anti")
    if rare.head(1):
        out = common.cut(out, "looked_up")
        more = out.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times")).join(rare, "pair")
        more = more.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        out = out.join(more, "row", "left")
        best, total = best + F.coalesce("more_best", F.lit(0)), total + F.coalesce("more_sum", F.lit(0))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), best.alias("n_best"), total.alias("count_sum"), "groups_sha256")
