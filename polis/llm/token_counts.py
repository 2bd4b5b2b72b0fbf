"""Operator 1: token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Distinct pieces whose lengths a worker remembers; beyond that it starts afresh.
REMEMBERED = 500_000
#: Bytes of text handed to the library at once.
BATCH_BYTES = 1 << 20

_lengths: dict[str, dict[bytes, int]] = {}
_encoders: dict[str, object] = {}


def _encoder(vocabulary: str):
    if vocabulary not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        _encoders[vocabulary] = encoder
    return _encoders[vocabulary]


def _byte_batches(pieces: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """Runs of pieces of about limit bytes each, longest first so that each run holds pieces of like length."""
    run, size = [], 0
    for piece in sorted(pieces, key=len, reverse=True):
        run.append(piece)
        size += len(piece) + 16
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_tokens(texts: list[str | None], vocabulary: str) -> list[int]:
    """Tokens of each text. ASCII white space, which the vocabulary's pattern never joins across, is the safe boundary at
    which texts are split; a piece seen before in this worker keeps its length."""
    encoder, known = _encoder(vocabulary), _lengths.setdefault(vocabulary, {})
    split = [(t or "").encode().split() for t in texts]
    new: set[bytes] = set()
    for pieces in split:
        new.update(pieces)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    else:
        new.difference_update(known)
    for run in _byte_batches(list(new), BATCH_BYTES):
        for piece, encoded in zip(run, encoder.encode_batch_fast([p.decode() for p in run], add_special_tokens=False)):
            known[piece] = len(encoded)
    get = known.__getitem__
    return [sum(map(get, pieces)) for pieces in split]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", max_tokens: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, without a shuffle.

    vocabulary: a file of public_tokenizers or an absolute path, present on every executor. The vocabulary must drop white
    space, as word_bpe_49k.json does. Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated
    rows give repeated rows; an empty table gives no rows; other columns of docs are left out.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, values = 0, batch.column("text")
            sizes = batch.column("n_bytes").to_pylist()
            while start < len(values):  # slices balanced by bytes, whatever the number of rows
                end, size = start, 0
                while end < len(values) and (end == start or size + sizes[end] <= 4 * BATCH_BYTES):
                    size += sizes[end]
                    end += 1
                n = count_tokens(values.slice(start, end - start).to_pylist(), vocabulary)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(start, end - start),
                        "n_bytes": pa.array(sizes[start:end], pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "over_limit": pa.array([x > max_tokens for x in n], pa.bool_()),
                    }
                )
                start = end

    rows = common.texts(docs, key, text).selectExpr("doc_id", "text", "CAST(octet_length(text) AS BIGINT) AS n_bytes")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
