"""Operator 10: WARC archives, written with segmented records and chunked bodies, and read back by segment reassembly."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"

#: Bytes of a batch of records on its way from Python.
BATCH_BYTES = 4 << 20

RECORD = "record_id string, warc_type string, page_id string, url string, payload_digest string, refers_to string, origin_id string, segment int, total_length long, block binary"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in HTTP chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing, with chunk extensions and trailers allowed; ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size, at = int(body[at:end].split(b";")[0], 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record without its end mark; line ends within values become spaces."""
    lines = [VERSION, *(k + b": " + b" ".join(v.splitlines()) for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def page_records(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, row: int, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The record of a page and, where its block is longer than segment_bytes, its continuation records."""
    name = lambda k: b"<urn:uuid:%b>" % str(uuid.UUID(hashlib.md5(f"{page_id}/{row}/{k}".encode()).hexdigest())).encode()
    common = [(b"WARC-Date", DATE)] + ([(b"WARC-Target-URI", url.encode())] if url is not None else [])
    own = [(b"WARC-Payload-Digest", b"sha1:" + digest.encode())] + ([(b"X-Page-ID", page_id.encode())] if page_id is not None else [])
    if refers_to is not None:
        yield record([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", name(1)), *common, *own, (b"WARC-Profile", REVISIT_PROFILE), (b"X-Refers-To-Page-ID", refers_to.encode())], HTTP_HEAD.replace(b"Transfer-Encoding: chunked\r\n", b""))
        return
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        kind = b"response" if k == 1 else b"continuation"
        fields = [(b"WARC-Type", kind), (b"WARC-Record-ID", name(k)), *common, *(own if k == 1 else [])]
        if len(parts) > 1:
            fields += [(b"WARC-Segment-Number", b"%d" % k)]
            fields += [(b"WARC-Segment-Origin-ID", name(1))] if k > 1 else []
            fields += [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == len(parts) else []
        yield record(fields, part)


def records_in(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, which is gzip (one member or many) or plain."""
    source = io.BufferedReader(_Inflated(archive), 1 << 16) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one is due: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := source.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its Content-Length")
        yield fields, block


class _Inflated(io.RawIOBase):
    """The inflated content of gzip members, a little at a time."""

    def __init__(self, data: bytes):
        self.rest, self.z, self.out = data, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.out:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.rest:
                return 0
            self.out = self.z.decompress(self.rest, 1 << 20)
            if not self.z.eof:
                self.rest = self.z.unconsumed_tail
                if not self.out and not self.rest:
                    return 0
        n = min(len(buffer), len(self.out))
        buffer[:n], self.out = self.out[:n], self.out[n:]
        return n


def _in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES or len(held) >= 5000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, segment_bytes: int = 16_384, chunk_bytes: int = 4096, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each row of pages under path, as gzip WARC files.

    Of rows with equal payloads of at least min_revisit_bytes, the one with the largest page_id is a response and the
    others are revisits of it; a null page_id is smaller than any. Rows that repeat the largest page_id with the same
    payload are responses too. Null html is an empty payload, a null url leaves the header out, and an empty table gives
    no records.
    """
    rows = pages.select(F.col(key).cast("string").alias("page_id"), F.col(key).alias("order"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("order").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(repeated.select(F.col("digest").alias("of"), "kept"), (F.col("digest") == F.col("of")) & (F.octet_length("payload") >= min_revisit_bytes), "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("order").eqNullSafe(F.col("kept")), F.col("kept").cast("string"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.monotonically_increasing_id().alias("row"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for n, batch in enumerate(batches):
                for k in range(batch.num_rows):
                    row = [c[k].as_py() for c in batch.columns]
                    if not n and not k:
                        info = hashlib.md5(f"info/{row[-1]}".encode()).hexdigest()
                        yield (record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:uuid:%b>" % str(uuid.UUID(info)).encode()), (b"WARC-Date", DATE), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n"),)
                    for x in page_records(*row, segment_bytes, chunk_bytes):
                        yield (x,)

        return _in_batches(each(), ["record"], [pa.binary()], lambda row: len(row[0]))

    out = rows.mapInArrow(records, "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path, one row each, as RECORD says; warcinfo and unknown types too."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for content in batch.column("content"):
                    for f, block in records_in(content.as_py()):
                        digest = f.get("warc-payload-digest")
                        yield (
                            f.get("warc-record-id"), f.get("warc-type"), f.get("x-page-id"), f.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), f.get("x-refers-to-page-id"),
                            f.get("warc-segment-origin-id"), int(f["warc-segment-number"]) if "warc-segment-number" in f else None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block,
                        )

        text = pa.string()
        return _in_batches(each(), [x.split()[0] for x in RECORD.split(", ")], [text] * 7 + [pa.int32(), pa.int64(), pa.binary()], lambda row: len(row[-1]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Response and revisit records with whole blocks; complete is false where segments lack or lengths disagree.

    Only segmented records shuffle, by the id of their origin: a group is the segments of one record.
    """
    known = records.filter(F.col("warc_type").isin("response", "revisit", "continuation"))
    whole = known.filter("segment IS NULL").withColumn("complete", F.lit(True))
    parts = known.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(
        *map(first, ["warc_type", "page_id", "url", "payload_digest", "refers_to"]), F.max("total_length").alias("total_length"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    joined = joined.withColumn("block", F.expr("CAST(array_join(transform(parts, x -> CAST(x.block AS STRING)), '') AS BINARY)"))
    complete = F.expr("transform(parts, x -> x.segment) = sequence(1, size(parts)) AND octet_length(block) <=> total_length")
    columns = ["warc_type", "page_id", "url", "payload_digest", "refers_to", "block", "complete"]
    return whole.select(columns).unionByName(joined.withColumn("complete", complete).select(columns))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload, payload_digest, refers_to, verified of the pages archived under path.

    The payload of a revisit is null. verified: all segments are there, their lengths add up, the chunked framing is sound,
    and the payload has the digest its record names.
    """

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, fine = [], []
            for kind, digest, block, complete in zip(*(batch.column(c).to_pylist() for c in ("warc_type", "payload_digest", "block", "complete"))):
                if kind == "revisit":
                    payload.append(None)
                    fine.append(complete)
                    continue
                head, _, body = block.partition(END)
                try:
                    body = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError:
                    complete = False
                payload.append(body)
                fine.append(complete and hashlib.sha1(body).hexdigest() == digest)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "warc_type")), pa.array(payload, pa.binary()), *(batch.column(c) for c in ("payload_digest", "refers_to")), pa.array(fine, pa.bool_())],
                names=["page_id", "url", "record_type", "payload", "payload_digest", "refers_to", "verified"],
            )

    whole = reassemble(read_records(spark, path))
    return whole.mapInArrow(payloads, "page_id string, url string, record_type string, payload binary, payload_digest string, refers_to string, verified boolean")
