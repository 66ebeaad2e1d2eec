"""WARC archives: writing records in segments, and reassembly on reading.

Writing.  A page is an HTTP response record whose body is sent in chunks
(``Transfer-Encoding: chunked``).  Of pages with equal payloads of ``least``
bytes or more the one with the smallest id is the response; the others are
revisit records that refer to it and hold its headers only.  A block longer
than ``segment_bytes`` is cut: a first segment and continuation records, which
name the first one's record id, their number and, the last one, the total
length.  Records are written by Spark's text writer with the end of a WARC
record as line separator, gzipped, at most ``file_records`` to a file.

Reading.  Files are parsed record by record by their content lengths, so a
payload may hold anything, in runs of bounded size.  Whole records are decoded
where they are read.  Segments are grouped by origin identifier, ordered by
number and joined in a stream that holds one record; the total length must
match and no number may be missing, or the record is reported as not
``complete``, without payload.  Then the chunked framing is decoded and the
payload's digest is compared with the header's.

Defined results: a null html is an empty payload; empty payloads are equal to
each other; rows with equal id and payload give one row; a row without id is a
response of its own, also if its payload is known; an empty table gives an
empty one; a null url gives a record without target; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaflow.llm.common import scratch_path, texts_of

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_RECORDS = 20_000
LEAST = 0
DATE = "2024-01-01T00:00:00Z"
#: What a batch of parsed records may hold.
RUN_BYTES = 4 << 20

_END = "\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


# ----------------------------------------------------------------------- writing

def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records(page, url: str | None, payload: bytes, first, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page; ``first`` is the page that it revisits, if any."""
    digest = digest_of(payload)
    own = record_id(page, digest)
    headers = {"WARC-Record-ID": own, "WARC-Target-URI": re.sub(r"\s", "", url) if url else None,
               "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if first is not None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        yield record("revisit", headers | {"WARC-Profile": _REVISIT, "WARC-Refers-To": record_id(first, digest)}, http.encode())
        return
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(payload, chunk_bytes))
    if len(block) <= segment_bytes:
        yield record("response", headers, block)
        return
    total = -(-len(block) // segment_bytes)
    for k in range(total):
        part = block[k * segment_bytes:(k + 1) * segment_bytes]
        number = {"WARC-Segment-Number": k + 1}
        if k == 0:
            yield record("response", headers | number, part)
        else:
            yield record("continuation", {
                "WARC-Record-ID": f"{own[:-1]}:{k + 1}>", "WARC-Segment-Origin-ID": own, **number,
                "WARC-Segment-Total-Length": len(block) if k == total - 1 else None}, part)


def _written(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                              texts_of(batch.column(2)), batch.column(3).to_pylist()):
                for r in records(page, url, html or b"", first, segment_bytes, chunk_bytes):
                    out.append(r)
                    held += len(r)
                if held > RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
          least: int = LEAST, file_records: int = FILE_RECORDS, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> None:
    """Write archives of ``pages`` below ``path``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                         html.alias("html"), F.sha2(html.cast("binary"), 256).alias("key"))
    first = (pages.where(F.col("page").isNotNull() & (F.octet_length("html") >= least)).groupBy("key")
             .agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").select("key", "first"))
    revisited = F.when(F.col("page") > F.col("first"), F.col("first"))
    (pages.join(first, "key", "left").select("page", "url", "html", revisited.alias("first"))
     .mapInArrow(_written(segment_bytes, chunk_bytes), "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path))


# ----------------------------------------------------------------------- reading

def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped file, holding little more than one record."""
    stream, at, data = zlib.decompressobj(31), 0, b""

    def more(size: int) -> bool:
        """Decompress until ``data`` has ``size`` bytes; false at the end of the file."""
        nonlocal stream, at, data
        parts, have = [data], len(data)
        while have < size and at < len(content):
            piece = stream.decompress(stream.unconsumed_tail or content[at:at + 65536], 1 << 20)
            if not stream.unconsumed_tail:
                at += 65536
            if stream.eof:  # the next gzip member
                at = min(at, len(content)) - len(stream.unused_data)
                stream = zlib.decompressobj(31)
            parts.append(piece)
            have += len(piece)
        data = b"".join(parts)
        return have >= size

    while more(1):
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more(len(data) + 1):
                raise ValueError("a WARC header does not end")
        lines = data[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not more(end + 4 + size):
            raise ValueError("a WARC block does not end")
        yield headers, data[end + 4:end + 4 + size]
        more(end + 8 + size)
        data = data[end + 8 + size:]


def http_body(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP message, its chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (
        x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return headers, body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return headers, b"".join(parts)
        part = body[end + 2:end + 2 + size]
        if len(part) < size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not have its length")
        parts.append(part)
        at = end + 4 + size


_FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
           ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
           ("block", pa.binary())]
_SEGMENTS = ("record_type string, record_id string, url string, refers_to string, digest string, origin string, "
             "segment int, total long, block binary")
_RECORDS = [("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
            ("complete", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_RESULT = ("record_type string, record_id string, url string, refers_to string, complete boolean, payload_bytes long, "
           "payload_digest string, payload binary")


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)],
                                      names=[n for n, _ in fields])


def _in_runs(rows: Iterator[tuple], fields: list[tuple], size_at: int) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += 200 + len(r[size_at] or b"")
        if total > RUN_BYTES:
            yield _batch(held, fields)
            held, total = [], 0
    if held:
        yield _batch(held, fields)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                for h, block in parsed(batch.column(0)[i].as_py()):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    yield (h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-refers-to"),
                           h.get("warc-payload-digest"), h.get("warc-segment-origin-id", h["warc-record-id"]),
                           int(number) if number else None, int(total) if total else None, block)
    return _in_runs(rows(), _FIELDS, 8)


def _finished(row: tuple, block: bytes | None, with_payload: bool) -> tuple:
    kind, name, url, refers, digest = row[:5]
    digest = digest.removeprefix("sha1:") if digest else None
    if block is None:
        return kind, name, url, refers, False, None, digest, None
    headers, payload = http_body(block)
    if kind == "revisit":
        size = headers.get("content-length")
        return kind, name, url, refers, True, int(size) if size else None, digest, None
    found = digest_of(payload)
    if digest and found != digest:
        return kind, name, url, refers, False, None, digest, None
    return kind, name, url, refers, True, len(payload), found, payload if with_payload else None


def _decoded(with_payload: bool):
    """Whole records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_finished(r, r[8], with_payload) for batch in batches
                for r in zip(*(batch.column(i).to_pylist() for i in range(9))))
        return _in_runs(rows, _RECORDS, 7)
    return run


def _joined(with_payload: bool):
    """Segments sorted by (origin, number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            first, parts, number, total, whole = None, [], 0, None, True
            for batch in batches:
                for r in zip(*(batch.column(i).to_pylist() for i in range(9))):
                    if first is None or r[5] != first[5]:
                        if first is not None:
                            yield close(first, parts, total, whole)
                        first, parts, number, total, whole = r, [], 0, None, r[6] == 1
                    if r[6] == number:  # a copy of a segment that is there
                        continue
                    whole &= r[6] == number + 1
                    number = r[6]
                    parts.append(r[8])
                    total = r[7] if r[7] is not None else total
            if first is not None:
                yield close(first, parts, total, whole)
        return _in_runs(rows(), _RECORDS, 7)

    def close(first: tuple, parts: list[bytes], total: int | None, whole: bool) -> tuple:
        block = b"".join(parts)
        return _finished(first, block if whole and total == len(block) else None, with_payload)
    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each response and revisit below ``path``: record_type, record_id, url, refers_to, complete,
    payload_bytes, payload_digest, payload (null for revisits and where it isn't wanted)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(_read, _SEGMENTS)
    whole = found.where("segment IS NULL AND record_type IN ('response', 'revisit')").mapInArrow(_decoded(with_payload), _RESULT)
    cut = (found.where("segment IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "segment")
           .mapInArrow(_joined(with_payload), _RESULT))
    return whole.unionAll(cut)


def report(pages: DataFrame) -> DataFrame:
    """The rows of query ``op4_warc``."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    found = read(spark, path, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))
    return found.dropDuplicates(["page_id", "payload_digest"])
