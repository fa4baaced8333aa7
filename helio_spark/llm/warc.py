"""WARC archives: write records with revisits and segments, read them back whole.

A payload longer than a segment continues in ``continuation`` records that name
their origin record. The reader groups them by that name, orders them by segment
number, verifies the total length and takes the chunked transfer framing off.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest block of a record, chunks of the transfer framing, pages in a file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_PAGES = 4096, 1024, 2000

# fixed values: names and phrases of the WARC and HTTP formats
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of a wrong size")
        parts.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block


def page_records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
                 segment: int, chunk: int) -> list[bytes]:
    """The records of one page without the blank lines after each."""
    sha = digest(payload)
    name = lambda p, tail="": f"<urn:page:{p}:{sha}{tail}>"
    uri = "".join((url or "about:blank").splitlines())
    base = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if revisit:
        block = HTTP.replace(b"Transfer-Encoding: chunked", b"Content-Length: %d" % len(payload))
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name(page)), *base,
                  ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
        return [_record([*fields, ("Content-Type", "application/http; msgtype=response")], block)]
    block = HTTP + chunked(payload, chunk)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name(page)), *base,
              ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [_record(fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", name(page, f":{n}")), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", name(page)), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, part))
    return out


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    file_pages: int = FILE_PAGES,
) -> None:
    """Write gzip-compressed WARC files of all pages to a new folder.

    Of equal payloads of ``min_bytes`` or more, the page with the largest id is the
    response and the others are revisits of it. A null payload is empty, a null id
    is below all others, exact repeated rows are equal records, a null URL is
    ``about:blank``. The payloads move once, to the join with the largest id of
    their digest; a digest that many pages share is split by adaptive execution.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.unhex(F.sha2("html", 256)))
    owner = rows.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.max("id").alias("owner"))
    marked = rows.join(owner, "key", "left").select(
        "id", "url", F.col("html").cast("binary").alias("html"), "owner",
        (F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out += page_records(*row, segment=segment_bytes, chunk=chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = marked.mapInArrow(run, "record binary")
    # the blank lines that end a record serve as the line separator
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", file_pages).text(path)


_FIELDS = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("origin", pa.string()), ("header_digest", pa.string()), ("segment", pa.int64()), ("total", pa.int64()),
    ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
]
_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, origin string, "
    "header_digest string, segment long, total long, block binary, payload binary, payload_bytes long, "
    "payload_digest string"
)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, block
        at = end + 4 + n + 4


def _gunzip(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:  # members one after another
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, out of its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(
        k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower()
        for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])
    )
    return unchunked(body) if framed else body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of all files below ``path``, one row each.

    record_id, record_type, target_uri, refers_to (the record id of the response),
    header_digest, payload (null for revisits), payload_bytes and payload_digest
    (computed; for a revisit, those that its headers state). Only records that continue are
    shuffled: their segments are grouped by the id of the first one and put in
    order. A missing segment, a wrong total length, a digest that differs and
    broken framing stop the job with an error. Records that occur several times
    give as many rows. An empty archive gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for f, block in parse(_gunzip(data.as_py())):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    row = {
                        "record_id": f["warc-record-id"], "record_type": kind, "target_uri": f.get("warc-target-uri"),
                        "refers_to": f.get("warc-refers-to"), "origin": f.get("warc-segment-origin-id", f["warc-record-id"]),
                        "header_digest": f.get("warc-payload-digest", "").rpartition(":")[2] or None,
                        "segment": number, "total": int(f.get("warc-segment-total-length", 0)) or None,
                    }
                    if number is not None:
                        row["block"] = block
                    elif kind == "response":
                        row |= _checked(block, row)
                    elif kind == "revisit":
                        row |= {"payload_bytes": _http_length(block), "payload_digest": row["header_digest"]}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return reassemble(files.mapInArrow(run, _SCHEMA))


def _http_length(block: bytes) -> int | None:
    for line in block.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"content-length":
            return int(v)
    return None


def _checked(block: bytes, row: dict) -> dict:
    payload = http_payload(block)
    sha = digest(payload)
    if row["header_digest"] and sha != row["header_digest"]:
        raise ValueError(f"the payload of {row['record_id']} differs from its digest")
    return {"payload": payload, "payload_bytes": len(payload), "payload_digest": sha}


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records from rows of which some are segments (a number, a block, an origin)."""
    done = records.where("segment is null").select(*_WHOLE)
    grouped = (
        records.where("segment is not null")
        .groupBy("origin")
        .agg(  # the segments of one record, which is one row of the result
            F.array_sort(F.collect_list(F.struct("segment", "block", "total"))).alias("parts"),
            F.first("target_uri", ignorenulls=True).alias("target_uri"),
            F.first("header_digest", ignorenulls=True).alias("header_digest"),
        )
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, parts, uri, sha in zip(*(c.to_pylist() for c in batch.columns)):
                by_number = {p["segment"]: p for p in parts}
                copies = sum(p["segment"] == 1 for p in parts)
                block = b"".join(by_number[n]["block"] for n in sorted(by_number))
                total = by_number[max(by_number)]["total"]
                if sorted(by_number) != list(range(1, len(by_number) + 1)) or total != len(block):
                    raise ValueError(f"segments of {name} are missing: {len(block)} of {total} bytes")
                row = {"record_id": name, "record_type": "response", "target_uri": uri, "header_digest": sha}
                out += [row | _checked(block, row)] * copies
            yield pa.RecordBatch.from_pylist(out, pa.schema(_FIELDS))

    return done.unionByName(grouped.mapInArrow(join, _SCHEMA).select(*_WHOLE))


_WHOLE = (
    "record_id", "record_type", "target_uri", "refers_to", "header_digest", "payload", "payload_bytes", "payload_digest"
)


def page_digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of ``write_warc``."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )
