"""WARC archives: records written with segments and chunked framing, and read back whole.

Writing.  A record is a row of bytes; Spark's text writer puts the rows of a
partition behind one another, with CRLF as line end, which closes a record.
So archives are committed like any other table and survive lost executors.  A
payload longer than ``SEGMENT`` is cut: the first part is the response, the
others are continuation records that name the origin's record id, and the last
one carries the total length.  Every other response frames its body in chunks.

Reading.  Archives are read as binary files and cut by Content-Length.
Continuations are grouped by origin identifier, ordered by segment number, and
joined; the total length is verified before HTTP headers are stripped and
chunked framing is decoded.  A record that fails a check keeps its row, with
the reason in ``error``.

Equal payloads, by digest and length, are stored once: the row with the largest
id is the response, the others are revisits that refer to it.  A null html is
an empty payload; it has a digest as any other.  Rows without page_id come
back with a null page_id and never revisit.  Rows that repeat a page_id are
records of their own.  An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.shared import fresh_path

VERSION = b"WARC/1.1"
# Bytes of a record block before it is cut into segments.
SEGMENT = 32 << 10
# Bytes of a chunk of a chunked body.
CHUNK = 4 << 10
# Records of an archive file: bounds its size together with SEGMENT.
RECORDS = 2_000
DATE = b"2024-01-01T00:00:00Z"


def digest_label(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """The body in chunks of at most that size, as HTTP frames it."""
    parts = [body[k : k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked frame; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        stop = framed.index(b"\r\n", at)
        size = int(framed[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(framed) or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A WARC record without its closing empty line's last CRLF, which the writer adds."""
    head = b"".join(b"%s: %s\r\n" % f for f in fields)
    return b"%s\r\n%sContent-Length: %d\r\n\r\n%s\r\n" % (VERSION, head, len(block), block)


def record_id(name: str) -> bytes:
    """An urn that depends on the name alone, so that a task run again writes the same."""
    h = hashlib.md5(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>".encode()


def page_records(number: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> list[bytes]:
    """The records of one page; ``number`` tells rows of equal page_id apart."""
    name = f"{page_id}/{number}"
    uri = (url or "").translate({9: "%09", 10: "%0A", 13: "%0D"}).encode()
    kind = b"revisit" if refers is not None else b"response"
    fields = [(b"WARC-Type", kind), (b"WARC-Record-ID", record_id(name)), (b"WARC-Date", DATE), (b"WARC-Target-URI", uri)]
    fields += [(b"X-Page-ID", b"" if page_id is None else b"%d" % page_id), (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    fields += [(b"X-Payload-Length", b"%d" % len(payload)), (b"Content-Type", b"application/http; msgtype=response")]
    if refers is not None:
        fields.append((b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append((b"X-Refers-To-Page-ID", b"%d" % refers))
        return [record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")]
    if number % 2:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
    if len(block) <= SEGMENT:
        return [record(fields, block)]
    parts = [block[k : k + SEGMENT] for k in range(0, len(block), SEGMENT)]
    out = [record([*fields, (b"WARC-Segment-Number", b"1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", record_id(f"{name}/{k}")), (b"WARC-Date", DATE), (b"WARC-Target-URI", uri)]
        more += [(b"WARC-Segment-Origin-ID", record_id(name)), (b"WARC-Segment-Number", b"%d" % k)]
        if k == len(parts):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(record(more, part))
    return out


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record, or several segments, for every row of (page_id, url, html)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    # Light rows decide which record is the response; copies are reduced before they move.
    light = rows.filter("page_id is not null").groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    repeated = light.filter("n > 1").select("digest", "size", "last")
    met = rows.join(repeated, ["digest", "size"], "left")
    # Rows of equal page_id: the row's place in its task tells them apart.
    met = met.withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "page_id", "url", "html", "last")]
            for number, page, url, html, last in zip(*columns):
                payload = html.encode()
                refers = last if last is not None and page is not None and page != last else None
                records = page_records(number, page, url, payload, digest_label(payload), refers)
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    records = met.select("row", "page_id", "url", "html", "last").mapInArrow(run, "record binary")
    # The string type holds any bytes; the writer copies them as they are.
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse_records(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields, by lower-case name, and block of every record of an archive."""
    at = 0
    while at < len(raw):
        if raw.startswith(b"\r\n", at):
            at += 2
            continue
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].split(b"\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        size = int(fields[b"content-length"])
        if stop + 4 + size > len(raw):
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, freed from chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        return dechunked(body)
    if b"content-length" in fields and int(fields[b"content-length"]) != len(body):
        raise ValueError("the body differs from its Content-Length")
    return body


_SEGMENTS = "origin string, segment int, total long, type string, page_id long, refers_to long, payload_length long, digest string, uri string, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for every record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def number(value: bytes | None) -> int | None:
        return int(value) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = content.as_py()
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                rows: list[tuple] = []
                held = 0
                for f, block in parse_records(raw):
                    origin = f.get(b"warc-segment-origin-id") or f[b"warc-record-id"]
                    digest = f.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    rows.append((origin.decode(), number(f.get(b"warc-segment-number")) or 0, number(f.get(b"warc-segment-total-length")), f[b"warc-type"].decode(), number(f.get(b"x-page-id")), number(f.get(b"x-refers-to-page-id")), number(f.get(b"x-payload-length")), digest, f.get(b"warc-target-uri", b"").decode(), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, _SEGMENTS)


_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
_NAMES = [field.split(" ")[0] for field in _SEGMENTS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


_PAGES = "page_id long, record_type string, refers_to long, uri string, payload binary, payload_bytes long, payload_digest string, error string"


def reassemble(segments: DataFrame) -> DataFrame:
    """A row for every response and revisit, with its whole payload.

    Only records that were cut are shuffled, by their origin; a record's own
    segments are all that meets in one group.
    """
    whole = segments.filter("segment = 0")
    cut = segments.filter("segment > 0")
    first = F.min_by(F.struct("type", "page_id", "refers_to", "payload_length", "digest", "uri"), "segment")
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    groups = cut.groupBy("origin").agg(first.alias("f"), F.max("total").alias("total"), parts.alias("parts"))
    joined = groups.select(
        F.lit(True).alias("cut"),
        "total",
        F.transform("parts", lambda p: p["segment"]).alias("numbers"),
        "f.*",
        F.transform("parts", lambda p: p["block"]).alias("blocks"),
    )
    plain = whole.select(
        F.lit(False).alias("cut"),
        "total",
        F.array(F.lit(1)).alias("numbers"),
        "type",
        "page_id",
        "refers_to",
        "payload_length",
        "digest",
        "uri",
        F.array("block").alias("blocks"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                payload, error = None, None
                try:
                    block = b"".join(x["blocks"])
                    if x["numbers"] != list(range(1, len(x["numbers"]) + 1)) or x["type"] == "continuation":
                        raise ValueError("a segment is missing")
                    if x["cut"] and x["total"] != len(block):
                        raise ValueError("the segments differ from the total length")
                    payload = http_payload(block)
                    if x["type"] == "response" and (len(payload) != x["payload_length"] or digest_label(payload) != x["digest"]):
                        raise ValueError("the payload differs from its digest")
                except (ValueError, KeyError) as problem:
                    error = str(problem)
                revisit = x["type"] == "revisit"
                size = x["payload_length"] if revisit or payload is None else len(payload)
                digest = x["digest"] if revisit or payload is None else digest_label(payload)
                rows.append((x["page_id"], x["type"], x["refers_to"], x["uri"], None if revisit else payload, size, digest, error))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            names = [field.split(" ")[0] for field in _PAGES.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return plain.unionByName(joined).mapInArrow(run, _PAGES)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages' archives and reads them back."""
    spark = pages.sparkSession
    target = path or fresh_path(spark, "warc")
    write_archives(pages, target)
    return reassemble(read_segments(spark, target))
