"""WARC archives of web pages: segmented and chunked records, revisits, and their reassembly."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a record's block; longer blocks go on in continuation records.
SEGMENT = 16_384
#: Bytes of a chunk of the transfer framing.
CHUNK = 4_096
#: Records in a file, so that a reader's task holds at most SEGMENT times as many bytes at once.
RECORDS_PER_FILE = 1_000
DATE = "2024-01-01T00:00:00Z"
PARSED = (
    "record_id string, kind string, page_id long, url string, refers_to long, digest string, length long, "
    "origin string, segment int, total long, block binary"
)
PAGES = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary, whole boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, most: int) -> list[bytes]:
    """data in parts of at most `most` bytes (four at least) that don't end inside a character."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end])
        at = end
    return parts


def http_message(payload: bytes) -> bytes:
    chunks = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cuts(payload, CHUNK))
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks + b"0\r\n\r\n"


def unframed(message: bytes) -> tuple[bytes, bool]:
    """Payload of an HTTP message with chunked framing or without; whether its framing is whole."""
    head, _, body = message.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body, True
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            n = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or line + 2 + n > len(body):
            return b"".join(parts), False
        if n == 0:
            return b"".join(parts), True
        parts.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def records(page_id: int | None, url: str | None, payload: bytes, top: int | None, first: bool, name: str, segment: int) -> list[str]:
    """The records of one page, each without the two line ends after it. first: revisits refer to this one."""
    digest = base32_sha1(payload)
    revisit = page_id != top
    own = f"urn:page:{page_id}:{digest}" + ("" if first else f":{name}")
    head = [
        "WARC/1.1", f"WARC-Record-ID: <{own}>", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head += [f"WARC-Refers-To: <urn:page:{top}:{digest}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block = http_message(payload)
    parts = cuts(block, segment)
    if len(parts) > 1:
        head.append("WARC-Segment-Number: 1")
    found = ["\r\n".join([*head, f"Content-Length: {len(parts[0])}", "", ""]) + parts[0].decode()]
    for n, part in enumerate(parts[1:], 2):
        more = [
            "WARC/1.1", f"WARC-Record-ID: <{own}:segment-{n}>", "WARC-Type: continuation", f"WARC-Date: {DATE}",
            f"WARC-Segment-Origin-ID: <{own}>", f"WARC-Segment-Number: {n}",
        ]
        if n == len(parts):
            more.append(f"WARC-Segment-Total-Length: {len(block)}")
        found.append("\r\n".join([*more, f"Content-Length: {len(part)}", "", ""]) + part.decode())
    return found


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes gzipped WARC 1.1 files with the records of every page.

    pages: page_id, url, html (null: empty); further columns are ignored. Of pages with equal payloads that with the
    largest id becomes a response and the others revisits of it. Rows that repeat that id and payload are all responses;
    pages without id are responses where no page with an id has their payload, else revisits. HTTP messages have chunked
    framing; blocks over `segment` bytes go on in continuation records. Record-IDs are unique, and a revisit's reference is
    the Record-ID of a response in the archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            out, size = [], 0
            for page_id, url, payload, top, first in rows:
                more = records(page_id, url, payload, top, first, f"{task}-{n}", segment)
                n += 1
                out += more
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "at": F.monotonically_increasing_id()})
    top = rows.groupBy("sha").agg(F.max("page_id").alias("top"), F.max_by("at", "page_id").alias("top_at"))
    lines = rows.join(top, "sha").select("page_id", "url", "payload", "top", (F.col("at") == F.col("top_at")).alias("first")).mapInArrow(run, "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def inflated(data: bytes) -> bytes:
    """A gzip file of one member or more, as far as it is whole."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(parts)


def number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def page_of(record_id: str) -> int | None:
    """The page in a Record-ID of ours; null in others."""
    parts = record_id.split(":")
    return number(parts[2]) if parts[:2] == ["urn", "page"] and len(parts) > 3 else None


def parsed(data: bytes) -> Iterator[tuple]:
    """The records of an archive as rows of PARSED, found by their Content-Length.

    A record without it, or whose header is cut off, ends the archive: nothing after it can be found. A block that is cut
    off is passed on as far as it goes. Records without type or Record-ID, and types other than response, revisit,
    resource and continuation (warcinfo, request, metadata), are left out.
    """
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", begin)) >= 0:
        lines = data[begin:end].decode("utf-8", "replace").split("\r\n")[1:]
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = number(field.get("content-length"))
        if size is None or size < 0:
            return
        at = end + 4 + size
        block = data[end + 4 : at]
        name, origin = field.get("warc-record-id", "").strip("<>"), field.get("warc-segment-origin-id", "").strip("<>")
        kind, refers = field.get("warc-type", "").lower(), field.get("warc-refers-to", "").strip("<>")
        if not name or kind not in ("response", "revisit", "resource", "continuation"):
            continue
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n\r\n")[0].split(b"\r\n"))} if kind == "revisit" else {}
        yield (
            name, kind, page_of(name), field.get("warc-target-uri"), page_of(f"{refers}:"), field.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            number(http.get(b"content-length", b"").decode("ascii", "replace")), origin or (name if "warc-segment-number" in field else None),
            number(field.get("warc-segment-number")), number(field.get("warc-segment-total-length")), block,
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The pages in such files: page_id, url, record_type, refers_to, digest, payload_bytes, payload, whole.

    Continuation records are grouped by the identifier of their origin and put in the order of their segment numbers;
    records that aren't segmented take no part in that shuffle. whole tells that the numbers have no gap, that the total
    length is as declared, that the chunked framing ends well and that the payload has the digest, if one is declared. Other
    writers' archives have null page ids; parsed() says what is left out. A revisit
    has no payload (null), and the digest and length of the full one from its header.
    """
    fields = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in PARSED.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parsed(inflated(content.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], f.type) for f in fields], schema=fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            out = []
            for kind, page_id, url, refers_to, digest, length, numbers, total, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "revisit":
                    out.append((page_id, url, kind, refers_to, digest, length, None, True))
                    continue
                block = b"".join(blocks)
                payload, whole = unframed(block)
                whole &= numbers is None or numbers == list(range(1, len(numbers) + 1)) and total == len(block)
                got = base32_sha1(payload)
                out.append((page_id, url, kind, None, got, len(payload), payload, whole and digest in (None, got)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(8)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = files.mapInArrow(parse, PARSED)
    single = rows.where("origin is null").select("kind", "page_id", "url", "refers_to", "digest", "length", F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("long").alias("total"), F.array("block").alias("blocks"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c)))
    parts = rows.where("origin is not null").groupBy("origin").agg(
        first("kind").alias("kind"), first("page_id").alias("page_id"), first("url").alias("url"), first("digest").alias("digest"),
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    joined = parts.select("kind", "page_id", "url", F.lit(None).cast("long").alias("refers_to"), "digest", F.lit(None).cast("long").alias("length"), F.col("parts.segment").alias("numbers"), "total", F.col("parts.block").alias("blocks"))
    return single.unionByName(joined).mapInArrow(decode, PAGES)
