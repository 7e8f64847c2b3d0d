"""WARC archives: writing with segmentation and deduplication, and reading back.

Written are response records with an HTTP head and a body in chunked transfer
framing; what exceeds a segment goes on in continuation records.  Of equal large
payloads one is written, the others are revisit records.  The reader parses
files of any writer by their lengths, passes over broken records and reports
them, groups continuation records by the identifier of their origin (which is
each written row's own), puts segments in order, verifies the total length,
takes off the framing and verifies the digest.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, text_blocks

VERSION = b"WARC/1.1"
#: Payloads from this size on are deduplicated.
DEDUP_BYTES = 1000
#: Block bytes of one segment, and payload bytes of one chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
#: Bytes of blocks or payloads that a reader passes on at a time.
BATCH_BYTES = 4 << 20
#: Records whose blocks are held as objects at a time.
ROWS = 32
#: Hexadecimal digits of a digest that say which cell it is in; the cells of repeated payloads are broadcast.
CELL_DIGITS = 5
#: Records of one file at most, so that a file is a bounded piece of work for a reader.
RECORDS_PER_FILE = 1_000
_DATE = b"2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        piece = payload[at : at + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes | None:
    """The payload of chunked transfer framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        m = re.match(rb"([0-9A-Fa-f]+)\s*(?:;.*)?$", data[at:line])
        if not m:
            return None
        size, at = int(m[1], 16), line + 2
        if not size:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(data[at : at + size])
        at += size + 2


def split_identifier(text: str | None) -> tuple[str | None, str | None]:
    """A record's identifier as that of its page and what tells it from the page's other rows."""
    m = re.fullmatch(r"(<urn:page:[^;>]*);row=([0-9]+)>", text or "")
    return (m[1] + ">", m[2]) if m else (text, None)


def header_value(text: str | None) -> bytes:
    """``text`` as a header's value: controls, spaces and % are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f%]", lambda m: b"%%%02X" % m[0][0], (text or "").encode())


def record(kind: bytes, name: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without the blank lines that end it."""
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<urn:page:%b>" % name), (b"WARC-Date", _DATE), *headers, (b"Content-Length", b"%d" % len(block))]
    return VERSION + b"\r\n" + b"".join(b"%b: %b\r\n" % h for h in head) + b"\r\n" + block


def response(name: bytes, url: bytes, payload: bytes) -> list[bytes]:
    """The records of a response: one, or the first segment and its continuations."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    headers = [(b"WARC-Target-URI", url), (b"WARC-Payload-Digest", b"sha1:" + digest), (b"Content-Type", b"application/http; msgtype=response")]
    if len(block) <= SEGMENT_BYTES:
        return [record(b"response", name, headers, block)]
    pieces = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    out = [record(b"response", name, [*headers, (b"WARC-Segment-Number", b"1")], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        more = [(b"WARC-Segment-Origin-ID", b"<urn:page:%b>" % name), (b"WARC-Segment-Number", b"%d" % k)]
        if k == len(pieces):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(record(b"continuation", b"%b:%d" % (name, k), more, piece))
    return out


def revisit(name: bytes, url: bytes, size: int, sha1: str, refers_to: bytes) -> bytes:
    """A revisit record; its block is the HTTP head that names the payload's size."""
    headers = [
        (b"WARC-Target-URI", url),
        (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(sha1))),
        (b"WARC-Refers-To", b"<urn:page:%b>" % refers_to),
        (b"WARC-Profile", PROFILE),
        (b"Content-Type", b"application/http; msgtype=response"),
    ]
    return record(b"revisit", name, headers, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % size)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record or more for each row of ``pages`` to files under ``path``, each record in a gzip member of its own.

    Null html counts as empty.  Of rows whose payloads are equal (by SHA-1 and
    size) and at least DEDUP_BYTES long the one with the largest id is a
    response, the others are revisits; rows that repeat this id too are responses
    each, and revisits refer to one of them.  A null id is written as ``null`` and
    never referred to.  Every record's identifier is the page's with a number of the
    row's own, so rows that repeat an id or have none stay apart.  Repeated digests
    are found on digests alone; payloads move only where their digest is in a cell
    of a repeated one.  An empty table gives an archive without records.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(";row="), F.monotonically_increasing_id()).alias("name"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1")
    ).withColumns({"size": F.length("payload"), "cell": F.conv(F.left("sha1", F.lit(CELL_DIGITS)), 16, 10).cast("int")})
    same = durable(
        rows.filter(F.col("size") >= DEDUP_BYTES).groupBy("sha1", "size").agg(F.max(F.when(F.col("id").isNotNull(), F.struct("id", "name"))).alias("first"), F.count("*").alias("n"), F.max("cell").alias("same_cell")).filter("n > 1").drop("n")
    )
    # a number for each cell at most, of which there are 16 ** CELL_DIGITS
    cells = F.broadcast(same.select("same_cell").distinct())
    perhaps = rows.join(cells, F.col("cell") == F.col("same_cell"), "left_semi")
    alone = rows.join(cells, F.col("cell") == F.col("same_cell"), "left_anti").select("name", "url", "payload", "sha1", "size", F.lit(None).cast("string").alias("refers_to"))
    joined = perhaps.join(same.drop("same_cell").withColumnsRenamed({"sha1": "same_sha1", "size": "same_size"}), (F.col("sha1") == F.col("same_sha1")) & (F.col("size") == F.col("same_size")), "left")
    refers = F.when(F.col("first.id") > F.col("id"), F.col("first.name"))
    slim = alone.unionAll(joined.select("name", "url", "payload", "sha1", "size", refers.alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, bodies in text_blocks(batch.column(2), BATCH_BYTES):
                out = []
                for r, body in zip(batch.slice(low, high - low).drop_columns(["payload"]).to_pylist(), bodies):
                    name, url = r["name"].encode(), header_value(r["url"])
                    if r["refers_to"] is not None:
                        out.append(member(revisit(name, url, r["size"], r["sha1"], r["refers_to"].encode())))
                    else:
                        out += map(member, response(name, url, body))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text writer ends every row with a separator: a member without content
    records = slim.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    (
        records.write.option("lineSep", member(b"", b"").decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .mode("overwrite")
        .text(path)
    )


def member(record: bytes, end: bytes = _END) -> bytes:
    """A record and the line ends after it as a gzip member, the same for the same record."""
    made = zlib.compressobj(4, zlib.DEFLATED, 31)
    return made.compress(record + end) + made.flush()


_RECORD = re.compile(rb"WARC/[0-9]+\.[0-9]+[ \t]*\r?\n")
_BLANK = re.compile(rb"\r?\n\r?\n")


def headers_of(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; lines that begin with white space go on the one before."""
    lines = re.split(rb"\r?\n", re.sub(rb"\r?\n[ \t]+", b" ", head))
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, colon, v in (x.partition(b":") for x in lines) if colon}


def number(text: str | None) -> int | None:
    """A header's number; None where it is none."""
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,18}", text) else None


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, headers by lower-case name, block, problem) of the records of a file, of any version of the format.

    A record without a problem has None there.  After a broken one reading goes on
    at the next line that begins a record.
    """
    at = 0
    while at < len(data):
        begin = _RECORD.match(data, at)
        if begin is None:
            following = re.compile(rb"^WARC/[0-9]+\.[0-9]+[ \t]*\r?$", re.M).search(data, at)
            end = following.start() if following else len(data)
            if data[at:end].strip():
                yield at, {}, b"", "no record begins here"
            at = end
            continue
        end = _BLANK.search(data, begin.end() - 2)
        headers = headers_of(data[begin.end() : end.start()]) if end else {}
        size = number(headers.get("content-length"))
        problem = None
        if end is None:
            problem = "the headers don't end"
        elif size is None:
            problem = "no length is stated"
        elif end.end() + size > len(data):
            problem = "the block ends too early"
        elif "warc-segment-number" in headers and not number(headers["warc-segment-number"]):
            problem = "the segment's number is none"
        if problem:
            yield at, headers, b"", problem
            at = begin.end()
            # what follows is passed over up to the next record
            following = re.compile(rb"^WARC/[0-9]+\.[0-9]+[ \t]*\r?$", re.M).search(data, at)
            at = following.start() if following else len(data)
            continue
        yield at, headers, data[end.end() : end.end() + size], None
        at = end.end() + size
        while data[at : at + 2] == b"\r\n" or data[at : at + 1] == b"\n":
            at += 2 if data[at : at + 1] == b"\r" else 1


def _inflate(data: bytes) -> bytes:
    """All members; of one that is broken what can be read, and nothing after it."""
    out = []
    while data:
        inner = zlib.decompressobj(31)
        try:
            out += [inner.decompress(data), inner.flush()]
        except zlib.error:
            break
        data = inner.unused_data.lstrip(b"\x00")
    return b"".join(out)


RECORDS = (
    "file string, offset bigint, type string, record_id string, origin string, row string, segment int, segmented boolean, total bigint, "
    "target_uri string, refers_to string, digest string, content_type string, block binary, problem string"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, as RECORDS says.

    ``origin`` is the identifier that a record's segments share, its own for one
    that isn't a continuation.  Identifiers are those of pages; ``row`` is what
    tells the origin from other rows of its page, null in files of other writers.
    A broken record has its ``problem``, null for others; nothing of it is used.
    ``offset`` counts the bytes of the file as it is after inflating.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                rows, held = [], 0
                for offset, h, block, problem in parse(_inflate(data) if data[:2] == b"\x1f\x8b" else data):
                    origin, row = split_identifier(h.get("warc-segment-origin-id", h.get("warc-record-id")))
                    rows.append(
                        {
                            "file": file.as_py(),
                            "offset": offset,
                            "type": h.get("warc-type"),
                            "record_id": split_identifier(h.get("warc-record-id"))[0],
                            "origin": origin,
                            "row": row,
                            "segment": (number(h.get("warc-segment-number")) or 1) & 0x7FFFFFFF,
                            "segmented": "warc-segment-number" in h and "warc-record-id" in h,
                            "total": number(h.get("warc-segment-total-length")),
                            "target_uri": h.get("warc-target-uri"),
                            "refers_to": split_identifier(h.get("warc-refers-to"))[0],
                            "digest": h.get("warc-payload-digest"),
                            "content_type": h.get("content-type"),
                            "block": block,
                            "problem": problem,
                        }
                    )
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, RECORDS.split(", "))])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def broken(found: DataFrame) -> DataFrame:
    """(file, offset, record_id, problem) of the records that aren't whole."""
    return found.filter("problem IS NOT NULL").select("file", "offset", "record_id", "problem")


def reassembled(found: DataFrame) -> DataFrame:
    """Records with their segments in order in ``blocks``, and ``complete``; broken ones are left out.

    A record is complete if its segments are numbered from 1 without a gap or a
    repeat and their length is the total that the last one states.  That is found
    out on numbers and lengths; only blocks of complete records are then brought
    together, so an identifier that a file repeats gathers nothing.  One that isn't
    complete has no blocks.  Only segmented records are shuffled.
    """
    columns = ["type", "record_id", "target_uri", "refers_to", "digest", "content_type"]
    found = found.filter("problem IS NULL")
    whole = found.filter(~F.col("segmented")).select(*columns, F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    # written, as archives would be parsed for each use of them
    parts = durable(found.filter("segmented").select("origin", F.coalesce("row", F.lit("")).alias("row"), "segment", "total", "block", *columns))
    each = parts.groupBy("origin", "row", "segment").agg(
        F.count("*").alias("n"), F.sum(F.length("block").cast("long")).alias("size"), F.max("total").alias("total"), *(F.max(c).alias(c) for c in columns)
    )
    heads = each.groupBy("origin", "row").agg(
        (F.coalesce(F.max("n") == 1, F.lit(False)) & (F.max("segment") == F.count("*")) & (F.min("segment") == 1) & (F.sum("size") == F.max("total"))).alias("complete"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in columns),
    )
    heads = durable(heads.withColumn("complete", F.coalesce("complete", F.lit(False))))
    good = heads.filter("complete").withColumnsRenamed({"origin": "o", "row": "r"}).drop("complete")
    held = parts.select("origin", "row", "segment", "block").join(good.select("o", "r"), (F.col("origin") == F.col("o")) & (F.col("row") == F.col("r")), "left_semi")
    ordered = held.groupBy("origin", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "block"))), lambda p: p.block).alias("blocks"))
    joined = good.join(ordered, (F.col("origin") == F.col("o")) & (F.col("row") == F.col("r"))).select(*columns, "blocks", F.lit(True).alias("complete"))
    lost = heads.filter("NOT complete").select(*columns, F.lit(None).cast("array<binary>").alias("blocks"), "complete")
    return whole.unionAll(joined).unionAll(lost)


def stated_digest(text: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a header's value, in base32 or hexadecimal digits; None where it is neither."""
    name, _, value = (text or "").strip().partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    try:
        size = hashlib.new(name).digest_size
        data = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error, TypeError):
        return None
    return (name, data) if len(data) == size else None


def payload_of(block: bytes, content_type: str | None, kind: str | None) -> tuple[dict[str, str], bytes | None]:
    """(HTTP headers, payload) of a record's block; None where its framing is broken."""
    http = content_type is None and kind in ("response", "request", "revisit") or (content_type or "").lower().startswith("application/http")
    if not http:
        return {}, block
    end = _BLANK.search(block)
    if end is None:
        return headers_of(block.partition(b"\n")[2]), b""
    headers, body = headers_of(block[: end.start()].partition(b"\n")[2]), block[end.end() :]
    codings = [c.strip() for c in headers.get("transfer-encoding", "").lower().split(",")]
    return headers, dechunked(body) if codings[-1] == "chunked" else body


def payloads(found: DataFrame) -> DataFrame:
    """(record_id, type, target_uri, refers_to, payload, payload_bytes, payload_sha1, valid) of reassembled records.

    The framing is taken off as the HTTP head says; a block that isn't HTTP is the
    payload itself.  A revisit has no payload; its size and digest are those that it
    states, null where it states none.  ``valid`` is whether the record is complete,
    its framing intact and its digest as stated; a digest that isn't stated, or of
    no known kind, can't be wrong.
    """
    text = pa.string()
    schema = pa.schema([("record_id", text), ("type", text), ("target_uri", text), ("refers_to", text), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", text), ("valid", pa.bool_())])

    def one(r: dict) -> dict:
        http, payload = payload_of(b"".join(r["blocks"] or []), r["content_type"], r["type"])
        stated = stated_digest(r["digest"])
        row = {k: r[k] for k in ("record_id", "type", "target_uri", "refers_to")}
        if r["type"] == "revisit":
            sha1 = stated[1].hex() if stated and stated[0] == "sha1" else None
            return row | {"payload_bytes": number(http.get("content-length")), "payload_sha1": sha1, "valid": r["complete"]}
        if not r["complete"] or payload is None:
            return row | {"payload": None, "payload_bytes": 0, "payload_sha1": hashlib.sha1(b"").hexdigest(), "valid": False}
        agrees = stated is None or hashlib.new(stated[0], payload).digest() == stated[1]
        return row | {"payload": payload, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest(), "valid": agrees}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(low, ROWS).to_pylist()], schema)

    return found.select("record_id", "type", "target_uri", "refers_to", "digest", "content_type", "blocks", "complete").mapInArrow(
        run, "record_id string, type string, target_uri string, refers_to string, payload binary, payload_bytes bigint, payload_sha1 string, valid boolean"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The payloads of all records under ``path``, reassembled and verified."""
    return payloads(reassembled(records(spark, path)))
