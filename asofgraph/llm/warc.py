"""Legacy archive converter: ARC records in, WARC records out, and WARC files written and read.

ARC versions differ in the line before each record. Version 1 has five fields (address, IP,
date, type, length); version 2 has ten (address, IP, date, type, result code, checksum, location,
offset, file name, length). The version block at the top names the version. Both declare the
length of the bytes that follow, which is what the parser goes by. Headers and payloads are any bytes.

A WARC file is a run of gzip members, one a record, of about ``FILE_BYTES``; records are written and read
one after another. Spark's text writer puts it down, a row a file, so any store that Spark
writes will do; that writer ends each file with a byte, for which 0 is chosen, padding by gzip's rules.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import pieces, read_table, shared_path, small_batches

#: The field lines that the version blocks of the two ARC versions carry.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
NO_ADDRESS = "urn:none"
#: The moment that converted pages carry where a table has none.
PAGE_DATE = "20240101000000"
END = b"\r\n\r\n"
#: Compressed bytes after which a WARC file ends; a longer record has a file to itself.
FILE_BYTES = 16 << 20


def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 asofgraph\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, name: str, offset: int) -> bytes:
    url = re.sub(r"\s", lambda m: quote(m[0], safe=""), url or NO_ADDRESS)
    if version == 1:
        line = f"{url} 0.0.0.0 {date} {kind} {len(block)}\n"
    else:
        line = f"{url} 0.0.0.0 {date} {kind} 200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}\n"
    return line.encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, list[str], bytes]]:
    """(offset, header fields, block) of each record but the version block.

    Blank lines between records are skipped. A header with another number of fields than its
    version has, or a length beyond the end of the data, is an error.
    """
    view, at, version = memoryview(data), 0, 1
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = any_text(data[at:end if end >= 0 else len(data)]).rstrip("\r").split(" ")
        if end < 0 or len(line) not in (5, 10) or not line[-1].isdigit():
            raise ValueError(f"no archive header at byte {at}")
        start, size = end + 1, int(line[-1])
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        block = bytes(view[start:start + size])
        if line[0].startswith("filedesc:"):
            version = 2 if block[:1] == b"2" else 1
        else:
            if len(line) != {1: 5, 2: 10}[version]:
                raise ValueError(f"the header at byte {at} isn't of version {version}")
            yield at, line, block
        at = start + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); no header: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block, b"") if cut < 0 else (block[:cut + 4], block[cut + 4:])


def any_text(data: bytes) -> str:
    """UTF-8 or, where it isn't that, Latin-1."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


_CONVERTED = (
    "archive string, offset long, record_id string, warc_date string, target string, content_type string, ip string, block_digest string, "
    "http binary, payload binary, payload_bytes long, payload_digest string"
)


def convert_record(archive: str, offset: int, fields: list[str], block: bytes) -> tuple:
    """The WARC identity of one ARC record: same input, same identifier, whatever task runs it.

    A checksum of version 2 that is an MD5 has to fit the block.
    """
    http, payload = split_http(block)
    digest = hashlib.sha256(payload)
    date = fields[2].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{offset} {fields[0]} {digest.hexdigest()}")
    kind = "application/http; msgtype=response" if http else fields[3]
    said = fields[5].lower() if len(fields) == 10 and re.fullmatch("[0-9a-fA-F]{32}", fields[5]) else None
    if said is not None and hashlib.md5(block).hexdigest() != said:
        raise ValueError(f"the checksum of the record at byte {offset} of {archive} doesn't fit")
    ip = None if fields[1] in ("0.0.0.0", "-", "") else fields[1]
    return archive, offset, f"<urn:uuid:{name}>", stamp, fields[0], kind, ip, said and f"md5:{said}", http, payload, len(payload), digest.hexdigest()


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch["archive"].to_pylist(), batch["content"], strict=True):
            yield from _in_batches((convert_record(archive, *found) for found in parse_arc(content.as_py() or b"")), _CONVERTED, 9)


def _in_batches(rows: Iterator[tuple], schema: str, payload: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes in column ``payload``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or b"") + 200
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def convert_arc(archives: DataFrame) -> DataFrame:
    """WARC records (identifier, date, target, HTTP header, payload, digest) of ARC files.

    ``archives`` has archive (a name, unique per file) and content (the bytes of one ARC file of
    either version, uncompressed). Null or empty content gives no record; a damaged file fails
    the job rather than losing records. Files are converted one at a time.
    """
    return archives.select("archive", "content").mapInArrow(_convert, _CONVERTED)


def _arc_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    for batch in pieces(batches, "html"):
        version = 1 + number % 2
        name = f"pages-{task:06d}-{number:06d}.arc"
        out = bytearray(version_block(name, version, PAGE_DATE))
        for page, url, html in zip(*(batch[n].to_pylist() for n in ("page_id", "url", "html")), strict=True):
            body = (html or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n"
            out += arc_record(version, url, PAGE_DATE, "text/html", head.encode() + body, name, len(out))
        number += 1
        yield _batch([(name, bytes(out))], "archive string, content binary")


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(archive, content): ARC files of a few MB, versions 1 and 2 in turn, one record a page row.

    Null html is an empty payload, a null address becomes ``urn:none``; a null page_id is kept as
    an empty header. Repeated rows give a record each. A page longer than a file's usual size has
    a file to itself.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_arc_files, "archive string, content binary")


def page_id(records: DataFrame) -> F.Column:
    return F.expr("try_cast(regexp_extract(decode(http, 'ISO-8859-1'), 'X-Page-Id: ([^\\\\r]*)', 1) AS BIGINT)")


def mark_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds page_id, record_type and refers_to (page, identifier and date of the record revisited).

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest
    page_id (then the smallest identifier; null page_ids last) is the response. Digests are
    counted by a partial aggregate, and only those met more than once are joined back. Shorter
    payloads join on a key of their own row, so no key gathers them.
    """
    rows = records.withColumn("page_id", page_id(records))
    order = F.struct(F.col("page_id").isNull().alias("no"), F.col("page_id").alias("p"), F.col("record_id").alias("r"), F.col("warc_date").alias("d"))
    first = (
        rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("key"))
        .agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    )
    key = F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(F.col("record_id"))
    revisit = F.col("first").isNotNull() & (F.col("first.r") != F.col("record_id"))
    return rows.withColumn("key", key).join(first, "key", "left").select(
        *rows.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        *(F.when(revisit, F.col(f"first.{a}")).alias(b) for a, b in (("p", "refers_to"), ("r", "refers_to_record"), ("d", "refers_to_date"))),
    )


def warc_record(row: dict) -> bytes:
    """One WARC/1.1 record with the two line ends that close it; a revisit has no payload."""
    revisit = row["record_type"] == "revisit"
    block = row["http"] if revisit else row["http"] + row["payload"]
    lines = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target"]),
        ("WARC-IP-Address", row["ip"]), ("WARC-Block-Digest", None if revisit else row["block_digest"]), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("X-Payload-Length", row["payload_bytes"]), ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", row["refers_to_record"]),
        ("WARC-Refers-To-Date", row["refers_to_date"]), ("X-Refers-To-Page", row["refers_to"]), ("Content-Type", row["content_type"]), ("Content-Length", len(block)),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + END


_WRITTEN = ("record_type", "record_id", "warc_date", "target", "ip", "block_digest", "payload_digest", "payload_bytes", "refers_to_record", "refers_to_date", "refers_to", "content_type", "http", "payload")


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = bytearray()

    def done() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["content"])
        out.clear()
        return made
    for batch in batches:
        for part in pieces([batch], "payload"):
            for row in part.to_pylist():
                member = gzip.compress(warc_record(row), 1, mtime=0)
                if out and len(out) + len(member) > FILE_BYTES:
                    yield done()
                out += member
    if out:
        yield done()


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files of records as mark_revisits returns them."""
    files = records.select(*_WRITTEN).mapInArrow(_archive, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


_READ = "record_type string, record_id string, target string, ip string, http binary, payload_bytes long, payload_digest string, refers_to long"


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds; zeros at the end are padding."""
    view, at = memoryview(data), 0
    while at < len(data) and data[at]:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = view[at:at + (1 << 16)]
            if not chunk:
                raise ValueError("the archive is cut short")
            out.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        yield b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        cut = data.index(END, at)
        lines = any_text(data[at:cut]).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = cut + 4, int(head["Content-Length"])
        if data[start + size:start + size + 4] != END:
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield head, data[start:start + size]
        at = start + size + 4


def _read_record(head: dict[str, str], block: bytes) -> tuple:
    http, payload = split_http(block)
    said, revisit = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != said:
        raise ValueError(f"the digest of {head['WARC-Record-ID']} doesn't fit its payload")
    size, to = int(head["X-Payload-Length"]) if revisit else len(payload), head.get("X-Refers-To-Page")
    return head["WARC-Type"], head["WARC-Record-ID"], head["WARC-Target-URI"], head.get("WARC-IP-Address"), http, size, said, to and int(to)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            found = (_read_record(*record) for member in members(content.as_py()) for record in parse_warc(member))
            yield from _in_batches(found, _READ, 4)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the gzipped WARC files in ``path``; digests are checked against the payloads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, _READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = mark_revisits(convert_arc(pages_to_arc(read_table(spark, sf_dir, "pages"))))
    path = shared_path(spark, "warc")
    small_batches(spark, 200)
    write_warc(records, path)
    back = read_warc(spark, path)
    return back.withColumn("page_id", page_id(back)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS f FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN f.f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.f <> page_id THEN f.f END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
