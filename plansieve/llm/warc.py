"""WARC archives: written as one gzip member per record, read back by a sequential reader.

An archive is one row of a table (name, content): binary content of a bounded size, whether it comes from
``write_archives`` or from ``spark.read.format("binaryFile")`` over files that others wrote. The reader goes through
an archive member by member: it decompresses in steps (never more than ``STEP`` bytes ahead), takes the block by the
record's Content-Length, and checks the block and the payload against the digests in the header, by the algorithm that each names, in
base32 or hex; digests of other algorithms are listed as unchecked. A damaged member gives a row that says so, and the reading goes on
at the next member that begins with a record. An archive is a cell, so files of others are read up to 2 GB, the size of a cell.

Records with equal payloads are stored once: the row with the largest page_id is the response, the others become
revisit records that name it and keep only the HTTP head, whose Content-Length still tells the payload's size.

Defined results: a null html is an empty payload; rows with a null page_id are written without an id and read back as null (they
are responses only where no row of their payload has an id); repeated rows of the largest page_id are all responses; a null url is left
out of the header; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import table, text_of
from plansieve.operators.narrow import stash

STEP = 1 << 16
ARCHIVE_BYTES = 4 << 20  # an archive is closed when its records reach this size, compressed
MIN_REVISIT_BYTES = 0

# Fixed values of the record format.
VERSION = b"WARC/1.1"
RECORD_START = b"WARC/"
MEMBER_START = b"\x1f\x8b\x08"
DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha384": hashlib.sha384, "sha512": hashlib.sha512}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- one record ----------------------------------------------------------------------------------------


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _header_value(value: str) -> str:
    """A header line holds no line breaks."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class DamagedRecord(ValueError):
    pass


def _member(view: memoryview, at: int) -> tuple[bytes, int]:
    """The decompressed member that begins at a place, and where it ends."""
    inflater, parts = zlib.decompressobj(31), []
    while not inflater.eof:
        fed = view[at : at + STEP]
        if not fed:
            raise DamagedRecord("the archive ends inside a member")
        try:
            parts.append(inflater.decompress(fed))
        except zlib.error as e:
            raise DamagedRecord(str(e)) from e
        at += len(fed) - len(inflater.unused_data)
    return b"".join(parts), at


def members(content: bytes) -> Iterator[bytes | DamagedRecord]:
    """The decompressed gzip members of an archive, one after the other; one error for each damaged stretch between them."""
    view, at, is_lost = memoryview(content), 0, False
    while 0 <= at < len(view):
        try:
            data, end = _member(view, at)
            if is_lost and not data.startswith(RECORD_START):
                raise DamagedRecord("no record")  # the mark stood inside of other data by chance
        except DamagedRecord as e:
            if not is_lost:
                is_lost = True
                yield e
            at = content.find(MEMBER_START, at + 1)
            continue
        is_lost, at = False, end
        yield data


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block, framed by Content-Length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not first.startswith(RECORD_START):
        raise DamagedRecord("no record header")
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise DamagedRecord("no content length")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedRecord("the block is not as long as its content length")
    return fields, rest[:size]


def _bare(digest: str | None) -> str | None:
    return digest.rpartition(":")[2] if digest else None


def holds(label: str, data: bytes) -> bool | None:
    """Whether ``data`` has the digest of a label ``algorithm:value``, in base32 or hex; None for an algorithm that is not known."""
    algorithm, _, value = label.rpartition(":")
    make = DIGESTS.get(algorithm.strip().lower().replace("-", ""))
    if not make:
        return None
    found, value = make(data).digest(), value.strip()
    return value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=") or value.lower() == found.hex()


def read_record(data: bytes) -> dict:
    fields, block = parse_record(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    labels = {"block": (fields.get("warc-block-digest"), block)}
    # A revisit's payload is in the record that it refers to.
    if kind == "response":
        labels["payload"] = fields.get("warc-payload-digest"), payload
    checks = {part: holds(label, held) for part, (label, held) in labels.items() if label}
    return {
        "page_id": _page_id(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_id(fields.get("warc-refers-to")),
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": int(said[1]) if said else len(payload),
        "payload_digest": _bare(fields.get("warc-payload-digest")),
        "problem": next((f"{part} digest differs" for part, ok in checks.items() if ok is False), None),
        "unchecked": ",".join(part for part, ok in checks.items() if ok is None) or None,
    }


def read_records(content: bytes) -> Iterator[dict]:
    """Every record of an archive as a row; a row with nothing but ``problem`` stands for each damaged record or stretch."""
    for data in members(content):
        try:
            if isinstance(data, DamagedRecord):
                raise data
            yield read_record(data)
        except DamagedRecord as e:
            yield {"problem": str(e)}


# --- tables --------------------------------------------------------------------------------------------

RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string, unchecked string"
_RECORDS_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string()), ("unchecked", pa.string())]
)
_ARCHIVES_ARROW = pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, refers_to, revisit: which rows are stored in full and which refer to another.

    Only payloads that occur more than once are looked up; the small table of them has one row per payload, made
    with map-side combine, so a payload that a third of all rows share is no hot key of the count. In the join it is one
    that adaptive execution splits, the table of payloads being the other side.
    """
    html = text_of(F.col("html"))
    rows = pages.select(F.col("page_id"), F.col("url"), html.alias("html"), F.sha1(html).alias("digest"))
    shared = (
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("stored_id"), F.count("*").alias("n_rows"))
        .where("n_rows > 1")
        .select("digest", "stored_id")
    )
    revisit = F.col("stored_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored_id"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("stored_id")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """name, n_records, content: archives of about ``archive_bytes``, one gzip member per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.RecordBatch.from_pylist([{"name": f"part-{part:05d}-{number:05d}.warc.gz", "n_records": len(parts), "content": b"".join(parts)}], schema=_ARCHIVES_ARROW)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                page_id, url, html, refers_to, revisit = (v.as_py() for v in row)
                parts.append(gzip_member(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield close()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield close()

    return plan_records(pages).mapInArrow(write, "name string, n_records long, content binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of every archive (any table with a ``content`` column); see :func:`read_records`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in read_records(content.as_py() or b""):
                    size += len(record.get("payload") or b"") if with_payload else 500
                    rows.append(record if with_payload else record | {"payload": None})
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)

    return archives.select("content").mapInArrow(read, RECORDS)


# --- query ---------------------------------------------------------------------------------------------


def op4_warc(spark, sf_dir):
    archives = stash(write_archives(table(spark, sf_dir, "pages")), "warc")
    read = read_archives(archives, with_payload=False)
    # A damaged archive must not pass for fewer pages.
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("damaged archive: "), "problem"))).otherwise(F.col("payload_digest"))
    return read.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


# Base32 of the 40 hex digits: 5 bits at a time.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS stored FROM p GROUP BY digest),
names AS (
  SELECT digest, stored, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(digest, 1 + (5 * k) // 4, 2) AS INTEGER) >> (3 - (5 * k) % 4)) & 31), 1), '' ORDER BY k) AS name
  FROM (SELECT digest || '0' AS digest, stored FROM m), (SELECT range AS k FROM range(32))
  GROUP BY digest, stored
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, name AS payload_digest,
  CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = stored THEN NULL ELSE stored END AS refers_to
FROM p JOIN names ON names.digest = p.digest || '0'
"""
