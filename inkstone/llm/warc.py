"""WARC archives: a writer, and a reader that salvages damaged ones.

Records are gzip members of their own. The reader checks each member and
record (compression, version line, lengths, payload digest); where a check
fails it searches for the next place at which a valid member or version line
begins, goes on from there, and logs the bytes between as quarantined. The same
search goes on inside decompressed members that hold several records, and a
damaged member is read as far as it can be decompressed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch

ARCHIVE_BYTES = 4 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_NAME = "urn:page:"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """Control characters and spaces would break the header's line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to``
    which has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, wbits=31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    """``first`` and ``end`` are bytes of the archive, of the whole member if
    there is one; ``inner`` has the bytes of the decompressed member. ``sound`` is
    false if that member is damaged, so that only the payload's digest vouches for the record."""

    first: int
    end: int
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    inner: tuple[int, int] | None = None
    sound: bool = True

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


@dataclass
class Gap:
    first: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes | None, int, int]:
    """Headers, payload (None for a revisit), payload length, and where the
    record ends. ValueError says which check failed."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    cut = data.find(b"\r\n\r\n", at)
    if cut < 0:
        raise ValueError("header without an end")
    headers = _headers(data[at:cut])
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    first, end = cut + 4, cut + 4 + size
    if size < 0 or end > len(data):
        raise ValueError("content is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end of record")
    block, payload, length = data[first:end], data[first:end], size
    if headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("HTTP header without an end")
        length = len(payload)
        if headers.get("warc-type") == "revisit":
            try:
                length, payload = int(_headers(http).get("content-length", "0")), None
            except ValueError:
                raise ValueError("no payload length") from None
    named = headers.get("warc-payload-digest", "")
    if payload is not None and named.startswith("sha1:") and named[5:] != digest(payload):
        raise ValueError("payload digest differs")
    return headers, payload, length, end + 4


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """What can be decompressed of the gzip member that begins at ``at``, where it
    ends, and what is wrong with it."""
    z, out, view = zlib.decompressobj(wbits=31), [], memoryview(data)
    while not z.eof and at < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(view[at : at + step]))
            at += step
        except zlib.error as e:
            if step == 1:
                return b"".join(out), at, f"member: {e}"
            z, step = before, step // 16  # up to the byte that can't be read
    at = min(at, len(data)) - len(z.unused_data)
    return b"".join(out), at, None if z.eof else "member is cut off"


def _inside(inner: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of decompressed bytes, which both ranges are of."""
    at, bad, why = 0, None, ""
    while at < len(inner):
        try:
            headers, payload, length, end = parse_record(inner, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            m = _VERSION.search(inner, at + 1)
            at = m.start() if m else len(inner)
            continue
        if bad is not None:
            yield Gap(bad, at, why, (bad, at))
            bad = None
        yield Record(at, end, headers, payload, length, (at, end))
        at = end
    if bad is not None:
        yield Gap(bad, at, why, (bad, at))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, plain or gzipped, and the gaps between.

    What is in one member has the member's range in the archive. A damaged
    member's range reaches to the next valid one; its records whose payloads have the
    digest they name come first, and then a gap for what couldn't be read. If
    one record is all there is in a damaged member, the damage is in it.
    """
    at, n = 0, len(data)
    bad, why, read, inner = None, "", [], None  # of the damaged stretch: first byte, reason, items that were read of it, the unread part

    def closed(end):
        for x in read:
            x.first, x.end = bad, end
            if isinstance(x, Record):
                x.sound = False
            yield x
        yield Gap(bad, end, why, inner)

    while at < n:
        found, wrong = [], None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            content, end, wrong = _member(data, at)
            found = list(_inside(content))
            rest = None
            if wrong:
                # a record that the damage has cut is part of the final gap
                rest = found.pop().inner[0] if found and isinstance(found[-1], Gap) else len(content)
                alone = len(found) == 1 and rest == len(content)
                found = [] if alone else [x for x in found if isinstance(x, Gap) or x.payload is not None and "warc-payload-digest" in x.headers]
            good = any(isinstance(x, Record) for x in found)
            for x in found:
                x.first, x.end = at, end
            if not wrong and not good and found:
                wrong = found[0].reason
        else:
            good, rest = False, None
            try:
                headers, payload, length, end = parse_record(data, at)
                found, good = [Record(at, end, headers, payload, length)], True
            except ValueError as e:
                wrong = str(e)
        if good and bad is not None:
            yield from closed(at)
            bad = None
        if not wrong:
            yield from found
            at = end
            continue
        if bad is None:
            bad, why, read, inner = at, wrong, found if good else [], (rest, len(content)) if good and rest is not None else None
        m = _START.search(data, at + 1)
        at = m.start() if m else n
    if bad is not None:
        yield from closed(n)


def decide_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """``id``, ``sha1``, ``keeper`` (the largest id with that payload) by row,
    without the payloads. Payloads below ``least`` bytes have none."""
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    each = pages.select(F.col(id_col).alias("id"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    keep = each.filter(F.col("size") >= least).groupBy("sha1").agg(F.max("id").alias("keeper"))
    return each.select("id", "sha1").distinct().join(keep, "sha1", "left")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Archives (``name``, ``content``) of about ARCHIVE_BYTES with a record for
    each row, in which the largest id of each payload has a response and the
    others revisit it. Rows that repeat an id and payload get records alike."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("hex", F.sha1(F.encode("html", "UTF-8")))
    chosen = decide_records(pages, id_col, html_col, least).withColumnRenamed("id", "own")
    rows = rows.join(chosen, F.col("id").eqNullSafe(F.col("own")) & (F.col("hex") == F.col("sha1")), "left")
    rows = rows.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches):
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for i, url, text, ref in zip(*(c.to_pylist() for c in b.columns)):
                held.append(member(record(i, url, text.encode(), ref)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"name": [f"part-{part:05d}-{count:05d}.warc.gz"], "content": [b"".join(held)]})
                    count, held, size = count + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"name": [f"part-{part:05d}-{count:05d}.warc.gz"], "content": [b"".join(held)]})

    return rows.mapInArrow(run, "name string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives (``name``, ``content``), as from
    ``write_archives`` or, renamed, the binaryFile source.

    Of a gap only ``archive``, ``first_byte``, ``end_byte``, ``gap`` (the
    check that failed) and, if it lies in a member, ``inner_first`` and ``inner_end``
    (bytes of the decompressed member) are set. ``sound`` is false for records of
    damaged members. A null or empty archive has neither.
    """
    schema = "archive string, first_byte long, end_byte long, inner_first long, inner_end long, sound boolean, gap string, record_id string, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string"

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                out = []
                for x in salvage(content.as_py() or b""):
                    if isinstance(x, Gap):
                        out.append((name.as_py(), x.first, x.end, *(x.inner or (None, None)), None, x.reason, *[None] * 7))
                    else:
                        h = x.headers
                        named = h.get("warc-payload-digest", "")
                        out.append((name.as_py(), x.first, x.end, *(x.inner or (None, None)), x.sound, None, h.get("warc-record-id", "").strip("<>"), x.kind, h.get("warc-target-uri"), x.payload, x.payload_bytes, named.removeprefix("sha1:") or None, h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
                names = [x.split()[0] for x in schema.split(", ")]
                columns = zip(*out) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return archives.select("name", "content").mapInArrow(run, schema)


def page_of(name):
    """The page id in a record's name, a column; null for a page without one."""
    return F.when(name.startswith(_NAME) & (F.length(name) > len(_NAME)), F.substring(name, len(_NAME) + 1, 30).cast("long"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` as read from
    the archives that are written of ``pages``.

    A null html is an empty payload. Of equal payloads the largest id's record
    is the response and the others revisit it; rows that repeat that
    id are responses as well. Rows without an id revisit if a row with an id
    has their payload, and are responses otherwise. A url may be
    null. Other columns aren't read. A record that can't be read again is an error.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    read = read_archives(scratch.keep(write_archives(pages, id_col, url_col, html_col)))
    read = read.filter(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "archive", "gap")).cast("boolean")))
    return read.select(page_of(F.col("record_id")).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(p.hex, 1 + 5 * (i // 4)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p JOIN k ON p.hex = k.hex"""
