"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

``write`` stores a record for each page, one gzip member a record, in archives of
bounded size in a folder that all executors share.  Of records with equal payloads
the one of the smallest page_id is a ``response``; the others are ``revisit``
records without the payload, naming that response.

``read`` opens archives (gzip members or plain) one file a task, holding one gzip
member, or one record of plain text, at a time.  Every record is checked: version line, header lines, length, the end
mark, block digest, and the member's own check sum.  After a failed check the
reader searches for the next place that passes all of them (a gzip member that
begins with a version line, or a version line in plain text), goes on there, and
logs the bytes passed over as a gap.  Records after a damaged one are so
recovered; in a damaged stretch a whole record inside another's payload counts as
one.  In a member of several records, or a whole file compressed as one member,
the records before the first damage are recovered and the search inside goes on in
the unpacked text.

Defined results: null html is empty.  Null page_ids come last: such a record is a
response only if no equal payload has an id, and then all of them are.  Rows of
equal id and payload are all responses, or revisit the same one.  Empty tables
give no archive and no rows.  Null urls are left out of the header; control
characters in urls are percent-encoded and come back so from the header, while
payloads come back byte by byte, whatever their length.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import qualified, shared_dir, small_batches

#: Payloads from this many bytes on are stored once.
MIN_SHARED = 100
#: An archive is closed when it has reached this size, and each file is read by one task.
ARCHIVE_BYTES = 32 << 20
#: Bytes read at a time.
CHUNK = 1 << 18
#: Slots over which the rows of one payload are spread when they look for their response.
SPREAD = 16
# The format's version line, line ends, end mark and the magic bytes of a gzip member.
VERSION, LINE, END, MAGIC = b"WARC/1.", b"\r\n", b"\r\n\r\n", b"\x1f\x8b\x08"
MAX_HEADER = 1 << 20

FOUND = "path string, offset long, length long, gap boolean, reason string, type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(record_id: str) -> Column:
    """The page_id that a record's name (a column) holds, null for none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record of the format, unpacked."""
    http = LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + END
    block = http if revisit else http + payload
    head = [VERSION + b"1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _name(page).encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x1f\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers_to).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return LINE.join(head) + END + block + END


def pack(data: bytes) -> bytes:
    """``data`` as one gzip member, the same bytes each time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, out, size, n, made = TaskContext.get().partitionId(), 0, None, 0, 0, []
        attempt = uuid.uuid4().hex  # another attempt of this task writes other files; only those of the one that ended are listed

        def close():
            nonlocal out, number
            out.close()
            made.append((f"{folder}/{name}", size, n))
            out, number = None, number + 1

        for batch in batches:
            payloads = batch.column("html").cast(pa.large_binary())
            for k, (page, url, digest, first, revisit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "revisit")), strict=True)):
                if out is None:
                    name = f"part-{part:06d}-{number:04d}-{attempt}.warc.gz"
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = pack(record(page, url, payloads[k].as_py(), digest, first, revisit, date))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"path": p, "bytes": b, "records": r} for p, b, r in made], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write(pages: DataFrame, folder: str | None = None, min_shared: int = MIN_SHARED, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder``; returns the written list of archives: path, bytes, records."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = rows.filter(F.octet_length("html") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = shared.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    slot = F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int")
    known = rows.withColumn("slot", slot).join(shared, ["digest", "slot"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    known = known.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))
    made = known.mapInArrow(_writer(folder, archive_bytes, date), "path string, bytes long, records long")
    listing = f"{folder}/_archives"
    made.write.parquet(listing)
    return spark.read.schema("path string, bytes long, records long").parquet(listing)


class _File:
    """Random reads of a file with the last chunks kept, so that the parser sees bytes by place."""

    def __init__(self, handle):
        self.handle, self.size, self.start, self.data = handle, handle.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``place`` on."""
        n = min(n, self.size - place)
        if n <= 0:
            return b""
        if not (self.start <= place and place + n <= self.start + len(self.data)):
            self.handle.seek(place)
            self.start, self.data = place, self.handle.read(max(n, CHUNK))
        return self.data[place - self.start : place - self.start + n]

    def find(self, mark: bytes, place: int) -> int:
        """The first place of ``mark`` from ``place`` on, or -1."""
        while place < self.size:
            data = self.at(place, CHUNK)
            k = data.find(mark)
            if k >= 0:
                return place + k
            if place + len(data) >= self.size:
                break
            place += len(data) - len(mark) + 1
        return -1


class _Text(_File):
    """The same over bytes in memory."""

    def __init__(self, data: bytes):
        self.size, self.data = len(data), data

    def at(self, place: int, n: int) -> bytes:
        return self.data[place : place + n]

    def find(self, mark: bytes, place: int) -> int:
        return self.data.find(mark, place)


class Damaged(Exception):
    """A check that failed."""


def _head(source, place: int) -> tuple[dict[bytes, bytes], int, int]:
    """The header lines at ``place``, where the block starts, and the block's length."""
    n = 4096
    while True:
        data = source.at(place, n)
        if not data.startswith(VERSION):
            raise Damaged("no version line")
        end = data.find(END)
        if end >= 0:
            break
        if len(data) < n or n >= MAX_HEADER:
            raise Damaged("header has no end")
        n *= 4
    lines = data[:end].split(LINE)
    if not re.fullmatch(rb"WARC/1\.[0-9]", lines[0]):
        raise Damaged("no version line")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        head[name.strip().lower()] = value.strip()
    length = head.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        raise Damaged("no length")
    return head, place + end + len(END), int(length)


def _record(source, place: int) -> tuple[dict[bytes, bytes], bytes, int]:
    """The checked record at ``place``: header, block and where the next one may start."""
    head, start, length = _head(source, place)
    after = start + length
    if source.at(after, len(END)) != END:
        raise Damaged("no end mark at the stated length")
    block = source.at(start, length)
    stated = head.get(b"warc-block-digest", b"")
    if stated.startswith(b"sha256:") and stated[7:].decode("ascii", "replace") != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    return head, block, after + len(END)


def _next(source, place: int, marks: tuple[bytes, ...]) -> int:
    """The first place from ``place`` on where a member or a version line can begin, or the end."""
    found = source.size
    for mark in marks:
        at = source.find(mark, place)
        while mark == VERSION and at > 0 and source.at(at - 1, 1) != b"\n":  # a version line starts a line
            at = source.find(mark, at + 1)
        if at >= 0:
            found = min(found, at)
    return found


def _walk(source, step, marks: tuple[bytes, ...]):
    """What ``step`` finds from place to place, (start, end, found), and the gaps between, (start, end, reason)."""
    place, lost, reason = 0, None, ""
    while place < source.size:
        try:
            found, after = step(source, place)
        except Damaged as failed:
            if lost is None:
                lost, reason = place, str(failed)
            place = _next(source, place + 1, marks)
            continue
        if lost is not None:
            yield lost, place, reason
            lost = None
        yield place, after, found
        place = after
    if lost is not None:
        yield lost, source.size, reason


def _member(source, place: int) -> tuple[bytes, int]:
    """The unpacked gzip member at ``place`` and where it ends; it must hold a version line first."""
    z, out, at, begun = zlib.decompressobj(31), [], place, False
    while not z.eof:
        data = source.at(at, CHUNK)
        if not data:
            raise Damaged("member has no end")
        try:
            out.append(z.decompress(data))
        except zlib.error as failed:
            raise Damaged("member can't be unpacked") from failed
        at += len(data)
        if not begun and sum(map(len, out)) >= len(VERSION):
            begun = True
            if not b"".join(out)[: len(VERSION)] == VERSION:
                raise Damaged("member without a version line")
    if not begun:
        raise Damaged("member without a version line")
    return b"".join(out), at - len(z.unused_data)


def _one(source, place: int) -> tuple[list, int]:
    """The record at ``place`` as a list of one, and where it ends."""
    head, block, after = _record(source, place)
    return [(head, block)], after


def _any(source, place: int) -> tuple[list, int]:
    """The records and gaps of the member, or the record, at ``place``, and where it ends."""
    if source.at(place, len(MAGIC)) != MAGIC:
        return _one(source, place)
    data, after = _member(source, place)
    inside = []
    for start, end, found in _walk(_Text(data), _one, (VERSION,)):
        inside += found if isinstance(found, list) else [f"in a member: {found}, bytes {start} to {end} unpacked"]
    if all(isinstance(x, str) for x in inside):
        raise Damaged(inside[0].removeprefix("in a member: "))
    return inside, after


def salvage(source):
    """All records, (start, end, (header, block)), and gaps, (start, end, reason), of an archive in order.

    A gap inside a member of several records is given the member's place in the file.
    """
    for start, end, found in _walk(source, _any, (MAGIC, VERSION)):
        for x in found if isinstance(found, list) else [found]:
            yield start, end, x


def _row(path: str, found: tuple, with_payload: bool) -> dict:
    start, end, what = found
    if isinstance(what, str):
        return {"path": path, "offset": start, "length": end - start, "gap": True, "reason": what}
    head, block = what
    text = lambda name: head[name].decode("utf-8", "replace") if name in head else None
    http, _, payload = block.partition(END) if block.startswith(b"HTTP/") else (b"", b"", block)
    stated = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", http)
    revisit = head.get(b"warc-type") == b"revisit"
    digest = text(b"warc-payload-digest")
    digest = digest.removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    return {
        "path": path, "offset": start, "length": end - start, "gap": False, "type": text(b"warc-type"), "record_id": text(b"warc-record-id"), "refers_to": text(b"warc-refers-to"), "target_uri": text(b"warc-target-uri"),
        "payload_digest": digest, "payload_bytes": int(stated[1]) if revisit and stated else len(payload), "payload": None if revisit or not with_payload else payload,
    }


def _reader(with_payload: bool):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in FOUND.split(", "))])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as handle:
                    for found in salvage(_File(handle)):
                        rows.append(_row(path, found, with_payload))
                        size += len(rows[-1].get("payload") or b"") + 500
                        if size > CHUNK * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``gap`` true, with their ``reason``) of the archives named by ``path``; one task a file.

    ``archives`` is best a written list, as ``write`` returns: it is read three times.
    """
    files = archives.select("path").repartitionByRange(max(1, archives.count()), "path")
    return files.mapInArrow(_reader(with_payload), FOUND)
