"""WARC archives: a writer with revisit records and a salvage reader.

The reader checks every record (gzip member, version line, header, length, digest). After a failed
check it searches for the next valid member or version line, goes on from there, and reports the
bytes between as a quarantined gap. It works through a window on the file, so memory is bounded by
the largest record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shared_folder, stored

MIN_REVISIT_BYTES = 1000
#: A new archive is begun when the current one has so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes of a file that the reader fetches at once.
WINDOW_BYTES = 1 << 20
#: Bytes in which the end of a header is looked for first.
HEADER_BYTES = 64 << 10

MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
VERSION_LINES = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _digest(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of another page's response."""
    block = b"" if refers_to is not None else HTTP + payload
    name = b"none" if page_id is None else b"%d" % page_id
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:" + name + b">",
        b"WARC-Date: 2000-01-01T00:00:00Z",
        b"WARC-Payload-Digest: " + _digest(payload),
        b"WARC-Block-Digest: " + _digest(block),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if url is not None:
        safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        head.append(b"WARC-Target-URI: " + safe.encode("utf-8", "replace"))
    if refers_to is None:
        head.append(b"Content-Type: application/http; msgtype=response")
    else:
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(Exception):
    """A record that fails a check."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block and end of the record that starts at ``at``."""
    if not data.startswith(VERSION_LINES, at):
        raise Damaged("no version line")
    # The data is a checked member or a record whose header was bounded before.
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("no end of header")
    fields: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("wrong length")
    block = data[begin:end]
    if "warc-block-digest" in fields and fields["warc-block-digest"].encode() != _digest(block):
        raise Damaged("wrong block digest")
    return fields, block, end + 4


class Window:
    """Random access to a file through one cached stretch."""

    def __init__(self, file, size: int, step: int = WINDOW_BYTES):
        self.file, self.size, self.step = file, size, step
        self.begin, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.begin <= at or at + n > self.begin + len(self.data):
            self.file.seek(at)
            self.begin, self.data = at, self.file.read(min(max(n, self.step), self.size - at))
        return self.data[at - self.begin : at - self.begin + n]

    def some(self, at: int) -> bytes:
        """What is held from ``at`` on, or else the next stretch; nothing is read twice but a version line."""
        held = self.begin + len(self.data)
        if not self.begin <= at < held or (held - at < len(VERSION) and held < self.size):
            return self.get(at, self.step)
        return self.data[at - self.begin :]

    def find(self, at: int) -> int:
        """The next place that may start a member or a version line, or the end of the file."""
        while at < self.size:
            part = self.some(at)
            hits = [h for h in (part.find(MEMBER), part.find(VERSION)) if h >= 0]
            if hits:
                return at + min(hits)
            if at + len(part) >= self.size:
                break
            at += max(1, len(part) - len(VERSION) + 1)
        return self.size


def _member(window: Window, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``; its checksum and length are verified by zlib."""
    inflate, parts, pos = zlib.decompressobj(wbits=31), [], at
    while not inflate.eof:
        chunk = window.some(pos)
        if not chunk:
            raise Damaged("member is cut short")
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        pos += len(chunk)
        if len(parts) == 1 and not VERSION.startswith(parts[0][: len(VERSION)]):
            raise Damaged("member is no record")
    return b"".join(parts), pos - len(inflate.unused_data)


def _plain(window: Window, at: int) -> tuple[dict[str, str], bytes, int]:
    # The stretch grows until the header ends; a line that is no field shows damage at once.
    n, head, stop = HEADER_BYTES, b"", -1
    while stop < 0:
        head = window.get(at, n)
        stop = head.find(b"\r\n\r\n")
        lines = head[: stop if stop >= 0 else len(head)].split(b"\r\n")[1:]
        if any(b":" not in line for line in (lines if stop >= 0 else lines[:-1])):
            raise Damaged("no header field")
        if stop < 0 and at + n >= window.size:
            raise Damaged("no end of header")
        n *= 4
    low = head[:stop].lower()
    field = low.rfind(b"\r\ncontent-length:")
    digits = low[field + 17 :].split(b"\r\n")[0].strip() if field >= 0 else b""
    if not digits.isdigit():
        raise Damaged("no content length")
    whole = window.get(at, stop + 4 + int(digits) + 4)
    fields, block, used = parse_record(whole)
    return fields, block, at + used


def salvage(file, size: int) -> Iterator[tuple]:
    """Records ("record", start, end, fields, block) and gaps ("gap", start, end, reason), in file order."""
    window, at = Window(file, size), 0
    gap, reason = None, ""
    while at < size:
        try:
            if window.get(at, len(MEMBER)) == MEMBER:
                data, end = _member(window, at)
                found, pos = [], 0
                while pos < len(data):
                    fields, block, pos = parse_record(data, pos)
                    found.append((fields, block))
            elif window.get(at, len(VERSION)) == VERSION:
                fields, block, end = _plain(window, at)
                found = [(fields, block)]
            else:
                raise Damaged("neither member nor version line")
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = window.find(at + 1)
            continue
        if gap is not None:
            yield ("gap", gap, at, reason)
            gap = None
        for fields, block in found:
            yield ("record", at, end, fields, block)
        at = end
    if gap is not None:
        yield ("gap", gap, size, reason)


def _number(uri: str | None):
    """The page number in <urn:page:N>, else null."""
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def with_references(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads that are long enough, the largest id is kept."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("key", F.when(F.col("size") >= least, F.sha1(F.col("html").cast("binary"))))
    kept = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    # Payloads that occur once need no join; adaptive execution splits a payload with very many copies.
    kept = kept.where("n > 1").select("key", "kept")
    refers = F.when(F.col("kept") > F.coalesce("page_id", F.lit(-(1 << 63))), F.col("kept"))
    return rows.join(kept, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) as gzip members; returns the stored manifest (path, records, size).

    Each task writes archives of bounded size. A name holds the task attempt, and only archives of
    attempts that Spark committed are in the manifest, so a lost or repeated task leaves no double.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        disk, base = fs.FileSystem.from_uri(folder)
        disk.create_dir(base, recursive=True)
        task = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        made, out, records, size = [], None, 0, 0

        def close():
            if out is not None:
                out.close()
                made.append((name, records, size))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]):
                if out is None or size >= archive_bytes:
                    close()
                    name = f"{base}/pages-{task}-{len(made):05d}.warc.gz"
                    out, records, size = disk.open_output_stream(name, compression=None), 0, 0
                data = record_bytes(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3])
                member = gzip.compress(data, 6, mtime=0)
                out.write(member)
                records += 1
                size += len(member)
        close()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "size"), map(list, zip(*made)))))

    rows = pages.select("page_id", "url", "html", "refers_to")
    return stored(rows.mapInArrow(run, "path string, records long, size long"), "warc-manifest")


RECORDS = (
    "kind string, path string, start long, end long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives named in ``manifest`` (path); one archive is read by one task.

    The payload of a response is checked against its digest; a record that fails is a gap.
    """
    names = RECORDS.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")

    def rows(disk, path):
        with disk.open_input_file(path) as file:
            for item in salvage(file, file.size()):
                if item[0] == "gap":
                    yield ("gap", path, item[1], item[2], item[3], *[None] * 7)
                    continue
                _, start, end, fields, block = item
                payload = block.partition(b"\r\n\r\n")[2]
                told = fields.get("warc-payload-digest", "")
                revisit = fields.get("warc-type") == "revisit"
                if not revisit and told and told.encode() != _digest(payload):
                    yield ("gap", path, start, end, "wrong payload digest", *[None] * 7)
                    continue
                size = int(fields.get("x-payload-length") or len(payload))
                raw = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else hashlib.sha1(payload).hexdigest()
                yield (
                    "record", path, start, end, None, _number(fields.get("warc-record-id")),
                    fields.get("warc-target-uri"), fields.get("warc-type"), _number(fields.get("warc-refers-to")),
                    size, raw, payload if with_payload and not revisit else None,
                )

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        disk, _ = fs.FileSystem.from_uri(folder)
        out, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in rows(disk, path):
                    out.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > 4 << 20:
                        yield _batch(pa, out, names)
                        out, held = [], 0
        if out:
            yield _batch(pa, out, names)

    # One task an archive; with a number of partitions adaptive execution does not merge the short rows.
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, RECORDS)


def _batch(pa, rows, names):
    text, whole = pa.string(), pa.int64()
    kinds = [text, text, whole, whole, text, whole, text, text, whole, whole, text, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to WARC archives and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Of equal
    payloads of at least 1000 bytes the one with the largest page_id is the response; rows that
    repeat that id are responses too. A null html is an empty payload, a null url has no target
    field, a null page_id is read back as null (such a page never is the one kept unless all copies
    are null). Other columns are ignored. An empty table gives an empty result.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(with_references(pages), folder)
    back = read_archives(manifest, folder)
    return back.where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
