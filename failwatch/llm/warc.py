"""WARC: one gzip member per record, and a reader whose tasks each own a byte range.

Writing. Each page is an HTTP response record whose payload is the html in UTF-8. Of pages with
equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page_id is a response
and the others are revisit records, which name it and carry no payload.

Reading. A file is cut into byte ranges. A task looks for the gzip magic from the start of its
range, takes the first place where a member really decodes to a WARC header, and follows the
members from there; it owns the records that start inside its range and reads the last of them
past its end. So ranges of any size give every record once.

Edge cases: a null html is an empty payload, a null url is left out, control characters in a url
are percent-encoded. A null page_id is written without that header and read back as null; such
a page is never referred to. Rows that repeat a whole page are all written; repeats of the
largest page_id are each a response. An empty table gives no record. Bytes of a file that are
no WARC member are skipped; a damaged member is passed over up to the next good one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from failwatch.llm.files import committed, listed, resolve

MIN_REVISIT = 1000
#: Bytes that one reading task scans.
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _record(page_id, url, html, digest: str, refers_to) -> bytes:
    payload = html.encode()
    kind = "response" if refers_to is None else "revisit"
    header = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        header.append("WARC-Target-URI: " + "".join(c if ord(c) >= 32 and c not in "%\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        header += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    block = http + payload
    header.append(f"Content-Length: {len(block)}")
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str) -> int:
    """Write the archives, one per task with rows; the number of records."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    last = (
        rows.where((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "last")
    )
    # A payload without a page_id can still revisit one that has it.
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    marked = rows.join(last, "digest", "left").select("page_id", "url", "html", "digest", revisit.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, path = 0, f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with committed(path) as out:
            while first is not None:
                for row in range(first.num_rows):
                    record = _record(*(first[c][row].as_py() for c in ("page_id", "url", "html", "digest", "refers_to")))
                    coder = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(coder.compress(record) + coder.flush())
                    n += 1
                first = next((b for b in batches if b.num_rows), None)
        yield pa.record_batch([pa.array([n])], ["records"])

    return marked.mapInArrow(run, "records bigint").agg(F.sum("records")).first()[0] or 0


class _Members:
    """Members of one file from a place on; reads ahead in pieces."""

    def __init__(self, source, size: int, start: int):
        self.source, self.size = source, size
        self.at, self.buffer = start, b""

    def _fill(self, n: int) -> bool:
        """Hold at least n bytes from ``at`` on, if there are."""
        while len(self.buffer) < n:
            self.source.seek(self.at + len(self.buffer))
            piece = self.source.read(min(READ_BYTES, self.size - self.at - len(self.buffer)))
            if not piece:
                return False
            self.buffer += piece
        return True

    def find(self, end: int) -> bool:
        """Move to the next gzip magic before ``end``."""
        while self.at < end:
            if not self._fill(len(MAGIC)):
                return False
            hit = self.buffer.find(MAGIC)
            if hit >= 0:
                self.at, self.buffer = self.at + hit, self.buffer[hit:]
                return self.at < end
            self._skip(len(self.buffer) - len(MAGIC) + 1)
        return False

    def _skip(self, n: int) -> None:
        self.at, self.buffer = self.at + n, self.buffer[n:]

    def looks_right(self) -> bool:
        """Whether the bytes here decode to the start of a WARC header."""
        self._fill(512)
        try:
            return zlib.decompressobj(31).decompress(self.buffer[:512], 5) == b"WARC/"
        except zlib.error:
            return False

    def take(self) -> bytes | None:
        """The member here, whole, and move behind it; None if it is damaged, and move one byte."""
        coder, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not coder.eof:
                if used >= len(self.buffer) and not self._fill(used + 1):
                    raise zlib.error("the file ends in a member")
                piece = self.buffer[used:]
                parts.append(coder.decompress(piece))
                used += len(piece) - len(coder.unused_data)
        except zlib.error:
            self._skip(1)
            return None
        self._skip(used)
        return b"".join(parts)


def _parse(record: bytes):
    """Fields of a record, or None for other record types."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(name):
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    if kind == "response":
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if fields.get("warc-payload-digest") not in (None, f"sha1:{digest}"):
            return None
    else:
        # The payload is that of the record referred to; its size and digest are in the header.
        n, digest, payload = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), None
    return page("warc-record-id"), fields.get("warc-target-uri"), kind, page("warc-refers-to"), n, digest, payload


def records_in(path: str, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that start at byte ``start`` or later but before ``end``."""
    store, target = resolve(path)
    with store.open_input_file(target) as source:
        members = _Members(source, source.size(), start)
        while members.find(end):
            if not members.looks_right():
                members._skip(1)
                continue
            record = members.take()
            if record is not None:
                yield record


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload."""
    ranges = [
        (path, start, min(start + split_bytes, size))
        for path, size in listed(folder, ".warc.gz")
        for start in range(0, size, split_bytes)
    ]
    plan = spark.createDataFrame(ranges, "path string, start bigint, end bigint").repartition(max(1, len(ranges)))
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                rows, size = [], 0
                for record in records_in(part["path"], part["start"], part["end"]):
                    if (row := _parse(record)) is not None:
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(record)
                    if size > 1 << 22:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return plan.mapInArrow(run, _SCHEMA)
