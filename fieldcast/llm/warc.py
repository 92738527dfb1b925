"""WARC archives: one gzip member per record, and a sequential reader (operator 2).

``write_archives`` lets each task write its pages as records of one or more
archive files in the shared folder.  Of records with equal payloads of
``revisit_from`` bytes or more, the one with the largest page_id is a response
and the others are revisits that refer to it; smaller ones are responses.

``read_archives`` reads each file from front to back in blocks: the members
are inflated as the blocks come, the header tells the length of the content,
and the payload is checked against its digest while it goes by, so memory does
not grow with the file.  A damaged record stops the read with its place.

A null html is an empty payload.  Rows of the largest page_id are all
responses, so a row that repeats the response is a response too.  A null
page_id gives a record without that field; among equal payloads it revisits
the largest page_id, and is a response if all are null.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import files
from fieldcast.llm.common import chunks
from fieldcast.operators.util import materialize

#: Bytes of payload from which copies become revisits; bytes after which a task begins a new file; bytes of a block.
REVISIT_FROM, FILE_BYTES, BLOCK = 1000, 256_000_000, 1 << 18
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; the block of a revisit is empty."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    block = payload if refers_to is None else b""
    fields.append(("Content-Length", str(len(block))))
    head = b"".join([VERSION, END, *(f"{k}: {v}".encode() + END for k, v in fields), END])
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(head) + press.compress(block) + press.compress(END + END) + press.flush()


def _written(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count, done = None, "", 0, 0, []
        for batch in chunks(batches, "payload"):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # a task that runs again writes other files; only files in the returned list are read
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output(path)
                data = record(page_id, url, payload, digest, refers_to)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write the pages (page_id, url, html) and return the list of archives (path, records)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    long_ones = rows.filter(F.octet_length("payload") >= revisit_from)
    # one row per payload that several records have, summed before the shuffle
    copied = long_ones.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").select("digest", "largest")
    told = rows.join(materialize(copied, "copied"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("largest")), F.col("largest"))
    folder = files.new_folder(pages.sparkSession, "warc")
    return materialize(told.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_written(folder), "path string, records long"), "archives")


class Inflated:
    """Bytes of a file of gzip members, read block by block."""

    def __init__(self, source):
        self.source, self.block, self.held, self.member = source, b"", b"", None

    def more(self) -> bool:
        """Inflate some more; False at the end of the file."""
        while True:
            if not self.block:
                self.block = self.source.read(BLOCK)
                if not self.block:
                    if self.member is not None:
                        raise ValueError("the last member is cut off")
                    return False
            self.member = self.member or zlib.decompressobj(31)
            data = self.member.decompress(self.block, BLOCK)
            self.block = self.member.unconsumed_tail
            if self.member.eof:
                self.block, self.member = self.member.unused_data, None
            if data:
                self.held += data
                return True

    def line(self) -> bytes | None:
        while (at := self.held.find(END)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("a header is cut off")
                return None
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def pieces(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes, as they come."""
        while length:
            if not self.held and not self.more():
                raise ValueError("a block is cut off")
            piece, self.held = self.held[:length], self.held[length:]
            length -= len(piece)
            yield piece


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open archive; raises ValueError where framing or digest is wrong."""
    stream = Inflated(source)
    while (version := stream.line()) is not None:
        if version != VERSION:
            raise ValueError(f"no record begins with {version[:40]!r}")
        fields: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        digest, block = hashlib.sha1(), []
        for piece in stream.pieces(int(fields["Content-Length"])):
            digest.update(piece)
            block.append(piece)
        if b"".join(stream.pieces(4)) != END + END:
            raise ValueError("a record does not end where its length says")
        if fields["WARC-Type"] == "response" and f"sha1:{digest.hexdigest()}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
        yield fields, b"".join(block)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    for batch in batches:
        for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
            rows, size, count = [], 0, 0
            with files.open_input(path) as source:
                for fields, block in records(source):
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    rows.append((page and int(page), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], refers and int(refers), block))
                    size, count = size + len(block), count + 1
                    if size > 4_000_000 or len(rows) >= 10_000:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)
            if count != expected:
                raise ValueError(f"{path} has {count} records, not {expected}")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of responses)."""
    spark = archives.sparkSession
    spread = archives.repartition(max(spark.sparkContext.defaultParallelism, min(archives.count(), 10_000)), "path")
    return spread.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
