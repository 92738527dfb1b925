"""Token ids in seekable zstandard files (operator 7).

A file is a row of independent zstandard frames, each holding the ids of some
documents, then a frame with the documents' ids and lengths, then the seek
table of the zstandard seekable format as a skippable frame: compressed size,
plain size and checksum of every frame, and a footer by which a reader finds
the table from the end of the file.  A reader decompresses the frames of the
documents that it was asked for, and checks each against its checksum.

Documents stand in ascending doc_id order over all files: each task writes one
range of them, in as many files as its ids ask for, so what a writer or reader
holds does not grow with the range.  A null text is a document of its end id
alone; null doc_ids come last; rows of one doc_id stand in the order of their
texts, by whose beginnings a doc_id of very many rows is spread over tasks too;
repeated rows are written as often as they occur.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm import files, tokens
from fieldcast.llm.common import LAST_ID, chunks, id_or_last
from fieldcast.operators.util import materialize

#: The vocabulary, the id that ends a document, and the ids after which a frame is closed.
VOCABULARY, END_ID, FRAME_IDS = "word_bpe_49k.json", 2, 262_144
#: Ids and documents after which a file is closed, and documents that a reading task gives out at once.
FILE_IDS, FILE_DOCS, READ_DOCS = 67_108_864, 262_144, 8_192
#: Code points of a text by which rows of one doc_id are spread.
SPREAD_CHARS = 64
#: Fixed values of the seekable format: skippable frame, footer, and the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file; ids are stored in two bytes each if all fit, else in four."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.press = zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.size, self.table, self.docs, self.lengths = 0, [], [], []

    def add(self, doc: int, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_IDS * self.width:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.press.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), _checksum(data)))

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
        self._frame(struct.pack("<q", self.width) + np.array([self.docs, self.lengths], "<i8").tobytes())
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + _FOOTER.size) + entries + _FOOTER.pack(len(self.table), CHECKSUMS, SEEKABLE))
        self.out.close()


class Reader:
    """Reads documents of one open file; ``frames_read`` counts the frames that were decompressed."""

    def __init__(self, source):
        self.source, self.frames_read = source, 0
        end = source.seek(0, 2)
        source.seek(end - _FOOTER.size)
        count, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(end - _FOOTER.size - 12 * count - 8)
        kind, size = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE or size != 12 * count + _FOOTER.size:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.plain = np.cumsum(self.table[:, 1]) - self.table[:, 1]
        index = self._frame(count - 1)
        self.width = struct.unpack_from("<q", index)[0]
        self.docs, self.lengths = np.frombuffer(index, "<i8", offset=8).reshape(2, -1)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.last: tuple[int, bytes] = (-1, b"")

    def _frame(self, i: int) -> bytes:
        import zstandard

        self.source.seek(int(self.at[i]))
        data = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
        if len(data) != self.table[i, 1] or _checksum(data) != self.table[i, 2]:
            raise ValueError(f"frame {i} does not have its checksum")
        self.frames_read += 1
        return data

    def ids(self, nth: int) -> np.ndarray:
        """Ids of the file's nth document, from the frames that hold it."""
        begin, end = (int(self.starts[nth]) * self.width, int(self.starts[nth] + self.lengths[nth]) * self.width)
        out = []
        i = int(np.searchsorted(self.plain[:-1], begin, side="right")) - 1
        while begin < end:
            if self.last[0] != i:
                self.last = (i, self._frame(i))
            from_, stop = begin - int(self.plain[i]), min(end - int(self.plain[i]), int(self.table[i, 1]))
            out.append(self.last[1][from_:stop])
            begin += stop - from_
            i += 1
        return np.frombuffer(b"".join(out), f"<u{self.width}").astype("<u4")


def _written(folder: str, vocabulary: str, end_id: int, file_ids: int, file_docs: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_path = tokens.vocabulary(vocabulary)
        width = 2 if tokens.size(vocabulary_path) <= 65_536 else 4
        writer, nth = None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            told = (path, *first, nth, total)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(told, _FILES, strict=True)], schema=_FILES)

        for batch in chunks(batches):
            rows = zip(batch.column("doc").to_pylist(), batch.column("spread").to_pylist(),
                       tokens.encode(batch.column("text").to_pylist(), vocabulary_path), strict=True)
            for doc, spread, ids in rows:
                if writer is None:
                    path, first, total = f"{folder}/{uuid.uuid4().hex}.zst", (doc, spread), 0
                    writer = Writer(files.open_output(path), width)
                writer.add(doc, np.append(ids, np.uint32(end_id)))
                total += len(ids) + 1
                if total >= file_ids or len(writer.docs) >= file_docs:
                    yield closed()
                    writer, nth = None, nth + 1
        tokens.forget()
        if writer is not None:
            yield closed()

    return run


_FILES = pa.schema([("path", pa.string()), ("first", pa.int64()), ("spread", pa.string()), ("nth", pa.int32()), ("ids", pa.int64())])


def write_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write all documents and return the files (path, first, start): ``start`` is the number of ids in the files before."""
    folder = files.new_folder(docs.sparkSession, "ids")
    rows = docs.select(id_or_last().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = rows.withColumn("spread", F.substring("text", 1, SPREAD_CHARS)).repartitionByRange("doc", "spread").sortWithinPartitions("doc", "text")
    written = ranges.mapInArrow(_written(folder, vocabulary, end_id, file_ids, file_docs), "path string, first long, spread string, nth int, ids long")
    # one row per file; files that begin alike are of one task
    before = F.sum("ids").over(Window.orderBy("first", "spread", "nth").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(materialize(written, "files").select("path", "first", F.coalesce(before, F.lit(0)).alias("start")), "files")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with files.open_input(path) as source:
                reader = Reader(source)
                for begin in range(0, len(reader.docs), READ_DOCS):
                    rows = []
                    for i in range(begin, min(begin + READ_DOCS, len(reader.docs))):
                        ids, doc = reader.ids(i), int(reader.docs[i])
                        rows.append((None if doc == LAST_ID else doc, start + int(reader.starts[i]), len(ids), zlib.crc32(ids.tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(listed: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = listed.sparkSession
    spread = listed.repartition(max(spark.sparkContext.defaultParallelism, min(listed.count(), 10_000)), "path")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
