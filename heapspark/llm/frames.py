"""Token files: independent zstandard frames, a document index and a trailing seek table.

Layout: data frames | index (skippable frame) | seek table (skippable frame).  The seek table
is that of the public zstd seekable format, with a checksum (low 32 bits of xxh64 of the
uncompressed data) for each frame, so that any reader of that format opens the file.  The index
lists ids and token counts in file order; ids' byte positions follow from the counts.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, slices, text_of, work_dir
from .tokens import encoder

# Fixed values of the public format.
SEEKABLE_MAGIC = 0x8F92EAB1
SEEK_TABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50

_INDEX = struct.Struct("<QB")  # documents, bytes of an id
_NULL = np.iinfo(np.int64).min  # a null doc_id in the index


def _open(path: str):
    """(filesystem, path) of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class FrameWriter:
    """Writes documents in order; memory holds one frame and the index of one file."""

    def __init__(self, sink, width: int = 2, frame_bytes: int = 1 << 18, level: int = 3):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes = [], 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"id {int(ids.max())} does not fit {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.ids.append(_NULL if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.tokens += len(ids)
        for at in range(0, len(raw), self.frame_bytes) or (0,):
            part = raw[at : at + self.frame_bytes]
            if self.held_bytes + len(part) > self.frame_bytes:
                self._flush()
            self.held.append(part)
            self.held_bytes += len(part)

    def _flush(self) -> None:
        if self.held_bytes:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        body = np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes()
        body = _INDEX.pack(len(self.ids), self.width) + self.zstd.compress(body)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        rows = self.table + [(8 + len(body), 0, 0)]
        seek = b"".join(struct.pack("<III", *x) for x in rows) + struct.pack("<IBI", len(rows), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)) + seek)


class FrameReader:
    """Random access to one file: reads the tail, then only the frames of what is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a file with a checksummed seek table")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(rows[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(rows[:-1, 1])])
        self.sums = rows[:-1, 2]
        body = self._at(int(self.packed_at[-2]) + 8, int(rows[-1, 0]) - 8)
        n, self.width = _INDEX.unpack_from(body)
        both = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[_INDEX.size :]), "<i8")
        self.ids, self.counts = both[:n], both[n:]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.cached: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            packed = self._at(int(self.packed_at[k]), int(self.packed_at[k + 1] - self.packed_at[k]))
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.raw_at[k + 1] - self.raw_at[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.cached = (k, raw)
        return self.cached[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document in file order."""
        at, end = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        parts, k = [], bisect_right(self.raw_at, at) - 1
        while at < end:
            upto = min(end, int(self.raw_at[k + 1]))
            parts.append(self.frame(k)[at - int(self.raw_at[k]) : upto - int(self.raw_at[k])])
            at, k = upto, k + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id (files are in ascending id order)."""
        return [self.document(i) for i in range(*np.searchsorted(self.ids, [doc_id, doc_id + 1]).tolist())]


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that every id of the tokenizer fits: 2 or 4."""
    from tokenizers import Tokenizer

    top = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return 2 if top < 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, words: bool = True, width: int | None = None, file_docs: int = 200_000, file_tokens: int = 1 << 28) -> DataFrame:
    """Encode whole texts and write them, in ascending doc_id order, as files in folder.

    Returns the manifest (path, part, first_id, n_docs, n_tokens), one row per file.  A task writes one
    file after another, each closed at file_docs documents or file_tokens ids, under names of its own,
    so a task that is run again leaves no half-written file in the manifest.  The order of files is that of
    (first_id, part).  Null ids come first.  width: bytes of an id, by default what the tokenizer's
    largest id needs; an id that does not fit is an error.
    """
    width = width or id_width(tokenizer, end_id)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, part, end = encoder(tokenizer, words), None, 0, struct.pack("<I", end_id)

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            cols = ([path], [part], [first], [len(writer.ids)], [writer.tokens])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "part", "first_id", "n_docs", "n_tokens"])

        for batch in slices(batches, most=1 << 20):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                if writer is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.zst"
                    where, name = _open(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    sink, first = where.open_output_stream(name, compression=None), doc
                    writer = FrameWriter(sink, width)
                writer.add(doc, np.frombuffer(raw + end, "<u4"))
                if len(writer.ids) >= file_docs or writer.tokens >= file_tokens:
                    yield closed()
                    writer, part = None, part + 1
        if writer is not None:
            yield closed()

    ordered = text_of(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(put, "path string, part long, first_id long, n_docs long, n_tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, frame by frame."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                where, name = _open(path)
                with where.open_input_file(name) as source:
                    reader = FrameReader(source)
                    for at in range(0, len(reader.ids), 10_000):
                        upto = min(len(reader.ids), at + 10_000)
                        crc = [zlib.crc32(reader.document(i)) for i in range(at, upto)]
                        ids = [None if x == _NULL else x for x in reader.ids[at:upto].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reader.starts[at:upto] + base), pa.array(reader.counts[at:upto]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file: the running total over files is small.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))
    files = max(1, manifest.count())
    return based.repartition(files, "path").mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of docs to the shared folder and read every document back.

    Null or empty text: the end id alone.  Repeated rows are documents of their own, ordered by
    text.  An empty table writes no file and gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    manifest = materialize(write(docs, tokenizer, work_dir(spark, "tokens"), end_id), "manifest")
    return read(manifest)
