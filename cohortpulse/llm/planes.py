"""Token ids in a binary format: blocks of ids as bit or byte planes, each compressed.

A file holds, after a magic word, the planes of one block after the other and then
a chunk index: for each block its number of ids and the sizes of its planes, and at
the very end the place of that index. An id is four bytes, little-endian, so a block
has 4 byte planes or 32 bit planes; planes of high bytes are almost all zero and
shrink to nothing. Any block can be read alone.

``write_ids`` sorts by ``doc_id`` in ranges and writes one file per range. A task's
file gets a name of its own, and only names that Spark committed with the task's
rows are ever read, so lost or repeated tasks leave nothing behind but an unread
file. Repeated ids keep all their rows, ordered by text; null ids come first. Null
text is empty and has the document end alone. An empty table gives no file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortpulse.llm.common import batches, map_rows, new_folder, numbered, rows_of, stored, table
from cohortpulse.llm.tokens import END, document_ids, vocabulary_path

MAGIC = b"IDPLANE1"
#: Ids in a block, and the zstandard level.
BLOCK = 1 << 16
LEVEL = 3

_DOCS = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64())])
_DOCS_DDL = "doc_id long, file string, part int, at long, n_tokens long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte or bit planes of unsigned 32-bit ids."""
    by_byte = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(by_byte[:, k]).tobytes() for k in range(4)]
    if kind == "bit":
        return [np.packbits(by_byte[:, k] >> b & 1).tobytes() for k in range(4) for b in range(8)]
    raise ValueError(f"planes are of bytes or bits, not {kind!r}")


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Ids from 4 byte planes or 32 bit planes."""
    out = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k, plane in enumerate(planes):
            out[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return out.view("<u4").ravel()


class Writer:
    """Ids in, blocks out; ``finish`` writes the chunk index."""

    def __init__(self, stream, block: int = BLOCK, kind: str = "byte"):
        self.stream, self.block, self.kind = stream, block, kind
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.index: list[tuple[int, list[int]]] = []
        self.at = stream.write(MAGIC) or len(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            everything = np.concatenate(self.waiting)
            whole = self.held // self.block * self.block
            for start in range(0, whole, self.block):
                self._put(everything[start : start + self.block])
            self.waiting, self.held = [everything[whole:]], self.held - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        for plane in planes:
            self.stream.write(plane)
        self.index.append((len(ids), [len(p) for p in planes]))
        self.at += sum(map(len, planes))

    def finish(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        n_planes = 4 if self.kind == "byte" else 32
        for n, sizes in self.index:
            self.stream.write(struct.pack(f"<I{n_planes}I", n, *sizes))
        self.stream.write(struct.pack("<QII", self.at, len(self.index), n_planes) + MAGIC)


class Reader:
    """Random access to the ids of one file, a block at a time."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 24)
        end = stream.read(24)
        if end[16:] != MAGIC:
            raise ValueError("no chunk index at the end of the file")
        at, chunks, n_planes = struct.unpack("<QII", end[:16])
        stream.seek(at)
        rows = struct.iter_unpack(f"<I{n_planes}I", stream.read(chunks * 4 * (1 + n_planes)))
        self.counts, self.sizes = [], []
        for n, *sizes in rows:
            self.counts.append(n)
            self.sizes.append(sizes)
        self.starts = np.cumsum([0, *self.counts])
        self.places = np.cumsum([len(MAGIC), *(sum(s) for s in self.sizes)])
        self.unzip = zstandard.ZstdDecompressor()
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.stream.seek(int(self.places[k]))
            data, at, planes = self.stream.read(sum(self.sizes[k])), 0, []
            for size in self.sizes[k]:
                planes.append(self.unzip.decompress(data[at : at + size]))
                at += size
            self.last = k, from_planes(planes, self.counts[k])
        return self.last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from number ``start`` of the file on."""
        if start < 0 or start + n > self.starts[-1]:
            raise IndexError(f"ids {start} to {start + n} of {self.starts[-1]}")
        k, parts = int(np.searchsorted(self.starts, start, side="right")) - 1, []
        while n > 0:
            got = self.chunk(k)[start - self.starts[k] :][:n]
            parts.append(got)
            start, n, k = start + len(got), n - len(got), k + 1
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and path of a folder, given as a URI or a local path."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    end: int | None = END, block: int = BLOCK, kind: str = "byte",
) -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` order under ``folder``.

    Returns the stored index of documents: ``doc_id, file, part, at`` (place in the
    file) and ``n_tokens``; files in the order of ``part`` hold the corpus in order.
    """
    if kind not in ("byte", "bit"):
        raise ValueError(f"planes are of bytes or bits, not {kind!r}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            writer, sink, at = None, None, 0
            for doc_id, text in rows_of(stream):
                if writer is None:
                    store, base = opened(folder)
                    store.create_dir(base, recursive=True)
                    name = f"ids-{part:06d}-{uuid.uuid4().hex}.planes"
                    sink = store.open_output_stream(f"{base}/{name}")
                    writer = Writer(sink, block, kind)
                ids = document_ids(vocabulary, text, end)
                writer.add(ids)
                yield doc_id, name, part, at, len(ids)
                at += len(ids)
            if writer is not None:
                writer.finish()
                sink.close()

        yield from batches(_DOCS, rows())

    ordered = numbered(docs, id_col, text_col).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, _DOCS_DDL), "ids-index")


def starts(index: DataFrame) -> DataFrame:
    """Ids before each part: a running sum over one row per file."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Ids of each indexed document, read from the files and digested:
    ``doc_id, part, at, n_tokens, ids_crc32``."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        store, base = opened(folder)
        name, reader = None, None
        for doc_id, file, part, at, n in rows:
            if file != name:
                source = store.open_input_file(f"{base}/{file}")
                name, reader = file, Reader(source, source.size())
            ids = reader.ids(at, n)
            yield doc_id, part, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return map_rows(index.select("doc_id", "file", "part", "at", "n_tokens"), run, schema, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")


def op5_plane_ids(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "planes")
    index = write_ids(table(spark, folder, "documents"), out, vocabulary_path())
    read = read_documents(index, out)
    return read.join(starts(index), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def planes_of(ids: np.ndarray, kind: str = "byte", block: int = BLOCK) -> bytes:
    """A whole file in memory; for small sets of ids and for tests."""
    out = io.BytesIO()
    writer = Writer(out, block, kind)
    writer.add(ids)
    writer.finish()
    return out.getvalue()
