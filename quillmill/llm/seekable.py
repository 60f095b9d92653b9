"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, for its documents in order, one zstandard frame each with the ids as
little-endian unsigned 32-bit integers; then one frame with the directory (document id and
number of ids of each document, signed 64-bit); then the seek table in a skippable frame:
compressed size, plain size and checksum (low 32 bits of XXH64 of the plain bytes) of every
frame, and the footer (number of frames, a flag byte, magic number). A reader fetches the tail
and the directory, then only the frames of the documents it wants, and checks each.

Documents are range-partitioned by id and sorted, so file after file is in ascending order. A
task writes files of about ``file_bytes`` under names of its own attempt; only the names in the
manifest, which Spark commits once per task, count. Lost executors cost a rerun of their tasks.

Defined cases: a null or empty text is a document of the end id alone; null ids sort first and
are kept; equal ids keep all their rows, by text; an empty table gives no files and reads back
empty; other columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, scratch_path
from .arrow import runs_by_size, texts_of
from .codes import encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)
FILE_BYTES = 64 << 20

MANIFEST = "part int, number int, path string, n_docs long, n_tokens long, n_bytes long"


def filesystem(uri: str):
    """The file system of a folder that all executors share, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class FrameWriter:
    def __init__(self, stream, level: int = 1):
        import zstandard

        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int]] = []
        self.n_bytes = self.n_tokens = 0

    def frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.compressor.compress(plain)
        self.stream.write(packed)
        self.n_bytes += len(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.frame(ids.astype("<u4").tobytes())
        self.directory.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        self.n_tokens += len(ids)

    def close(self) -> None:
        self.frame(np.array(self.directory, "<i8").tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class FrameReader:
    """Random access to one file."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.entries = np.frombuffer(table, "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        pairs = np.frombuffer(self._plain(count - 1), "<i8").reshape(-1, 2)
        self.doc_ids, self.counts = pairs[:, 0], pairs[:, 1]

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def _plain(self, k: int) -> bytes:
        return self._opened(self._at(int(self.starts[k]), int(self.entries[k, 0])), k)

    def _opened(self, packed: bytes, k: int) -> bytes:
        import xxhash

        plain = self.decompressor.decompress(packed, max_output_size=int(self.entries[k, 1]))
        if len(plain) != self.entries[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; reads its frame only."""
        return np.frombuffer(self._plain(k), "<u4")

    def documents(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """All documents, read in blocks."""
        sizes = self.entries[:-1, 0].tolist()
        for a, b in runs_by_size(sizes, block):
            held = self._at(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
            for k in range(a, b):
                at = int(self.starts[k] - self.starts[a])
                yield np.frombuffer(self._opened(held[at : at + sizes[k]], k), "<u4")


def _written(folder: str, path: str, end_id: int, file_bytes: int):
    """Writes the sorted documents of a partition; one manifest row per file."""

    def run(batches):
        from pyspark import TaskContext

        part, number, writer, name = TaskContext.get().partitionId(), 0, None, ""
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)

        def row():
            writer.close()
            values = [part, number, f"{folder}/{name}", len(writer.directory), writer.n_tokens, writer.n_bytes]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
                names=["part", "number", "path", "n_docs", "n_tokens", "n_bytes"],
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in runs_by_size([len(t) for t in texts]):
                for doc_id, ids in zip(doc_ids[a:b], encoder(path).encode(texts[a:b]).each(), strict=True):
                    if writer is None:
                        name = f"ids-{part:05d}-{number:04d}-{uuid.uuid4().hex}.zst"
                        writer = FrameWriter(system.open_output_stream(f"{root}/{name}", compression=None))
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                    if writer.n_bytes >= file_bytes:
                        yield row()
                        number, writer = number + 1, None
        if writer is not None:
            yield row()

    return run


def write_ids(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
    partitions: int | None = None, folder: str | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of all texts; returns the manifest, one row per file, with ``start``: the
    ids in all files before it."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")  # splits the rows of one id among files
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie)
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    manifest = materialize(ordered.mapInArrow(_written(folder, path, end_id, file_bytes), MANIFEST), "manifest")
    # One row per file: files of a partition first, then partitions.
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = per_part.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return manifest.join(base, "part").select(*manifest.columns, (F.col("base") + before).alias("start"))


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_ids(spark: SparkSession, manifest: DataFrame, digest: bool = False) -> DataFrame:
    """All documents of the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (little-endian). With ``digest``, ``ids_crc32`` instead of ``ids``,
    so that no ids leave the reading task."""
    schema = READ.replace("ids binary", "ids_crc32 long") if digest else READ

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = filesystem(name)
                with system.open_input_file(at) as source:
                    reader = FrameReader(source)
                    starts = start + np.cumsum(reader.counts) - reader.counts
                    doc_ids = [None if d == NULL_ID else d for d in reader.doc_ids.tolist()]
                    held: list = []
                    first = size = 0
                    for k, ids in enumerate(reader.documents()):
                        held.append(zlib.crc32(ids) if digest else ids.tobytes())
                        size += 8 if digest else ids.nbytes
                        if size > 4 << 20 or k + 1 == len(doc_ids):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(doc_ids[first : k + 1], pa.int64()), pa.array(starts[first : k + 1]), pa.array(reader.counts[first : k + 1]),
                                 pa.array(held, pa.int64() if digest else pa.binary())],
                                names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                            )
                            held, first, size = [], k + 1, 0

    files = manifest.select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, schema)


def lookup(manifest_rows, doc_ids: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The ids of a few documents, decompressing their frames only."""
    for row in manifest_rows:
        system, at = filesystem(row["path"])
        with system.open_input_file(at) as source:
            reader = FrameReader(source)
            for k in np.flatnonzero(np.isin(reader.doc_ids, list(doc_ids))).tolist():
                yield int(reader.doc_ids[k]), reader.document(k)
