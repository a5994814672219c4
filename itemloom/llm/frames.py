"""Token files of independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds the ids of whole documents in a row, cut into frames of about ``FRAME_IDS`` ids;
a document may cross frames. Behind the frames stand two skippable frames, which plain
zstandard decoders pass over: the document table (id and number of ids of each document,
compressed) and, last, the seek table of the public seekable format (compressed size,
decompressed size and checksum of each frame, the document table's included, then the footer). Readers take the footer, then the tables,
then only the frames that hold the documents they want. Checksums are the low 32 bits of
XXH64 of a frame's raw bytes.

Files are written by the tasks into the shared folder through its own file system. A task
writes to a name no other attempt uses and returns it; only names in the committed manifest
are ever read, so lost or repeated tasks leave no trace in the result.

Defined results: a null text is an empty one and has the end id alone; documents with equal
ids are ordered by text and each is written; null ids come first; an empty table gives no
files and no rows; other columns are ignored. A bad checksum raises ``ValueError``.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, texts_of
from .common import documents, materialise, partitions, shared_folder, spread
from .ordered import bucketed, dealt
from .tokens import encoder, vocabulary_path

FRAME_IDS = 65_536
END_ID = 1
LEVEL = 3
TABLE_FRAME, SEEK_FRAME, SEEK_FOOTER = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


def file_system(path: str):
    """The file system that a path or address names, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes documents to a binary stream; ``close`` adds the tables."""

    def __init__(self, out, dtype: str = "<u4", frame_ids: int = FRAME_IDS):
        self.out, self.dtype, self.frame_ids = out, np.dtype(dtype), frame_ids
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.seek: list[bytes] = []
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        while self.size >= self.frame_ids:
            run = np.concatenate(self.held)
            self._frame(run[:self.frame_ids])
            self.held, self.size = [run[self.frame_ids:]], len(run) - self.frame_ids

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.seek.append(ENTRY.pack(len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self._frame(np.concatenate(self.held))
        table = self.zip.compress(np.array(self.docs, dtype="<i8").tobytes())
        body = struct.pack("<Q", len(self.docs)) + bytes([self.dtype.itemsize]) + table
        self.out.write(struct.pack("<II", TABLE_FRAME, len(body)) + body)
        self.seek.append(ENTRY.pack(8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        seek = b"".join(self.seek) + FOOTER.pack(len(self.seek), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(seek)) + seek)
        self.out.close()


class FrameReader:
    """Reads single documents of a file, decompressing only the frames that hold them."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - FOOTER.size)
        frames, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("no seek table")
        at = end - FOOTER.size - frames * ENTRY.size
        file.seek(at)
        entries = np.frombuffer(file.read(frames * ENTRY.size), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.sums = entries[:-1, 2]
        self.packed = np.concatenate(([0], np.cumsum(entries[:-1, 0])))
        self.raw = np.concatenate(([0], np.cumsum(entries[:-1, 1])))
        table_size = int(entries[-1, 0])
        file.seek(int(self.packed[-1]))
        magic, _ = struct.unpack("<II", file.read(8))
        if magic != TABLE_FRAME:
            raise ValueError("no document table")
        body = file.read(table_size - 8)
        count, width = struct.unpack("<Q", body[:8])[0], body[8]
        self.dtype = np.dtype(f"<u{width}")
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[9:], max_output_size=max(1, 16 * count)), dtype="<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = table[:, 0], table[:, 1]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.unzip = zstandard.ZstdDecompressor()
        self.last: tuple[int, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frame(self, k: int) -> np.ndarray:
        if self.last is None or self.last[0] != k:
            self.file.seek(int(self.packed[k]))
            raw = self.unzip.decompress(self.file.read(int(self.packed[k + 1] - self.packed[k])), max_output_size=int(self.raw[k + 1] - self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, np.frombuffer(raw, dtype=self.dtype))
        return self.last[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        width = self.dtype.itemsize
        a, b = int(self.starts[i]) * width, int(self.starts[i + 1]) * width
        if a == b:
            return np.zeros(0, self.dtype)
        first = int(np.searchsorted(self.raw, a, "right")) - 1
        parts = []
        while a < b:
            frame = self.frame(first)
            low, high = int(self.raw[first]), int(self.raw[first + 1])
            parts.append(frame[(a - low) // width:(min(b, high) - low) // width])
            a, first = high, first + 1
        return np.concatenate(parts)


def write_files(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write token files in ascending doc_id order; returns the manifest.

    Manifest columns: bucket (ascends with doc_id), path, documents, ids.
    """
    spark = df.sparkSession
    folder = (path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    file, vocab = folder, vocabulary or vocabulary_path()
    rows, _ = bucketed(documents(df, doc_id, text))

    def run(batches):
        enc = encoder(vocab)
        bucket, writer, name, count, total = None, None, None, 0, 0

        def closed():
            writer.close()
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "path": name, "documents": count, "ids": total}], schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
        store, root = file_system(file)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lengths = enc.encode(texts_of(part.column("text")))
                ends = np.cumsum(lengths)
                for k, (b, d) in enumerate(zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist())):
                    if b != bucket:
                        if writer is not None:
                            yield closed()
                        bucket, count, total = b, 0, 0
                        name = f"part-{b:06d}-{uuid.uuid4().hex}.zst"
                        writer = FrameWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_ids=frame_ids)
                    own = np.append(ids[ends[k] - lengths[k]:ends[k]], np.uint32(end_id))
                    writer.add(-1 if d is None else d, own)
                    count += 1
                    total += len(own)
        if writer is not None:
            yield closed()

    made = dealt(rows, partitions(spark), "doc_id", "text").mapInArrow(run, "bucket int, path string, documents long, ids long")
    return materialise(made).withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    order = Window.orderBy("bucket")  # one row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, name = file_system(path)
                with store.open_input_file(name) as file:
                    reader = FrameReader(file)
                    crc = np.fromiter((zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in range(len(reader))), np.int64, len(reader))
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids), pa.array(base + reader.starts[:-1]), pa.array(reader.lengths), pa.array(crc)],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread(placed.select("path", "base"), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """Ids of single documents; only the frames that hold them are decompressed."""
    want = np.array(sorted(wanted), dtype=np.int64)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = file_system(path)
                with store.open_input_file(name) as file:
                    reader = FrameReader(file)
                    for i in np.flatnonzero(np.isin(reader.doc_ids, want)):
                        yield pa.RecordBatch.from_arrays([pa.array([int(reader.doc_ids[i])]), pa.array([reader.ids(int(i)).tolist()], pa.list_(pa.int64()))], schema=schema)

    return spread(manifest.select("path"), "path").mapInArrow(run, "doc_id long, ids array<long>")
