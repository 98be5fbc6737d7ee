"""Token-id files that give single documents without decompressing the rest.

A file holds one zstandard frame for each document (its ids, little-endian unsigned
32-bit), a last frame with the documents' ids (64-bit, null as the least value), and
a seek table in a skippable frame at the end: each frame's compressed and plain size
and the low half of its plain bytes' XXH64. The table's layout is that of the public
seekable zstandard format, so other tools can read it. A reader takes the table from
the file's end, seeks to the frames it wants, and checks each against its checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import scratch, staged, texts
from wayfarer.llm.encoding import encoder
from wayfarer.llm.words import ragged

# Fixed values of the seekable format: skippable frame, its footer, and a flag for checksums.
_SKIPPABLE, _FOOTER, _CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_NO_ID = -(2**63)


class Writer:
    def __init__(self, out):
        self.out, self.entries, self.ids = out, [], []
        self.compressor = zstandard.ZstdCompressor(level=3)

    def _frame(self, plain: bytes) -> None:
        packed = self.compressor.compress(plain)
        self.entries.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype("<u4").tobytes())
        self.ids.append(_NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        self._frame(np.array(self.ids, "<i8").tobytes())
        size = 12 * len(self.entries) + 9
        self.out.write(struct.pack("<II", _SKIPPABLE, size) + b"".join(self.entries) + struct.pack("<IBI", len(self.entries), _CHECKSUMS, _FOOTER))


class Reader:
    """Random access to one file's documents."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != _FOOTER or flags != _CHECKSUMS:
            raise ValueError("no seek table at the file's end")
        file.seek(size - 9 - 12 * n)
        self.entries = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.start = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()
        self.doc_ids = np.frombuffer(self.frame(n - 1), "<i8")

    def frame(self, i: int) -> bytes:
        self.file.seek(int(self.start[i]))
        plain = self.decompressor.decompress(self.file.read(int(self.entries[i, 0])), max_output_size=int(self.entries[i, 1]))
        if len(plain) != self.entries[i, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return plain

    def ids(self, i: int) -> np.ndarray:
        """Ids of the file's document number i; no other one is decompressed."""
        return np.frombuffer(self.frame(i), "<u4")


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each attempt has a file of its own; only those named in the manifest count.
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid4().hex}.ids.zst"
        store, at = fs.FileSystem.from_uri(path)
        writer, tokens, code = None, 0, encoder(vocabulary, spaced=False)
        for batch in batches:
            if writer is None:
                out = store.open_output_stream(at, compression=None)
                writer = Writer(out)
            ids = iter(batch.column("doc_id").to_pylist())
            for part in code.encode(batch.column("text")):
                for x in part:
                    writer.add(next(ids), np.append(x, np.uint32(end_id)))
                    tokens += len(x) + 1
        if writer is not None:
            writer.close()
            out.close()
            row = {"shard": [TaskContext.get().partitionId()], "path": [path], "docs": [len(writer.ids)], "tokens": [tokens], "first_id": [writer.ids[0]], "last_id": [writer.ids[-1]]}
            numbers = [(c, pa.int64()) for c in ("docs", "tokens", "first_id", "last_id")]
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *numbers]))

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write all texts' ids in ascending doc_id order; returns the manifest.

    The manifest (shard, path, docs, tokens, first_id, last_id, start) has one row for
    each file, in order of ``shard``; ``start`` is the number of ids in all files
    before it.
    ``folder`` is a URI that all executors and pyarrow can write to. A lost task
    leaves a file that no manifest names.

    Null texts are empty (just the end id), null ids come first, and rows that share
    an id stand in order of their texts. No rows write no files.
    """
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    order = texts(docs).withColumn("h", F.xxhash64("text"))
    order = order.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = staged(order.mapInArrow(_write(folder, vocabulary, end_id), "shard int, path string, docs long, tokens long, first_id long, last_id long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, at = fs.FileSystem.from_uri(row["path"])
            with store.open_input_file(at) as file:
                reader, start = Reader(file, file.size()), row["start"]
                for i in range(0, len(reader.doc_ids), 4096):
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for k in range(i, min(i + 4096, len(reader.doc_ids))):
                        plain = reader.frame(k)
                        out["doc_id"].append(None if reader.doc_ids[k] == _NO_ID else int(reader.doc_ids[k]))
                        out["start"].append(start)
                        out["n_tokens"].append(len(plain) // 4)
                        out["ids_crc32"].append(zlib.crc32(plain))
                        start += len(plain) // 4
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(x, pa.int64()) for x in out]))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files themselves."""
    files = staged(manifest, "manifest")
    return files.repartition(max(1, files.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents that ``wanted.doc_id`` names; no other is decompressed.

    Each file's first and last id tell which files may hold a document, and only
    these are opened, once each. Ids that no file holds give no rows, null ones
    neither; rows that share an id are all returned. The driver holds three values a
    file.
    """
    files = manifest.select("path", "first_id", "last_id", "shard").orderBy("shard").collect()
    held = manifest.sparkSession.sparkContext.broadcast([(r["path"], r["first_id"], r["last_id"]) for r in files])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [p for p, _, _ in held.value]
        first, last = (np.array([x[k] for x in held.value], np.int64) for k in (1, 2))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            low, high = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            n = np.maximum(high - low, 0)
            at = ragged(low, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array([paths[k] for k in at], pa.string())], names=["doc_id", "path"])

    def read(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(key[0].as_py())
        ids_here = np.concatenate([b.column("doc_id").to_numpy() for b in batches])
        with store.open_input_file(at) as file:
            reader = Reader(file, file.size())
            found = np.flatnonzero(np.isin(reader.doc_ids, ids_here))
            for i in range(0, len(found), 1024):
                part = found[i : i + 1024]
                ids = pa.array([reader.ids(k).astype(np.int32) for k in part], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[part]), ids], names=["doc_id", "ids"])

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return asked.mapInArrow(place, "doc_id long, path string").groupBy("path").applyInArrow(read, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id))
