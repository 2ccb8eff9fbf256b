"""Token ids as binary files: bit-plane shuffling with a chunk index (operator 10).

Ids of a document go into fixed-size blocks of 32-bit integers. A block is
transposed into byte planes (or bit planes), and each plane is compressed by
zstandard: high planes are nearly constant and cost almost nothing. A file is

    magic | planes of chunk 0 | planes of chunk 1 | ... | index | footer

where the index holds, per chunk, its offset, its number of ids and the length
of each compressed plane, and per document its id and number of ids.

A range shuffle by ``doc_id`` deals the texts out; each task streams its range
into files below the shared scratch folder and returns one manifest row a file. A
repeated task writes files of new names, so that only names in the manifest count. The
folder is reached by pyarrow's filesystems (local and shared mounts, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrawl.llm.common import encoder, partitions, slices, strings
from pagetrawl.session import scratch_path, settle

MAGIC = b"PLANES01"
MANIFEST = "part int, file int, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """A block's planes, the lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    flags = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(flags[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(n)


class PlaneWriter:
    """Writes documents to one file-like sink, a block at a time."""

    def __init__(self, sink, block: int = 65536, bits: bool = False, level: int = 1):
        import zstandard

        self.sink, self.block, self.bits = sink, block, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.rest, self.held, self.at = [], 0, len(MAGIC)
        self.chunks, self.docs, self.n_ids = [], [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id is not None, doc_id or 0, n))
        self.n_ids += n
        self.rest.append(ids)
        self.held += n
        if self.held >= self.block:
            whole = np.frombuffer(b"".join(self.rest), "<u4")
            full = self.held // self.block * self.block
            for k in range(0, full, self.block):
                self._chunk(whole[k : k + self.block])
            self.rest, self.held = [whole[full:].tobytes()], self.held - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Writes index and footer; the file's length."""
        if self.held:
            self._chunk(np.frombuffer(b"".join(self.rest), "<u4"))
        width = 2 + (32 if self.bits else 4)
        index = self.pack(np.array(self.chunks, "<i8").reshape(-1, width).tobytes())
        docs = self.pack(np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        footer = struct.pack("<qqqq", len(index), len(docs), width, self.at) + MAGIC
        self.sink.write(index + docs + footer)
        return self.at + len(index) + len(docs) + len(footer)


def read_file(source):
    """Documents of one file, ``(doc_id, ids)`` in turn; holds a chunk and a document at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    end = source.seek(0, io.SEEK_END)
    source.seek(end - 32 - len(MAGIC))
    footer = source.read(32 + len(MAGIC))
    n_index, n_docs, width, at = struct.unpack("<qqqq", footer[:32])
    if footer[32:] != MAGIC:
        raise ValueError("not a file of id planes")
    source.seek(at)
    index = np.frombuffer(unpack(source.read(n_index)) if n_index else b"", "<i8").reshape(-1, width)
    docs = np.frombuffer(unpack(source.read(n_docs)), "<i8").reshape(-1, 3)

    def chunks():
        for offset, n, *lengths in index.tolist():
            source.seek(offset)
            yield from_planes([unpack(source.read(k)) for k in lengths], n)

    following, rest = chunks(), np.empty(0, "<u4")
    for known, doc_id, n in docs.tolist():
        parts, need = [], n
        while need > len(rest):
            parts.append(rest)
            need -= len(rest)
            rest = next(following)
        parts.append(rest[:need])
        rest = rest[need:]
        yield (doc_id if known else None), np.concatenate(parts)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, keeps_space: bool, end_id: int,
    block: int = 65536, bits: bool = False, file_ids: int = 1 << 24,
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into files in ascending ``doc_id`` order; the manifest, a row a file.

    Null text is empty and has the end id alone; null ids come first; rows of equal ids
    are all kept, in order of their texts. Other columns are ignored. An empty table makes no file.
    """

    def write(batches):
        from pyspark import TaskContext

        encode, end = encoder(vocabulary, keeps_space), end_id.to_bytes(4, "little")
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        part, made, writer, sink, name = TaskContext.get().partitionId(), 0, None, None, ""

        def row():
            size = writer.close()
            sink.close()
            values = [part, made, name, len(writer.docs), writer.n_ids, size]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, [pa.int32()] * 2 + [pa.string()] + [pa.int64()] * 3)],
                ["part", "file", "path", "n_docs", "n_ids", "n_bytes"],
            )

        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                if writer is None:
                    name = f"ids-{part:06d}-{made:04d}-{uuid.uuid4().hex}.planes"
                    sink = files.open_output_stream(f"{root}/{name}")
                    writer = PlaneWriter(sink, block, bits)
                writer.add(doc_id, encode(text) + end)
                if writer.n_ids >= file_ids:
                    yield row()
                    made, writer = made + 1, None
        if writer is not None:
            yield row()

    n = partitions(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return settle(dealt.mapInArrow(write, MANIFEST), "id-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, file, in one task a few files.

    ``start`` adds the ids of all earlier files, from the manifest (a row a file), to those in the file.
    """

    def read(batches):
        files, root = _file_system(folder)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(f"{root}/{path}") as source:
                    rows, at = [], first
                    for doc_id, ids in read_file(source):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), path))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield _found(rows)
                            rows = []
                    yield _found(rows)

    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first"))
    dealt = starts.repartition(partitions(manifest.sparkSession))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def _found(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def token_files(docs: DataFrame, vocabulary: str, keeps_space: bool = False, end_id: int = 2, **options) -> DataFrame:
    """Writes ``docs`` as id files below the scratch folder and reads them back, a row a document."""
    folder = scratch_path(docs.sparkSession, "id-files")
    return read_token_files(write_token_files(docs, folder, vocabulary, keeps_space, end_id, **options), folder)
