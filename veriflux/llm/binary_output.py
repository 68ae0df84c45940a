"""Token ids in binary files: fixed-size blocks, cut into byte or bit planes, each compressed.

A file (``.vbp``) has

* 8 bytes ``VFBPLN01``;
* for each block of ``block`` ids (the last may have fewer) its planes one after another,
  each a zstandard frame: plane k of kind "byte" has byte k of every id, of kind "bit" bit
  k of every id, packed eight to a byte;
* the directory, a zstandard frame of JSON: kind of planes, the chunk index (for each
  block its offset, number of ids and compressed length of each plane) and where the
  document table lies;
* the directory's offset and length, two little-endian unsigned 64-bit integers, and the
  8 bytes again.

The document table has for each document, in order, its id (64-bit signed), whether it has
one, and its number of token ids (64-bit). Files hold ascending ranges of ``doc_id``, and
so do their names. A task writes a file under a name of its own and then renames it, so a
task that runs twice leaves one whole file.

Defined cases: a null or empty text is a document of one id (the end id); documents with a
null ``doc_id`` come first; rows that repeat an id follow each other in order of their
text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import filesystem, fresh_folder, local_rows, small_batches

MAGIC, BLOCK = b"VFBPLN01", 1 << 16
MANIFEST = "part int, uri string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file to a binary stream, holding one block of ids at a time."""

    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = 3):
        import zstandard

        if kind not in ("byte", "bit"):
            raise ValueError(f"planes are 'byte' or 'bit', not {kind!r}")
        self.out, self.block, self.kind = out, block, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.chunks, self.doc_ids, self.has_id, self.lengths = [], [], [], []
        self.waiting, self.n_waiting, self.n_ids, self.at = [], 0, 0, 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.has_id.append(doc_id is not None)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            part = ids[i : min(i + self.block, whole)]
            offset = self.at
            self.chunks.append([offset, len(part), [self._write(self.zstd.compress(p)) for p in to_planes(part, self.kind)]])
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._blocks(last=True)
        where = self.at
        parts = [np.array(self.doc_ids, "<i8"), np.array(self.has_id, np.uint8), np.array(self.lengths, "<i8")]
        sizes = [self._write(self.zstd.compress(x.tobytes())) for x in parts]
        directory = {"planes": self.kind, "chunks": self.chunks, "documents": {"offset": where, "sizes": sizes, "n": len(self.lengths)}}
        offset = self.at
        size = self._write(self.zstd.compress(json.dumps(directory).encode()))
        self._write(struct.pack("<QQ", offset, size) + MAGIC)


class PlaneReader:
    """Reads a file through its directory: ``chunk(k)``, or ``documents()`` in order."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdDecompressor()
        tail = self._read(size - 24, 24)
        if tail[16:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a whole plane file")
        offset, length = struct.unpack("<QQ", tail[:16])
        self.directory = json.loads(self.zstd.decompress(self._read(offset, length)))

    def _read(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        data = self.stream.read(length)
        if len(data) != length:
            raise ValueError("plane file ends early")
        return data

    def chunk(self, k: int) -> np.ndarray:
        offset, n, sizes = self.directory["chunks"][k]
        data, planes, at = self._read(offset, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.zstd.decompress(data[at : at + s]))
            at += s
        return from_planes(planes, n, self.directory["planes"])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        where = self.directory["documents"]
        parts, at = [], where["offset"]
        for s in where["sizes"]:
            parts.append(self.zstd.decompress(self._read(at, s)))
            at += s
        doc_ids, has_id, lengths = (np.frombuffer(p, t).tolist() for p, t in zip(parts, ("<i8", np.uint8, "<i8")))
        held, k = bytearray(), 0
        for doc_id, has, n in zip(doc_ids, has_id, lengths):
            while len(held) < 4 * n:
                held += self.chunk(k).tobytes()
                k += 1
            yield (doc_id if has else None), bytes(held[: 4 * n])
            del held[: 4 * n]


def write_ids(docs: DataFrame, folder: str | None = None, *, end_id: int = 1, tokenizer_path: str | None = None, block: int = BLOCK, planes: str = "byte") -> list:
    """Tokenise all documents and write them in ascending ``doc_id``; a row of ``MANIFEST`` for each file, in order."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "token-ids")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        fs, path = filesystem(folder)
        final, own = f"{path}/part-{part:06d}.vbp", f"{path}/.writing-{part:06d}-{uuid.uuid4().hex}"
        encode = tokens.encoder(tokenizer_path).encode
        for batch in batches:
            if writer is None:
                stream = fs.open_output_stream(own)
                writer = PlaneWriter(stream, block, planes)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                writer.add(doc_id, ids + end)
        if writer is not None and writer.lengths:
            writer.close()
            stream.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [f"{folder}/part-{part:06d}.vbp"], "n_docs": pa.array([len(writer.lengths)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the text's hash deals out rows that share one id, too
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return sorted(ranged.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.part)


def read_ids(spark: SparkSession, manifest: list) -> DataFrame:
    """The documents of the files, with the number of ids of all documents before each: ``ROWS``."""
    rows, before = [], 0
    for r in manifest:
        rows.append((r.uri, before))
        before += r.n_ids
    if not rows:
        return spark.createDataFrame([], ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as stream:
                    out, held = [], 0
                    for doc_id, ids in PlaneReader(stream, stream.size()).documents():
                        out.append((doc_id, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 4_000_000:
                            yield _rows(out)
                            out, held = [], 0
                    yield _rows(out)

    return local_rows(spark, rows, "uri string, start long").mapInArrow(run, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])
