"""Image files: PNM, BMP, PNG and uncompressed TIFF decoded to pixel rows, without an imaging library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

IMAGE = "path string, width int, height int, channels int, bits int, pixels binary"


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of uint8 or uint16; a ValueError for other formats, JPEG among them."""
    for magic, reader in ((b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"P5", _pnm), (b"P6", _pnm), (b"II*\0", _tiff), (b"MM\0*", _tiff)):
        if data.startswith(magic):
            try:
                return reader(data)
            except (struct.error, IndexError, KeyError, zlib.error) as e:
                raise ValueError(f"a damaged image: {e}") from e
    raise ValueError("neither PNM, BMP, PNG nor TIFF")


def _grid(raw: bytes, h: int, w: int, c: int, kind: str) -> np.ndarray:
    need = h * w * c * np.dtype(kind).itemsize
    if min(h, w, c) < 1 or len(raw) < need:
        raise ValueError(f"{len(raw)} bytes for an image of {need}")
    return np.frombuffer(raw[:need], kind).reshape(h, w, c).astype(np.dtype(kind).newbyteorder("="))


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end] not in b" \t\r\n":
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    return _grid(data[at + 1 :], h, w, 3 if data[1:2] == b"6" else 1, "u1" if top < 256 else ">u2")


def _bmp(data: bytes) -> np.ndarray:
    start, (w, h), (depth, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18), struct.unpack_from("<HI", data, 28)
    if depth not in (24, 32) or packed not in (0, 3):
        raise ValueError(f"a BMP of {depth} bits, compression {packed}")
    n = depth // 8
    pitch = (w * n + 3) // 4 * 4
    rows = _grid(data[start:], abs(h), pitch, 1, "u1")[:, : w * n, 0].reshape(abs(h), w, n)[..., 2::-1]
    return rows if h < 0 else rows[::-1]


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, "u1").reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or interlaced:
        raise ValueError("interlaced or packed PNG pixels")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = c * depth // 8
    lines = _grid(zlib.decompress(packed), h, w * step + 1, 1, "u1")[..., 0]
    out = np.zeros((h + 1, (w + 1) * step), np.int32)  # a pixel and a row of zeros before the image
    for y, line in enumerate(lines, 1):
        out[y, step:] = _unfiltered(int(line[0]), line[1:].astype(np.int32), out[y - 1], step)
    x = _grid(out[1:, step:].astype(np.uint8).tobytes(), h, w, c, "u1" if depth == 8 else ">u2")
    if colour == 3:
        return palette[x[..., 0]]
    return x[..., :3] if c == 4 else x[..., :1] if c == 2 else x  # alpha goes


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above[step:]) & 255
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
    if kind not in (3, 4):
        raise ValueError(f"PNG filter {kind}")
    row, up = [0] * step + line.tolist(), above.tolist()
    for i in range(step, len(row)):
        a, b, c = row[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        row[i] = (row[i] + guess) & 255
    return np.array(row[step:], np.int32)


def _tiff(data: bytes) -> np.ndarray:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(e + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        form = {1: "B", 3: "H", 4: "I"}.get(kind)
        if form:
            size = struct.calcsize(form) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{e}{n}{form}", data, where)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("a compressed TIFF")
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
    return _grid(raw, tags[257][0], tags[256][0], tags.get(277, (1,))[0], "u1" if tags.get(258, (8,))[0] == 8 else e + "u2")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images, 16-bit samples little-endian; a file that can't be decoded fails the query."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1)):
                try:
                    x = decode(content.as_py())
                except ValueError as e:
                    raise ValueError(f"{where}: {e}") from e
                kind = "<u2" if x.itemsize == 2 else "u1"
                row = [[where.as_py()], *([n] for n in (x.shape[1], x.shape[0], x.shape[2], 8 * x.itemsize)), [x.astype(kind).tobytes()]]
                kinds = [pa.string(), *[pa.int32()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["path", "width", "height", "channels", "bits", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, IMAGE)
