"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY tiles
with difference hashes.

Decoding accepts P5 and P6 (8 bit) and uncompressed 8-bit grey or 24-bit BMP. Anything else raises ValueError.
Defined results for payload images: null text is empty; an empty text is one row of 64 zero bytes; equal texts give
equal values; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

ROW = 64
TILE = 32
HASH_ROWS, HASH_COLS = 8, 9
#: Rows of an image whose integral is held at once.
BAND = 4096


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the bottom, each padded to four bytes."""
    h, w = pixels.shape
    pad = -w % 4
    body = np.pad(pixels[::-1], ((0, 0), (0, pad))).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(body), 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + body


_NETPBM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) array of bytes."""
    if m := _NETPBM.match(data):
        deep = {b"5": 1, b"6": 3}[m[1]]
        w, h, most = int(m[2]), int(m[3]), int(m[4])
        if most > 255 or len(data) - m.end() < w * h * deep:
            raise ValueError("damaged or 16-bit Netpbm")
        out = np.frombuffer(data, np.uint8, w * h * deep, m.end())
        return out.reshape((h, w) if deep == 1 else (h, w, 3))
    if data[:2] == b"BM" and len(data) >= 54:
        start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
        if packed or bits not in (8, 24):
            raise ValueError("compressed or unusual BMP")
        deep = bits // 8
        line = (w * deep + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * deep]
        rows = rows[::-1] if h > 0 else rows
        if deep == 3:
            return rows.reshape(abs(h), w, 3)[:, :, ::-1]
        palette = np.frombuffer(data, np.uint8, 1024, 14 + size).reshape(256, 4)[:, :3][:, ::-1]
        if (palette[:, 0] == np.arange(256)).all() and (palette == palette[:, :1]).all():
            return rows
        return palette[rows]
    raise ValueError("neither Netpbm nor BMP")


def _prefix(integral: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Values of a piecewise linear prefix sum (first axis) at fractional edges."""
    low = np.minimum(np.floor(edges).astype(np.int64), len(integral) - 2)
    part = (edges - low)[:, None]
    return integral[low] * (1 - part) + integral[low + 1] * part


def area_resize(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over each target cell's exact area, by an integral image that is built band after band of rows."""
    h, w = pixels.shape[:2]
    across = np.linspace(0, w, cols + 1)
    down = np.linspace(0, h, rows + 1)
    tops = np.zeros((rows + 1, cols + 1))
    above = np.zeros(w + 1)
    for y in range(0, h, BAND):
        band = pixels[y : y + BAND]
        integral = np.zeros((len(band) + 1, w + 1))
        integral[0] = above
        np.cumsum(band, axis=1, out=integral[1:, 1:])
        np.cumsum(integral, axis=0, out=integral)
        here = (down >= y) & (down <= y + len(band))
        if here.any():
            tops[here] = _prefix(_prefix(integral, down[here] - y).T.copy(), across).T
        above = integral[-1].copy()
    cells = np.diff(np.diff(tops, axis=0), axis=1)
    return cells / ((h / rows) * (w / cols))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: is a cell darker than its right neighbour, of 8 rows of 9 cells."""
    small = np.rint(area_resize(pixels, HASH_ROWS, HASH_COLS) * 256)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def media_of(text: bytes, form: str = "pgm") -> bytes:
    """The text's bytes, padded with zeros to a positive multiple of 64, as a grey image 64 wide."""
    padded = text + bytes(-len(text) % ROW or (0 if text else ROW))
    pixels = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    return encode_pgm(pixels) if form == "pgm" else encode_bmp(pixels)


_TILES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tile", pa.binary()), ("feature", pa.string())])


def media_columns(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media (stored image), tile (NPY) and feature (difference hash) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for i, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    stored = media_of(raw, form)
                    shown = grey(decode(stored))
                    out.append((i, len(raw), stored, npy_tile(shown), difference_hash(shown)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TILES, strict=True)], schema=_TILES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, tile binary, feature string")


_DIGESTS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_sha256", pa.string())]


def media_digests(media: DataFrame) -> DataFrame:
    """Decode stored media again and digest what comes back."""
    schema = pa.schema(_DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, n, stored, tile, feature in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n_bytes", "media", "tile", "feature")), strict=True):
                payload = np.ascontiguousarray(decode(stored)).tobytes()
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, hashlib.sha256(tile).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[] for _ in _DIGESTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
