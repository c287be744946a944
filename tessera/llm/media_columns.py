"""Media columns: Netpbm and BMP bytes as numpy arrays, area resizing, NPY tiles, difference hashes.

``decode`` reads P1 to P6 and uncompressed BMP of 8, 24 or 32 bits; ``area_resize`` averages exact areas by
an integral image; ``npy`` writes a tile; ``difference_hash`` compares neighbours of a 9 x 8 reduction.
``tiles`` does all of it over a table of media bytes; damaged media and nulls give null results.

``text_media`` stores any text losslessly as a P5 image of 64 columns: UTF-8 bytes, padded with zero
bytes to a positive multiple of 64.  Null texts count as empty.  Equal texts give equal values;
one row per input row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import arrow_map, documents

WIDTH = 64
TILE = (16, 16)

_HEADER = re.compile(rb"(P[1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" + rb"(?:\s|#[^\n]*\n)+(\d+)")
_MOST = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_pgm(gray: np.ndarray) -> bytes:
    """P5 bytes of a two-dimensional uint8 array."""
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()


def encode_bmp(gray: np.ndarray) -> bytes:
    """BMP bytes, 8 bits with a gray palette, of a two-dimensional uint8 array."""
    h, w = gray.shape
    row = -(-w // 4) * 4
    at = 54 + 1024
    head = b"BM" + (at + row * h).to_bytes(4, "little") + bytes(4) + at.to_bytes(4, "little")
    info = b"".join(v.to_bytes(n, "little") for v, n in ((40, 4), (w, 4), (h, 4), (1, 2), (8, 2), (0, 4), (row * h, 4), (2835, 4), (2835, 4), (256, 4), (0, 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    padded = np.zeros((h, row), np.uint8)
    padded[:, :w] = gray[::-1]
    return head + info + palette.tobytes() + padded.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a Netpbm header")
    kind, w, h, at, most = m[1], int(m[2]), int(m[3]), m.end(), 1
    if kind not in (b"P1", b"P4"):
        if not (m := _MOST.match(data, at)):
            raise ValueError("no largest sample value")
        most, at = int(m[1]), m.end()
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if not n or not 0 < most < 1 << 16:
        raise ValueError("no samples, or a largest value out of range")
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:n]
        v = 1 - (np.frombuffer(bits, np.uint8) - 48)
        if (v > 1).any():
            raise ValueError("a bit is neither 0 nor 1")
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * -(-w // 8), at + 1).reshape(h, -1)
        v = 1 - np.unpackbits(rows, axis=1)[:, :w].ravel()
    elif kind in (b"P2", b"P3"):
        v = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[:n], np.int64)
        if ((v < 0) | (v > most)).any():
            raise ValueError("a sample out of range")
    else:
        v = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(v) != n:
        raise ValueError("too few samples")
    if most != 255:
        v = (v.astype(np.int64) * 255 + most // 2) // most
    v = v.astype(np.uint8)
    return v.reshape(h, w, 3) if depth == 3 else v.reshape(h, w)


def _bmp(data: bytes) -> np.ndarray:
    at, size, w, h = (int.from_bytes(data[k : k + 4], "little", signed=k > 14) for k in (10, 14, 18, 22))
    bits, packed = (int.from_bytes(data[k : k + n], "little") for k, n in ((28, 2), (30, 4)))
    if bits not in (8, 24, 32) or packed not in (0, 3) or w <= 0 or not h:
        raise ValueError("BMP of a kind that isn't read")
    row = -(-w * bits // 32) * 4
    v = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bits // 8]
    v = v if h < 0 else v[::-1]
    if bits == 8:
        used = int.from_bytes(data[46:50], "little") or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        v = palette[v]
        return v[:, :, 0] if (palette == palette[:, :1]).all() else v
    return v.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """uint8 array, rows x columns or rows x columns x 3 (red, green, blue)."""
    return _bmp(data) if data[:2] == b"BM" else _netpbm(data)


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness by the usual integer weights."""
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area of each new pixel, from an integral image; float64."""
    h, w = image.shape
    whole = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

    def between(a: np.ndarray, n: int, size: int) -> np.ndarray:
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(int), size - 1)
        return a[low] + (a[low + 1] - a[low]) * (at - low)[:, None]

    cut = between(between(whole, height, h).T, width, w).T
    return np.diff(np.diff(cut, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 means is below its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, size: tuple[int, int] = TILE) -> bytes:
    return npy(np.clip(np.round(area_resize(gray(image), *size)), 0, 255).astype(np.uint8))


def tiles(media: DataFrame, id_col: str = "media_id", data_col: str = "data", size: tuple[int, int] = TILE) -> DataFrame:
    """media_id, height, width, tile (NPY bytes), dhash of a table of media bytes; write it as Parquet."""

    def run(ids, datas):
        out = ([], [], [], [])
        for data in datas:
            try:
                image = decode(data or b"")
                made = (*image.shape[:2], tile(image, size), difference_hash(gray(image)))
            except (ValueError, IndexError, ArithmeticError, MemoryError):  # whatever a damaged file may raise
                made = (None,) * 4
            for column, v in zip(out, made):
                column.append(v)
        return ids, *out

    rows = media.selectExpr(f"cast(`{id_col}` as long) as media_id", f"`{data_col}` as data")
    return arrow_map(rows, "media_id long, height int, width int, tile binary, dhash string", run, "media_id", "data")


def store(text: str | None) -> tuple[bytes, int]:
    """P5 bytes of a text, and its length in bytes without padding."""
    data = (text or "").encode()
    n = len(data)
    data += bytes(-n % WIDTH if n else WIDTH)
    return encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, WIDTH)), n


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored form of every text."""

    def run(ids, texts):
        made = [store(t) for t in texts]
        return ids, [m[1] for m in made], [m[0] for m in made]

    return arrow_map(docs, "doc_id long, n_bytes long, media binary", run, "doc_id", "text")


def digest(media: bytes) -> tuple:
    """Payload size, hash and tail checksum as read back, then size and hash of the media, feature and tile checksum."""
    image = decode(media)
    payload = image.tobytes()
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
        len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), zlib.crc32(tile(image)),
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(ids, n_bytes, medias):
        return ids, n_bytes, *map(list, zip(*map(digest, medias)))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_crc32 long"
    return arrow_map(text_media(documents(spark, sf_dir)), schema, run, "doc_id", "n_bytes", "media")
