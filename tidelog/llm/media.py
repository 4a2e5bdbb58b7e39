"""Media columns: Netpbm and BMP images as numpy arrays, resized tiles and difference hashes."""

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
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import extended, refuse, utf8

#: Payload bytes are laid out in rows of this many 8-bit samples.
ROW = 64
#: Height and width of a tile; hashes compare neighbours on a grid of (8, 9).
TILE = (32, 32)
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
_COMMENT = re.compile(rb"#[^\n]*(\n|$)")


def _netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: plain and raw bitmaps (0 black, 255 white), grey and colour maps, scaled to 255."""
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or len(m[1]) > 10:
            raise ValueError("Netpbm header is cut short, or a number of it is too long")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, *rest = numbers
    depth, most = (3 if kind in (3, 6) else 1), (rest[0] if rest else 1)
    if not (width * height and 0 < most < 65536):
        raise ValueError("Netpbm size or greatest value is out of range")
    count = width * height * depth
    if count > 8 * len(data):  # so no wrong header asks for more memory than its file does
        raise ValueError("Netpbm samples are cut short")
    if kind == 1:
        bits = re.sub(rb"\s", b"", _COMMENT.sub(b"", data[at:]))
        values = np.frombuffer(bits[:count], dtype=np.uint8) - 48
    elif kind in (2, 3):
        tokens = _COMMENT.sub(b"\n", data[at:]).split(None, count)[:count]
        if not all(x.isdigit() and len(x) <= 5 for x in tokens):
            raise ValueError("a Netpbm sample is no number or too long")
        values = np.array([int(x) for x in tokens], dtype=np.int64)
    else:
        body = memoryview(data)[at + 1 :]
        if kind == 4:
            stride = -(-width // 8)
            if len(body) < stride * height:
                raise ValueError("Netpbm samples are cut short")
            rows = np.frombuffer(body, dtype=np.uint8, count=stride * height).reshape(height, stride)
            values = np.unpackbits(rows, axis=1)[:, :width].ravel()
        else:
            size = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
            if len(body) < count * size.itemsize:
                raise ValueError("Netpbm samples are cut short")
            values = np.frombuffer(body, dtype=size, count=count)
    if values.size != count:
        raise ValueError("Netpbm samples are cut short")
    if most < np.iinfo(values.dtype).max and values.max() > most:
        raise ValueError("a Netpbm sample is above the greatest value")
    if kind in (1, 4):
        values = (1 - values.astype(np.uint8)) * 255
    elif most != 255:
        values = values.astype(np.int64) * 255 // most
    values = values.astype(np.uint8, copy=False)
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 1, 4, 8 (palette), 16, 24 or 32 bits, by colour masks too; grey where the palette is grey."""
    if len(data) < 54:
        raise ValueError("BMP header is cut short")
    (offset,) = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    flipped, height = height > 0, abs(height)
    if header < 40 or not (width > 0 < height) or bits not in (1, 4, 8, 16, 24, 32) or packing not in ((0, 3) if bits in (16, 32) else (0,)):
        raise ValueError("BMP form is not supported")
    stride = (width * bits + 31) // 32 * 4
    if len(data) < offset + stride * height:
        raise ValueError("BMP samples are cut short")
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=offset).reshape(height, stride)
    rows = rows[::-1] if flipped else rows
    if bits == 24 or (bits == 32 and not packing):
        step = bits // 8
        return np.ascontiguousarray(rows[:, : width * step].reshape(height, width, step)[:, :, 2::-1])
    if bits > 8:
        if packing and len(data) < 66:
            raise ValueError("BMP masks are cut short")
        masks = struct.unpack_from("<III", data, 54) if packing else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(rows[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        shifts = [(m & -m).bit_length() - 1 if m else 0 for m in masks]
        return np.stack([((pixels & m) >> s) * 255 // max(1, m >> s) for m, s in zip(masks, shifts)], axis=2).astype(np.uint8)
    if bits < 8:
        parts = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = (parts * (1 << np.arange(bits)[::-1])).sum(axis=2).astype(np.uint8)
    used = min(struct.unpack_from("<I", data, 46)[0] or 1 << bits, 1 << bits)
    if len(data) < 14 + header + 4 * used:
        raise ValueError("BMP palette is cut short")
    palette = np.frombuffer(data, dtype=np.uint8, count=4 * used, offset=14 + header).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        palette = palette[:, 0]
    full = np.zeros((1 << bits, *palette.shape[1:]), dtype=np.uint8)
    full[: len(palette)] = palette
    return full[rows[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """An 8-bit array (height, width) or (height, width, 3) of a Netpbm or BMP file; ValueError if it is none.

    What follows the samples is left unread; an index past the palette is black.
    """
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode(payload: bytes) -> bytes:
    """A payload of a positive multiple of ROW bytes as a raw grey map, ROW samples wide.

    Every fourth height becomes a BMP with a grey palette instead, every fourth plus one that
    divides by three a colour map, so that all readers are in use; the samples are the payload.
    """
    height = len(payload) // ROW
    if height % 4 == 0:
        palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
        palette[:, 3] = 0
        head = 14 + 40 + 1024
        return (
            struct.pack("<2sIHHI", b"BM", head + len(payload), 0, 0, head)
            + struct.pack("<IiiHHIIiiII", 40, ROW, -height, 1, 8, 0, len(payload), 2835, 2835, 256, 256)
            + palette.tobytes()
            + payload
        )
    if height % 4 == 1 and height % 3 == 0:
        return b"P6\n%d %d\n255\n" % (ROW, height // 3) + payload
    return b"P5\n%d %d\n255\n" % (ROW, height) + payload


#: Red, green and blue in a thousandth of grey.
LUMA = (299, 587, 114)


def box_sums(image: np.ndarray, height: int, width: int) -> tuple[np.ndarray, int]:
    """Whole numbers whose ratio to the second result are the area means of the boxes of an even grid.

    From an integral image. Boxes cover part pixels too, in units of 1 / height and 1 / width of
    a pixel, so nothing is rounded.
    """
    grey, scale = (image, 1) if image.ndim == 2 else (image.astype(np.int64) @ np.array(LUMA), sum(LUMA))
    rows, cols = grey.shape
    total = np.zeros((rows + 1, cols + 1), dtype=np.int64)
    np.cumsum(grey, axis=0, out=total[1:, 1:], dtype=np.int64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def lines(table: np.ndarray, size: int, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * size
        low = np.minimum(edge // n, size - 1)
        part = (edge - low * n)[:, None]
        return np.diff(table[low] * (n - part) + table[low + 1] * part, axis=0)

    return lines(lines(total, rows, height).T, cols, width).T, rows * cols * scale


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of the boxes of an even grid."""
    sums, whole = box_sums(image, height, width)
    return sums / whole


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: on a grid of 8 rows and 9 columns, whether each cell is darker than the next."""
    sums, _ = box_sums(image, 8, 9)
    return np.packbits(sums[:, :-1] < sums[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, size: tuple[int, int] = TILE) -> bytes:
    """The resized image, 8 bits, halves rounded up, as an NPY file."""
    sums, whole = box_sums(image, *size)
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray((2 * sums + whole) // (2 * whole), dtype=np.uint8), allow_pickle=False)
    return out.getvalue()


def to_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` of the UTF-8 text and ``media``, an image whose samples are the text.

    The text is filled with zero bytes up to a positive multiple of ROW; null counts as empty.
    ``keep`` may not name ``n_bytes`` or ``media``.
    """
    refuse(keep, "n_bytes", "media")
    kept = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = utf8(batch.column("__text"))
            images = [encode(x.ljust(max(1, -(-len(x) // ROW)) * ROW, b"\0")) for x in rows]
            sizes = pa.array([len(x) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(images, pa.binary())], [*keep, "n_bytes", "media"])

    return kept.mapInArrow(work, extended(kept.drop("__text"), n_bytes=T.LongType(), media=T.BinaryType()))


_FEATURES = [
    ("samples", pa.int64(), T.LongType()),
    ("samples_sha256", pa.string(), T.StringType()),
    ("tail_crc32", pa.int64(), T.LongType()),
    ("media_bytes", pa.int64(), T.LongType()),
    ("media_sha256", pa.string(), T.StringType()),
    ("height", pa.int32(), T.IntegerType()),
    ("width", pa.int32(), T.IntegerType()),
    ("dhash", pa.string(), T.StringType()),
    ("tile", pa.binary(), T.BinaryType()),
]


def _features(data: bytes) -> list:
    image = decode(data)
    raw = image.tobytes()
    return [
        len(raw),
        hashlib.sha256(raw).hexdigest(),
        zlib.crc32(raw[-ROW:]),
        len(data),
        hashlib.sha256(data).hexdigest(),
        image.shape[0],
        image.shape[1],
        difference_hash(image),
        tile(image),
    ]


def features(stored: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of ``stored``, and what the decoded image gives; all null where ``media`` is
    null or no Netpbm or BMP file. ``tile`` is an NPY file of TILE samples. Columns that have a feature's name are refused."""
    names = [c for c in stored.columns if c != media]
    refuse(names, *(n for n, _, _ in _FEATURES))
    kept = stored.select(*names, F.col(media).alias("__media"))

    def one(data: bytes | None) -> list:
        try:
            return _features(data) if data else [None] * len(_FEATURES)
        except ValueError:
            return [None] * len(_FEATURES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                columns = list(zip(*(one(x.as_py()) for x in part.column("__media")))) or [()] * len(_FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, kind) for c, (_, kind, _) in zip(columns, _FEATURES))],
                    [*names, *(n for n, _, _ in _FEATURES)],
                )

    return kept.mapInArrow(work, extended(kept.drop("__media"), **{n: kind for n, _, kind in _FEATURES}))
