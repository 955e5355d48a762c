"""Media columns: Netpbm and BMP images decoded to arrays, resized by area, and
written as NPY tiles with difference hashes.

Decoding covers P1 to P6 (8 and 16 bit samples, comments) and uncompressed BMP of
1, 4, 8, 24 and 32 bits in either row order, those of 32 bits also with colour masks. Resizing averages the exact area that
each output pixel covers: the integral image of a picture is linear within a
pixel, so its value at fractional edges is an interpolation, and a resize is two
small gathers and differences whatever the factor.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.names import fresh

TILE = 32
_SPACE = b" \t\r\n\v\f"


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1:2], 2, []
    while len(fields) < (2 if kind in b"14" else 3):
        while at < len(data) and (data[at] in _SPACE or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[start:at]))
    width, height = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in b"36" else 1
    if width < 1 or height < 1 or not 1 <= top <= 65535:
        raise ValueError("bad Netpbm size")
    n = width * height * channels
    body = data[at + 1 :]
    if kind == b"4":
        stride = -(-width // 8)
        if len(body) < stride * height:
            raise ValueError("Netpbm data end early")
        bits = np.unpackbits(np.frombuffer(body, np.uint8, stride * height).reshape(height, stride), axis=1)[:, :width]
        return ((1 - bits) * np.uint8(255))[:, :, None]
    if kind == b"1":
        digits = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:n]
        values, top = 49 - digits.astype(np.int64), 1
    elif kind in b"23":
        values = np.array(body.split()[:n], np.int64)
    else:
        sample = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(body) < n * sample.itemsize:
            raise ValueError("Netpbm data end early")
        values = np.frombuffer(body, sample, n)
        if top == 255:
            return values.reshape(height, width, channels)
    if len(values) < n:
        raise ValueError("Netpbm data end early")
    return ((values.astype(np.int64) * 255 + top // 2) // top).clip(0, 255).astype(np.uint8).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("bad BMP header")
    offset, head, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width < 1 or height == 0 or (packed == 3 and depth != 32):
        raise ValueError("BMP of an unsupported kind")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(data) < offset + rows * stride:
        raise ValueError("BMP data end early")
    raw = np.frombuffer(data, np.uint8, rows * stride, offset).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if packed == 3:
        masks = struct.unpack_from("<III", data, 54)
        if offset < 66 or 0 in masks:
            raise ValueError("bad BMP colour masks")
        values = np.ascontiguousarray(raw[:, : width * 4]).view("<u4").astype(np.int64)
        out = np.empty((rows, width, 3), np.uint8)
        for k, mask in enumerate(masks):
            shift = (mask & -mask).bit_length() - 1
            top = mask >> shift
            out[:, :, k] = (((values & mask) >> shift) * 255 + top // 2) // top
        return out
    if depth >= 24:
        return raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.zeros((1 << depth, 3), np.uint8)
    listed = np.frombuffer(data, np.uint8, min(colours, 1 << depth) * 4, 14 + head).reshape(-1, 4)
    palette[: len(listed)] = listed[:, 2::-1]
    if depth == 8:
        index = raw[:, :width]
    else:
        bits = np.unpackbits(raw, axis=1)
        index = (bits if depth == 1 else bits.reshape(rows, -1, 4) @ np.array([8, 4, 2, 1], np.uint8))[:, :width]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of uint8, channels 1 or 3; ValueError for anything else."""
    if data[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode(image: np.ndarray, kind: str) -> bytes:
    """The inverse of ``decode`` for P5, P6, BMP8 (grey palette) and BMP24."""
    height, width = image.shape[:2]
    if kind in ("P5", "P6"):
        return f"{kind}\n{width} {height}\n255\n".encode() + np.ascontiguousarray(image).tobytes()
    depth = 8 if kind == "BMP8" else 24
    stride = (width * depth + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * depth // 8] = image.reshape(height, width) if depth == 8 else image[:, :, ::-1].reshape(height, -1)
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256)) if depth == 8 else b""
    offset = 54 + len(palette)
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", offset + rows.size, 0, offset, 40, width, height, 1, depth, 0, rows.size, 2835, 2835, 0, 0)
    return head + palette + rows[::-1].tobytes()


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (size / parts)
    low = np.minimum(at.astype(int), size - 1)
    return low, at - low


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of each output pixel, as float64 (height, width, channels)."""
    h, w, c = image.shape
    # 64-bit sums are exact for any picture that fits in memory
    integral = np.zeros((h + 1, w + 1, c), np.int64)
    np.cumsum(image, axis=0, dtype=np.int64, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
    low, part = _edges(h, height)
    rows = integral[low] + part[:, None, None] * (integral[low + 1] - integral[low])
    low, part = _edges(w, width)
    cells = rows[:, low] + part[None, :, None] * (rows[:, low + 1] - rows[:, low])
    return np.diff(np.diff(cells, axis=0), axis=1) / ((h / height) * (w / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0] if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour (signed)."""
    cells = np.rint(grey(resize(image, 8, 9)) * 1024)
    return int(np.packbits(cells[:, :-1] < cells[:, 1:]).view(">i8")[0])


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, array, (1, 0), allow_pickle=False)
    return out.getvalue()


_COLUMNS = "width int, height int, channels int, tile binary, dhash bigint, error string"


def tiles(df: DataFrame, id_col: str, media: Column, tile: int = TILE) -> DataFrame:
    """(id, width, height, channels, tile binary, dhash bigint, error string): for
    each row its image's size, an NPY file of (tile, tile, channels) uint8, and the
    hash. Null media give nulls; media that can't be decoded give nulls and the
    reason in ``error``. Images of any size count whole; repeated rows are treated
    each; an empty table gives an empty result; other columns are ignored. ``id`` has
    the name and type of ``id_col`` and may be null."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            image = decode(data)
            small = np.rint(resize(image, tile, tile)).astype(np.uint8)
            return image.shape[1], image.shape[0], image.shape[2], npy(small), difference_hash(image), None
        except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as why:
            return None, None, None, None, None, str(why)[:200] or type(why).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(one(x.as_py()) for x in batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], [batch.schema.names[0], *_NAMES])

    narrow = df.select(F.col(id_col), media.alias(fresh([id_col], "media")[0]))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, {_COLUMNS}")


_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def picture_of(text: str | None, number: int | None, width: int = 64) -> bytes | None:
    """A text's UTF-8 bytes as the pixels of an image, zeros after the last; the
    number chooses one of four formats. Null and empty texts have none."""
    if not text:
        return None
    kind = ("P5", "P6", "BMP8", "BMP24")[(number or 0) % 4]
    channels = 3 if kind in ("P6", "BMP24") else 1
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    height = -(-len(raw) // (width * channels))
    image = np.zeros(height * width * channels, np.uint8)
    image[: len(raw)] = raw
    return encode(image.reshape(height, width, channels), kind)


def pictures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): every document's whole text as an image, of any length. A
    null or empty text has null media; a null id is kept, and ids may be of any type.
    Repeated rows have an image each; an empty table gives an empty result; other
    columns are ignored."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([picture_of(t if isinstance(t, str) else None, None if pd.isna(n) else int(n)) for t, n in zip(texts, numbers)], dtype=object)

    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    number = F.col(id_col).cast("bigint") if whole else F.xxhash64(id_col)
    return docs.select(F.col(id_col).alias("doc_id"), made(F.col(text_col).cast("string"), number).alias("media"))
