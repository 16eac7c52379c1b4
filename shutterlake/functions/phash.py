"""The 64-bit perceptual hash of a square grey image.

Low frequencies of a discrete cosine transform, 8 x 8. As the bits are defined,
only the vertical index is normalised; products are summed row by row in single
precision; and the threshold is the middle magnitude of the 63 alternating
coefficients as a selection finds it that takes the pivot for every rank up to
one past the smaller values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8


def tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines (8, size) and vertical factors (8), in single precision."""
    u, x = np.arange(SIDE)[:, None], np.arange(size)[None, :]
    cosines = np.cos((2 * x + 1) * u * np.pi / (2 * size)).astype(np.float32)
    scale = np.sqrt(2 / size)
    norm = np.full(SIDE, scale, np.float64)
    norm[0] = scale / np.sqrt(2.0)
    return cosines, norm.astype(np.float32)


def transform(pixels: np.ndarray, size: int, consts=None) -> np.ndarray:
    """Coefficients [v, u]. A row's sums are made in double precision and stored as single."""
    cosines, norm = consts or tables(size)
    c64, n64 = cosines.astype(np.float64), norm.astype(np.float64)
    rows = np.zeros((size, SIDE))
    image = pixels.reshape(size, size).astype(np.float64)
    for x in range(size):  # in the order of the definition
        rows += image[:, x, None] * c64[None, :, x]
    rows = rows.astype(np.float32).astype(np.float64)
    out = np.zeros((SIDE, SIDE), np.float32)
    for y in range(size):
        out = (out.astype(np.float64) + n64[:, None] * rows[y][None, :] * c64[:, y, None]).astype(np.float32)
    return out


def middle(values: np.ndarray) -> float:
    """The selection of rank len // 2 described above."""
    k = len(values) // 2
    while len(values) > 1:
        at = len(values) // 2
        pivot = values[at]
        rest = np.delete(values, at)
        low, high = rest[rest < pivot], rest[rest >= pivot]
        if k < len(low):
            values = low
        elif k > len(low) + 1:
            values, k = high, k - len(low) - 1
        else:
            return float(pivot)
    return float(values[0])


def phash(pixels: bytes, size: int, consts=None) -> int:
    """The hash as a signed 64-bit integer: bit 8 * v + u for coefficient (v, u)."""
    c = transform(np.frombuffer(pixels, np.uint8), size, consts).ravel()
    bits = (c > middle(np.abs(c[1:]))).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def phash_udf(size: int):
    """Hashes of a binary column of size * size grey bytes; others give null."""

    @F.pandas_udf("bigint")
    def run(parts: pd.Series) -> pd.Series:
        consts = tables(size)
        return pd.Series([phash(bytes(p), size, consts) if p is not None and len(p) == size * size else None for p in parts], dtype="Int64")

    return run


def hamming(a: str | Column, b: str | Column, low_byte: bool = False) -> Column:
    """Bits in which two hashes differ. low_byte: 65 if they differ beyond the lowest byte."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    d = F.bit_count(a.bitwiseXOR(b))
    return F.when(F.shiftrightunsigned(a.bitwiseXOR(b), 8) != 0, F.lit(65)).otherwise(d) if low_byte else d


def image_similarity(a: str | Column, b: str | Column, low_byte: bool = False) -> Column:
    return 1 - hamming(a, b, low_byte) / F.lit(64.0)


def hamming_arrays(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two arrays of words, over the shorter's length."""
    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s + x)


def hash_hex(h: str | Column) -> Column:
    """A hash as 16 hexadecimal digits, its lowest byte first."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def hash_from_hex(text: str | Column) -> Column:
    """The hash of such digits."""
    part = lambda i: F.shiftleft(F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("bigint"), 8 * i)
    out = part(0)
    for i in range(1, 8):
        out = out.bitwiseOR(part(i))
    return out
