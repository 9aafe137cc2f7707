"""64-bit signatures as Column expressions: views, bits, hex, bands and Hamming similarity."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Views of a 64-element vector: kind and number of elements kept around the centre.
VIEWS = (("full", 64), ("center90", 58), ("center80", 52), ("center70", 44), ("center60", 38))


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hex64(bits: Column) -> Column:
    """16 lower-case hex characters of an array of 64 zeros and ones, most significant first."""
    half = lambda a: F.lower(F.lpad(F.hex(F.aggregate(F.slice(bits, a, 32), F.lit(0).cast("long"), lambda s, b: s * 2 + b)), 8, "0"))
    return F.concat(half(1), half(33))


def view_hashes(x: Column, width: int) -> tuple[Column, Column]:
    """Median hash and adjacent-difference hash of the centre of an array<double> of 64 elements."""
    part = F.slice(x, (64 - width) // 2 + 1, width)
    places = F.sequence(F.lit(0), F.lit(63))

    def median_bits(s: Column) -> Column:
        sorted_ = F.array_sort(s)
        return bound((F.element_at(sorted_, width // 2) + F.element_at(sorted_, width // 2 + 1)) / 2, lambda m: F.transform(places, lambda i: (F.element_at(s, F.floor(i * width / 64).cast("int") + 1) > m).cast("long")))

    def step_bits(s: Column) -> Column:
        at = lambda i: F.floor(i * width / 64).cast("int")
        return F.transform(places, lambda i: (F.element_at(s, (at(i) + 1) % width + 1) > F.element_at(s, at(i) + 1)).cast("long"))

    return bound(part, lambda s: hex64(median_bits(s))), bound(part, lambda s: hex64(step_bits(s)))


def bands(signature: Column) -> Column:
    """Eight bands of two hex characters; an absent signature has none."""
    padded = F.lpad(signature, 16, "0")
    return F.when(signature.isNull() | (signature == ""), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(padded, 2 * i + 1, F.lit(2))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex signatures, by 32-bit halves; null if either is absent or malformed."""
    half = lambda h, at: F.conv(F.substring(F.lpad(h, 16, "0"), at, 8), 16, 10).cast("long")
    well = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(well, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))))


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - differing bits / 64); 0 if either is absent."""
    return F.coalesce(F.lit(100.0) * (F.lit(1.0) - hamming(a, b) / F.lit(64.0)), F.lit(0.0))


def planes(count: int = 64, dim: int = 64) -> np.ndarray:
    """Planes of +1 and -1 from MD5, the same in every engine: +1 where the first hex digit of md5('j:i') is below 8."""
    return np.array([[1.0 if hashlib.md5(f"{j}:{i}".encode()).hexdigest()[0] < "8" else -1.0 for i in range(dim)] for j in range(count)])


def simhash(vectors: Column, normals: np.ndarray | None = None) -> Column:
    """64-bit sign hash of a vector column, most significant bit first; Arrow batches, one matrix product each."""
    use = planes() if normals is None else normals

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=str)
        bits = np.stack(column.to_numpy()).astype(np.float64) @ use.T >= 0
        packed = np.packbits(bits, axis=1)
        return pd.Series([row.tobytes().hex() for row in packed])

    return run(vectors)


def gaussian_planes(count: int = 64, dim: int = 64, seed: int = 5601) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dim))


def projection(dim: int, to: int = 128, seed: int = 20260816) -> np.ndarray:
    """Gaussian projection to fewer dimensions, scaled by the root of the source's."""
    return np.random.default_rng(seed).standard_normal((dim, to)) / np.sqrt(dim)
