"""Vector similarity in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a: Column, b: Column) -> Column:
    """100 * cosine, held between 0 and 100; 0 where a norm is nearly 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.sqrt(dot(a, a)) < 1e-8) | (F.sqrt(dot(b, b)) < 1e-8), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * dot(a, b) / norms)))


def pearson_score(a: Column, b: Column) -> Column:
    """(r + 1) * 50 of two histograms, 0 where either is constant."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    centred = lambda x: F.transform(x, lambda v: v - mean(x))
    p, q = centred(a), centred(b)
    scale = F.sqrt(dot(p, p) * dot(q, q))
    return F.when(scale < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (dot(p, q) / scale + 1) * 50)))


def quantised(matrix: np.ndarray) -> np.ndarray:
    """Unit vectors as kept at half precision, decoded and scaled again."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix, dtype=np.float32), where=norms > 1e-8).astype(np.float16).astype(np.float32)
    again = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, again, out=unit, where=again > 1e-8)
