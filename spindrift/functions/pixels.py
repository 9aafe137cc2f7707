"""Image descriptors in numpy on decoded pixel arrays, for use within pandas UDFs.

Decoders, learned models and local feature detectors are not part of this library; a row without their output has
nulls, and fusion counts a null signal as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, borders of cells weighted by their part."""

    def weights(source: int, target: int) -> np.ndarray:
        edges = np.linspace(0, source, target + 1)
        cells = np.arange(source)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * target / source

    return np.round(weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T, 6)  # a flat image stays flat


def dct2(image: np.ndarray) -> np.ndarray:
    """Orthonormal two-dimensional DCT-II."""
    n = image.shape[0]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis @ image @ basis.T


def bits_to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel().astype(np.uint8)).tobytes().hex()


def perceptual_hash(image: np.ndarray) -> str:
    """Low 8 x 8 DCT coefficients of a 32 x 32 grey image against their median without the first."""
    low = np.round(dct2(area_resize(grey(image), 32, 32))[:8, :8].ravel(), 6)
    return bits_to_hex(low > np.median(low[1:]))


def difference_hash(image: np.ndarray) -> str:
    small = area_resize(grey(image), 8, 9)
    return bits_to_hex(small[:, 1:] > small[:, :-1])


def trimmed(image: np.ndarray) -> np.ndarray:
    """Without a uniform dark, light or flat border, if what is left is large enough."""
    g = grey(image)
    edge = np.concatenate([g[0], g[-1], g[:, 0], g[:, -1]])
    level = np.median(edge)
    if not (level <= 25 or level >= 230 or edge.std() < 8):
        return image
    mask = np.abs(g - level) > 18
    if mask.mean() < 0.20:
        return image
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    box = (rows[-1] - rows[0] + 1) * (columns[-1] - columns[0] + 1)
    return image[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if box >= 0.45 * g.size else image


def centre(image: np.ndarray, share: float) -> np.ndarray:
    h, w = image.shape[:2]
    a, b = max(1, round(h * share)), max(1, round(w * share))
    return image[(h - a) // 2 : (h - a) // 2 + a, (w - b) // 2 : (w - b) // 2 + b]


def circle(image: np.ndarray) -> np.ndarray:
    """The inscribed circle, grey outside."""
    h, w = image.shape[:2]
    y, x = np.ogrid[:h, :w]
    inside = (y - (h - 1) / 2) ** 2 + (x - (w - 1) / 2) ** 2 <= (min(h, w) / 2) ** 2
    out = image.copy()
    out[~inside] = 127
    return out


def views(image: np.ndarray) -> list[tuple[str, str, str]]:
    """(kind, perceptual, difference) of seven views, repeated pairs left out after the first."""
    clear = trimmed(image)
    every = [("full", image), ("trim", clear), *((f"center{s}", centre(clear, s / 100)) for s in (90, 80, 70, 60)), ("circle", circle(clear))]
    seen, out = set(), []
    for kind, view in every:
        pair = (perceptual_hash(view), difference_hash(view))
        if pair not in seen:
            seen.add(pair)
            out.append((kind, *pair))
    return out


def information(image: np.ndarray) -> dict[str, float | bool]:
    """Entropy of 64 grey levels, edge share, deviation, focus, and the low-information and blur flags."""
    g = grey(image)
    p = np.histogram(g, 64, (0, 256))[0] / g.size
    p = p[p > 0]
    entropy = float(-(p * np.log2(p)).sum())
    dy, dx = np.gradient(g)
    edges = float((np.hypot(dx, dy) > 40).mean())
    inner = g[1:-1, 1:-1]
    focus = float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * inner).var()) if inner.size else 0.0
    spread = float(g.std())
    return {"entropy": entropy, "edges": edges, "std": spread, "lap_var": focus, "low_info": (entropy < 2.5 and edges < 0.025) or (spread < 16 and edges < 0.018), "blurry": focus < 25}


def colour_histogram(image: np.ndarray) -> np.ndarray:
    """16 hues by 8 saturations, scaled to unit length."""
    rgb = (image if image.ndim == 3 else np.repeat(image[..., None], 3, 2)).astype(np.float64)
    top, low = rgb.max(-1), rgb.min(-1)
    d = np.where(top > low, top - low, 1)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(top == r, ((g - b) / d) % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) / 6
    hue, sat = np.where(top > low, hue, 0), np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    h = np.histogram2d(hue.ravel(), sat.ravel(), (16, 8), ((0, 1), (0, 1)))[0].ravel()
    n = np.linalg.norm(h)
    return h / n if n else h


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """One window over both grey images, 0 to 100; 0 under 400 pixels."""
    x, y = grey(a).ravel(), grey(b).ravel()
    if x.size < 400 or x.size != y.size:
        return 0.0
    c1, c2 = 6.5025, 58.5225
    mx, my = x.mean(), y.mean()
    s = (2 * mx * my + c1) * (2 * ((x - mx) * (y - my)).mean() + c2) / ((mx * mx + my * my + c1) * (x.var() + y.var() + c2))
    return float(max(0.0, min(1.0, s)) * 100)


def homography_sane(matrix: np.ndarray, height: int, width: int) -> bool:
    """Well conditioned, and the frame's image is a convex quadrangle of 0.01 to 25 times its area."""
    if not np.isfinite(matrix).all() or np.linalg.cond(matrix) > 2e5:
        return False
    corners = np.array([[0, 0, 1], [width, 0, 1], [width, height, 1], [0, height, 1]], float) @ matrix.T
    if (np.abs(corners[:, 2]) < 1e-9).any():
        return False
    p = corners[:, :2] / corners[:, 2:]
    side = np.roll(p, -1, 0) - p
    turn = side[:, 0] * np.roll(side[:, 1], -1) - side[:, 1] * np.roll(side[:, 0], -1)
    area = abs((p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)).sum()) / 2
    return bool((turn > 0).all() or (turn < 0).all()) and 0.01 <= area / (width * height) <= 25


def image_views(height: Column, width: Column, data: Column) -> Column:
    """array<struct<kind, phash, dhash>> of raw grey or RGB bytes; null for data that does not fit its size."""

    @F.pandas_udf("array<struct<kind:string,phash:string,dhash:string>>")
    def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for a, b, raw in zip(h, w, d, strict=True):
            n = 0 if raw is None or a != a or b != b else len(raw)
            if n and n in (int(a) * int(b), 3 * int(a) * int(b)):
                x = np.frombuffer(raw, np.uint8).reshape(int(a), int(b), -1)
                out.append([{"kind": k, "phash": p, "dhash": q} for k, p, q in views(x[..., 0] if x.shape[2] == 1 else x)])
            else:
                out.append(None)
        return pd.Series(out)

    return run(height, width, data)
