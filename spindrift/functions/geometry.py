"""Pairwise verification of two sets of keypoints and descriptors, in numpy, for use in grouped or mapped batches.

Descriptors are data: any detector may have made them. Matches must be mutual and clearly better than the second best;
a projective map is fitted by sampling with a fixed seed; the score depends on how many matches agree with it, and on
how much of both frames they cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .pixels import homography_sane

RATIO, TOLERANCE, SAMPLES = 0.72, 3.5, 400

# Fixed values. Least inliers, ratio, smaller and larger coverage; then cap, base, points an inlier (and from how many, and
# at most), points for the ratio and for the smaller coverage.
TIERS = (
    ((18, 0.52, 0.025, 0.10), (98.8, 90.5, 0.22, 18, 6.8, 1.5, 8.0)),
    ((12, 0.45, 0.018, 0.075), (89.5, 78.0, 0.55, 0, np.inf, 4.0, 10.0)),
    ((7, 0.35, 0.01, 0.0), (83.0, 62.0, 1.4, 0, np.inf, 7.0, 10.0)),
)


@dataclass
class Match:
    score: float = 0.0
    inliers: int = 0
    ratio: float = 0.0
    mutual: int = 0
    coverage_q: float = 0.0
    coverage_c: float = 0.0
    sane: bool = False


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming for bytes, else Euclidean."""
    if a.dtype == np.uint8:
        return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(-1).astype(np.float64)
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def mutual(a: np.ndarray, b: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """Pairs (row of a, row of b) that choose each other, each clearly before its second choice."""
    if len(a) < 2 or len(b) < 2:
        return np.empty((0, 2), int)
    d = distances(a, b)

    def choice(m: np.ndarray) -> np.ndarray:
        order = np.argsort(m, axis=1, kind="stable")
        rows = np.arange(len(m))
        return np.where(m[rows, order[:, 0]] < ratio * m[rows, order[:, 1]], order[:, 0], -1)

    forth, back = choice(d), choice(d.T)
    rows = np.flatnonzero(forth >= 0)
    return np.array([(r, forth[r]) for r in rows if back[forth[r]] == r], int).reshape(-1, 2)


def _systems(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear equations for maps with a last element of 1, from sets of point pairs (..., n, 2)."""
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    o, z = np.ones_like(x), np.zeros_like(x)
    first = np.stack([x, y, o, z, z, z, -u * x, -u * y], -1)
    second = np.stack([z, z, z, x, y, o, -v * x, -v * y], -1)
    return np.concatenate([first, second], -2), np.concatenate([u, v], -1)


def _agree(maps: np.ndarray, p: np.ndarray, q: np.ndarray, tolerance: float) -> np.ndarray:
    z = np.concatenate([p, np.ones((len(p), 1))], 1) @ np.swapaxes(maps, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.hypot(*np.moveaxis(z[..., :2] / z[..., 2:] - q, -1, 0)) <= tolerance


def projective(p: np.ndarray, q: np.ndarray, tolerance: float = TOLERANCE, samples: int = SAMPLES) -> tuple[np.ndarray | None, np.ndarray]:
    """The map from p to q on which most pairs agree, all samples solved at once, and those pairs."""
    n = len(p)
    if n < 4:
        return None, np.zeros(n, bool)
    rng = np.random.default_rng(n)
    picks = np.argsort(rng.random((samples, n)), axis=1)[:, :4]
    a, b = _systems(p[picks], q[picks])
    good = np.abs(np.linalg.det(a)) > 1e-6
    if not good.any():
        return None, np.zeros(n, bool)
    maps = np.concatenate([np.linalg.solve(a[good], b[good][..., None])[..., 0], np.ones((good.sum(), 1))], 1).reshape(-1, 3, 3)
    votes = _agree(maps, p, q, tolerance)
    keep = votes[votes.sum(1).argmax()]
    a, b = _systems(p[keep], q[keep])
    fitted = np.append(np.linalg.lstsq(a, b, rcond=None)[0], 1).reshape(3, 3)
    again = _agree(fitted[None], p, q, tolerance)[0]
    return (fitted, again) if again.sum() >= keep.sum() else (maps[votes.sum(1).argmax()], keep)


def coverage(points: np.ndarray, shape: tuple[int, int]) -> float:
    """Share of the frame within the convex hull."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0

    def chain(q) -> list:
        out: list = []
        for x in q:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]):
                out.pop()
            out.append(x)
        return out[:-1]

    h = np.array(chain(p) + chain(p[::-1]))
    area = abs((h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)).sum()) / 2
    return float(area / max(1, shape[0] * shape[1]))


def score(inliers: int, ratio: float, matches: int, low: float, high: float, sane: bool) -> float:
    for (n, r, a, b), (cap, base, each, above, most, by_ratio, by_cover) in TIERS:
        if sane and inliers >= n and ratio >= r and low >= a and high >= b:
            return min(cap, base + min(most, (inliers - above) * each) + ratio * by_ratio + low * by_cover)
    return min(74.0, matches * 2.2 + ratio * 16 + low * 20)


def verify(points_q: np.ndarray, desc_q: np.ndarray, shape_q, points_c: np.ndarray, desc_c: np.ndarray, shape_c) -> Match:
    """Under 6 descriptors on a side nothing is scored; under 5 mutual matches 9 points for each, 55 at most."""
    if min(len(desc_q), len(desc_c)) < 6:
        return Match()
    pairs = mutual(desc_q, desc_c)
    if len(pairs) < 5:
        return Match(score=min(55.0, 9.0 * len(pairs)), mutual=len(pairs))
    p, q = points_q[pairs[:, 0]].astype(float), points_c[pairs[:, 1]].astype(float)
    found, keep = projective(p, q)
    if found is None:
        return Match(mutual=len(pairs))
    n = int(keep.sum())
    cq, cc = coverage(p[keep], shape_q), coverage(q[keep], shape_c)
    ratio, sane = n / len(pairs), bool(homography_sane(found, *shape_q))
    return Match(score(n, ratio, len(pairs), min(cq, cc), max(cq, cc), sane), n, ratio, len(pairs), cq, cc, sane)


def blended(geometry: float, inliers: int, ratio: float, overlap: float, ssim: float) -> float:
    """Structural similarity of the aligned overlap may lift the score."""
    return max(geometry, min(99.4, 0.72 * geometry + 0.28 * ssim)) if inliers >= 8 and ratio >= 0.35 and overlap >= 0.08 else geometry


def binary_score(a: np.ndarray, b: np.ndarray) -> float:
    """One-way ratio test at 0.75 of binary descriptors: matches over the smaller set, 160 for all, 100 at most."""
    if min(len(a), len(b)) < 5:
        return 0.0
    d = np.sort(distances(a, b), axis=1)
    return float(min(100.0, (d[:, 0] < 0.75 * d[:, 1]).sum() / max(12, min(len(a), len(b))) * 160))


_FIELDS = "query_id long, cand_id long, geometry double, inliers int, ratio double, mutual int, coverage_q double, coverage_c double, sane boolean"


def verified(pairs: DataFrame) -> DataFrame:
    """Match columns for rows (query_id, cand_id, and for sides q and c: points, descriptors as array<array<float>>, height, width).

    Also tries the query mirrored left to right where the first score is below 90. Null sides score 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                sides = [None if x is None else np.array([np.asarray(y, np.float64) for y in x]) for x in (r.points_q, r.desc_q, r.points_c, r.desc_c)]
                m = Match()
                if all(s is not None for s in sides):
                    pq, dq, pc, dc = sides
                    shapes = (int(r.height_q), int(r.width_q)), (int(r.height_c), int(r.width_c))
                    m = verify(pq, dq, shapes[0], pc, dc, shapes[1])
                    if m.score < 90 and len(pq):
                        flipped = verify(pq * [-1, 1] + [shapes[0][1], 0], dq, shapes[0], pc, dc, shapes[1])
                        m = flipped if flipped.score > m.score else m
                out.append((r.query_id, r.cand_id, m.score, m.inliers, m.ratio, m.mutual, m.coverage_q, m.coverage_c, m.sane))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _FIELDS.split(", ")])

    return pairs.mapInPandas(run, _FIELDS)
