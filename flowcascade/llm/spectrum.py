"""Eigendecomposition of a scatter matrix, kept up to date by rank-one updates.

An update by ``v`` changes ``U diag(d) U'`` to that plus ``v v'``.  In the basis ``U`` this is
a diagonal plus a rank-one matrix: its eigenvalues are the roots of a secular equation, one
between each two neighbouring poles ``d``.  Poles that the update does not move, or that
coincide, are deflated first.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
MAX_STEPS = 120


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - x))``, for ascending poles and positive weights.

    Every root lies between its pole and the next one; the last below the last pole plus
    all weights.  Returns the roots and ``poles[j] - roots[i]`` at ``[j, i]``, which is
    accurate also where a root nearly touches a pole, because each root is found as a
    distance from the closer of its two poles.
    """
    k = len(poles)
    if k == 1:
        return poles + weights, -weights.reshape(1, 1)
    each = np.arange(k)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    gaps = ends - poles
    with np.errstate(all="ignore"):
        middle = 1 + (weights[:, None] / ((poles[:, None] - poles) - gaps / 2)).sum(0)
        right = middle < 0
        right[-1] = False               # the upper end of the last interval is no pole
        origin = np.where(right, ends, poles)
        far = poles[:, None] - origin
        last = ends - origin            # the upper ends, seen from the origins
        low = np.where(right, -gaps / 2, 0.0)
        high = np.where(right, 0.0, gaps / 2)
        high[-1], low[-1] = gaps[-1] * (1 + EPS), gaps[-1] / 2 if middle[-1] < 0 else 0.0
        at = (low + high) / 2
        below = each[:, None] <= each
        for _ in range(MAX_STEPS):
            distance = far - at
            terms = weights[:, None] / distance
            f = 1 + terms.sum(0)
            done = np.abs(f) <= EPS * k * (1 + np.abs(terms).sum(0))
            low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
            done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            # a rational function with poles at both ends, fitted to value and slopes
            slopes = terms / distance
            left = np.where(below, slopes, 0).sum(0)
            slope = slopes.sum(0)
            d1, d2 = distance[each, each], last - at
            a = (d1 + d2) * f - d1 * d2 * slope
            b = d1 * d2 * f
            c = f - d1 * left - d2 * (slope - left)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            moved = at + step
            inside = (moved > low) & (moved < high)
            at = np.where(done, at, np.where(inside, moved, (low + high) / 2))
    return origin + at, far - at


def _merge_equal(poles: np.ndarray, z: np.ndarray, vectors: np.ndarray, kept: np.ndarray,
                 scale: float, tolerance: float) -> np.ndarray:
    """Turn pairs of (nearly) equal poles so that one of them is not moved by the update."""
    def small(i, j):
        r = np.hypot(z[i], z[j])
        return np.abs((poles[j] - poles[i]) * z[i] * z[j] / (r * r)) <= tolerance

    if not small(kept[:-1], kept[1:]).any():
        return kept
    still, i = [], kept[0]
    for j in kept[1:]:
        if small(i, j):
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            poles[i], poles[j] = (poles[i] * c * c + poles[j] * s * s,
                                  poles[i] * s * s + poles[j] * c * c)
            z[i], z[j] = 0.0, r
        else:
            still.append(i)
        i = j
    return np.array([*still, i])


def rank_one(values: np.ndarray, vectors: np.ndarray,
             v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors after adding ``v v'``."""
    z = vectors.T @ v
    size = float(z @ z)
    if size == 0 or not np.isfinite(size):
        return values, vectors
    z /= np.sqrt(size)
    tolerance = 8 * EPS * max(np.abs(values).max(), size)
    kept = np.flatnonzero(size * np.abs(z) > tolerance)
    if not len(kept):
        return values, vectors
    poles, vectors = values.copy(), vectors.copy()
    if len(kept) > 1:
        kept = _merge_equal(poles, z, vectors, kept, size, tolerance)
        kept = kept[np.argsort(poles[kept], kind="stable")]
    p = poles[kept]
    roots, distance = secular_roots(p, size * z[kept] ** 2)
    between = p - p[:, None]
    np.fill_diagonal(between, 1.0)
    # the weights for which these roots are exact keep the vectors orthogonal
    weights = np.sqrt(np.abs(np.prod(-distance / between, axis=1)))
    turned = np.copysign(weights, z[kept])[:, None] / distance
    turned /= np.sqrt((turned * turned).sum(0))
    poles[kept] = roots
    vectors[:, kept] = vectors[:, kept] @ turned
    order = np.argsort(poles, kind="stable")
    return poles[order], vectors[:, order]


class Spectrum:
    """Count, sums, mean and scatter spectrum of vectors; of none at first."""

    def __init__(self, width: int):
        self.n = 0
        self.sums = np.zeros(width, np.int64)
        self.mean = np.zeros(width)
        self.values = np.zeros(width)
        self.vectors = np.eye(width)

    def update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """The update for joining ``n`` vectors around another mean."""
        total = self.n + n
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n * n / total))
        self.mean = self.mean + (mean - self.mean) * (n / total)
        self.n = total

    def add_rows(self, rows: np.ndarray) -> None:
        """Centred updates by a block of whole numbers.

        More rows than columns are first turned (QR) into as many rows as columns with the
        same scatter around the block's mean, so a block costs no more updates than that.
        """
        if not len(rows):
            return
        self.sums += rows.sum(0)
        mean = rows.mean(0)
        centred = rows - mean
        if len(rows) > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for v in centred:
            self.update(v)
        self._shift(len(rows), mean)

    def add(self, other: "Spectrum") -> None:
        """One update per eigenpair of the other spectrum, and one for the means."""
        if not other.n:
            return
        for value, v in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(np.sqrt(value) * v)
        self.sums += other.sums
        self._shift(other.n, other.mean)
