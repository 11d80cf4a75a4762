"""The eigendecomposition of a scatter matrix, kept up to date by rank-one updates.

A scatter D = U diag(d) U' that gains v v' has the eigenvalues at which

    1 + sum_j z_j^2 / (d_j - t) = 0,    z = U' v,

one between each two neighbours of d and one above the last. ``secular_roots`` finds all of them
side by side, each as a distance from its nearest pole, so that no digits cancel. Entries with a z of
nothing, and all but one of each set of equal d, are deflated first: their eigenpairs stay. The
eigenvectors come from the z that belongs exactly to the roots found, which keeps them orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 80


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(roots, gaps) for ascending distinct d and nonzero z; gaps[j, i] = d_j - root_i.

    Between its two poles the function is replaced by one with the same value and slope that has
    these poles only, whose root is the next guess; a guess outside the bracket becomes its middle.
    """
    k, weight = len(d), z * z
    upper = np.append(d[1:], d[-1] + weight.sum())
    width = upper - d
    middle = d + width / 2
    value = 1 + (weight[:, None] / (d[:, None] - middle)).sum(0)
    left = value >= 0  # the root is nearer to its lower pole
    left[-1] = True
    origin = np.where(left, d, upper)
    from_origin = d[:, None] - origin
    below = np.where(left, 0.0, -width)  # the two poles, seen from the origin
    above = np.where(left, width, 0.0)
    low, high = np.where(left, 0.0, -width / 2), np.where(left, width / 2, 0.0)
    if value[-1] < 0:
        low[-1], high[-1] = width[-1] / 2, width[-1] * (1 + 4 * EPS)
    guess = (low + high) / 2
    is_lower = np.tri(k, dtype=bool).T  # pole j <= root i
    for _ in range(ROUNDS):
        gap = from_origin - guess
        share = weight[:, None] / gap
        slope = share / gap
        value = 1 + share.sum(0)
        done = np.abs(value) <= EPS * k * (1 + np.abs(share).sum(0))
        low, high = np.where(value < 0, guess, low), np.where(value > 0, guess, high)
        done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        lower_slope = (slope * is_lower).sum(0)
        all_slope = slope.sum(0)
        to_lower, to_upper = below - guess, above - guess
        a = (to_lower + to_upper) * value - to_lower * to_upper * all_slope
        b = to_lower * to_upper * value
        c = value - to_lower * lower_slope - to_upper * (all_slope - lower_slope)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = guess + step
        inside = (moved > low) & (moved < high)  # False for NaN
        guess = np.where(done, guess, np.where(inside, moved, (low + high) / 2))
    return origin + guess, from_origin - guess


class Spectrum:
    """Count, mean and eigendecomposition (ascending) of the scatter of the vectors seen."""

    def __init__(self, size: int):
        self.n = 0
        self.sums = [0] * size
        self.mean = np.zeros(size)
        self.values = np.zeros(size)
        self.vectors = np.eye(size)

    def _merge_equal(self, at: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
        """Rotates entries of equal eigenvalue until one of them has all of z; those left."""
        d = self.values
        kept = [at[0]]
        for j in at[1:]:
            i = kept[-1]
            size = np.hypot(z[i], z[j])
            cos, sin = z[j] / size, z[i] / size
            if (d[j] - d[i]) * cos * sin <= tolerance and (d[j] - d[i]) * -cos * sin <= tolerance:
                u_i, u_j = self.vectors[:, i].copy(), self.vectors[:, j]
                self.vectors[:, i] = cos * u_i - sin * u_j
                self.vectors[:, j] = sin * u_i + cos * u_j
                d[i], d[j] = d[i] * cos**2 + d[j] * sin**2, d[j] * cos**2 + d[i] * sin**2
                z[i], z[j] = 0.0, size
                kept[-1] = j
            else:
                kept.append(j)
        return np.array(kept)

    def gain(self, vector: np.ndarray) -> None:
        """The scatter gains vector vector'."""
        z = self.vectors.T @ vector
        size = np.linalg.norm(z)
        tolerance = 8 * EPS * max(abs(self.values[-1]), abs(self.values[0]), size * size)
        at = np.flatnonzero(np.abs(z) * size > tolerance)
        if not len(at):
            return
        d = self.values
        pair = z[at[1:]] * z[at[:-1]]
        turned = np.abs(np.diff(d[at]) * pair) <= tolerance * (z[at[1:]] ** 2 + z[at[:-1]] ** 2)
        if turned.any():
            at = self._merge_equal(at, z, tolerance)
            at = at[np.argsort(d[at], kind="stable")]
        if len(at) == 1:
            d[at] += z[at] ** 2
        else:
            roots, gaps = secular_roots(d[at], z[at])
            poles = np.abs(d[at][:, None] - d[at])
            np.fill_diagonal(poles, 1.0)
            exact = np.exp((np.log(np.abs(gaps)).sum(1) - np.log(poles).sum(1)) / 2)
            turn = np.copysign(exact, z[at])[:, None] / gaps
            turn /= np.linalg.norm(turn, axis=0)
            self.vectors[:, at] = self.vectors[:, at] @ turn
            d[at] = roots
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], self.vectors[:, order]

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """Takes in the means of n further vectors, whose own scatter is added apart."""
        total = self.n + n
        apart = mean - self.mean
        if self.n:
            self.gain(apart * np.sqrt(self.n * (n / total)))
        self.mean = self.mean + apart * (n / total)
        self.n = total

    def add(self, x: np.ndarray, copies: int = 1) -> None:
        """Takes in ``copies`` equal vectors of whole numbers: one centred rank-one update."""
        self._shift(copies, x.astype(float))
        self.sums = [s + copies * int(v) for s, v in zip(self.sums, x)]

    def absorb(self, other: Spectrum) -> None:
        """Takes in all that another spectrum has seen, one of its eigenpairs after another."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.gain(np.sqrt(value) * vector)
        self._shift(other.n, other.mean)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
