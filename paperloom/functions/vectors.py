"""Matrices from columns of vectors, and centroids of a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of float64; shorter ones are filled up with zeros, null vectors and components are zeros."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(values) == width * len(sizes):
        return np.array(values, np.float64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def widened(points: np.ndarray, width: int) -> np.ndarray:
    """The same vectors with zeros up to so many components."""
    return points if points.shape[1] >= width else np.pad(points, ((0, 0), (0, width - points.shape[1])))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return widened(a, width), widened(b, width)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest centroid, the first of equal ones, and the distance to it."""
    points, centroids = same_width(points, centroids)
    own = ((centroids**2).sum(1) - 2 * points @ centroids.T).argmin(1)
    return own, np.sqrt(((points - centroids[own]) ** 2).sum(1))


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centroids of a sample by Lloyd's rounds, from points spread evenly over it; one zero vector for an empty sample."""
    if not len(sample):
        return np.zeros((1, max(1, sample.shape[1])))
    out = np.unique(sample[np.unique(np.linspace(0, len(sample) - 1, k).astype(np.int64))], axis=0)
    for _ in range(rounds):
        own, _ = nearest(sample, out)
        sizes = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        out = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], out)
    return out
