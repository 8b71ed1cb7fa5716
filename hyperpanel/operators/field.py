"""Repulsion through a scalar and a vector field on a grid around the embedding."""

from __future__ import annotations

import numpy as np

PIXELS, LEAST, PAD = 2.0, 5, 0.1
RADIUS, SUPPORT = 32, 6.5


def grid_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, extent, size) of the padded box and its pixels per axis."""
    low, high = y.min(0), y.max(0)
    pad = (high - low) * PAD / 2
    low, extent = low - pad, np.maximum(high - low + 2 * pad, 1e-9)
    return low, extent, np.maximum((PIXELS * extent).astype(int), LEAST)


def pixel_centres(low: np.ndarray, extent: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((np.arange(size[d]) + 0.5) / size[d] * extent[d] + low[d] for d in (0, 1))


def fields(y: np.ndarray, xs: np.ndarray, ys: np.ndarray, raster: bool = False) -> np.ndarray:
    """(3, rows, columns): sum of t, t^2 dx and t^2 dy with t = 1 / (1 + d^2); raster leaves out points beyond the kernel."""
    out = np.zeros((3, len(ys), len(xs)))
    for s in range(0, len(y), 256):
        dx, dy = xs[None, :] - y[s : s + 256, 0, None], ys[None, :] - y[s : s + 256, 1, None]
        t = 1 / (1 + dy[:, :, None] ** 2 + dx[:, None, :] ** 2)
        if raster:
            t = t * ((np.abs(dy) < SUPPORT * 2.5)[:, :, None] & (np.abs(dx) < SUPPORT * 2.5)[:, None, :])
        out[0] += t.sum(0)
        out[1] += (t * t * dx[:, None, :]).sum(0)
        out[2] += (t * t * dy[:, :, None]).sum(0)
    return out


def bilinear(values: np.ndarray, low: np.ndarray, extent: np.ndarray, y: np.ndarray) -> np.ndarray:
    """values (3, rows, columns) at the points y."""
    size = np.array(values.shape[:0:-1])
    at = np.clip((y - low) / extent * size - 0.5, 0, size - 1)
    first = np.minimum(at.astype(int), np.maximum(size - 2, 0))
    share = at - first
    x0, y0 = first[:, 0], first[:, 1]
    x1, y1 = np.minimum(x0 + 1, size[0] - 1), np.minimum(y0 + 1, size[1] - 1)
    sx, sy = share[:, 0], share[:, 1]
    return values[:, y0, x0] * (1 - sx) * (1 - sy) + values[:, y0, x1] * sx * (1 - sy) + values[:, y1, x0] * (1 - sx) * sy + values[:, y1, x1] * sx * sy


def field_repulsion(y: np.ndarray, raster: bool = False) -> tuple[np.ndarray, float]:
    """(forces, Z) of two-dimensional embeddings."""
    low, extent, size = grid_of(y)
    xs, ys = pixel_centres(low, extent, size)
    return field_forces(fields(y, xs, ys, raster), low, extent, y)


def field_forces(values: np.ndarray, low: np.ndarray, extent: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(forces, Z) by the sums of :func:`fields`."""
    s, vx, vy = bilinear(values, low, extent, y)
    return np.stack([vx, vy], axis=1), max(float(np.maximum(s - 1, 0).sum()), 1e-12)
