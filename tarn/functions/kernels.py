"""Neighbourhood kernels on one frame, in numpy, for grouped Arrow functions.

A frame is a two-dimensional array. Neighbours are the eight around a pixel.
"""

from __future__ import annotations

import numpy as np


def _shifted(a: np.ndarray, fill: bool) -> list[np.ndarray]:
    p = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    return [p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]


def closing(a: np.ndarray) -> np.ndarray:
    """3 x 3 dilation (outside false), then 3 x 3 erosion (outside true)."""
    return np.logical_and.reduce(_shifted(np.logical_or.reduce(_shifted(a, False)), True))


def label(a: np.ndarray) -> np.ndarray:
    """Components of true pixels, numbered from 1 in reading order; 0 is background.

    Runs of each row are joined with those of the row above that they touch, by
    union-find over runs.
    """
    h, w = a.shape
    out = np.zeros((h, w), np.int64)
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.r_[0, a[y].astype(np.int8), 0]))
        row, k = [], 0
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(parent)
            parent.append(i)
            while k < len(above) and above[k][1] < s:
                k += 1
            j = k
            while j < len(above) and above[j][0] <= e:
                p, q = find(i), find(above[j][2])
                parent[max(p, q)] = min(p, q)
                j += 1
            row.append((s, e, i))
            runs.append((y, s, e, i))
        above = row
    number: dict[int, int] = {}
    for y, s, e, i in runs:
        r = find(i)
        out[y, s:e] = number.setdefault(r, len(number) + 1)
    return out


def sizes(lab: np.ndarray) -> np.ndarray:
    return np.bincount(lab.ravel())


def fill_holes(a: np.ndarray, limit: int) -> np.ndarray:
    """Components of false pixels smaller than ``limit`` become true."""
    return ~drop_small(~a, limit)


def drop_small(a: np.ndarray, limit: int) -> np.ndarray:
    """Components of true pixels smaller than ``limit`` go."""
    lab = label(a)
    keep = sizes(lab) >= limit
    keep[0] = False
    return keep[lab]


def clean(frame: np.ndarray, value: int = 1, limit: int = 50) -> np.ndarray:
    """Labelled components of a class: closed, holes filled, small ones dropped. The input stays as it is."""
    a = frame == value if value else np.zeros(frame.shape, bool)
    lab = label(fill_holes(closing(a), limit))
    # small components go and the others are numbered anew, in the same order
    keep = sizes(lab) >= limit
    keep[0] = False
    return np.where(keep, np.cumsum(keep), 0)[lab]


def touching(lab: np.ndarray, raster: np.ndarray) -> np.ndarray:
    """Pixels of the components that the raster touches."""
    hit = np.unique(lab[raster > 0])
    return np.isin(lab, hit[hit > 0])


def inside_polygon(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule for points and a ring of (x, y)."""
    inside = np.zeros(x.shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if y0 == y1:
            continue
        cross = (y0 > y) != (y1 > y)
        inside ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def rasterise(ring: np.ndarray, height: int, width: int, left: float, top: float, pixel: float, all_touched: bool = True) -> np.ndarray:
    """1 where a pixel's centre is in the ring, and with ``all_touched`` where an edge passes through it. Rows go from the top down."""
    cx, cy = left + (np.arange(width) + 0.5) * pixel, top - (np.arange(height) + 0.5) * pixel
    out = inside_polygon(*np.meshgrid(cx, cy), ring)
    if all_touched:
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            # cut the edge where it crosses grid lines; each part lies in one pixel
            u0, v0, u1, v1 = (a[0] - left) / pixel, (top - a[1]) / pixel, (b[0] - left) / pixel, (top - b[1]) / pixel
            t = [0.0, 1.0]
            for p, q in ((u0, u1), (v0, v1)):
                if p != q:
                    lines = np.arange(np.ceil(min(p, q)), np.floor(max(p, q)) + 1)
                    t += ((lines - p) / (q - p)).tolist()
            t = np.unique(np.clip(t, 0, 1))
            m = (t[1:] + t[:-1]) / 2 if len(t) > 1 else t
            i, j = np.floor(v0 + m * (v1 - v0)).astype(int), np.floor(u0 + m * (u1 - u0)).astype(int)
            ok = (i >= 0) & (i < height) & (j >= 0) & (j < width)
            out[i[ok], j[ok]] = True
    return out.astype(np.uint8)


def gaussian(a: np.ndarray, sigma: float, cut: float = 4.0) -> np.ndarray:
    """Separable Gaussian filter with mirrored edges."""
    r = int(cut * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a.astype(float), [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, p)
    return a
