"""Small per-image kernels for what neighbour windows cannot express: flooding from
markers, and contrast by local histograms. Images are groups, and are what is spread."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumigrid.operators.masks import _label_image
from lumigrid.operators.pixel import IMAGE


def flood(surface: np.ndarray, markers: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Labels grown from markers over a surface, highest pixels first, within `inside`;
    ties go to the pixel that was reached first."""
    out, order, n = np.where(inside, markers, 0), [], 0
    for r, c in zip(*np.nonzero(out), strict=True):
        order.append((-surface[r, c], n, r, c))
        n += 1
    heapq.heapify(order)
    while order:
        _, _, r, c = heapq.heappop(order)
        for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= a < out.shape[0] and 0 <= b < out.shape[1] and inside[a, b] and not out[a, b]:
                out[a, b] = out[r, c]
                heapq.heappush(order, (-surface[a, b], n, a, b))
                n += 1
    return out


def grid(image: pd.DataFrame, name: str) -> np.ndarray:
    out = np.zeros((int(image.r.max()) + 1, int(image.c.max()) + 1))
    out[image.r, image.c] = image[name]
    return out


def watershed(px: DataFrame, maxima: str = "maxima", interior: str = "interior", distance: int = 2, peak: float = 0.1, inside: float = 0.1, least: int = 0, by: list[str] = IMAGE) -> DataFrame:
    """Instances of two model heads: peaks of `maxima` (the largest within `distance`, above
    `peak`) flood `interior` above `inside`; labels of fewer than `least` pixels go."""
    schema = px.select(*by, "r", "c").schema.simpleString()[7:-1] + ",label:int"

    def run(image: pd.DataFrame) -> pd.DataFrame:
        top, body = grid(image, maxima), grid(image, interior)
        high = np.pad(top, distance, constant_values=-np.inf)
        around = np.lib.stride_tricks.sliding_window_view(high, (2 * distance + 1,) * 2).max(axis=(2, 3))
        peaks = (top == around) & (top > peak)
        r, c = np.nonzero(peaks)
        markers = np.zeros(top.shape, np.int64)
        if len(r):
            markers[r, c] = _label_image(r, c, label=np.ones(len(r), np.int64))
        found = flood(top, markers, body > inside)
        size = np.bincount(found.reshape(-1))
        found[size[found] < least] = 0
        found = np.searchsorted(np.unique(np.r_[0, found.reshape(-1)]), found)
        return image[[*by, "r", "c"]].assign(label=found[image.r, image.c].astype(np.int32))

    return px.groupBy(*by).applyInPandas(run, schema)


def local_contrast(px: DataFrame, tile: int = 128, bins: int = 64, clip: float = 0.01, by: list[str] = IMAGE) -> DataFrame:
    """Contrast-limited adaptive histogram equalization to [-1, 1]: the clipped cumulative
    histogram of each tile, between tile centres bilinearly."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        x = grid(image, "v")
        low, high = x.min(), x.max()
        level = np.minimum(((x - low) / (high - low) * bins).astype(int), bins - 1) if high > low else np.zeros(x.shape, int)
        rows, cols = (max(1, -(-n // tile)) for n in x.shape)
        curve = np.zeros((rows, cols, bins))
        for i in range(rows):
            for j in range(cols):
                h = np.bincount(level[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].reshape(-1), minlength=bins).astype(float)
                most = max(1.0, clip * h.sum())
                h = np.minimum(h, most) + np.maximum(h - most, 0).sum() / bins
                curve[i, j] = h.cumsum() / h.sum()

        def between(n, size):
            at = np.clip((np.arange(size) + 0.5) / tile - 0.5, 0, n - 1)
            a = at.astype(int)
            return a, np.minimum(a + 1, n - 1), at - a

        (r0, r1, fr), (c0, c1, fc) = between(rows, x.shape[0]), between(cols, x.shape[1])
        pick = lambda r, c: curve[r[:, None], c[None, :], level]
        fr, fc = fr[:, None], fc[None, :]
        y = (1 - fr) * ((1 - fc) * pick(r0, c0) + fc * pick(r0, c1)) + fr * ((1 - fc) * pick(r1, c0) + fc * pick(r1, c1))
        return image.assign(v=2 * y[image.r, image.c] - 1)

    return px.groupBy(*by).applyInPandas(run, px.schema)
