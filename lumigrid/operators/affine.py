"""Affine augmentation of block images: one map for an image, its masks and its other
channels, drawn by any key. With a movie as the key all its frames move alike; with movie
and frame each moves by itself. An image is one row, so nothing is shuffled or joined:
each place of the result looks up what it shows in its own row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.operators.tables import draw, key_of

__all__ = ["FILLS", "MAP", "apply", "channel_shift", "drawn", "key_of", "uniform", "warp"]

#: How an image goes on beyond its border: abcd is followed by ...
FILLS = ("constant", "nearest", "reflect", "wrap")  # kkkk, dddd, dcba, abcd
MAP = ("m_rr", "m_rc", "m_cr", "m_cc", "m_r", "m_c")


def uniform(key: Column, seed: int, low: float, high: float) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * draw(key, seed) / 2147483647


def drawn(
    blocks: DataFrame, key: Column, seed: int, rotation: float = 0.0, height_shift: float = 0.0, width_shift: float = 0.0,
    shear: float = 0.0, zoom: float | tuple[float, float] = 0.0, flip_rows: bool = False, flip_cols: bool = False,
) -> DataFrame:
    """`blocks` (h, w) with the map of each row. A place (r, c) of the result, from the
    middle of the image, shows what is at m_rr r + m_rc c + m_r, m_cr r + m_cc c + m_c:
    turned by up to `rotation` degrees, shifted (below 1: by a share of the side, else
    pixels), sheared by up to `shear` degrees, and each axis scaled by its own draw of
    zoom (a number z: 1 - z to 1 + z). Flips mirror the result, each at even odds."""
    low, high = zoom if isinstance(zoom, tuple) else (1 - zoom, 1 + zoom)
    size = {n: F.col(n) if 0 < shift < 1 else F.lit(1) for n, shift in (("h", height_shift), ("w", width_shift))}
    turn = uniform(key, seed, -rotation, rotation) * (math.pi / 180)
    slant = uniform(key, seed + 1, -shear, shear) * (math.pi / 180)
    down = uniform(key, seed + 2, -height_shift, height_shift) * size["h"]
    right = uniform(key, seed + 3, -width_shift, width_shift) * size["w"]
    zr, zc = uniform(key, seed + 4, low, high), uniform(key, seed + 5, low, high)
    fr, fc = (F.when((draw(key, seed + s) % 2 == 1) & F.lit(on), -1.0).otherwise(1.0) for s, on in ((6, flip_rows), (7, flip_cols)))
    values = (
        F.cos(turn) * zr * fr, -F.sin(turn + slant) * zc * fc, F.sin(turn) * zr * fr, F.cos(turn + slant) * zc * fc,
        F.cos(turn) * down - F.sin(turn) * right, F.sin(turn) * down + F.cos(turn) * right,
    )
    return blocks.withColumns(dict(zip(MAP, values)))


def _inside(at: np.ndarray, n: int, fill: str) -> np.ndarray:
    """The pixel of a line of n that stands at a whole number, inside or beyond it."""
    if fill == "reflect":
        at = np.mod(at, 2 * n)
        return np.where(at < n, at, 2 * n - 1 - at)
    return np.mod(at, n) if fill == "wrap" else np.clip(at, 0, n - 1)


def warp(px: np.ndarray, maps: np.ndarray, h: int, w: int, order: int, fill: str = "nearest", cval: float = 0.0) -> np.ndarray:
    """Images (n, h * w) seen through their maps (n, 6); the nearest pixel (order 0) or the
    weighted four around (order 1). "constant" gives `cval` for any place beyond the
    outermost pixels' centres."""
    r, c = np.divmod(np.arange(h * w), w)
    r, c = r - (h - 1) / 2, c - (w - 1) / 2
    m = maps[:, :, None]
    sr, sc = m[:, 0] * r + m[:, 1] * c + m[:, 4] + (h - 1) / 2, m[:, 2] * r + m[:, 3] * c + m[:, 5] + (w - 1) / 2
    rows = np.arange(len(px))[:, None]
    look = lambda a, b: px[rows, _inside(a, h, fill) * w + _inside(b, w, fill)]
    if order == 0:
        out = look(np.floor(sr + 0.5).astype(np.int64), np.floor(sc + 0.5).astype(np.int64))
    else:
        a, b = np.floor(sr).astype(np.int64), np.floor(sc).astype(np.int64)
        u, v = sr - a, sc - b
        out = (look(a, b) * (1 - v) + look(a, b + 1) * v) * (1 - u) + (look(a + 1, b) * (1 - v) + look(a + 1, b + 1) * v) * u
    if fill == "constant":
        out = np.where((sr < 0) | (sr > h - 1) | (sc < 0) | (sc > w - 1), px.dtype.type(cval), out)
    return out


#: Values of images that are looked up at once.
AT_ONCE = 1 << 20


def apply(blocks: DataFrame, orders: dict[str, int], fill: str = "nearest", cval: float = 0.0) -> DataFrame:
    """`blocks` (from drawn()) with the arrays named in `orders` seen through the row's map,
    0 for masks and 1 for intensities; the map's columns are dropped. A null array stays
    null; other columns stay. Images of any sizes can be mixed; an image is row-major and
    has h * w values."""
    if fill not in FILLS:
        raise ValueError(f"fill is one of {', '.join(FILLS)}")
    kept = [c for c in blocks.columns if c not in MAP]
    for name, order in orders.items():
        if order not in (0, 1):
            raise ValueError("an order is 0 or 1")
    source = blocks.withColumns({n: F.col(n).cast("array<double>") for n, o in orders.items() if o == 1})

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            h, w = (batch.column(names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "w"))
            maps = np.stack([batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in MAP], 1)
            out = {n: batch.column(names.index(n)) for n in kept}
            for name, order in orders.items():
                column = out[name]
                valid = np.asarray(column.is_valid())
                first = np.r_[0, np.cumsum(np.where(valid, h * w, 0))]
                flat = column.flatten().to_numpy(zero_copy_only=False)
                if len(flat) != first[-1]:
                    raise ValueError(f"{name} has {len(flat)} values where {first[-1]} pixels are")
                made = np.empty_like(flat)
                shapes = np.unique(np.stack([h[valid], w[valid]], 1), axis=0)
                for a, b in shapes.tolist():
                    which = np.flatnonzero(valid & (h == a) & (w == b))
                    step = max(1, AT_ONCE // max(1, a * b))
                    for k in range(0, len(which), step):
                        some = which[k : k + step]
                        at = first[some][:, None] + np.arange(a * b)
                        made[at] = warp(flat[at], maps[some], a, b, order, fill, cval)
                offsets = pa.array(np.where(np.r_[valid, True], first, 0).astype(np.int32), mask=~np.r_[valid, True])
                out[name] = pa.ListArray.from_arrays(offsets, pa.array(made, column.type.value_type))
            yield pa.RecordBatch.from_arrays([out[n] for n in kept], names=kept)

    return source.mapInArrow(run, source.select(*kept).schema)


def channel_shift(blocks: DataFrame, key: Column, seed: int, most: float, value: str = "px") -> DataFrame:
    """Each image brighter or darker by one draw up to `most`, within its own least and
    largest value; targets are left alone by not naming them."""
    by = uniform(key, seed, -most, most)
    low, high = F.array_min(value), F.array_max(value)
    return blocks.withColumn(value, F.transform(value, lambda x: F.greatest(low, F.least(high, x + by))))
