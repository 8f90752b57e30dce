"""What cells look like: patches of an image around each cell, brought to one size.

Boxes are sent to the tiles of an image that they lie on, and pixels, each sent once, are
met in their tile; places beyond the border have none and are zeros. So a frame is never
compared with all its cells, and a task holds the patches of a few cells."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.operators.pixel import IMAGE


#: The side of the tiles where boxes meet pixels.
TILE = 32
#: Values of pictures that are made at once.
VALUES = 1 << 18


def boxes(cells: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """The box (r0, c0, h, w), centre (cr, cc) and area of each cell of pixels (r, c, label)."""
    e = cells.where("label <> 0").groupBy(*by, "label")
    low = e.agg(*[F.min(k).alias(f"{k}0") for k in "rc"], (F.max("r") - F.min("r") + 1).alias("h"), (F.max("c") - F.min("c") + 1).alias("w"), F.avg("r").alias("cr"), F.avg("c").alias("cc"), F.count("*").alias("area"))
    return low


def around(found: DataFrame, half: int) -> DataFrame:
    """Boxes of side 2 * half whose middle is the pixel of each centre."""
    at = {f"{k}0": F.floor(f"c{k}").cast("int") - half for k in "rc"}
    return found.withColumns({**at, "h": F.lit(2 * half), "w": F.lit(2 * half)})


def patches(px: DataFrame, found: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """For each box (by, label, r0, c0, h, w) the pixels (r, c, v; own: whether the pixel
    has the cell's label) that it has in its image, counted from its corner: one row with
    their arrays. Boxes without any pixel are left out."""
    if "label" not in px.columns:
        px = px.withColumn("label", F.lit(None).cast("long"))
    asked = found.select(*by, "label", "r0", "c0", "h", "w")
    seen = px.select(*by, "r", "c", F.col("v").cast("double").alias("v"), F.col("label").alias("_l"))
    for k, n in (("r", "h"), ("c", "w")):
        first, last = F.floor(F.col(f"{k}0") / TILE), F.floor((F.col(f"{k}0") + F.col(n) - 1) / TILE)
        asked, seen = asked.withColumn(f"_{k}", F.explode(F.sequence(first, last))), seen.withColumn(f"_{k}", F.floor(F.col(k) / TILE))
    inside = F.col("r").between(F.col("r0"), F.col("r0") + F.col("h") - 1) & F.col("c").between(F.col("c0"), F.col("c0") + F.col("w") - 1)
    # merged, as tables made by exploding arrays look small enough to be sent through the driver
    got = asked.hint("merge").join(seen.hint("merge"), [*by, "_r", "_c"]).where(inside)
    got = got.withColumns({"r": (F.col("r") - F.col("r0")).cast("int"), "c": (F.col("c") - F.col("c0")).cast("int"), "own": F.coalesce(F.col("_l") == F.col("label"), F.lit(False))})
    held = F.collect_list(F.struct("r", "c", "v", "own"))
    each = got.groupBy(*by, "label", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w")).agg(held.alias("_p"))
    return each.select(*by, "label", "h", "w", *[F.col(f"_p.{k}").alias(k) for k in ("r", "c", "v", "own")])


@lru_cache(4096)
def weights(n: int, size: int) -> np.ndarray:
    """The share of each of n pixels of a line in each of `size`: linear between centres,
    zeros beyond the ends; a line that shrinks is first smoothed by a Gaussian of half the
    factor's excess over 1, cut off at four spreads."""
    place = (np.arange(size) + 0.5) * n / size - 0.5
    low = np.floor(place).astype(int)
    out = np.zeros((size, n))
    for at, share in ((low, 1 - (place - low)), (low + 1, place - low)):
        there = (at >= 0) & (at < n)
        out[np.flatnonzero(there), at[there]] += share[there]
    spread = max(0.0, (n / size - 1) / 2)
    reach = int(4 * spread + 0.5)
    if reach == 0:
        return out
    step = np.arange(-reach, reach + 1)
    bell = np.exp(-0.5 * (step / spread) ** 2)
    far = np.arange(n)[:, None] - np.arange(n)[None, :]
    smooth = np.where(np.abs(far) <= reach, np.exp(-0.5 * (far / spread) ** 2), 0.0) / bell.sum()
    return out @ smooth


def resampled(found: DataFrame, size: int, by: list[str] = IMAGE, only_own: bool = False) -> DataFrame:
    """Patches as by, label and `patch`, size * size values in rows. With `only_own` the
    pixels of other cells and of the background are zeros, and the cell's have mean 0 and
    spread 1 (zeros if they are all alike)."""
    out = T.StructType([*[found.schema[c] for c in (*by, "label")], T.StructField("patch", T.ArrayType(T.DoubleType()))])

    def run(batches):
        step = max(1, VALUES // (size * size))
        for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            names = batch.schema.names
            col = {n: batch.column(names.index(n)) for n in names}
            first = col["r"].offsets.to_numpy()
            h, w = col["h"].to_numpy(), col["w"].to_numpy()
            base = first[0]
            r, c, v, own = (col[k].flatten().to_numpy(zero_copy_only=False) for k in ("r", "c", "v", "own"))
            made = np.empty((batch.num_rows, size * size))
            for k in range(batch.num_rows):
                part = slice(first[k] - base, first[k + 1] - base)
                values = v[part]
                if only_own:
                    mine = own[part].astype(bool)
                    spread = values[mine].std() if mine.any() else 0.0
                    values = np.where(mine & (spread > 0), (values - (values[mine].mean() if mine.any() else 0.0)) / (spread or 1.0), 0.0)
                grid = np.zeros((h[k], w[k]))
                grid[r[part], c[part]] = values
                made[k] = (weights(int(h[k]), size) @ grid @ weights(int(w[k]), size).T).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1) * size * size, pa.int32())
            yield pa.RecordBatch.from_arrays([*[col[n] for n in (*by, "label")], pa.ListArray.from_arrays(offsets, pa.array(made.reshape(-1)))], names=[*by, "label", "patch"])

    return found.mapInArrow(run, out)


def appearances(cells: DataFrame, size: int, by: list[str] = IMAGE, mode: str = "resize", norm: bool = False) -> DataFrame:
    """A picture of each cell of pixels (by, r, c, label, v): of its box, resized ("resize"),
    or of `size` pixels around its centre as they are ("fixed"), there with `norm` of the
    cell alone, standardized."""
    if mode not in ("resize", "fixed"):
        raise ValueError('mode is "resize" or "fixed"')
    if mode == "resize":
        return resampled(patches(cells, boxes(cells, by), by), size, by)
    if size % 2:
        raise ValueError("a fixed patch has an even side")
    return resampled(patches(cells, around(boxes(cells, by), size // 2), by), size, by, norm)


def neighbourhoods(cells: DataFrame, reach: int, half: int, by: list[str] = IMAGE) -> DataFrame:
    """What is up to `reach` pixels around each cell's centre, zeros beyond the border, at
    a side of 2 * half + 1."""
    return resampled(patches(cells, around(boxes(cells, by), reach), by), 2 * half + 1, by)


def future_areas(cells: DataFrame, reach: int, half: int, by: list[str], time: str = "t") -> DataFrame:
    """What is in the next frame where each cell's neighbourhood is now; none for cells of
    a movie's last frame."""
    ahead = around(boxes(cells, by), reach).withColumn(time, F.col(time) + 1)
    later = resampled(patches(cells.drop("label"), ahead, by), 2 * half + 1, by)
    return later.withColumn(time, F.col(time) - 1)


def features(cells: DataFrame, size: int, by: list[str] = IMAGE, mode: str = "resize", norm: bool = False) -> DataFrame:
    """The table of a cell's features: by, label, cr, cc, area and its appearance (patch)."""
    return boxes(cells, by).select(*by, "label", "cr", "cc", "area").join(appearances(cells, size, by, mode, norm), [*by, "label"])
