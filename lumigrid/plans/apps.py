"""Applications: images through preparation, tiles, a model and back, as one plan.

A model is a function from a batch of tiles (n, size, size) to named heads of that shape.
It runs by Arrow batches of tile rows; a batch is what it sees at once, so memory is that
of a batch. Weights are the caller's; `box_model` is a stand-in without any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.operators import kernels, masks, pixel, tables

Model = Callable[[np.ndarray], dict[str, np.ndarray]]


def box_model(tiles: np.ndarray) -> dict[str, np.ndarray]:
    """Heads of a blurred image: its values, and how bright its surroundings are."""
    p = np.pad(tiles, ((0, 0), (1, 1), (1, 1)), mode="edge")
    blurred = sum(p[:, a : a + tiles.shape[1], b : b + tiles.shape[2]] for a in range(3) for b in range(3)) / 9
    return {"maxima": blurred, "interior": (blurred > 0).astype(float)}


def predict(tiled: DataFrame, model: Model, heads: tuple[str, ...], size: int, batch: int = 64) -> DataFrame:
    """`tiled` rows (pixel.tiles) with a column for each head in place of v. The pixels of
    a tile are gathered into a row, at most size * size of them."""
    keys = ["image_id", "tile_r", "tile_c", "at_r", "at_c"]
    rows = tiled.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "c", "v"))), lambda x: x["v"]).alias("px"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    schema = "image_id long, tile_r int, tile_c int, at_r int, at_c int, w int, " + ", ".join(f"{n} array<double>" for n in heads)

    def run(frames):
        for f in frames:
            for low in range(0, len(f), batch):
                part = f.iloc[low : low + batch]
                x = np.zeros((len(part), size, size))
                for k, (px, h, w) in enumerate(zip(part.px, part.h, part.w, strict=True)):
                    x[k, :h, :w] = np.asarray(px).reshape(h, w)
                made = model(x)
                out = part[[*keys, "w"]].copy()
                for n in heads:
                    out[n] = [made[n][k, :h, :w].reshape(-1).tolist() for k, (h, w) in enumerate(zip(part.h, part.w, strict=True))]
                yield out

    back = rows.mapInPandas(run, schema)
    each = back.select(*keys, "w", F.posexplode(F.arrays_zip(*heads)).alias("i", "p"))
    return each.select(*keys, F.floor(F.col("i") / F.col("w")).cast("int").alias("r"), (F.col("i") % F.col("w")).cast("int").alias("c"), *[F.col(f"p.{n}").alias(n) for n in heads])


def blend(tiled: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """Images of heads from their tiles: the mean where tiles overlap."""
    place = [(F.col("at_r") + F.col("r")).alias("r"), (F.col("at_c") + F.col("c")).alias("c")]
    return tiled.groupBy("image_id", *place).agg(*[F.avg(n).alias(n) for n in heads])


@dataclass
class Segmentation:
    """px (image_id, r, c, v) to a mask (image_id, r, c, label)."""

    model: Model = box_model
    size: int = 8
    overlap: float = 0.75
    prepare: Callable[[DataFrame], DataFrame] = pixel.normalize
    heads: tuple[str, ...] = ("maxima", "interior")
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        for name in ("model", "prepare"):
            if not callable(getattr(self, name)):
                raise ValueError(f"{name} must be callable")

    def __call__(self, px: DataFrame) -> DataFrame:
        missing = {"image_id", "r", "c", "v"} - set(px.columns)
        if missing:
            raise ValueError(f"pixels lack {', '.join(sorted(missing))}")
        stride = max(1, int(self.size * self.overlap))
        tiled = pixel.tiles(self.prepare(px.select("image_id", "r", "c", "v")), self.size, stride)
        return kernels.watershed(blend(predict(tiled, self.model, self.heads, self.size), self.heads), *self.heads, **self.options)


def compartments(px: DataFrame, apps: dict[str, Segmentation]) -> DataFrame:
    """Masks of several compartments in one table."""
    out = None
    for name, app in apps.items():
        part = app(px).withColumn("compartment", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def detect(px: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int = 8) -> DataFrame:
    """The class of each image: scores of its tiles (n, classes), summed, the largest."""
    tiled = pixel.tiles(px, size)
    rows = tiled.groupBy("image_id", "tile_r", "tile_c").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "c", "v"))), lambda x: x["v"]).alias("px"))

    def run(frames):
        for f in frames:
            if len(f):
                s = model(np.stack([np.asarray(p) for p in f.px]))
                yield pd.DataFrame({"image_id": np.repeat(f.image_id.to_numpy(), s.shape[1]), "class": np.tile(np.arange(s.shape[1], dtype=np.int32), len(f)), "p": s.reshape(-1)})

    return tables.vote(rows.mapInPandas(run, "image_id long, class int, p double"), ["image_id"])


def targets(mask: DataFrame, names: list[str], **options) -> dict[str, DataFrame]:
    """The training targets of a mask by name, from one filtered and relabelled table."""
    whole = masks.relabel(mask)
    return {n: masks.transform(whole, n, **options.get(n, {})) for n in names}
