"""Images too large for a model, read in crops with a margin and put together again.

A crop is given the pixels that the model sees around it, so what it makes of the crop's
own pixels does not depend on where the cuts are; crops do not overlap there, and the
images come together without any aggregation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.operators.pixel import IMAGE, extent

Model = Callable[[np.ndarray], dict[str, np.ndarray]]
PADDINGS = ("reflect", "zero")


def _shown(at: Column, n: Column, margin: int, padding: str) -> Column:
    """The places from -margin to n - 1 + margin that show pixel `at` of a line of n: only
    its own, or those where the line mirrored at its outermost pixels, again and again,
    comes to it."""
    if padding == "zero":
        return F.array(at)
    period = F.greatest(2 * (n - 1), F.lit(1))
    least = lambda x: x - F.floor((x + margin) / period) * period
    runs = [F.sequence(least(x), n - 1 + margin, period) for x in (at, -at)]
    some = [F.when(least(x) <= n - 1 + margin, run).otherwise(F.array().cast("array<bigint>")) for x, run in zip((at, -at), runs)]
    return F.array_distinct(F.concat(*some))


def halo_crops(px: DataFrame, crops: int = 4, field: int = 61, padding: str = "reflect", by: list[str] = IMAGE) -> DataFrame:
    """`px` in crops x crops parts, each of side // crops pixels and a margin of (field - 1)
    // 2 on all sides: by, tile_r, tile_c, at_r, at_c (of the part's first pixel), r and c
    (in the crop, margin included), h and w (of the crop), v. A pixel is sent to the crops
    that show it, so nothing is joined. The rest of a side that `crops` does not divide is
    in margins only. With "zero", places beyond the image have no row."""
    if padding not in PADDINGS:
        raise ValueError(f"padding is one of {', '.join(PADDINGS)}, not {padding!r}")
    margin = (field - 1) // 2
    e = extent(px, by).withColumns({f"_{n}": (F.floor(F.col(n) / crops) + 2 * margin).cast("int") for n in "hw"})
    for k, n in (("r", "h"), ("c", "w")):
        side = F.floor(F.col(n) / crops)
        e = e.where(side > 0).withColumn("_p", F.explode(_shown(F.col(k).cast("long"), F.col(n).cast("long"), margin, padding)))
        # crop i shows the places from i * side - margin to (i + 1) * side + margin - 1
        low, high = F.greatest(F.ceil((F.col("_p") - margin + 1 - side) / side), F.lit(0)), F.least(F.floor((F.col("_p") + margin) / side), F.lit(crops - 1))
        e = e.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn(f"tile_{k}", F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int"))))
        e = e.withColumn(f"at_{k}", (F.col(f"tile_{k}") * side).cast("int"))
        e = e.withColumn(k, (F.col("_p") - F.col(f"at_{k}") + margin).cast("int"))
    return e.select(*by, "tile_r", "tile_c", "at_r", "at_c", "r", "c", F.col("_h").alias("h"), F.col("_w").alias("w"), "v")


def modelled(cropped: DataFrame, model: Model, heads: tuple[str, ...], field: int, by: list[str] = IMAGE) -> DataFrame:
    """What a model makes of crops: by, tile_r, tile_c, r and c in the image, heads. The
    model is given crops of one size (n, h, w) at once and gives, for each head, arrays as
    large, whose margins are cut off, or without the margins."""
    keys, margin = [*by, "tile_r", "tile_c", "at_r", "at_c", "h", "w"], (field - 1) // 2
    rows = cropped.groupBy(*keys).agg(F.collect_list(F.struct("r", "c", F.col("v").cast("double").alias("v"))).alias("_p"))
    rows = rows.select(*keys, *[F.col(f"_p.{k}").alias(f"_{k}") for k in "rcv"])
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in heads]])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            r, c, v = (batch.column(names.index(k)) for k in ("_r", "_c", "_v"))
            first = r.offsets.to_numpy() - r.offsets[0].as_py()
            r, c, v = (x.flatten().to_numpy() for x in (r, c, v))
            h, w = (batch.column(names.index(k)).to_numpy() for k in "hw")
            out = {n: [None] * batch.num_rows for n in heads}
            for a, b in np.unique(np.stack([h, w], 1), axis=0).tolist():
                which = np.flatnonzero((h == a) & (w == b))
                x = np.zeros((len(which), a, b))
                for k, row in enumerate(which):
                    part = slice(first[row], first[row + 1])
                    x[k, r[part], c[part]] = v[part]
                made, inner = model(x), (a - 2 * margin, b - 2 * margin)
                for n in heads:
                    y = made[n]
                    if y.shape[1:] == (a, b):
                        y = y[:, margin : a - margin, margin : b - margin]
                    if y.shape[1:] != inner:
                        raise ValueError(f"{n} has shape {y.shape[1:]}; a crop has {(a, b)}, without its margin {inner}")
                    for k, row in enumerate(which):
                        out[n][row] = y[k].reshape(-1)
            arrays = [pa.array(out[n], pa.list_(pa.float64())) for n in heads]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(k)) for k in keys], *arrays], names=[*keys, *heads])

    back = rows.mapInArrow(run, schema)
    each = back.select(*keys, F.posexplode(F.arrays_zip(*heads)).alias("i", "_p"))
    side = F.col("w") - 2 * margin
    place = [(F.col("at_r") + F.floor(F.col("i") / side)).cast("int").alias("r"), (F.col("at_c") + F.col("i") % side).cast("int").alias("c")]
    return each.select(*by, "tile_r", "tile_c", *place, *[F.col(f"_p.{n}").alias(n) for n in heads])


def stitch(made: DataFrame, px: DataFrame, crops: int, heads: tuple[str, ...], by: list[str] = IMAGE) -> DataFrame:
    """Images (by, r, c, heads) of modelled crops; pixels of `px` in the rest of a side that
    `crops` does not divide are zeros."""
    rest = extent(px, by).where((F.col("r") >= F.floor(F.col("h") / crops) * crops) | (F.col("c") >= F.floor(F.col("w") / crops) * crops))
    return made.select(*by, "r", "c", *heads).unionByName(rest.select(*by, "r", "c", *[F.lit(0.0).alias(n) for n in heads]))


def whole_image(px: DataFrame, model: Model, heads: tuple[str, ...], crops: int = 4, field: int = 61, padding: str = "reflect", by: list[str] = IMAGE) -> DataFrame:
    """What a model that sees `field` pixels makes of images (by, r, c, v), by crops: by, r,
    c, heads. The result does not depend on `crops`, but for the rest of a side that it does
    not divide, which is zeros. Memory is that of the crops of one batch."""
    return stitch(modelled(halo_crops(px, crops, field, padding, by), model, heads, field, by), px, crops, heads, by)
