"""Images with the targets that a model learns from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.operators import augment, masks, pixel, tables


#: The planes of each target; those of disc are class0, class1, ... by the image's labels.
PLANES = {
    "fgbg": ("fg", "bg"),
    "pixelwise": ("edge", "interior", "background"),
    "outer-distance": ("dist",),
    "watershed-cont": ("dist",),
    "inner-distance": ("inner",),
    "centroid": ("inner",),
    "watershed": ("bin0", "bin1", "bin2", "bin3"),
    "disc": (),
}


def label_targets(labels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Targets of each name of each label channel, as rows: image_id, channel, r, c, target,
    plane, value (double). labels: image_id, channel, r, c, label. What a target only needs
    on the way is no plane of it; unknown names are an error."""
    keys, shown = ["image_id", "channel"], ["image_id", "channel", "r", "c"]
    made = []
    for name in names:
        if name not in PLANES:
            raise ValueError(f"no target {name!r}; there are {', '.join(PLANES)}")
        e = masks.fgbg(labels) if name == "fgbg" else masks.TRANSFORMS[name](labels, by=keys)
        if name == "disc":
            rows = e.select(*shown, F.concat(F.lit("class"), "class").alias("plane"), F.col("hot").alias("value"))
        else:
            if name == "watershed":
                e = e.withColumns({p: (F.col("bin") == k).cast("int") for k, p in enumerate(PLANES[name])})
            held = F.array(*[F.struct(F.lit(p).alias("plane"), F.col(p).cast("double").alias("value")) for p in PLANES[name]])
            rows = e.select(*shown, F.explode(held).alias("_p")).select(*shown, "_p.*")
        made.append(rows.select(*shown, F.lit(name).alias("target"), "plane", F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, made)


def training_pairs(px: DataFrame, mask: DataFrame, least: int, crop: tuple[int, int], seed: int) -> DataFrame:
    """Images of `least` objects or more, with their targets: both cut alike by the same
    draws, images normalized, masks as foreground. image_id, r, c, v, label, fg, bg."""
    rich = tables.min_objects(mask, least).join(px, ["image_id", "r", "c"])
    cut = augment.random_crop(rich, *crop, seed)
    return masks.fgbg(pixel.normalize(cut))
