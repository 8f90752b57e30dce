"""Operators on pixel tables. Neighbours are reached by windows along rows and columns,
one shuffle by (image, line) each, rather than by joins of a table with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to a spread before division.
EPSILON = 1e-7
IMAGE = ["image_id"]


#: The axes of an image; a stack has ("z", "r", "c").
PLANE = ("r", "c")


def along(axis: str, by: list[str], axes: tuple[str, ...] = PLANE):
    """The window of an image's line along `axis`, ordered."""
    return Window.partitionBy(*by, *[a for a in axes if a != axis]).orderBy(axis)


def normalize(px: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Whole-image: less the mean, over the spread."""
    own = Window.partitionBy(*by)
    return px.withColumn("v", (F.col("v") - F.avg("v").over(own)) / (F.stddev_pop("v").over(own) + EPSILON))


def box_sum(px: DataFrame, k: int, value: Column, name: str, by: list[str] = IMAGE) -> DataFrame:
    """Sum over the square of side k around each pixel, zeros outside: two passes of
    line windows, k + k steps instead of k * k."""
    h = k // 2
    lines = px.withColumn(name, F.sum(value).over(along("c", by).rangeBetween(-h, h)))
    return lines.withColumn(name, F.sum(name).over(along("r", by).rangeBetween(-h, h)))


def box_mean(px: DataFrame, k: int, by: list[str] = IMAGE) -> DataFrame:
    """`px` with `mean` of the square of side k; outside counts as zeros."""
    return box_sum(px, k, F.col("v"), "mean", by).withColumn("mean", F.col("mean") / (k * k))


def normalize_local(px: DataFrame, k: int, by: list[str] = IMAGE) -> DataFrame:
    """Less the box mean, over the local spread of what remains."""
    centred = box_mean(px, k, by).withColumn("v", F.col("v") - F.col("mean")).drop("mean")
    both = box_sum(box_sum(centred, k, F.col("v"), "s1", by), k, F.col("v") * F.col("v"), "s2", by)
    spread = F.sqrt(F.greatest(F.col("s2") / (k * k) - F.pow(F.col("s1") / (k * k), 2), F.lit(0.0))) + EPSILON
    return both.withColumn("v", F.col("v") / spread).drop("s1", "s2")


def normalize_max(px: DataFrame, k: int, by: list[str] = IMAGE, whole_batch: bool = False) -> DataFrame:
    """Over the maximum of the image (or of all images), less the box mean."""
    if whole_batch:
        top = px.agg(F.max("v").alias("top"))
        scaled = px.join(F.broadcast(top)).withColumn("v", F.col("v") / F.col("top")).drop("top")
    else:
        scaled = px.withColumn("v", F.col("v") / F.max("v").over(Window.partitionBy(*by)))
    return box_mean(scaled, k, by).withColumn("v", F.col("v") - F.col("mean")).drop("mean")


def extent(px: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """`px` with the height and width of its image."""
    own = Window.partitionBy(*by)
    return px.withColumns({"h": F.max("r").over(own) + 1, "w": F.max("c").over(own) + 1})


def _mirrored(at: Column, n: Column, before: Column | int, after: Column | int) -> Column:
    """All places of a padded line that show pixel `at` of a line of n: itself and its
    reflections at both ends, the edge pixel not repeated."""
    shows = F.array(at, F.when((at > 0) & (at <= before), -at), F.when((at < n - 1) & (2 * (n - 1) - at <= n - 1 + after), 2 * (n - 1) - at))
    return F.filter(shows, lambda x: x.isNotNull())


def reflect_pad(px: DataFrame, pad: int, by: list[str] = IMAGE) -> DataFrame:
    """Images grown by `pad` on each side, reflected: each pixel is sent to the places that
    show it, so nothing is joined. pad must be less than the image's sides."""
    e = extent(px, by).withColumn("r", F.explode(_mirrored(F.col("r"), F.col("h"), pad, pad)))
    e = e.withColumn("c", F.explode(_mirrored(F.col("c"), F.col("w"), pad, pad)))
    return e.withColumns({"r": F.col("r") + pad, "c": F.col("c") + pad}).drop("h", "w")


def pad_to(px: DataFrame, height: int, width: int, by: list[str] = IMAGE) -> DataFrame:
    """Images reflected on both ends up to the sides of a model's input, an odd pixel at the
    far end; sides that are as long stay. The input is less than twice an image."""
    e = extent(px, by)
    for k, n, size in (("r", "h", height), ("c", "w", width)):
        lack = F.greatest(F.lit(size) - F.col(n), F.lit(0))
        e = e.withColumns({"_b": F.floor(lack / 2).cast("int"), "_a": F.ceil(lack / 2).cast("int")})
        e = e.withColumn(k, F.explode(_mirrored(F.col(k), F.col(n), F.col("_b"), F.col("_a")))).withColumn(k, F.col(k) + F.col("_b"))
    return e.drop("h", "w", "_a", "_b")


def max_pool(px: DataFrame, size: int, by: list[str] = IMAGE) -> DataFrame:
    """The maximum of each size x size square, squares side by side; a rest is left out."""
    e = extent(px, by).where((F.col("r") < F.col("h") - F.col("h") % size) & (F.col("c") < F.col("w") - F.col("w") % size))
    return e.groupBy(*by, F.floor(F.col("r") / size).cast("int").alias("r"), F.floor(F.col("c") / size).cast("int").alias("c")).agg(F.max("v").alias("v"))


def dilated_max_pool(px: DataFrame, size: int, dilation: int, by: list[str] = IMAGE) -> DataFrame:
    """The maximum of size x size pixels that stand `dilation` apart, at every place where
    all are inside: lags along rows, then along columns."""
    e = extent(px, by)
    for axis in ("c", "r"):
        steps = [F.lead("v", k * dilation).over(along(axis, by)) if k else F.col("v") for k in range(size)]
        e = e.withColumn("v", F.greatest(*steps) if size > 1 else steps[0])
    reach = (size - 1) * dilation
    return e.where((F.col("r") < F.col("h") - reach) & (F.col("c") < F.col("w") - reach)).drop("h", "w")


def location(px: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """`px` with row and column as shares of the last one; null for a side of one pixel."""
    share = lambda k, n: F.col(k) / F.nullif(F.col(n) - 1, F.lit(0)).cast("double")
    e = extent(px, by)
    return e.withColumns({"loc_r": share("r", "h"), "loc_c": share("c", "w")}).drop("h", "w")


def resize_nearest(px: DataFrame, height: int | Column, width: int | Column, by: list[str] = IMAGE) -> DataFrame:
    """Images of height x width (numbers, or columns of h and w); each pixel goes to the
    places whose nearest source it is, from the first to the last."""
    e = extent(px, by)
    for k, n, size in (("r", "h", height), ("c", "w", width)):
        size = size if isinstance(size, Column) else F.lit(size)
        at = lambda i, n=n, size=size: F.floor((i * size + F.col(n) - 1) / F.col(n)).cast("int")
        low, high = at(F.col(k)), at(F.col(k) + 1) - 1
        e = e.where(high >= low).withColumn(k, F.explode(F.sequence(low, high)))
    return e.drop("h", "w")


def resize_bilinear(px: DataFrame, height: int | Column, width: int | Column, by: list[str] = IMAGE) -> DataFrame:
    """Images of height x width (numbers, or columns of h and w) by the weights of the four
    nearest pixel centres: each pixel is sent to where it weighs, and weights are summed."""

    def spread(frame, k, n, size):
        size = size if isinstance(size, Column) else F.lit(size)
        at, last = F.col(k), F.col(n) - 1
        place = lambda x: (x + 0.5) * size / F.col(n) - 0.5  # noqa: E731  (of a source's centre)
        low = F.when(at == 0, 0).otherwise(F.greatest(F.floor(place(at - 1)), F.lit(0))).cast("int")
        high = F.when(at == last, size - 1).otherwise(F.least(F.ceil(place(at + 1)), size - 1)).cast("int")
        centre = lambda x: F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, (x + 0.5) * F.col(n) / size - 0.5))
        reach = F.transform(F.sequence(low, high), lambda x: F.struct(x.alias("to"), (1 - F.abs(centre(x) - at)).alias("weight")))
        out = frame.withColumn("_s", F.explode(F.filter(reach, lambda s: s["weight"] > 0)))
        return out.withColumns({k: F.col("_s.to"), "v": F.col("v") * F.col("_s.weight")}).drop("_s")

    e = spread(spread(extent(px, by), "r", "h", height), "c", "w", width)
    return e.groupBy(*by, "r", "c").agg(F.sum("v").alias("v"))


def to_resolution(px: DataFrame, mpp: float | None, model_mpp: float, by: list[str] = IMAGE) -> DataFrame:
    """Images of `mpp` microns a pixel at the resolution of a model: sides times mpp /
    model_mpp, cut to whole pixels; as they are where mpp is not known or equal."""
    if mpp is None or mpp == model_mpp:
        return px
    scale = mpp / model_mpp
    return resize_bilinear(px, F.floor(F.col("h") * scale).cast("int"), F.floor(F.col("w") * scale).cast("int"), by)


def windows(px: DataFrame, places: DataFrame, half: int, by: list[str] = IMAGE) -> DataFrame:
    """The pixels within `half` of each place (by, r, c) on both axes: dr and dc tell where
    from it. A place is sent to its window, which is joined by pixel."""
    each = F.sequence(F.lit(-half), F.lit(half))
    sent = places.select(*by, F.col("r").alias("at_r"), F.col("c").alias("at_c")).withColumn("dr", F.explode(each)).withColumn("dc", F.explode(each))
    sent = sent.withColumns({"r": F.col("at_r") + F.col("dr"), "c": F.col("at_c") + F.col("dc")})
    return sent.join(px.select(*by, "r", "c", "v"), [*by, "r", "c"]).select(*by, F.col("at_r").alias("r"), F.col("at_c").alias("c"), "dr", "dc", "v")


def crop_shape(images: DataFrame, crops: int = 4, field: int = 61) -> DataFrame:
    """`images` (h, w) with crop_h and crop_w, the sides of a crop when an image is read in
    `crops` parts on each axis by a model that sees `field` pixels."""
    return images.withColumns({f"crop_{n}": (F.floor(F.col(n) / crops) + (field - 1)).cast("int") for n in ("h", "w")})


def at_pixel(x: Column) -> Column:
    """The pixel that a coordinate is taken for: half a pixel on, cut to a whole number, so
    the first pixel is also shown from -1.5 on."""
    return (x + 0.5).cast("int")


def coordinate_text(places: DataFrame) -> DataFrame:
    """`places` (x, y and h, w, v of what is shown there, v null outside) with shown: the
    coordinates, and the value where they are inside. The pixel is at_pixel() of each."""
    col, row = at_pixel(F.col("x")), at_pixel(F.col("y"))
    inside = (col >= 0) & (col < F.col("w")) & (row >= 0) & (row < F.col("h"))
    at = F.format_string("x=%.4f, y=%.4f", "x", "y")
    return places.withColumn("shown", F.when(inside, F.concat(at, F.format_string(", z=%.4f", "v"))).otherwise(at))


def trim(px: DataFrame, rows: int, cols: int, by: list[str] = IMAGE) -> DataFrame:
    """Images without a border of `rows` and `cols` pixels, counted from 0 again."""
    e = extent(px, by).where((F.col("r") >= rows) & (F.col("r") < F.col("h") - rows) & (F.col("c") >= cols) & (F.col("c") < F.col("w") - cols))
    return e.withColumns({"r": F.col("r") - rows, "c": F.col("c") - cols}).drop("h", "w")


def tiles(px: DataFrame, size: int, stride: int | None = None, by: list[str] = IMAGE) -> DataFrame:
    """`px` in tiles of side `size`: tile_r, tile_c, r, c, v. Tiles begin `stride` apart (by
    default side by side), the last flush with the end, so it may overlap."""
    stride = stride or size
    e = extent(px, by)

    def origins(n):
        count = F.greatest(F.ceil((F.col(n) - size) / stride) + 1, F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("tile"), F.greatest(F.least(i * stride, F.col(n) - size), F.lit(0)).alias("at")))

    for k, n in (("r", "h"), ("c", "w")):
        e = e.withColumn("_o", F.explode(origins(n))).where((F.col("_o.at") <= F.col(k)) & (F.col(k) < F.col("_o.at") + size))
        e = e.withColumns({f"tile_{k}": F.col("_o.tile"), f"at_{k}": F.col("_o.at"), k: F.col(k) - F.col("_o.at")}).drop("_o")
    return e.drop("h", "w")


def untile(tiled: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Images from tiles() rows; where tiles overlap, their mean."""
    return tiled.groupBy(*by, (F.col("at_r") + F.col("r")).alias("r"), (F.col("at_c") + F.col("c")).alias("c")).agg(F.avg("v").alias("v"))


def clamp_percentile(px: DataFrame, share: float, by: list[str] = IMAGE) -> DataFrame:
    """Values above the percentile of their image become it."""
    own = Window.partitionBy(*by)
    return px.withColumn("v", F.least("v", F.percentile("v", F.lit(share)).over(own)))


def stretch_percentiles(px: DataFrame, low: float, high: float, by: list[str] = IMAGE) -> DataFrame:
    """Rescales so that the percentiles of the non-zero pixels become 0 and 1; clipped."""
    own = Window.partitionBy(*by)
    lit = F.when(F.col("v") != 0, F.col("v"))
    a, b = F.percentile(lit, F.lit(low)).over(own), F.percentile(lit, F.lit(high)).over(own)
    e = px.withColumns({"a": a, "b": b})
    return e.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))))).drop("a", "b")


def local_maxima(px: DataFrame, distance: int, above: float, by: list[str] = IMAGE) -> DataFrame:
    """Pixels above a threshold that are the largest within `distance` on both axes."""
    lines = px.withColumn("top", F.max("v").over(along("c", by).rangeBetween(-distance, distance)))
    top = lines.withColumn("top", F.max("top").over(along("r", by).rangeBetween(-distance, distance)))
    return top.where((F.col("v") == F.col("top")) & (F.col("v") > above)).drop("top")


def threshold(px: DataFrame, above: float) -> DataFrame:
    """Pixels at or below the threshold become 0."""
    return px.withColumn("v", F.when(F.col("v") > above, F.col("v")).otherwise(0.0))


def drop_empty_lines(px: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Without rows and columns that hold only zeros."""
    some = lambda k: F.max(F.col("v") != 0).over(Window.partitionBy(*by, k))
    e = px.withColumns({"_r": some("r"), "_c": some("c")})
    return e.where("_r and _c").drop("_r", "_c")
