"""Operators on instance masks: boundaries, distances, components, relabelling."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.operators.pixel import EPSILON, IMAGE, PLANE, along


def _neighbours(mask: DataFrame, value: str, by: list[str], axes: tuple[str, ...] = PLANE) -> list:
    """The values before and after each pixel on every axis; null outside."""
    return [step(value).over(along(axis, by, axes)) for axis in axes for step in (F.lag, F.lead)]


def boundary(mask: DataFrame, by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """`mask` with edge: 1 for instance pixels beside another value (4 neighbours, in a
    stack 6)."""
    any_ = F.lit(False)
    for n in _neighbours(mask, "label", by, axes):
        any_ = any_ | F.coalesce(n != F.col("label"), F.lit(False))
    return mask.withColumn("edge", F.when((F.col("label") > 0) & any_, 1).otherwise(0))


def dilate(mask: DataFrame, value: str, radius: int, by: list[str] = IMAGE) -> DataFrame:
    """`value` as its maximum over the disk of a radius. Set pixels are sent to the disk
    around them (a bounded fan-out), and those that arrive are counted once."""
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around])
    sent = mask.where(F.col(value) > 0).select(*by, "r", "c", F.col(value).alias("_v"), F.explode(offsets).alias("_o"))
    grown = sent.groupBy(*by, (F.col("r") + F.col("_o.a")).alias("r"), (F.col("c") + F.col("_o.b")).alias("c")).agg(F.max("_v").alias("_v"))
    return mask.join(grown, [*by, "r", "c"], "left").withColumn(value, F.coalesce("_v", F.col(value) * 0)).drop("_v")


def pixelwise(mask: DataFrame, dilation: int = 0, split_edges: bool = False, by: list[str] = IMAGE) -> DataFrame:
    """One-hot classes: edge, interior, background; with split_edges the edges between
    cells and those to the background apart: edge_cell, edge_background, interior,
    background. A dilation widens edges by a disk, at the cost of interior and
    background."""
    e = boundary(mask, by)
    e = e.withColumn("interior", ((F.col("label") > 0) & (F.col("edge") == 0)).cast("int"))
    if split_edges:
        near = [F.coalesce(n == 0, F.lit(False)) for n in _neighbours(e, "label", by)]
        touches = (near[0] | near[1] | near[2] | near[3]).cast("int")
        e = e.withColumns({"edge_background": (F.col("edge") * touches), "edge_cell": F.col("edge") * (1 - touches)})
        names = ["edge_cell", "edge_background"]
    else:
        names = ["edge"]
    if dilation:
        for name in names:
            e = dilate(e, name, dilation, by)
            e = e.withColumn(name, F.when(F.col("interior") == 1, 0).otherwise(F.col(name)))
    total = sum((F.col(n) for n in names), F.col("interior"))
    return e.withColumn("background", F.when(total > 0, 0).otherwise(1)).select(*by, "r", "c", *names, "interior", "background")


def erode_edges(mask: DataFrame, width: int, by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """Instances without their outermost `width` pixels."""
    for _ in range(width):
        mask = boundary(mask, by, axes).withColumn("label", F.when(F.col("edge") == 1, 0).otherwise(F.col("label"))).drop("edge")
    return mask


def relabel(mask: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Labels as 1..n in ascending order, background as it is. Ranks come from the distinct
    labels, so that no window sorts pixels."""
    names = mask.where("label <> 0").select(*by, "label").distinct()
    ranks = names.withColumn("_new", F.row_number().over(Window.partitionBy(*by).orderBy("label")))
    return mask.join(ranks, [*by, "label"], "left").withColumn("label", F.coalesce("_new", F.lit(0))).drop("_new")


def fgbg(mask: DataFrame) -> DataFrame:
    """`mask` with fg, 1 for any instance (negative values stay), and bg."""
    fg = F.when(F.col("label") > 1, 1).otherwise(F.col("label"))
    return mask.withColumns({"fg": fg, "bg": (fg == 0).cast("int")})


def one_hot(mask: DataFrame, classes: int | None = None, by: list[str] = IMAGE) -> DataFrame:
    """A row for each pixel and class 0..n-1 with `hot`. Without `classes` an image has as
    many as its largest label asks for."""
    top = F.lit(classes - 1) if classes else F.max("label").over(Window.partitionBy(*by))
    each = mask.withColumn("_top", top).withColumn("class", F.explode(F.sequence(F.lit(0), "_top")))
    return each.withColumn("hot", (F.col("class") == F.col("label")).cast("int")).drop("_top")


# ---- components --------------------------------------------------------------------


def _label_image(*coordinates: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Components of equal labels, diagonal neighbours too, numbered by their first pixel in
    row-major order. Neighbours hook the larger of their roots to the smaller, and pointers
    jump to their roots, so a winding component takes a few rounds as a round one does."""
    shape = tuple(int(k.max()) + 3 for k in coordinates)
    inside = tuple(k + 1 for k in coordinates)
    value = np.zeros(shape, np.int64)
    value[inside] = label
    flat = value.reshape(-1)
    place = np.flatnonzero(flat)
    root = np.arange(flat.size)
    pairs = []
    for a in itertools.product((-1, 0, 1), repeat=len(shape)):
        step = int(np.ravel_multi_index(tuple(k + 1 for k in a), shape) - np.ravel_multi_index((1,) * len(shape), shape))
        if step > 0:
            same = place[flat[place] == flat[place - step]]
            pairs.append(np.stack([same - step, same]))
    one, two = np.concatenate(pairs, axis=1)
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            break
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root[place]] != root[place]).any():
            root[place] = root[root[place]]
    found = np.where(value != 0, root.reshape(shape) + 1, 0)[inside]
    return np.where(found > 0, np.searchsorted(np.unique(found[found > 0]), found) + 1, 0)


def components(mask: DataFrame, by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """`mask` with component: 1..n for touching pixels of one label, 0 for background. An
    image is a group, and images are what is spread."""
    schema = mask.schema.simpleString()[7:-1] + ",component:int"

    def run(image: pd.DataFrame) -> pd.DataFrame:
        return image.assign(component=_label_image(*[image[a].to_numpy() for a in axes], label=image.label.to_numpy()).astype(np.int32))

    return mask.groupBy(*by).applyInPandas(run, schema)


# ---- distances ---------------------------------------------------------------------


def _envelope(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The least of (x[i] - x[j])**2 + g[j] over j, for each i of each line (a row), by the
    lower envelope of the parabolas: linear in the line. Infinite g is no parabola."""
    lines, width = g.shape
    every = np.arange(lines)
    kept, begin, top = np.zeros((lines, width), np.int64), np.full((lines, width + 1), np.inf), np.full(lines, -1)
    for q in range(width):
        new = every[np.isfinite(g[:, q])]
        cross, open_ = np.full(lines, -np.inf), new
        while len(open_ := open_[top[open_] >= 0]):
            j = kept[open_, top[open_]]
            at = ((g[open_, q] + x[open_, q] ** 2) - (g[open_, j] + x[open_, j] ** 2)) / (2 * (x[open_, q] - x[open_, j]))
            hidden = at <= begin[open_, top[open_]]
            cross[open_[~hidden]] = at[~hidden]
            open_ = open_[hidden]
            top[open_] -= 1
        top[new] += 1
        kept[new, top[new]], begin[new, top[new]] = q, cross[new]
    begin[np.arange(width + 1)[None, :] > top[:, None]] = np.inf
    out, now = np.full((lines, width), np.inf), np.zeros(lines, np.int64)
    for q in range(width):
        while (on := begin[every, np.minimum(now + 1, width)] < x[:, q]).any():
            now[on] += 1
        j = kept[every, now]
        out[:, q] = np.where(top >= 0, (x[:, q] - x[every, j]) ** 2 + g[every, j], np.inf)
    return out


def _along_lines(px: DataFrame, line: list[str], axis: str, spacing: float) -> DataFrame:
    """line, axis and the squared distance _g after one more axis. A line is a row; lines of
    one length in an Arrow batch go through the envelope together."""
    held = px.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).cast("int").alias("x"), F.coalesce("_g", F.lit(float("inf"))).alias("g")))).alias("_l"))
    held = held.select(*line, F.col("_l.x").alias("_x"), F.col("_l.g").alias("_h"))

    def run(batches):
        for b in batches:
            x, g = (b.column(b.schema.get_field_index(c)) for c in ("_x", "_h"))
            ends = np.r_[0, np.cumsum(pc.list_value_length(x).to_numpy())]
            flat = x.flatten().to_numpy() * float(spacing), g.flatten().to_numpy()
            out = np.empty(len(flat[0]))
            for size in np.unique(np.diff(ends)).tolist():
                mine = ends[:-1][np.diff(ends) == size][:, None] + np.arange(size)
                out[mine] = _envelope(flat[0][mine], flat[1][mine])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in line], x, pa.ListArray.from_arrays(ends.astype(np.int32), out)], names=[*line, "_x", "_h"])

    done = held.mapInArrow(run, held.schema)
    each = done.select(*line, F.explode(F.arrays_zip("_x", "_h")).alias("_e"))
    return each.select(*line, F.col("_e._x").alias(axis), F.when(F.col("_e._h") < float("inf"), F.col("_e._h")).alias("_g"))


def distance(mask: DataFrame, spacing: tuple[float, ...] | None = None, by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """`mask` with dist: the Euclidean distance of a foreground pixel to the nearest
    background, null where the image has none, 0 on the background. `spacing` is the size
    of a pixel on each axis.

    Separable: windows give the nearest background on each line of the first axis; then,
    axis by axis, the least of (x - x')**2 + the squared distance so far on the line. The
    work is linear in the pixels, and no group is larger than a line.
    """
    spacing = spacing or (1.0,) * len(axes)
    lines = along(axes[0], by, axes)
    zero = F.when(F.col("label") == 0, F.col(axes[0]))
    before = F.last(zero, ignorenulls=True).over(lines.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(zero, ignorenulls=True).over(lines.rowsBetween(0, Window.unboundedFollowing))
    far = F.least(F.col(axes[0]) - before, after - F.col(axes[0]))
    keys = [*by, *axes]
    found = mask.select(*keys, F.pow(far * F.lit(spacing[0]), 2).alias("_g"))
    for axis, size in zip(axes[1:], spacing[1:], strict=True):
        found = _along_lines(found, [*by, *[a for a in axes if a != axis]], axis, size)
    return mask.join(found, keys, "left").withColumn("dist", F.sqrt("_g")).drop("_g")


def outer_distance(
    mask: DataFrame, per: str = "component", by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE, spacing: tuple[float, ...] | None = None, erosion: int = 0, normalize: bool = True
) -> DataFrame:
    """Distances to the background as shares of the largest in their component (or label:
    per="label", which is what stacks take), or as they are without `normalize`. Instances
    first lose `erosion` pixels of their edges."""
    mask = erode_edges(mask, erosion, by, axes)
    if not normalize:
        return distance(mask, spacing, by, axes)
    e = distance(components(mask, by, axes) if per == "component" else mask, spacing, by, axes)
    top = F.max("dist").over(Window.partitionBy(*by, per))
    return e.withColumn("dist", F.when(F.col("label") == 0, 0.0).otherwise(F.col("dist") / F.nullif(top, F.lit(0.0))))


def weighted_centroids(mask: DataFrame, per: str = "label", by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """The distance-weighted centre (c and the axis's name) and the area of each instance;
    needs dist."""
    total = F.sum("dist")
    return mask.where("label <> 0").groupBy(*by, per).agg(*[(F.sum(F.col(a) * F.col("dist")) / total).alias(f"c{a}") for a in axes], F.count("*").alias("area"))


def inner_distance(mask: DataFrame, alpha: float | str = 0.1, beta: float = 1.0, per: str = "component", by: list[str] = IMAGE, axes: tuple[str, ...] = PLANE, spacing: tuple[float, ...] | None = None, erosion: int = 0) -> DataFrame:
    """`mask` with inner: 1 / (1 + beta * alpha * d2), d2 the squared distance to the
    instance's weighted centre; alpha "auto" is 1 / sqrt(area), in a stack the inverse cube
    root. 0 on the background. Instances first lose `erosion` pixels of their edges."""
    mask = erode_edges(mask, erosion, by, axes)
    if isinstance(alpha, str) and alpha != "auto":
        raise ValueError('alpha is a number or "auto"')
    e = distance(components(mask, by, axes) if per == "component" else mask, spacing, by, axes)
    centre = weighted_centroids(e, per, by, axes)
    area = F.col("area").cast("double")
    a = 1 / (F.sqrt(area) if len(axes) == 2 else F.cbrt(area)) if alpha == "auto" else F.lit(float(alpha))
    d2 = sum((F.pow((F.col(x) - F.col(f"c{x}")) * F.lit(s), 2) for x, s in zip(axes, spacing or (1.0,) * len(axes), strict=True)), F.lit(0.0))
    out = e.join(centre, [*by, per], "left").withColumn("inner", F.when(F.col("label") == 0, 0.0).otherwise(1 / (1 + F.lit(beta) * a * d2)))
    return out.drop(*[f"c{x}" for x in axes], "area")


def binned(px: DataFrame, value: str, bins: int, by: list[str] = IMAGE) -> DataFrame:
    """`px` with bin 0..bins-1: equal widths from the image's least to its largest value,
    each bin closed on the right."""
    own = Window.partitionBy(*by)
    e = px.withColumns({"_lo": F.min(value).over(own) - EPSILON, "_hi": F.max(value).over(own) + EPSILON})
    return e.withColumn("bin", (F.ceil((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) - 1).cast("int")).drop("_lo", "_hi")


#: Targets by name; each takes a mask and gives pixel columns.
TRANSFORMS = {
    "pixelwise": pixelwise,
    "outer-distance": outer_distance,
    "inner-distance": inner_distance,
    "centroid": inner_distance,
    "watershed-cont": outer_distance,
    "fgbg": fgbg,
    "disc": one_hot,
    None: one_hot,
}


def watershed_bins(mask: DataFrame, bins: int = 4, by: list[str] = IMAGE) -> DataFrame:
    return binned(outer_distance(mask, by=by), "dist", bins, by)


TRANSFORMS["watershed"] = watershed_bins


def transform(mask: DataFrame, name: str | None, **options) -> DataFrame:
    """The target of a name; unknown names are an error."""
    if name not in TRANSFORMS:
        raise ValueError(f"no mask transform {name!r}; there are {', '.join(map(str, TRANSFORMS))}")
    return TRANSFORMS[name](mask, **options)
