"""Volumes: flooding from markers block by block, resampling and turning along any axis.

A volume is rows by, z, r, c and is never one group. Flooding keeps blocks of a bounded
size as rows of arrays; in each round blocks settle what they can by themselves and send
the values of their faces that have changed to their neighbours, until none has. Paths to
markers then cross faces, and are followed in the graph of faces by doubling."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumigrid.operators import affine
from lumigrid.operators.pixel import along
from lumigrid.operators.tables import checkpointed

AXES = ("z", "r", "c")
#: Voxels of a block on each axis.
BLOCK = (16, 64, 64)
#: The six neighbours of a voxel, in the order of their places.
STEPS = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0))
_FACE = "z int, r int, c int, level double, hops long"


# ---- flooding ------------------------------------------------------------------------


def _around(a: np.ndarray, step: tuple[int, int, int]) -> np.ndarray:
    """What the neighbour of each inner voxel has in an array with a border of one."""
    return a[tuple(slice(1 + s, n - 1 + s) for s, n in zip(step, a.shape))]


_INNER = (slice(1, -1),) * 3
_FAR = np.int64(1) << 62


def _settle(f: np.ndarray, marked: np.ndarray, level: np.ndarray, hops: np.ndarray) -> None:
    """Fills level and hops of a block (arrays with a border, which holds what neighbours
    have sent): the least height that a path from a marker must reach, and its steps since
    it was reached. f is infinite where nothing can be."""
    high, mark = f[_INNER], marked[_INNER]
    open_ = np.isfinite(high) & ~mark
    inner = np.where(mark, high, np.inf)
    level[_INNER] = inner
    while True:
        best = np.minimum.reduce([_around(level, s) for s in STEPS])
        new = np.where(open_, np.maximum(high, best), inner)
        if (new == level[_INNER]).all():
            break
        level[_INNER] = new
    own = level[_INNER]
    lower = np.logical_or.reduce([_around(level, s) < own for s in STEPS]) & open_ & np.isfinite(own)
    first = np.where(mark | lower, 0, _FAR)
    hops[_INNER] = first
    while True:
        best = np.minimum.reduce([np.where(_around(level, s) == own, _around(hops, s), _FAR) for s in STEPS])
        new = np.where(mark | lower | ~np.isfinite(own), first, np.minimum(best + 1, _FAR))
        if (new == hops[_INNER]).all():
            break
        hops[_INNER] = new


class _Block:
    """The arrays of one block, from the lists of its row."""

    def __init__(self, block: tuple[int, int, int], at: tuple[int, int, int], row: dict, halo: dict):
        self.shape = tuple(n + 2 for n in block)
        self.origin = np.array([n * k - 1 for n, k in zip(block, at)])
        self.place = tuple(np.asarray(row[a], np.int64) - o for a, o in zip(AXES, self.origin))
        self.f = np.full(self.shape, np.inf)
        self.f[self.place] = row["f"]
        self.marker = np.zeros(self.shape, np.int64)
        self.marker[self.place] = row["marker"]
        self.level, self.hops = np.full(self.shape, np.inf), np.full(self.shape, _FAR)
        for (z, r, c), (level, hops) in halo.items():
            p = (z - self.origin[0], r - self.origin[1], c - self.origin[2])
            self.level[p], self.hops[p] = level, hops
        _settle(self.f, self.marker > 0, self.level, self.hops)

    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """For each voxel of the row the marker that its path comes to in the block, or 0;
        and the flat place where the path leaves it."""
        at = np.arange(self.f.size).reshape(self.shape)
        level, hops, to = self.level[_INNER].copy(), self.hops[_INNER].copy(), at.copy()
        level[:], hops[:] = np.inf, _FAR
        best = at[_INNER].copy()
        for s in STEPS:  # of equal ones the first place
            l, h = _around(self.level, s), _around(self.hops, s)
            better = (l < level) | ((l == level) & (h < hops))
            level, hops, best = np.where(better, l, level), np.where(better, h, hops), np.where(better, _around(at, s), best)
        free = (self.marker[_INNER] == 0) & np.isfinite(self.level[_INNER])
        to[_INNER] = np.where(free, best, at[_INNER])
        to = to.reshape(-1)
        while (to[to] != to).any():
            to = to[to]
        root = to[np.ravel_multi_index(self.place, self.shape)]
        return self.marker.reshape(-1)[root], root


def flood(voxels: DataFrame, by: list[str], block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """`voxels` (by, z, r, c, f, marker) with label. Markers (above 0) grow over the rows
    that there are, by faces, the least f first: each voxel joins the path from a marker
    whose greatest f is least; on a plateau, the one with fewer steps; then through the
    neighbour that was reached first in that order, then in that of places. 0 where no
    marker leads. The result does not depend on `block`, which bounds what a task holds;
    rounds are as many as blocks that a path goes through. Voxels are distinct; a null
    f is no voxel's, a null marker none."""
    keys = [*by, *(f"b{a}" for a in AXES)]
    names = [*by, *AXES]
    in_block = {f"b{a}": F.floor(F.col(a) / n).cast("int") for a, n in zip(AXES, block)}
    v = voxels.where("f is not null").select(*by, *[F.col(a).cast("int").alias(a) for a in AXES], F.col("f").cast("double").alias("f"), F.coalesce(F.col("marker").cast("long"), F.lit(0)).alias("marker"))
    rows = v.withColumns(in_block).groupBy(*keys).agg(F.collect_list(F.struct(*AXES, "f", "marker")).alias("_v"))
    none = F.array().cast(T.ArrayType(T.StructType.fromDDL(_FACE)))
    state = rows.select(*keys, "_v", none.alias("halo"), none.alias("fresh"), F.lit(True).alias("news"))
    fields = ("z", "r", "c", "level", "hops")
    kept = T.StructType([*[state.schema[k] for k in keys], state.schema["_v"], state.schema["halo"], state.schema["fresh"]])

    def step(frames):
        for frame in frames:
            out = []
            for row in frame.to_pylist():
                if row["news"] or row["sent"]:
                    halo = {(x["z"], x["r"], x["c"]): (x["level"], x["hops"]) for x in row["halo"]}
                    at = tuple(row[f"b{a}"] for a in AXES)
                    lists = {k: [x[k] for x in row["_v"]] for k in ("z", "r", "c", "f", "marker")}
                    before = None if row["news"] else _Block(block, at, lists, halo)
                    halo.update({(x["z"], x["r"], x["c"]): (x["level"], x["hops"]) for x in row["sent"] or []})
                    now = _Block(block, at, lists, halo)
                    changed = np.isfinite(now.level)
                    if before is not None:
                        changed &= (now.level != before.level) | (now.hops != before.hops)
                    face = np.zeros(now.shape, bool)
                    for k in range(3):
                        for side in (1, -2):
                            face[tuple(side if j == k else slice(1, -1) for j in range(3))] = True
                    places = np.argwhere(changed & face)
                    row["fresh"] = [dict(zip(fields, (*(p + now.origin).tolist(), float(now.level[tuple(p)]), int(now.hops[tuple(p)])))) for p in places]
                    row["halo"] = [dict(zip(fields, (*p, *x))) for p, x in halo.items()]
                else:
                    row["fresh"] = []
                out.append({k: row[k] for k in kept.names})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = to_arrow_schema(kept)
    first = True
    while True:
        if first:
            joined = state.withColumn("sent", F.col("fresh"))
        else:
            moved = F.array(*[F.struct(*[(F.col(f"_x.{a}") + s).alias(a) for a, s in zip(AXES, step_)]) for step_ in STEPS])
            sent = state.select(*by, F.explode("fresh").alias("_x")).select(*by, "_x", F.explode(moved).alias("_to"))
            for a, n in zip(AXES, block):
                sent = sent.withColumns({f"b{a}": F.floor(F.col(f"_to.{a}") / n).cast("int"), f"_o{a}": F.floor(F.col(f"_x.{a}") / n).cast("int")})
            other = sent.where(" or ".join(f"b{a} <> _o{a}" for a in AXES))
            news = other.groupBy(*keys).agg(F.collect_list("_x").alias("sent"))
            joined = state.withColumn("news", F.lit(False)).join(news, keys, "left")
        state = checkpointed(joined.select(*kept.names, "news", "sent").mapInArrow(step, kept))
        first = False
        if state.where(F.size("fresh") > 0).isEmpty():
            break

    found = T.StructType([*[state.schema[k] for k in by], *T.StructType.fromDDL("z array<int>, r array<int>, c array<int>, label array<long>, tz array<int>, tr array<int>, tc array<int>").fields])

    def follow(frames):
        for frame in frames:
            out = []
            for row in frame.to_pylist():
                lists = {k: [x[k] for x in row["_v"]] for k in ("z", "r", "c", "f", "marker")}
                halo = {(x["z"], x["r"], x["c"]): (x["level"], x["hops"]) for x in row["halo"]}
                b = _Block(block, tuple(row[f"b{a}"] for a in AXES), lists, halo)
                label, root = b.parents()
                left = np.stack(np.unravel_index(root, b.shape)) + b.origin[:, None]
                out.append({**{k: row[k] for k in by}, **{a: lists[a] for a in AXES}, "label": label.tolist(), **{f"t{a}": left[i].astype(np.int32).tolist() for i, a in enumerate(AXES)}})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(found))

    zipped = state.select(*keys, "_v", "halo").mapInArrow(follow, found).select(*by, F.explode(F.arrays_zip(*found.names[len(by) :])).alias("_p")).select(*by, "_p.*")
    zipped = checkpointed(zipped)
    target = [f"t{a}" for a in AXES]
    own = " and ".join(f"{a} = t{a}" for a in AXES)
    chase = zipped.where(f"label = 0 and not ({own})").select(*by, *target).distinct()
    known = zipped.join(chase.select(*by, *[F.col(f"t{a}").alias(a) for a in AXES]), names, "left_semi")
    known = known.withColumn("done", F.expr(f"label > 0 or ({own})"))
    while True:
        known = checkpointed(known)
        if known.where("not done").isEmpty():
            break
        nxt = known.select(*by, *[F.col(a).alias(f"t{a}") for a in AXES], F.col("label").alias("_l"), F.col("done").alias("_d"), *[F.col(f"t{a}").alias(f"_t{a}") for a in AXES])
        open_ = known.where("not done").join(nxt, [*by, *target])
        jumped = open_.select(*names, F.col("_l").alias("label"), *[F.col(f"_t{a}").alias(f"t{a}") for a in AXES], F.col("_d").alias("done"))
        known = known.where("done").unionByName(jumped)
    ends = known.select(*by, *[F.col(a).alias(f"t{a}") for a in AXES], F.col("label").alias("_l"))
    out = zipped.join(ends, [*by, *target], "left").select(*names, F.when(F.col("label") > 0, F.col("label")).otherwise(F.coalesce("_l", F.lit(0))).alias("label"))
    return v.select(*names, "f", "marker").join(out, names)


def peaks(voxels: DataFrame, value: str, distance: int, above: float, by: list[str]) -> DataFrame:
    """Voxels above a threshold that are the largest within `distance` on all axes, by three
    passes of line windows."""
    top = voxels.withColumn("_top", F.col(value))
    for axis in AXES:
        top = top.withColumn("_top", F.max("_top").over(along(axis, by, AXES).rangeBetween(-distance, distance)))
    return top.where((F.col(value) == F.col("_top")) & (F.col(value) > above)).drop("_top")


def numbered_peaks(found: DataFrame, by: list[str]) -> DataFrame:
    """Peaks (by, z, r, c) with marker, alike for those that touch (corners too): the place
    of the first of them as a number, handed on until none changes. Peaks are few and
    touch in small plateaus."""
    place = F.col("z").cast("long") * (1 << 40) + F.col("r").cast("long") * (1 << 20) + F.col("c") + 1
    now = checkpointed(found.select(*by, *AXES).withColumn("marker", place))
    steps = [F.struct(*[F.lit(s).alias(a) for a, s in zip(AXES, d)]) for d in product((-1, 0, 1), repeat=3) if any(d)]
    while True:
        sent = now.withColumn("_s", F.explode(F.array(*steps))).select(*by, *[(F.col(a) + F.col(f"_s.{a}")).alias(a) for a in AXES], F.col("marker").alias("_m"))
        least = sent.groupBy(*by, *AXES).agg(F.min("_m").alias("_m"))
        new = now.join(least, [*by, *AXES], "left").withColumn("changed", F.coalesce(F.col("_m") < F.col("marker"), F.lit(False)))
        now = checkpointed(new.withColumn("marker", F.least("marker", F.coalesce("_m", "marker"))).drop("_m"))
        if now.where("changed").isEmpty():
            return now.drop("changed")
        now = now.drop("changed")


def watershed(voxels: DataFrame, by: list[str], maxima: str = "maxima", interior: str = "interior", distance: int = 2, peak: float = 0.1, inside: float = 0.1, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Instances of volumes from two model heads: peaks of `maxima` flood it from above
    within `interior` above `inside`. by, z, r, c, label (1..n in each volume, by their
    first peak; 0 elsewhere)."""
    marks = numbered_peaks(peaks(voxels, maxima, distance, peak, by), by)
    body = voxels.where(F.col(interior) > inside).select(*by, *AXES, (-F.col(maxima)).alias("f"))
    grown = flood(body.join(marks, [*by, *AXES], "left"), by, block)
    names = grown.where("label > 0").select(*by, "label").distinct()
    rank = names.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("label")))
    numbered = grown.join(rank, [*by, "label"], "left").select(*by, *AXES, F.coalesce("_n", F.lit(0)).alias("label"))
    return voxels.select(*by, *AXES).join(numbered, [*by, *AXES], "left").withColumn("label", F.coalesce("label", F.lit(0)))


# ---- resampling and turning ----------------------------------------------------------


def _mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places of a line of n that is mirrored at its outermost pixels."""
    if n == 1:
        return np.zeros_like(at)
    at = np.mod(at, 2 * (n - 1))
    return np.where(at < n, at, 2 * (n - 1) - at)


def line_weights(n: int, size: int, order: int = 1) -> np.ndarray:
    """The share of each of n pixels of a line in each of `size` (order 1: linear between
    centres; a line that shrinks is first smoothed by a Gaussian of half the factor's
    excess over 1, cut off at four spreads; order 0: the nearest). The line goes on as
    its mirror image."""
    place = (np.arange(size) + 0.5) * n / size - 0.5
    out = np.zeros((size, n))
    if order == 0:
        out[np.arange(size), _mirrored(np.floor(place + 0.5).astype(int), n)] = 1
        return out
    low = np.floor(place).astype(int)
    for at, share in ((low, 1 - (place - low)), (low + 1, place - low)):
        np.add.at(out, (np.arange(size), _mirrored(at, n)), share)
    spread = max(0.0, (n / size - 1) / 2)
    reach = int(4 * spread + 0.5)
    if reach:
        steps = np.arange(-reach, reach + 1)
        bell = np.exp(-0.5 * (steps / spread) ** 2)
        smooth = np.zeros((n, n))
        for k, b in zip(steps, bell / bell.sum()):
            np.add.at(smooth, (np.arange(n), _mirrored(np.arange(n) + k, n)), b)
        out = out @ smooth
    return out


def resize_axis(voxels: DataFrame, axis: str, by: list[str], size: int | None = None, scale: float | None = None, order: int = 1, axes: tuple[str, ...] = AXES) -> DataFrame:
    """`voxels` (by, axes, v) with `size` places along an axis, or `scale` times as many
    (rounded). Lines are gathered, so what a task holds is a line; places of a line go from
    0 without a gap."""
    if (size is None) == (scale is None):
        raise ValueError("give a size or a scale")
    others = [*by, *[a for a in axes if a != axis]]
    lines = voxels.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(axis, F.col("v").cast("double").alias("v")))).alias("_p")).select(*others, F.col("_p.v").alias("_v"))

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("_v")
            column = batch.column(at)
            length = column.value_lengths().to_numpy()
            first = np.r_[0, np.cumsum(length)]
            flat = column.flatten().to_numpy()
            made = [None] * batch.num_rows
            for n in np.unique(length).tolist():
                which = np.flatnonzero(length == n)
                to = size if size is not None else int(round(n * scale))
                done = flat[first[which][:, None] + np.arange(n)] @ line_weights(n, to, order).T
                for k, row in enumerate(which):
                    made[row] = done[k]
            arrays = [batch.column(k) for k in range(batch.num_columns) if k != at] + [pa.array(made, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[x for x in batch.schema.names if x != "_v"], "_v"])

    each = lines.mapInArrow(run, lines.schema).select(*others, F.posexplode("_v").alias(axis, "v"))
    return each.select(*by, *axes, "v")


def turn_slices(voxels: DataFrame, across: str, key, seed: int, rotation: float, by: list[str], order: int = 1, fill: str = "nearest", cval: float = 0.0) -> DataFrame:
    """Volumes turned in the planes that stand across an axis ("r": each row's plane of
    depth and columns), all planes of a key by one drawn angle. by, z, r, c, v."""
    rest = [a for a in AXES if a != across]
    held = F.array_sort(F.collect_list(F.struct(*rest, F.col("v").cast("double").alias("v"))))
    size = {n: (F.max(a) + 1).alias(n) for n, a in zip(("h", "w"), rest)}
    planes = voxels.groupBy(*by, across).agg(*size.values(), held.alias("_p")).select(*by, across, "h", "w", F.col("_p.v").alias("px"))
    turned = affine.apply(affine.drawn(planes, key, seed, rotation=rotation), {"px": order}, fill, cval)
    each = turned.select(*by, across, "w", F.posexplode("px").alias("_i", "v"))
    return each.select(*by, *[{across: F.col(across), rest[0]: F.floor(F.col("_i") / F.col("w")).cast("int").alias(rest[0]), rest[1]: (F.col("_i") % F.col("w")).cast("int").alias(rest[1])}[a] for a in AXES], "v")


def tiles(voxels: DataFrame, size: tuple[int, int, int], stride: tuple[int, int, int] | None, by: list[str]) -> DataFrame:
    """`voxels` in boxes of `size`, which begin `stride` apart (by default side by side), the
    last flush with the end: tile_z, tile_r, tile_c, at_z, at_r, at_c, z, r, c, v."""
    own = Window.partitionBy(*by)
    e = voxels.withColumns({f"_n{a}": F.max(a).over(own) + 1 for a in AXES})
    for a, n, s in zip(AXES, size, stride or size):
        count = F.greatest(F.ceil((F.col(f"_n{a}") - n) / s) + 1, F.lit(1)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("tile"), F.greatest(F.least(i * s, F.col(f"_n{a}") - n), F.lit(0)).alias("at")))  # noqa: B023
        e = e.withColumn("_o", F.explode(F.filter(starts, lambda o: (o["at"] <= F.col(a)) & (F.col(a) < o["at"] + n))))  # noqa: B023
        e = e.withColumns({f"tile_{a}": F.col("_o.tile"), f"at_{a}": F.col("_o.at"), a: F.col(a) - F.col("_o.at")}).drop("_o")
    return e.drop(*[f"_n{a}" for a in AXES])


def untile(tiled: DataFrame, by: list[str]) -> DataFrame:
    """Volumes from tiles() rows; where tiles overlap, their mean."""
    return tiled.groupBy(*by, *[(F.col(f"at_{a}") + F.col(a)).alias(a) for a in AXES]).agg(F.avg("v").alias("v"))


# ---- samples of movies ---------------------------------------------------------------


def movie_windows(frames: DataFrame, places: DataFrame, half: int, half_t: int, movie: str = "movie", outside: float = 0.0) -> DataFrame:
    """The block of 2 * half_t + 1 frames and 2 * half + 1 pixels on both axes round each
    place (movie, t, r, c): the place and px, a flat array by frame, row and column. Frames
    are block rows (movie, t, h, w, px). Pixels and frames that a movie does not have are
    `outside`; a place that is given more than once has one row.

    A place asks each of its frames once, and the frame's task cuts the pixels out, so what
    is shuffled is one row a frame and place, and no pixel but those of samples."""
    side = 2 * half + 1
    asks = places.select(movie, F.col("t").alias("at"), "r", "c").distinct().withColumn("dt", F.explode(F.sequence(F.lit(-half_t), F.lit(half_t))))
    held = asks.withColumn("t", (F.col("at") + F.col("dt")).cast(frames.schema["t"].dataType)).join(frames.select(movie, "t", "h", "w", "px"), [movie, "t"], "left")

    def pixel(k):
        r, c = F.col("r") - half + F.floor(k / side), F.col("c") - half + k % side
        there = (r >= 0) & (r < F.col("h")) & (c >= 0) & (c < F.col("w"))
        return F.when(there, F.get("px", (r * F.col("w") + c).cast("int"))).otherwise(F.lit(outside))

    cut = held.select(movie, F.col("at").alias("t"), "r", "c", "dt", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), pixel).alias("_v"))
    whole = F.array_sort(F.collect_list(F.struct("dt", "_v")))
    return cut.groupBy(movie, "t", "r", "c").agg(whole.alias("_f")).select(movie, "t", "r", "c", F.flatten("_f._v").alias("px"))
