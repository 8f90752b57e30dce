"""Volumes against plain loops: flooding by a queue, resampling, turning, boxes."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import affine, kernels, volumes

BY = ["stack"]


def rows_of(spark, arrays, name="v"):
    rows = [(k, *map(int, p), float(x)) for k, a in arrays.items() for p, x in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"stack string, z int, r int, c int, {name} double").repartition(3)


def plain_flood(f, marker):
    """One queue of (greatest f of the path, steps on its plateau): then each voxel follows
    its first neighbour in that order to a marker."""
    cost = {}
    queue = [((float(f[p]), 0), p) for p in map(tuple, np.argwhere(marker > 0))]
    heapq.heapify(queue)
    near = lambda p: [q for q in ((p[0] + a, p[1] + b, p[2] + c) for a, b, c in volumes.STEPS) if all(0 <= x < n for x, n in zip(q, f.shape)) and np.isfinite(f[q])]
    while queue:
        d, p = heapq.heappop(queue)
        if p in cost:
            continue
        cost[p] = d
        for q in near(p):
            if q not in cost and not marker[q]:
                heapq.heappush(queue, ((float(f[q]), 0) if f[q] > d[0] else (d[0], d[1] + 1), q))
    label = np.zeros(f.shape, int)
    for p in cost:
        q = p
        while not marker[q]:
            q = min((cost[x], x) for x in near(q) if x in cost)[1]
        label[p] = marker[q]
    return label


def flooded(spark, f, marker, block):
    rows = [("s", *map(int, p), float(x), int(marker[p])) for p, x in np.ndenumerate(f) if np.isfinite(x)]
    v = spark.createDataFrame(rows, "stack string, z int, r int, c int, f double, marker int").repartition(2)
    out = np.zeros(f.shape, int)
    got = volumes.flood(v, BY, block).collect()
    assert len(got) == len(rows)
    for x in got:
        out[x.z, x.r, x.c] = x.label
    return out


@pytest.mark.parametrize("kind", ["values", "plateaus", "winding"])
def test_flood_whatever_the_blocks(spark, kind):
    draw = np.random.default_rng(3)
    shape = (5, 9, 8)
    f = draw.normal(size=shape) if kind == "values" else draw.integers(0, 3, shape).astype(float)
    f[draw.random(shape) < 0.2] = np.inf
    marker = np.where((draw.random(shape) < 0.03) & np.isfinite(f), np.arange(1, f.size + 1).reshape(shape), 0)
    if kind == "winding":  # one path through all blocks and back
        f[:], marker[:] = np.inf, 0
        f[2, ::2], f[2, 1::4, 7], f[2, 3::4, 0] = 1, 1, 1
        marker[2, 0, 0] = 5
    want = plain_flood(f, marker)
    assert (want > 0).sum() > 20
    for block in ((2, 3, 4), (16, 64, 64)):
        assert np.array_equal(flooded(spark, f, marker, block), want)


def test_flood_of_an_image_is_that_of_images(spark):
    draw = np.random.default_rng(4)
    top = draw.normal(size=(12, 15))
    marker = np.where(draw.random(top.shape) < 0.05, np.arange(1, top.size + 1).reshape(top.shape), 0)
    inside = draw.random(top.shape) < 0.85
    want = kernels.flood(top, marker, inside)
    got = flooded(spark, np.where(inside, -top, np.inf)[None], np.where(inside, marker, 0)[None], (1, 4, 5))
    assert np.array_equal(got[0], want)


def test_watershed(spark):
    """Two balls that touch and one apart, in two volumes; a flat top is one peak."""
    z, r, c = np.indices((9, 14, 14))
    ball = lambda a, b, d: np.clip(4 - np.sqrt((z - a) ** 2 + (r - b) ** 2 + (c - d) ** 2), 0, 2.5)
    a = np.maximum(ball(4, 4, 4), ball(4, 4, 9))
    v = rows_of(spark, {"two": a, "three": np.maximum(a, ball(4, 11, 11)), "none": 0 * a})
    heads = v.select(*BY, "z", "r", "c", F.col("v").alias("maxima"), F.col("v").alias("interior"))
    got = volumes.watershed(heads, BY, block=(4, 5, 6)).collect()
    found = {s: {x.label for x in got if x.stack == s} for s in ("two", "three", "none")}
    assert found == {"two": {0, 1, 2}, "three": {0, 1, 2, 3}, "none": {0}}
    label = {(x.stack, x.z, x.r, x.c): x.label for x in got}
    assert label["two", 4, 4, 3] != label["two", 4, 4, 10] and label["two", 4, 4, 3] == label["two", 3, 4, 4] and label["two", 0, 0, 0] == 0


def plain_line(values, size):
    """Smoothed, then read between centres; beyond its ends the line is mirrored."""
    n = len(values)

    def at(line, i):
        while not 0 <= i < n:
            i = 0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i
        return line[i]

    spread = max(0.0, (n / size - 1) / 2)
    reach = int(4 * spread + 0.5)
    line = list(values)
    if reach:
        bell = {k: math.exp(-0.5 * (k / spread) ** 2) for k in range(-reach, reach + 1)}
        line = [sum(b * at(values, i + k) for k, b in bell.items()) / sum(bell.values()) for i in range(n)]
    out = []
    for i in range(size):
        p = (i + 0.5) * n / size - 0.5
        low = math.floor(p)
        out.append(at(line, low) * (1 - (p - low)) + at(line, low + 1) * (p - low))
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 16])
def test_resize(spark, size):
    draw = np.random.default_rng(5)
    a = {"x": draw.normal(size=(7, 2, 3)), "y": draw.normal(size=(2, 2, 2)), "z": draw.normal(size=(1, 1, 1))}
    got = volumes.resize_axis(rows_of(spark, a), "z", BY, size).collect()
    assert len(got) == size * (6 + 4 + 1)
    for x in got:
        assert math.isclose(x.v, plain_line(a[x.stack][:, x.r, x.c].tolist(), size)[x.z], abs_tol=1e-9)
    near = volumes.resize_axis(rows_of(spark, {"x": np.arange(4.0).reshape(4, 1, 1)}), "z", BY, scale=2.0, order=0).orderBy("z").collect()
    assert [x.v for x in near] == [0, 0, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        volumes.resize_axis(rows_of(spark, a), "z", BY)


def test_turned_slices(spark):
    a = np.random.default_rng(6).normal(size=(5, 3, 4))
    v = rows_of(spark, {"x": a})
    for across, planes in (("r", [a[:, k] for k in range(3)]), ("c", [a[:, :, k] for k in range(4)])):
        frame = spark.createDataFrame([("x", *planes[0].shape)], "stack string, h int, w int")
        m = affine.drawn(frame, affine.key_of(F.col("stack")), 9, rotation=80).select(*affine.MAP).first()
        got = volumes.turn_slices(v, across, affine.key_of(F.col("stack")), 9, 80, BY, fill="reflect").collect()
        assert len(got) == a.size
        for x in got:
            k, place = (x.r, (x.z, x.c)) if across == "r" else (x.c, (x.z, x.r))
            h, w = planes[k].shape
            want = affine.warp(planes[k].reshape(1, -1), np.array([m]), h, w, 1, "reflect").reshape(h, w)
            assert math.isclose(x.v, want[place], abs_tol=1e-12)


def test_boxes_of_a_volume(spark):
    a = np.random.default_rng(7).normal(size=(5, 6, 7))
    v = rows_of(spark, {"x": a, "y": a[:2, :3]})
    boxes = volumes.tiles(v, (2, 4, 4), (2, 3, 3), BY)
    assert boxes.select("stack", "tile_z", "tile_r", "tile_c").distinct().where("stack = 'x'").count() == 3 * 2 * 2
    assert boxes.where("z >= 2 or r >= 4 or c >= 4 or z < 0 or r < 0 or c < 0").count() == 0
    back = volumes.untile(boxes, BY).join(v.withColumnRenamed("v", "was"), [*BY, "z", "r", "c"])
    assert back.count() == v.count() and back.where(F.abs(F.col("v") - F.col("was")) > 1e-12).count() == 0
