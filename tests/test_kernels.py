"""Goldens and invariants of masks, kernels, applications and the tracker."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import augment, kernels, masks, pixel, tables
from lumigrid.plans.apps import Segmentation, box_model, compartments, targets
from lumigrid.streaming import tracker

RNG = np.random.default_rng(1)


def table(spark, images, name):
    rows = [(i, r, c, a[r, c].item()) for i, a in enumerate(images) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"image_id long, r int, c int, {name} {'int' if images[0].dtype.kind == 'i' else 'double'}")


def image(df, name, k=0):
    rows = df.where(F.col("image_id") == k).collect()
    out = np.zeros((max(r.r for r in rows) + 1, max(r.c for r in rows) + 1))
    for r in rows:
        out[r.r, r.c] = r[name]
    return out


TWO = np.zeros((5, 5), np.int32)
TWO[1:3, 0:3], TWO[3:5, 0:3] = 1, 2


def test_two_touching_cells(spark):
    m = table(spark, [TWO], "label")
    p = masks.pixelwise(m, split_edges=True)
    assert image(p, "edge_cell").astype(int).tolist() == [[0] * 5, [0] * 5, [1, 1, 0, 0, 0], [1, 1, 0, 0, 0], [0] * 5]
    assert image(p, "edge_background").astype(int).tolist() == [[0] * 5, [1, 1, 1, 0, 0], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0], [0, 0, 1, 0, 0]]
    total = masks.pixelwise(m, 1).select((F.col("edge") + F.col("interior") + F.col("background")).alias("n")).distinct().collect()
    assert [r.n for r in total] == [1]
    d = image(masks.distance(m), "dist")
    zero = np.argwhere(TWO == 0)
    want = [[0 if TWO[r, c] == 0 else np.sqrt(((zero - [r, c]) ** 2).sum(axis=1)).min() for c in range(5)] for r in range(5)]
    assert np.allclose(d, want)
    assert image(masks.components(m), "component").tolist() == TWO.tolist()
    assert image(masks.outer_distance(m), "dist").max() == 1
    inner = image(masks.inner_distance(m), "inner")
    assert (inner[TWO == 0] == 0).all() and (inner[TWO > 0] > 0).all() and inner.max() <= 1


def test_anisotropic_distance_and_full_images(spark):
    m = table(spark, [(RNG.random((7, 9)) > 0.3).astype(np.int32), np.ones((3, 3), np.int32)], "label")
    a = image(m, "label")
    zero = np.argwhere(a == 0)
    d = image(masks.distance(m, (0.5, 2.0)), "dist")
    assert np.allclose(d, [[0 if a[r, c] == 0 else np.sqrt((((zero - [r, c]) * [0.5, 2.0]) ** 2).sum(axis=1)).min() for c in range(9)] for r in range(7)])
    assert masks.distance(m).where("image_id = 1 and dist is not null").count() == 0


def test_relabel_golden(spark):
    m = table(spark, [np.array([[0, 3, 5], [4, 99, 123]], np.int32)], "label")
    assert image(masks.relabel(m), "label").tolist() == [[0, 1, 3], [2, 4, 5]]
    with pytest.raises(ValueError, match="no mask transform"):
        masks.transform(m, "nothing")
    assert set(targets(m, ["fgbg", "pixelwise"])) == {"fgbg", "pixelwise"}


def test_window_bounds_and_split(spark):
    a = np.zeros((30, 30), np.int32)
    a[0, 0] = a[11, 11] = 1
    m = table(spark, [a], "v")
    assert [(r.r, r.c) for r in tables.sample_windows(m, 10).collect()] == [(11, 11)]
    assert tables.sample_windows(m, 10, "same").count() == 2
    with pytest.raises(ValueError):
        tables.sample_windows(m, 10, "other")
    n = tables.split(spark.range(100), ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"val": 21, "test": 5, "train": 74}
    with pytest.raises(ValueError):
        tables.split(spark.range(5), ["id"], 80, 20)


def test_tiles_pads_and_resizes(spark):
    a = RNG.random((11, 7))
    p = table(spark, [a], "v")
    for size, stride in ((4, None), (4, 3), (5, 2), (20, 9)):
        assert np.allclose(image(pixel.untile(pixel.tiles(p, size, stride)), "v"), a)
    assert np.allclose(image(pixel.reflect_pad(p, 3), "v"), np.pad(a, 3, mode="reflect"))
    assert np.allclose(image(pixel.trim(pixel.reflect_pad(p, 2), 2, 2), "v"), a)
    assert np.allclose(image(pixel.resize_bilinear(p, 11, 7), "v"), a)
    assert np.allclose(image(pixel.resize_nearest(p, 22, 14), "v"), a.repeat(2, 0).repeat(2, 1))
    assert np.allclose(image(augment.random_affine(p, 1), "v"), a)  # no movement is the identity


def test_watershed_and_contrast(spark):
    yy, xx = np.mgrid[:20, :20]
    two = np.exp(-((yy - 6) ** 2 + (xx - 6) ** 2) / 12) + np.exp(-((yy - 13) ** 2 + (xx - 13) ** 2) / 12)
    px = table(spark, [two], "maxima").withColumn("interior", F.col("maxima"))
    found = image(kernels.watershed(px), "label")
    assert set(np.unique(found)) == {0, 1, 2} and found[6, 6] != found[13, 13] and ((found > 0) == (two > 0.1)).all()
    flat = image(kernels.local_contrast(table(spark, [RNG.random((30, 25)), np.ones((4, 4))], "v"), tile=10), "v")
    assert -1 <= flat.min() and flat.max() <= 1 and flat.std() > 0.3


def test_applications(spark):
    px = table(spark, [RNG.random((17, 13)), np.zeros((4, 4))], "v")
    app = Segmentation(size=8)
    out = app(px)
    assert out.count() == 17 * 13 + 16 and out.where("image_id = 1 and label > 0").count() == 0
    both = compartments(px, {"whole": app, "nuclear": Segmentation(size=8, options={"peak": 0.3})})
    assert both.count() == 2 * out.count()
    with pytest.raises(ValueError):
        Segmentation(model=3)
    with pytest.raises(ValueError):
        app(px.drop("v"))
    assert box_model(np.ones((2, 3, 3)))["maxima"].shape == (2, 3, 3)


def test_zca_is_white(spark):
    x = RNG.normal(size=(200, 6)) @ RNG.normal(size=(6, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, px array<double>")
    y = np.array([r.px for r in augment.zca(df).collect()])
    assert np.allclose(np.cov(y.T, bias=True), np.eye(6), atol=1e-3)


def test_assignment_is_best():
    for n, m in ((1, 1), (3, 3), (3, 5), (4, 6)):
        cost = RNG.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = tracker.assign(cost)
        assert len(set(got.tolist())) == n and np.isclose(cost[np.arange(n), got].sum(), best)


def movie_rows():
    """Two tracks, one divides at t = 3, one is unseen at t = 2."""
    spots = {0: [(0, 0), (20, 0)], 1: [(1, 0), (20, 1)], 2: [(2, 0)], 3: [(2, 1.5), (2, -1.5), (20, 3)], 4: [(2, 3), (2, -3), (20, 4)]}
    return [("m", t, k, float(x), float(y), 1.0) for t, s in spots.items() for k, (x, y) in enumerate(s)]


SCHEMA = "movie string, t int, detection long, x double, y double, area double"


def test_tracker_and_stream(spark, tmp_path):
    rows = movie_rows()
    got = {(r.t, r.detection): (r.track, r.parent) for r in tracker.track(spark.createDataFrame(rows, SCHEMA)).collect()}
    a, b = got[0, 0][0], got[0, 1][0]
    assert got[2, 0] == (a, None) and got[3, 2] == (b, None) and got[4, 2] == (b, None)
    assert {got[3, 0], got[3, 1]} == {(a, None), (3, a)} and {got[4, 0][0], got[4, 1][0]} == {a, 3}
    for t in range(5):  # a stream that brings a frame at a time
        spark.createDataFrame([r for r in rows if r[1] == t], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.track_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.t, r.detection): (r.track, r.parent) for r in spark.table("tracked").collect()} == got
