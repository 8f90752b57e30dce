"""Crops, affine maps and pictures of cells against plain loops, on images of several sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import affine, appearance, crops
from lumigrid.queries.windows import blur


def table(spark, images, extra=""):
    rows = [(k, r, c, float(v)) for k, a in images.items() for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, r int, c int, v double").repartition(3)


def arrays(rows, value, shapes):
    out = {k: np.full(s, np.nan) for k, s in shapes.items()}
    for x in rows:
        assert np.isnan(out[x.image_id][x.r, x.c])  # each pixel once
        out[x.image_id][x.r, x.c] = x[value]
    return out


@pytest.fixture(scope="module")
def images():
    draw = np.random.default_rng(1)
    return {k: draw.normal(size=s) for k, s in enumerate([(12, 12), (12, 24), (5, 7), (1, 4), (36, 12)])}


@pytest.mark.parametrize("padding", ["reflect", "zero"])
def test_crops_do_not_matter(spark, images, padding):
    px = table(spark, images)
    shapes = {k: a.shape for k, a in images.items()}
    for n in (1, 2, 3, 4):
        got = arrays(crops.whole_image(px, blur, ("mean", "top"), n, 5, padding).collect(), "mean", shapes)
        for k, a in images.items():
            wide = np.pad(a, 2, mode="reflect") if padding == "reflect" else np.pad(a, 2)
            want = blur(wide[None])["mean"][0, 2:-2, 2:-2]
            h, w = (s // n * n for s in a.shape)
            want[h:], want[:, w:] = 0, 0
            if not (h and w):
                want[:] = 0
            assert np.allclose(got[k], want)


def test_margin_wider_than_the_image(spark, images):
    """Mirrored again and again, as often as it takes."""
    px = table(spark, {2: images[2], 3: images[3]})
    got = crops.halo_crops(px, 1, 61).collect()
    for k in (2, 3):
        wide = np.pad(images[k], 30, mode="reflect")
        made = np.full(wide.shape, np.nan)
        for x in got:
            if x.image_id == k:
                assert np.isnan(made[x.r, x.c]) and (x.h, x.w) == wide.shape
                made[x.r, x.c] = x.v
        assert np.array_equal(made, wide)


def test_models_of_both_kinds(spark, images):
    px = table(spark, {0: images[0]})
    inner = lambda x: {"mean": x[:, 1:-1, 1:-1]}
    got = arrays(crops.whole_image(px, inner, ("mean",), 3, 3).collect(), "mean", {0: (12, 12)})
    assert np.array_equal(got[0], images[0])
    with pytest.raises(ValueError):
        crops.halo_crops(px, padding="same")
    with pytest.raises(Exception, match="without its margin"):
        crops.whole_image(px, lambda x: {"mean": x[:, :3, :3]}, ("mean",), 3, 5).collect()
    assert crops.whole_image(px.limit(0), inner, ("mean",), 3, 3).count() == 0


def plain_warp(a, m, order, fill, cval):
    h, w = a.shape

    def at(i, n):
        if fill == "reflect":
            i %= 2 * n
            return i if i < n else 2 * n - 1 - i
        return i % n if fill == "wrap" else min(max(i, 0), n - 1)

    out = np.empty(a.shape)
    for r in range(h):
        for c in range(w):
            y, x = r - (h - 1) / 2, c - (w - 1) / 2
            sr, sc = m[0] * y + m[1] * x + m[4] + (h - 1) / 2, m[2] * y + m[3] * x + m[5] + (w - 1) / 2
            if fill == "constant" and not (0 <= sr <= h - 1 and 0 <= sc <= w - 1):
                out[r, c] = cval
            elif order == 0:
                out[r, c] = a[at(math.floor(sr + 0.5), h), at(math.floor(sc + 0.5), w)]
            else:
                i, j = math.floor(sr), math.floor(sc)
                out[r, c] = sum(a[at(i + p, h), at(j + q, w)] * (1 - abs(sr - i - p)) * (1 - abs(sc - j - q)) for p in (0, 1) for q in (0, 1))
    return out


@pytest.mark.parametrize("fill", affine.FILLS)
def test_affine(spark, images, fill):
    """Sizes mixed in a batch, masks by the nearest pixel with the same map, null arrays."""
    rows = [(k, *a.shape, a.reshape(-1).tolist(), (a.reshape(-1) > 0).astype(int).tolist()) for k, a in images.items()]
    rows.append((9, 2, 2, None, [1, 2, 3, 4]))
    blocks = spark.createDataFrame(rows, "image_id long, h int, w int, px array<double>, mask array<int>").coalesce(1)
    drawn = affine.drawn(blocks, F.col("image_id"), 5, 180, 0.4, 3, 30, (0.5, 1.5), True, True)
    maps = {r.image_id: [r[n] for n in affine.MAP] for r in drawn.collect()}
    got = {r.image_id: r for r in affine.apply(drawn, {"px": 1, "mask": 0}, fill, 7).collect()}
    assert got[9].px is None and set(got[9].asDict()) == {"image_id", "h", "w", "px", "mask"}
    for k, a in images.items():
        assert np.allclose(np.reshape(got[k].px, a.shape), plain_warp(a, maps[k], 1, fill, 7))
        assert np.array_equal(np.reshape(got[k].mask, a.shape), plain_warp((a > 0).astype(float), maps[k], 0, fill, 7))


def test_maps(spark):
    """No draw leaves an image alone; keys of names draw apart; frames by movie alike."""
    blocks = spark.createDataFrame([(f"purchase/{m}", t, 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for m in range(3) for t in range(2)], "movie string, t int, h int, w int, px array<double>")
    still = affine.apply(affine.drawn(blocks, affine.key_of(F.col("movie")), 1), {"px": 1}, "constant")
    assert still.where(F.col("px") != F.array(*[F.lit(float(v)) for v in range(1, 7)])).count() == 0
    by_movie = affine.drawn(blocks, affine.key_of(F.col("movie")), 1, rotation=90)
    assert by_movie.groupBy("movie").agg(F.count_distinct("m_rc").alias("n")).where("n > 1").count() == 0 and by_movie.select("m_rc").distinct().count() == 3
    assert affine.drawn(blocks, affine.key_of(F.col("movie"), F.col("t")), 1, rotation=90).select("m_rc").distinct().count() == 6
    with pytest.raises(ValueError):
        affine.apply(blocks, {"px": 1}, "mirror")
    with pytest.raises(ValueError):
        affine.apply(blocks, {"px": 3})


def plain_line(values, size):
    """A line smoothed, then read between its centres, one number at a time."""
    n = len(values)
    spread = max(0.0, (n / size - 1) / 2)
    reach = int(4 * spread + 0.5)
    if reach:
        bell = [math.exp(-0.5 * (k / spread) ** 2) for k in range(-reach, reach + 1)]
        values = [sum(b / sum(bell) * values[i + k] for k, b in zip(range(-reach, reach + 1), bell) if 0 <= i + k < n) for i in range(n)]
    out = []
    for i in range(size):
        p = (i + 0.5) * n / size - 0.5
        low = math.floor(p)
        out.append(sum(values[q] * (1 - abs(p - q)) for q in (low, low + 1) if 0 <= q < n))
    return out


def plain_picture(a, size):
    rows = np.array([plain_line(list(x), size) for x in a])
    return np.array([plain_line(list(x), size) for x in rows.T]).T


@pytest.fixture(scope="module")
def cells(spark, images):
    a = np.abs(images[4][:20]) + 1
    label = np.zeros((20, 12), int)
    label[0:9, 0:5], label[12:14, 3:12], label[19, 11] = 1, 2, 3
    rows = [(m, t, r, c, int(label[r, c]), float(a[r, c] * (t + 1))) for m in (1, 2) for t in (0, 1) for r in range(20) for c in range(12)]
    return a, label, spark.createDataFrame(rows, "movie long, t int, r int, c int, label int, v double")


BY = ["movie", "t"]


def boxes_of(label):
    for k in (1, 2, 3):
        r, c = np.nonzero(label == k)
        yield k, r, c


def test_appearances(cells):
    a, label, px = cells
    for size in (3, 8):
        got = {(x.movie, x.t, x.label): np.reshape(x.patch, (size, size)) for x in appearance.appearances(px, size, BY).collect()}
        assert len(got) == 12
        for k, r, c in boxes_of(label):
            want = plain_picture(a[r.min() : r.max() + 1, c.min() : c.max() + 1], size)
            assert np.allclose(got[1, 0, k], want) and np.allclose(got[2, 1, k], 2 * want)


def test_fixed_and_neighbourhoods(cells):
    a, label, px = cells
    wide, where = np.pad(a, 40), np.pad(label, 40)
    fixed = {x.label: np.reshape(x.patch, (6, 6)) for x in appearance.appearances(px, 6, BY, "fixed", True).where("movie = 1 and t = 0").collect()}
    plain = {x.label: np.reshape(x.patch, (6, 6)) for x in appearance.appearances(px, 6, BY, "fixed").where("movie = 1 and t = 0").collect()}
    near = {x.label: np.reshape(x.patch, (5, 5)) for x in appearance.neighbourhoods(px, 8, 2, BY).where("movie = 1 and t = 0").collect()}
    later = {(x.t, x.label): np.reshape(x.patch, (5, 5)) for x in appearance.future_areas(px, 8, 2, BY).where("movie = 1").collect()}
    assert {t for t, _ in later} == {0}
    for k, r, c in boxes_of(label):
        y, x = math.floor(r.mean()) + 40, math.floor(c.mean()) + 40
        cut, own = wide[y - 3 : y + 3, x - 3 : x + 3], where[y - 3 : y + 3, x - 3 : x + 3] == k
        assert np.allclose(plain[k], cut)
        spread = cut[own].std()
        assert np.allclose(fixed[k], np.where(own, (cut - cut[own].mean()) / (spread or 1), 0) if spread else 0)
        assert np.allclose(near[k], plain_picture(wide[y - 8 : y + 8, x - 8 : x + 8], 5))
        assert np.allclose(later[0, k], 2 * near[k])
    with pytest.raises(ValueError):
        appearance.appearances(px, 5, BY, "fixed")
    with pytest.raises(ValueError):
        appearance.appearances(px, 4, BY, "other")


def test_features_and_no_cells(cells):
    _, _, px = cells
    rows = appearance.features(px, 4, BY).collect()
    assert len(rows) == 12 and {r.area for r in rows} == {45, 18, 1} and all(len(r.patch) == 16 for r in rows)
    assert appearance.features(px.withColumn("label", F.lit(0)), 4, BY).count() == 0
