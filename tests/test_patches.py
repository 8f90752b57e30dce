"""Patches of boxes that lie on several tiles and beyond the border."""

import random

from pyspark.sql import functions as F

from lumigrid.operators import appearance


def test_patches_by_tiles(spark):
    draw = random.Random(6)
    px = spark.range(2 * 70 * 40).select((F.floor(F.col("id") / 2800) + 1).alias("image_id"), F.floor(F.col("id") / 40 % 70).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"), (F.col("id") * 0.5).alias("v"))
    pixels = {(i, r, c): ((i - 1) * 2800 + r * 40 + c) * 0.5 for i in (1, 2) for r in range(70) for c in range(40)}
    boxes = [(i, k, draw.randrange(-40, 70), draw.randrange(-40, 40), draw.choice([1, 7, 33, 90]), draw.choice([1, 5, 64])) for i in (1, 2) for k in range(12)]
    got = appearance.patches(px, spark.createDataFrame(boxes, "image_id long, label int, r0 int, c0 int, h int, w int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # pixels do not go through the driver
    found = {(g.image_id, g.label): sorted(zip(g.r, g.c, g.v)) for g in got.collect()}
    want = {}
    for i, k, r0, c0, h, w in boxes:
        inside = sorted((r - r0, c - c0, v) for (j, r, c), v in pixels.items() if i == j and r0 <= r < r0 + h and c0 <= c < c0 + w)
        if inside:
            want[i, k] = inside
    assert found == want


def test_pictures_in_small_batches(spark, monkeypatch):
    cells = spark.range(300).select((F.col("id") % 60).alias("image_id"), (F.col("id") / 60).cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1).alias("label"), F.col("id").cast("double").alias("v")).coalesce(1)
    whole = {r.image_id: r.patch for r in appearance.appearances(cells, 4).collect()}
    monkeypatch.setattr(appearance, "VALUES", 48)
    assert {r.image_id: r.patch for r in appearance.appearances(cells, 4).collect()} == whole and len(whole) == 60
