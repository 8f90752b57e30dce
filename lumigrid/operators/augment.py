"""Augmentation and standardization with draws that depend on key and seed alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.operators.pixel import EPSILON, IMAGE, extent
from lumigrid.operators.tables import draw, key_of


def uniform(key: Column, seed: int, low: float, high: float) -> Column:
    return F.lit(low) + (high - low) * draw(key, seed) / 2147483647


def drawn_zoom(key: Column, seed: int, zoom: float) -> Column:
    """The scale that random_affine() draws: what a model of scales learns."""
    return uniform(key, seed + 3, 1 - zoom, 1 + zoom)


def random_affine(px: DataFrame, seed: int, rotation: float = 0.0, shift: float = 0.0, zoom: float = 0.0, flip: bool = False, key: str = "image_id", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Each image turned, moved, scaled and perhaps flipped by its own draws, the nearest
    pixel for each place; places that show nothing become 0. Masks that go through with
    the same seed and key stay in step."""
    k = F.col(key).cast("long")
    e = extent(px, [key])
    size = e.groupBy(key).agg(F.max("h").alias("h"), F.max("w").alias("w"))
    angle, a, b = uniform(k, seed, -rotation, rotation) * (math.pi / 180), uniform(k, seed + 1, -shift, shift), uniform(k, seed + 2, -shift, shift)
    scale, mirror = drawn_zoom(k, seed, zoom), (draw(k, seed + 4) % 2 == 1) & F.lit(flip)
    places = size.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    y, x = F.col("r") - (F.col("h") - 1) / 2 - a, F.col("c") - (F.col("w") - 1) / 2 - b
    sr = (F.cos(angle) * y + F.sin(angle) * x) * scale + (F.col("h") - 1) / 2
    sc = (F.cos(angle) * x - F.sin(angle) * y) * scale + (F.col("w") - 1) / 2
    sc = F.when(mirror, F.col("w") - 1 - sc).otherwise(sc)
    wanted = places.select(key, "r", "c", F.round(sr).cast("int").alias("_r"), F.round(sc).cast("int").alias("_c"))
    source = px.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), *values)
    out = wanted.join(source, [key, "_r", "_c"], "left")
    return out.select(key, "r", "c", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def random_crop(px: DataFrame, height: int, width: int, seed: int, key: str = "image_id") -> DataFrame:
    """A drawn part of each image, inclusive of the last place; whole if it is no larger."""
    k = F.col(key).cast("long")
    at = lambda n, size, s: draw(k, s) % F.greatest(F.col(n) - size + 1, F.lit(1))
    e = extent(px, [key]).withColumns({"_r": at("h", height, seed), "_c": at("w", width, seed + 1)})
    e = e.where((F.col("r") >= F.col("_r")) & (F.col("r") < F.col("_r") + height) & (F.col("c") >= F.col("_c")) & (F.col("c") < F.col("_c") + width))
    return e.withColumns({"r": (F.col("r") - F.col("_r")).cast("int"), "c": (F.col("c") - F.col("_c")).cast("int")}).drop("_r", "_c", "h", "w")


def brightness(px: DataFrame, low: float, high: float, seed: int, key: str = "image_id") -> DataFrame:
    return px.withColumn("v", F.col("v") * uniform(F.col(key).cast("long"), seed, low, high))


def standardize(px: DataFrame, rescale: float | None = None, center: bool = False, spread: bool = False, by: list[str] = IMAGE) -> DataFrame:
    """Rescaled, then less the mean of its channels, over their spread, pixel by pixel."""
    own = Window.partitionBy(*by, "r", "c")
    if rescale:
        px = px.withColumn("v", F.col("v") * rescale)
    if center:
        px = px.withColumn("v", F.col("v") - F.avg("v").over(own))
    if spread:
        px = px.withColumn("v", F.col("v") / (F.stddev_pop("v").over(own) + EPSILON))
    return px


def zca(blocks: DataFrame, epsilon: float = 1e-6, column: str = "px") -> DataFrame:
    """Block images whitened: less the mean, times the inverse root of the covariance. Each
    task sums products of its rows to one row; the driver sees features squared, never
    images."""
    n = len(blocks.select(column).first()[0])

    def sums(batches):
        total, outer, count = np.zeros(n), np.zeros((n, n)), 0
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b[column]])
                total, outer, count = total + x.sum(axis=0), outer + x.T @ x, count + len(x)
        yield pd.DataFrame({"count": [count], "total": [total.tolist()], "outer": [outer.reshape(-1).tolist()]})

    parts = blocks.select(column).mapInPandas(sums, "count long, total array<double>, outer array<double>")
    add = lambda name: parts.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    count = parts.agg(F.sum("count")).first()[0]
    mean = np.array([r.x for r in add("total")]) / count
    cov = np.array([r.x for r in add("outer")]).reshape(n, n) / count - np.outer(mean, mean)
    u, s, _ = np.linalg.svd(cov)
    turn = (u / np.sqrt(s + epsilon)) @ u.T

    def apply(batches):
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b[column]])
                b[column] = list((x - mean) @ turn)
            yield b

    return blocks.mapInPandas(apply, blocks.schema)


def siamese_pairs(cells: DataFrame, lineage: DataFrame, seed: int) -> DataFrame:
    """For each track a pair to compare, its kind drawn among same, different and division:
    kind, movie, track, t, other, other_t. A kind that a track cannot give falls back to
    different, then to same. The tracks of a frame are numbered and the drawn number is
    joined, so no frame is gathered. Draws depend on the names of movie and track."""
    track = cells.groupBy("movie", "track").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    drawn = track.withColumn("_k", key_of(F.col("movie"), F.col("track"))).withColumn("_d", draw(F.col("_k"), seed) % 3)
    kids = lineage.where("daughters is not null").select("movie", "track", F.get("daughters", F.lit(0)).alias("daughter"))
    born = track.select("movie", F.col("track").alias("daughter"), F.col("first").alias("born"))
    drawn = drawn.join(kids.join(born, ["movie", "daughter"]), ["movie", "track"], "left").withColumn("t", F.col("last"))
    frame = Window.partitionBy("movie", "t")
    placed = cells.select("movie", "t", "track").distinct()
    placed = placed.withColumns({"_place": F.row_number().over(frame.orderBy("track")) - 1, "_n": F.count("*").over(frame) - 1})
    drawn = drawn.join(placed, ["movie", "t", "track"]).withColumn("_to", draw(F.col("_k"), seed + 1) % F.greatest("_n", F.lit(1)))
    drawn = drawn.withColumn("_to", F.col("_to") + F.when(F.col("_to") >= F.col("_place"), 1).otherwise(0))  # past the track itself
    other = placed.select("movie", "t", F.col("_place").cast("long").alias("_to"), F.col("track").alias("_other"))
    kind = F.when((F.col("_d") == 2) & F.col("daughter").isNotNull(), "division").when((F.col("_d") != 0) & F.col("_other").isNotNull(), "different").otherwise("same")
    out = drawn.join(other, ["movie", "t", "_to"], "left").withColumn("kind", kind)
    pick = lambda a, b, c: F.when(F.col("kind") == "division", a).when(F.col("kind") == "different", b).otherwise(c)
    return out.select("kind", "movie", "track", "t", pick(F.col("daughter"), F.col("_other"), F.col("track")).alias("other"), pick(F.col("born"), F.col("t"), F.col("first")).alias("other_t"))
