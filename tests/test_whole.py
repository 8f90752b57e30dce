"""Queries over whole tables lose no rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumigrid import catalog
from lumigrid.operators import masks, tables

SF = "/root/testdata/sf0.01"  # more than twelve images of a class


@pytest.mark.parametrize("name", ["outer_distance_3d", "inner_distance_3d", "erode_edges_3d"])
def test_every_image_is_in_a_stack(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    images = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert df.count() == df.select("stack", "z", "r", "c").distinct().count() == 64 * images
    assert df.where("z not between 0 and 11").count() == 0


def test_positions_of_a_large_table(spark):
    """More rows than range sampling looks at, and a column that positions do not need."""
    rows = spark.range(0, 2_000_000, 1, 9).select((F.col("id") * 7919 % 2_000_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
    got = tables.number(rows, ["k"], "place")
    assert got.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first() == (2_000_000, 0, 1_999_999)
    ends = got.select("place", "k", F.lag("k").over(Window.partitionBy(F.floor(F.col("place") / 50_000)).orderBy("place")).alias("before"))
    assert ends.where("before >= k").count() == 0


def test_distances_of_a_large_image(spark):
    """A mask of 512 x 512 pixels, which rows for each pair of a line would not fit."""
    side = 512
    mask = spark.range(side * side).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    hole = (F.col("r") == 100) & (F.col("c") == 37)
    far = masks.distance(mask.withColumn("label", F.when(hole, 0).otherwise(1)))
    want = F.sqrt(F.pow(F.col("r") - 100, 2) + F.pow(F.col("c") - 37, 2))
    assert far.count() == side * side and far.where(F.abs(F.col("dist") - want) > 1e-9).count() == 0
    winding = (F.col("r") % 2 == 0) | ((F.col("r") % 4 == 1) & (F.col("c") == side - 1)) | ((F.col("r") % 4 == 3) & (F.col("c") == 0))
    found = masks.components(mask.withColumn("label", winding.cast("int")))
    assert found.agg(F.max("component")).first()[0] == 1


def test_every_event_is_in_a_lineage(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    days = events.groupBy("event_type", "user_id", events.ts.cast("date")).count().count()
    assert catalog.QUERIES["track_stats"](spark, SF).agg({"cells": "sum"}).first()[0] == days
    found = catalog.QUERIES["lineages"](spark, SF)
    users = events.agg({"user_id": "max"}).first()[0] + 1
    assert found.where(f"daughters is not null and track % {users} >= 64").count() > 0
    assert catalog.QUERIES["invalid_lineages"](spark, SF).where("movie like 'view/%'").count() > 0
