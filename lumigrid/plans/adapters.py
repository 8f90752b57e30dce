"""Tables of a star schema seen as images, masks, movies and cells.

Forms that the operators take:

* block: ``image_id, h, w, px array<double>``, row-major, one row for each image
* pixel: ``image_id, r, c, v``; with more keys (``t``, ``ch``) for movies and channels
* mask: ``image_id, r, c, label``; 0 is background
* cell: ``movie, track, t, x, y, area``; lineage: ``movie, track, first, last, daughters``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    side = F.lit(SIDE)
    return e.select(F.col("vec_id").alias("image_id"), side.alias("h"), side.alias("w"), F.col("embedding").cast("array<double>").alias("px"), F.col("label").alias("class"))


def pixels(images: DataFrame) -> DataFrame:
    """A row for each pixel of block images."""
    p = images.select("image_id", "w", F.posexplode("px").alias("i", "v"))
    return p.select("image_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("r"), (F.col("i") % F.col("w")).cast("int").alias("c"), "v")


def blocks_of(px: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Block images of whole pixel tables: by, h, w, px. An image is a row of the result."""
    held = F.array_sort(F.collect_list(F.struct("r", "c", F.col(value).alias("v"))))
    e = px.groupBy(*by).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), held.alias("_p"))
    return e.select(*by, "h", "w", F.col("_p.v").alias("px"))


def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(blocks(spark, sf_dir))


def mask_table(spark: SparkSession, sf_dir: str, above: float = 0.05) -> DataFrame:
    """Quadrants of bright pixels as four instances."""
    p = pixel_table(spark, sf_dir)
    quadrant = 1 + F.floor(F.col("r") / 4) * 2 + F.floor(F.col("c") / 4)
    return p.select("image_id", "r", "c", F.when(F.col("v") > above, quadrant).otherwise(0).cast("int").alias("label"))


def movie_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a class in order, as frames: movie, t, image_id."""
    own = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("movie"), (F.row_number().over(own) - 1).alias("t"), F.col("vec_id").alias("image_id"))


def cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a type and day as a cell: where it is and how large. Values are
    added in the order of events, as the last digit of a mean depends on it, and strict
    bounds on distances on that."""
    e = read(spark, sf_dir, "events")
    values = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))))
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v["value"]), F.count("value"))
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    return e.groupBy(F.col("event_type").alias("movie"), F.col("user_id").alias("track"), day.alias("t")).agg(
        mean.alias("x"), F.avg(F.hour("ts").cast("double")).alias("y"), F.count("*").alias("area")
    )


def generation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells: thirty days of an event type are a movie, and a user is another track in
    each ten days of it. Users 2p and 2p+1 of the next ten days are daughters of user p."""
    c = cell_table(spark, sf_dir)
    span = c.agg(F.min("t").alias("_t0"), (F.max("track") + 1).alias("_w"))  # one row
    age = F.col("t") - F.col("_t0")
    movie = F.concat(F.col("movie"), F.lit("/"), F.floor(age / 30))
    track = F.col("track") + F.col("_w") * F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.floor(age / 10) % 3 + 1).cast("int"))
    return c.join(F.broadcast(span)).withColumns({"movie": movie, "track": track}).drop("_t0", "_w")


def lineage_table(cells: DataFrame) -> DataFrame:
    """Tracks with their first and last frame; tracks 2p and 2p+1 that both begin after p
    has ended are its daughters."""
    tracks = cells.groupBy("movie", "track").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    child = tracks.select(F.col("movie").alias("_m"), F.floor(F.col("track") / 2).cast("long").alias("parent"), F.col("track").alias("daughter"), F.col("first").alias("born"))
    pair = tracks.join(child, (F.col("movie") == F.col("_m")) & (F.col("track") == F.col("parent")) & (F.col("born") > F.col("last"))).select("movie", "track", "daughter")
    both = pair.groupBy("movie", "track").agg(F.sort_array(F.collect_list("daughter")).alias("daughters")).where(F.size("daughters") == 2)
    return tracks.join(both, ["movie", "track"], "left")
