"""Spatial and temporal graphs of cells: edges are rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.operators import near

FRAME = ["movie", "t"]


def _neighbours(cells: DataFrame, within: float, made, fields: dict[str, T.DataType]) -> DataFrame:
    """What `made` gives for each slice of cells (their rows and, in ascending order, pairs
    of a cell's number among them and a row nearer than `within`, itself too)."""

    def each(block: near.Block):
        for rows, one, two, _ in block.asked(lambda d2: np.sqrt(d2) < within):
            if len(one):
                yield made(block.table, rows, one, two)

    return near.run(near.dealt(cells, within, FRAME, ("x", "y")), within, FRAME, ("x", "y"), each, fields)


def _own(table, rows: np.ndarray, track: str) -> dict:
    return {**{k: table.column(k).take(pa.array(rows)) for k in FRAME}, track: table.column("track").take(pa.array(rows))}


def _types(cells: DataFrame, track: str) -> dict[str, T.DataType]:
    return {**{k: cells.schema[k].dataType for k in FRAME}, track: cells.schema["track"].dataType}


def adjacency(cells: DataFrame, within: float) -> DataFrame:
    """movie, t, i, j for cells of a frame nearer than `within`, each with itself too. Only
    cells are shuffled (near.dealt), and a frame of many cells is not compared with itself;
    a cell's neighbours are one row until they are returned."""

    def made(table, rows, one, two):
        return {**_own(table, rows, "i"), "j": near.lists(one, len(rows), table.column("track").combine_chunks().take(pa.array(two)))}

    e = cells.select(*FRAME, "track", "x", "y")
    return _neighbours(e, within, made, {**_types(cells, "i"), "j": T.ArrayType(cells.schema["track"].dataType)}).select(*FRAME, "i", F.explode("j").alias("j"))


def degrees(cells: DataFrame, within: float, *more: str) -> DataFrame:
    """movie, t, track, x, y, `more` and degree, how many cells are nearer than `within`."""
    names = ["x", "y", *more]

    def made(table, rows, one, two):
        return {**_own(table, rows, "track"), **{k: table.column(k).take(pa.array(rows)) for k in names}, "degree": pa.array(np.bincount(one, minlength=len(rows)))}

    fields = {**_types(cells, "track"), **{k: cells.schema[k].dataType for k in names}, "degree": T.LongType()}
    return _neighbours(cells.select(*FRAME, "track", *names), within, made, fields)


def _weight(table, rows: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    degree = table.column("degree").combine_chunks().to_numpy()
    return 1.0 / np.sqrt((degree[rows][one] * degree[two]).astype(float))


def normalized_adjacency(cells: DataFrame, within: float) -> DataFrame:
    """normalized(adjacency()), without a shuffle of edges: degrees are counted first, and
    go with the cells."""

    def made(table, rows, one, two):
        n, track = len(rows), table.column("track").combine_chunks()
        return {**_own(table, rows, "i"), "j": near.lists(one, n, track.take(pa.array(two))), "weight": near.lists(one, n, pa.array(_weight(table, rows, one, two)))}

    fields = {**_types(cells, "i"), "j": T.ArrayType(cells.schema["track"].dataType), "weight": T.ArrayType(T.DoubleType())}
    e = _neighbours(degrees(cells, within), within, made, fields)
    return e.select(*FRAME, "i", F.explode(F.arrays_zip("j", "weight")).alias("e")).select(*FRAME, "i", "e.j", "e.weight")


def neighbour_sums(cells: DataFrame, within: float, feature: str) -> DataFrame:
    """convolve() over normalized_adjacency(), without a shuffle of edges: a block sums up
    what is near its cells. Neighbours without a track take no part."""

    def made(table, rows, one, two):
        there = table.column("track").is_valid().combine_chunks().to_numpy(zero_copy_only=False)[two]
        one, two = one[there], two[there]
        value = table.column("_f").combine_chunks()
        known = value.is_valid().to_numpy(zero_copy_only=False)[two]
        terms = np.where(known, _weight(table, rows, one, two) * value.to_numpy(zero_copy_only=False)[two].astype(float), 0.0)
        some, first = np.unique(one, return_index=True)
        # in long doubles, so that the order of neighbours does not show
        total = np.add.reduceat(terms.astype(np.longdouble), first).astype(float) if len(some) else np.zeros(0)
        return {**_own(table, rows[some], "track"), feature: pa.array(total, mask=np.bincount(one, known, len(rows))[some] == 0)}

    e = degrees(cells.withColumn("_f", F.col(feature)), within, "_f")
    return _neighbours(e, within, made, {**_types(cells, "track"), feature: T.DoubleType()})


def normalized(edges: DataFrame) -> DataFrame:
    """Weights 1 / sqrt(degree of i * degree of j)."""
    own = lambda k: F.count("*").over(Window.partitionBy(*FRAME, k))
    return edges.withColumns({"_i": own("i"), "_j": own("j")}).select(*FRAME, "i", "j", (1.0 / F.sqrt((F.col("_i") * F.col("_j")).cast("double"))).alias("weight"))


def convolve(cells: DataFrame, edges: DataFrame, feature: str) -> DataFrame:
    """The weighted sum of a feature over each cell's neighbours."""
    other = cells.select(*FRAME, F.col("track").alias("j"), F.col(feature).alias("_f"))
    return edges.join(other, [*FRAME, "j"]).groupBy(*FRAME, F.col("i").alias("track")).agg(F.sum(F.col("weight") * F.col("_f")).alias(feature))


def same_edges(cells: DataFrame) -> DataFrame:
    """movie, t, track for tracks that are also in the next frame."""
    after = F.lead("t").over(Window.partitionBy("movie", "track").orderBy("t"))
    return cells.withColumn("_n", after).where(F.col("_n") == F.col("t") + 1).select(*FRAME, "track")


def daughter_edges(lineage: DataFrame) -> DataFrame:
    """movie, t, track, daughter at the last frame of the mother; not for movies that end
    there."""
    each = lineage.select("movie", F.col("last").alias("t"), "track", F.explode("daughters").alias("daughter"))
    ends = lineage.groupBy("movie").agg(F.max("last").alias("_end"))
    return each.join(ends, "movie").where(F.col("t") < F.col("_end")).drop("_end")


def pairs(cells: DataFrame) -> DataFrame:
    """Each cell with each of the next frame, and how far that is: movie, t, i, j, dx, dy."""
    after = cells.select("movie", (F.col("t") - 1).alias("t"), F.col("track").alias("j"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return cells.join(after, FRAME).select(*FRAME, F.col("track").alias("i"), "j", (F.col("_x") - F.col("x")).alias("dx"), (F.col("_y") - F.col("y")).alias("dy"))


def different_counts(cells: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """How many pairs of a frame and the next are neither the same track nor mother and
    daughter: counted from the frames' sizes, as the pairs are nearly all there are."""
    size = cells.groupBy(*FRAME).agg(F.count("*").alias("n"))
    after = size.select("movie", (F.col("t") - 1).alias("t"), F.col("n").alias("m"))
    same = same_edges(cells).groupBy(*FRAME).agg(F.count("*").alias("s"))
    e = size.join(after, FRAME).join(same, FRAME, "left")
    if lineage is not None:
        here = cells.select("movie", (F.col("t") - 1).alias("t"), F.col("track").alias("daughter"))
        born = daughter_edges(lineage).join(here, [*FRAME, "daughter"], "left_semi").groupBy(*FRAME).agg(F.count("*").alias("d"))
        e = e.join(born, FRAME, "left")
    else:
        e = e.withColumn("d", F.lit(0))
    return e.select(*FRAME, (F.col("n") * F.col("m") - F.coalesce("s", F.lit(0)) - F.coalesce("d", F.lit(0))).alias("different"))


def others(cells: DataFrame) -> DataFrame:
    """movie, t, track and the other tracks of its frame, sorted; none for a cell without a
    track. A frame's tracks are sorted once, and each cell takes what is before and after
    its own; the result grows with the square of a frame, and a task holds one frame."""
    everyone = cells.groupBy(*FRAME).agg(F.sort_array(F.collect_set("track")).alias("_all"))
    place = F.array_position("_all", F.col("track")).cast("int")
    rest = F.concat(F.slice("_all", F.lit(1), place - 1), F.slice("_all", place + 1, F.size("_all")))
    none = F.slice("_all", F.lit(1), F.lit(0))
    return cells.join(everyone, FRAME).select(*FRAME, "track", F.coalesce(rest, none).alias("different"))


def next_frame(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (movie, track, t) with the track's first frame after t, null without one: an
    as-of join by one window over both, instead of a range join."""
    both = cells.select("movie", "track", "t", F.lit(0).alias("_a")).unionByName(asked.select("movie", "track", "t", F.lit(1).alias("_a")))
    later = Window.partitionBy("movie", "track").orderBy("t").rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("next", F.min(F.when(F.col("_a") == 0, F.col("t"))).over(later)).where("_a = 1").drop("_a")


def daughter_first_frames(lineage: DataFrame) -> DataFrame:
    """movie, track, daughter and the daughter's first frame."""
    born = lineage.select("movie", F.col("track").alias("daughter"), F.col("first").alias("born"))
    return lineage.select("movie", "track", F.explode("daughters").alias("daughter")).join(born, ["movie", "daughter"])


def deltas(cells: DataFrame) -> DataFrame:
    """`cells` with dx, dy since the track's frame before; 0 at its first."""
    own = Window.partitionBy("movie", "track").orderBy("t")
    step = lambda k: F.coalesce(F.col(k) - F.lag(k).over(own), F.lit(0.0))
    return cells.withColumns({"dx": step("x"), "dy": step("y")})


def track_runs(cells: DataFrame) -> DataFrame:
    """Unbroken runs of each track: movie, track, first, last, frames."""
    own = Window.partitionBy("movie", "track").orderBy("t")
    island = cells.withColumn("_g", F.col("t") - F.row_number().over(own))
    return island.groupBy("movie", "track", "_g").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("frames")).drop("_g")


def rotate(cells: DataFrame, degrees: float) -> DataFrame:
    a, b = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return cells.withColumns({"x": F.col("x") * a + F.col("y") * b, "y": F.col("y") * a - F.col("x") * b})


def translate(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    return cells.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def concat_tracks(*tables: DataFrame) -> DataFrame:
    """Tracks of several sets in one, with `batch` telling them apart; rows are ragged, so
    nothing is padded."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("batch", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
