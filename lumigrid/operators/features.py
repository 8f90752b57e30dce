"""Tables of features of tracked cells: cleaned, padded, and as sparse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short names of features that a sink uses, and which of them are inputs; fixed values.
NAMES = {"app": "appearances", "cent": "centroids", "morph": "morphologies", "adj": "adj_matrices", "temp_adj": "temporal_adj_matrices"}
INPUTS = ("app", "cent", "morph", "adj")


def known(edges: DataFrame, lineage: DataFrame, columns: tuple[str, ...] = ("track",)) -> DataFrame:
    """The rows whose tracks (in each of `columns`) have a lineage in their movie."""
    names = lineage.select("movie", "track").distinct()
    for c in columns:
        edges = edges.join(names.withColumnRenamed("track", c), ["movie", c], "left_semi")
    return edges


def linked_frames(cells: DataFrame, same: DataFrame) -> DataFrame:
    """The cells of frames from which a track goes on."""
    return cells.join(same.select("movie", "t").distinct(), ["movie", "t"], "left_semi")


def padded(cells: DataFrame, most: int, features: tuple[str, ...]) -> DataFrame:
    """A row for each place 1..most of each frame: the cells of the frame by their place,
    and zeros for places that have none. Cells beyond the last place are an error of the
    caller and stay as they are."""
    places = cells.select("movie", "t").distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(most))))
    out = places.join(cells, ["movie", "t", "place"], "full")
    return out.select("movie", "t", "place", *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in features])


def sparse(rows: DataFrame, by: list[str], axes: tuple[str, ...], value: str) -> DataFrame:
    """One row for each `by` with what is not zero, in the order of its coordinates: val and
    for each axis ind_<axis>, all arrays."""
    held = F.array_sort(F.collect_list(F.struct(*axes, F.col(value).alias("val"))))
    e = rows.where(F.col(value) != 0).groupBy(*by).agg(held.alias("_h"))
    return e.select(*by, F.col("_h.val").alias("val"), *[F.col(f"_h.{a}").alias(f"ind_{a}") for a in axes])


def batch_of(sparse_rows: DataFrame, batch: str, which: int) -> DataFrame:
    """One batch of sparse rows, without its coordinate."""
    return sparse_rows.where(F.col(batch) == which).drop(batch)


def routed(df: DataFrame, keys: tuple[str, ...] = (), names: dict[str, str] = NAMES, inputs: tuple[str, ...] = INPUTS) -> DataFrame:
    """The keys, and features by their full names in two structs: x of the inputs and y of
    the targets. A column that is neither a key nor a known short name is an error; so is
    a table without an input or a target."""
    short = [c for c in df.columns if c not in keys]
    unknown = [c for c in short if c not in names]
    if unknown:
        raise ValueError(f"no feature has the short name {', '.join(unknown)}; there are {', '.join(names)}")
    pick = lambda wanted: [F.col(c).alias(names[c]) for c in short if (c in inputs) == wanted]
    if not pick(True) or not pick(False):
        raise ValueError("there must be an input and a target")
    return df.select(*keys, F.struct(*pick(True)).alias("x"), F.struct(*pick(False)).alias("y"))


def largest_shape(cells: DataFrame) -> DataFrame:
    """What a batch of all movies needs: movies, and the most frames and cells of a frame."""
    per = cells.groupBy("movie", "t").agg(F.count("*").alias("n")).groupBy("movie").agg(F.count("*").alias("t"), F.max("n").alias("n"))
    return per.agg(F.count("*").alias("movies"), F.max("t").alias("frames"), F.max("n").alias("cells"))


def unmerged(df: DataFrame, index: str, length: int) -> DataFrame:
    """`df` with batch and t of an index that was made by merging batches of `length`."""
    return df.withColumns({"batch": F.floor(F.col(index) / length), "t": F.col(index) % length})


def merged_options(defaults: Column, own: Column) -> Column:
    """Options as a map: the caller's own where given, defaults otherwise."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)
