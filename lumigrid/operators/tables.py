"""Filters, sampling, splits, aggregates and joins over object tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.operators.pixel import IMAGE

def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder, which executors share. Only where none is
    set and the master is local, as in tests, a temporary folder takes its place."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumigrid-"))
    return df.checkpoint()


# ---- draws -------------------------------------------------------------------------


def draw(key: Column | tuple[tuple[Column, int], ...], seed: int) -> Column:
    """A number that depends on key and seed alone, in any engine with 64-bit integers;
    the product makes draws of different seeds independent. A key can also be a sum, as
    columns with their factors. The product with 2654435761 is taken by halves of that
    number, as 64 bits may not hold it; keys below zero or beyond 64 bits take decimals."""
    terms = key if isinstance(key, tuple) else ((key, 1),)
    small, large = F.lit(0).cast("long"), F.lit(0).cast("decimal(20,0)")
    for column, factor in terms:
        small = F.try_add(small, F.try_multiply(column.cast("long"), F.lit(factor)))
        large = (large + column.cast("decimal(20,0)") * F.lit(factor)).cast("decimal(28,0)")
    at, rest = F.lit(seed * 40503 + 1), small % F.lit(4294967296)
    halves = (rest * F.lit(2654435761 >> 16) % F.lit(65536) * F.lit(65536) + rest * F.lit(2654435761 & 65535) + at) % F.lit(4294967296)
    x = F.when(small >= 0, halves).otherwise(((large * F.lit(2654435761) + at) % F.lit(4294967296)).cast("long"))
    return (x % F.lit(2147483647)) * (x % F.lit(2147483629)) % F.lit(2147483647)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """`df` with `place`, the position (from 0) in a random order."""
    parts = df.withColumn("_d", draw(F.col(key), seed))
    return number(parts, ["_d", key], "place").drop("_d")


def number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with its position from 0 in a total order, without one task that holds all:
    rows are dealt by ranges, numbered within them, and moved by the sizes of the ranges
    before. The sizes are one row for each range. The dealt rows are checkpointed, as rows
    dealt anew for the sizes could fall into other ranges."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    # the id has the partition in its high bits and the row's place in it in the low 33
    dealt = checkpointed(dealt.withColumn("_p", F.shiftright("_m", 33)).withColumn("_n", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))
    sizes = dealt.groupBy("_p").agg((F.max("_n") + 1).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_n") + F.col("_before")).drop("_p", "_n", "_before")


def split(df: DataFrame, order: list[str], val: int = 20, test: int = 5) -> DataFrame:
    """`df` with split by position modulo 100: val takes the residues 0..val, test the
    `test` after them, train the rest. val + test must be below 100."""
    if val + test >= 100:
        raise ValueError("val and test must leave something to train on")
    rest = F.col("_i") % 100
    return number(df, order, "_i").withColumn("split", F.when(rest <= val, "val").when(rest <= val + test, "test").otherwise("train")).drop("_i")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """`df` with batch, the number of its mini-batch."""
    return number(df, order, "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def trim_to_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The rows of whole batches."""
    n = df.count()
    return number(df, order, "_i").where(F.col("_i") < n - n % size).drop("_i")


def class_balance(df: DataFrame, batch: str, label: str, key: str, seed: int, cap: int | None = None) -> DataFrame:
    """As many rows of each class of a batch as its rarest class has (and `cap` at most),
    drawn by key and seed."""
    per = Window.partitionBy(batch, label)
    counts = df.groupBy(batch, label).agg(F.count("*").alias("_k")).groupBy(batch).agg(F.min("_k").alias("_k"))
    drawn = df.withColumn("_n", F.row_number().over(per.orderBy(draw(F.col(key), seed), key))).join(counts, batch)
    most = F.least("_k", F.lit(cap)) if cap else F.col("_k")
    return drawn.where(F.col("_n") <= most).drop("_n", "_k")


def sample_windows(mask: DataFrame, half: int, padding: str = "valid", most: int | None = None, seed: int = 0, by: list[str] = IMAGE) -> DataFrame:
    """Places of set pixels of a class mask (v = 1): by, r, c. "valid" wants the window of
    2 * half + 1 strictly inside. At most `most` are drawn."""
    own = Window.partitionBy(*by)
    e = mask.withColumns({"_h": F.max("r").over(own) + 1, "_w": F.max("c").over(own) + 1}).where("v = 1")
    if padding == "valid":
        e = e.where((F.col("r") - half > 0) & (F.col("r") + half < F.col("_h")) & (F.col("c") - half > 0) & (F.col("c") + half < F.col("_w")))
    elif padding != "same":
        raise ValueError("padding is 'valid' or 'same'")
    e = e.drop("_h", "_w")
    if most is None:
        return e
    key = ((F.col(by[0]), 1_000_003), (F.col("r"), 1009), (F.col("c"), 1))
    return e.orderBy(draw(key, seed), *by, "r", "c").limit(most)


def key_of(*columns: Column) -> Column:
    """A number for one or more keys of any type, by 28 bits of the digest of their text;
    names that differ anywhere draw differently. A null key is the empty text."""
    text = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def temporal_slice(frames: DataFrame, length: int, seed: int, movie: str = "movie") -> DataFrame:
    """A run of `length` frames of each movie (a key of any type), its start drawn; whole if
    shorter. t begins at 0 again."""
    ends = frames.groupBy(movie).agg(F.max("t").alias("_last"))
    start = ends.withColumn("_s", draw(key_of(F.col(movie)), seed) % F.greatest(F.col("_last") + 2 - length, F.lit(1)))
    cut = frames.join(start, movie).where((F.col("t") >= F.col("_s")) & (F.col("t") < F.col("_s") + length))
    return cut.withColumn("t", F.col("t") - F.col("_s")).drop("_s", "_last")


def placed(cells: DataFrame) -> DataFrame:
    """`cells` with place, their number in their frame from 1 by track."""
    return cells.withColumn("place", F.row_number().over(Window.partitionBy("movie", "t").orderBy("track")))


def sample_volumes(mask: DataFrame, half: int, half_t: int, movie: str = "movie", padding: str = "valid", most: int | None = None, seed: int = 0) -> DataFrame:
    """Places of set pixels of movies (v = 1): movie, t, r, c. "valid" wants the window of
    2 * half + 1 pixels and 2 * half_t + 1 frames strictly inside, "same" takes all. At most
    `most` are drawn."""
    if padding not in ("valid", "same"):
        raise ValueError("padding is 'valid' or 'same'")
    e = mask.where("v = 1")
    if padding == "valid":
        ends = mask.groupBy(movie).agg(*[(F.max(a) + 1).alias(f"_{a}") for a in ("t", "r", "c")])
        e = e.join(ends, movie)
        for a, n in (("t", half_t), ("r", half), ("c", half)):
            e = e.where((F.col(a) - n > 0) & (F.col(a) + n < F.col(f"_{a}")))
    e = e.select(movie, "t", "r", "c")
    if most is None:
        return e
    return e.orderBy(draw(key_of(F.col(movie), F.col("t"), F.col("r"), F.col("c")), seed), movie, "t", "r", "c").limit(most)


def random_frames(tracks: DataFrame, k: int, seed: int, frames: str = "frames") -> DataFrame:
    """k drawn frames of each track but its last, in order; shorter tracks are filled from
    the left with their oldest. Draws depend on the track and the frame."""
    f = F.col(frames)
    rest = F.when(F.size(f) > 1, F.slice(f, F.lit(1), F.size(f) - 1)).otherwise(f)
    drawn = F.array_sort(F.transform(rest, lambda t: F.struct(draw(((F.col("track"), 1_000_003), (t, 1)), seed).alias("d"), t.alias("t"))))
    some = F.array_sort(F.transform(F.slice(drawn, 1, k), lambda x: x["t"]))
    return tracks.withColumn(frames, F.concat(F.array_repeat(F.get(f, F.lit(0)), F.greatest(F.lit(k) - F.size(some), F.lit(0))), some))


def fetch_frames(tracks: DataFrame, k: int, frames: str = "frames") -> DataFrame:
    """The last k frames of each track; shorter ones are filled from the left with their
    oldest."""
    f = F.col(frames)
    tail = F.slice(f, F.greatest(F.size(f) - k + 1, F.lit(1)), k)
    return tracks.withColumn(frames, F.concat(F.array_repeat(F.get(f, F.lit(0)), F.greatest(F.lit(k) - F.size(f), F.lit(0))), tail))


# ---- filters -----------------------------------------------------------------------


def min_objects(mask: DataFrame, least: int, by: list[str] = IMAGE) -> DataFrame:
    """Images with at least `least` values besides one for the background."""
    rich = mask.groupBy(*by).agg(F.count_distinct("label").alias("_n")).where(F.col("_n") - 1 >= least)
    return mask.join(rich, by, "left_semi")


def long_tracks(cells: DataFrame, more_than: int = 3) -> DataFrame:
    """Cells of tracks that are in more than so many frames."""
    long = cells.groupBy("movie", "track").agg(F.count_distinct("t").alias("_n")).where(F.col("_n") > more_than)
    return cells.join(long, ["movie", "track"], "left_semi")


def whole_families(lineage: DataFrame, cells: DataFrame, more_than: int = 3) -> DataFrame:
    """Lineages whose daughters are all in more than so many frames; their daughters are
    left out otherwise."""
    long = cells.groupBy("movie", F.col("track").alias("daughter")).agg((F.count_distinct("t") > more_than).alias("long"))
    each = lineage.select("movie", "track", F.explode("daughters").alias("daughter")).join(long, ["movie", "daughter"], "left")
    whole = each.groupBy("movie", "track").agg(F.every(F.coalesce("long", F.lit(False))).alias("whole"))
    return lineage.join(whole, ["movie", "track"], "left").withColumn("daughters", F.when(F.coalesce("whole", F.lit(False)), F.col("daughters"))).drop("whole")


def invalid_lineages(lineage: DataFrame, cells: DataFrame) -> DataFrame:
    """Movies with a lineage that its cells do not bear out: a daughter that is missing or
    begins before its parent has ended, or frames of no cell."""
    born = cells.groupBy("movie", F.col("track").alias("daughter")).agg(F.min("t").alias("born"))
    each = lineage.select("movie", "track", "last", F.explode("daughters").alias("daughter")).join(born, ["movie", "daughter"], "left")
    wrong = each.where(F.col("born").isNull() | (F.col("born") <= F.col("last"))).select("movie")
    gone = lineage.select("movie", "track").join(cells, ["movie", "track"], "left_anti").select("movie")
    return wrong.union(gone).distinct()


def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 0) -> DataFrame:
    """`df` with split, test for about that share of keys; a key's rows stay together, and
    more rows do not move others."""
    return df.withColumn("split", F.when(draw(F.col(key), seed) % 1000 < int(test * 1000), "test").otherwise("train"))


def sequential_tracks(cells: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and lineage with tracks numbered 1..n in each movie; daughters follow."""
    new = lineage.select("movie", "track").distinct().withColumn("_new", F.row_number().over(Window.partitionBy("movie").orderBy("track")))
    child = new.select("movie", F.col("track").alias("_d"), F.col("_new").alias("_dn"))
    kin = lineage.select("movie", "track", F.explode("daughters").alias("_d")).join(child, ["movie", "_d"]).groupBy("movie", "track").agg(F.sort_array(F.collect_list("_dn")).alias("daughters"))
    family = lineage.drop("daughters").join(kin, ["movie", "track"], "left")
    renumber = lambda t: t.join(new, ["movie", "track"]).withColumn("track", F.col("_new")).drop("_new")
    return renumber(cells), renumber(family)


# ---- aggregates --------------------------------------------------------------------


def extents(mask: DataFrame, axes: tuple[str, ...], by: list[str] = IMAGE) -> DataFrame:
    """Mean and median side of the instances' bounding boxes on each axis, rounded."""
    box = mask.where("label <> 0").groupBy(*by, "label").agg(*[(F.max(a) - F.min(a) + 1).alias(a) for a in axes])
    # sides are small numbers: medians come from how often each occurs
    kinds = box.groupBy(*axes).agg(F.count("*").alias("_k"))
    mean = lambda a: F.round(F.sum(F.col(a) * F.col("_k")) / F.sum("_k"))
    median = lambda a: F.round(F.percentile(F.col(a), F.lit(0.5), F.col("_k")))
    return kinds.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("mean", mean), ("median", median))])


def track_stats(cells: DataFrame, lineage: DataFrame) -> DataFrame:
    """By movie: frames, cells, tracks, divisions, mean frames of a track."""
    seen = cells.groupBy("movie").agg(F.count_distinct("t").alias("frames"), F.count("*").alias("cells"))
    kin = lineage.groupBy("movie").agg(F.count("*").alias("tracks"), F.count("daughters").alias("divisions"))
    return seen.join(kin, "movie").withColumn("mean_frames", F.col("cells") / F.col("tracks"))


def regionprops(mask: DataFrame, value: str | None = None, by: list[str] = IMAGE) -> DataFrame:
    """Area, centroid, half-open bounding box, eccentricity (of the ellipse of equal second
    moments, 1/12 for a pixel's own extent), and the sum of `value`."""
    inside = mask.where("label <> 0")
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    more = [F.sum(value).alias("total")] if value else []
    p = inside.groupBy(*by, "label").agg(
        F.count("*").alias("area"), F.avg(r).alias("cr"), F.avg(c).alias("cc"), F.min("r").alias("r0"), F.min("c").alias("c0"),
        (F.max("r") + 1).alias("r1"), (F.max("c") + 1).alias("c1"),
        (F.var_pop(r) + 1 / 12).alias("_a"), (F.var_pop(c) + 1 / 12).alias("_b"), F.covar_pop(r, c).alias("_c"), *more,
    )
    half, root = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, 2) + F.pow("_c", 2))
    return p.withColumn("eccentricity", F.sqrt(F.greatest(F.lit(0.0), 1 - (half - root) / (half + root)))).drop("_a", "_b", "_c")


def perimeters(mask: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """The number of an instance's pixel sides that face another value or the outside."""
    from lumigrid.operators.masks import _neighbours

    sides = [F.coalesce((n != F.col("label")).cast("int"), F.lit(1)) for n in _neighbours(mask, "label", by)]
    total = sides[0] + sides[1] + sides[2] + sides[3]
    return mask.withColumn("_s", total).where("label <> 0").groupBy(*by, "label").agg(F.sum("_s").alias("perimeter"))


def featurewise(px: DataFrame, per: list[str]) -> DataFrame:
    """Mean and spread over all images, for each of `per`."""
    return px.groupBy(*per).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """The weight of each class: (1 / classes) * all / (its own + 1)."""
    own = labels.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    everything = own.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return own.join(F.broadcast(everything)).select("class", ((1.0 / F.col("classes")) * F.col("total") / (F.col("n") + 1.0)).alias("weight"))


def vote(scores: DataFrame, by: list[str], label: str = "class", score: str = "p") -> DataFrame:
    """The class of the largest summed score; of equal ones (to 9 digits) the least."""
    total = scores.groupBy(*by, label).agg(F.round(F.sum(score), 9).alias("_s"))
    return total.groupBy(*by).agg(F.max_by(label, F.struct("_s", -F.col(label))).alias(label))


def mean_scale(scales: DataFrame, by: list[str], value: str = "scale", snap: float = 0.01) -> DataFrame:
    """The mean, or 1 if it is within `snap` of it."""
    m = scales.groupBy(*by).agg(F.avg(value).alias("scale"))
    return m.withColumn("scale", F.when(F.abs(F.col("scale") - 1) < snap, 1.0).otherwise(F.col("scale")))


def confusion(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    return pairs.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, batch: str, label: str) -> DataFrame:
    return df.groupBy(batch, label).agg(F.count("*").alias("n"))


def overlaps(truth: DataFrame, predicted: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """Pairs of instances that share pixels: true, predicted, common, iou. One join by
    pixel, sizes from the same rows."""
    both = truth.select(*by, "r", "c", F.col("label").alias("true")).join(predicted.select(*by, "r", "c", F.col("label").alias("predicted")), [*by, "r", "c"])
    n = both.groupBy(*by, "true", "predicted").agg(F.count("*").alias("common"))
    size = lambda k: F.sum("common").over(Window.partitionBy(*by, k))
    met = n.withColumns({"_a": size("true"), "_b": size("predicted")}).where((F.col("true") != 0) & (F.col("predicted") != 0))
    return met.select(*by, "true", "predicted", "common", (F.col("common") / (F.col("_a") + F.col("_b") - F.col("common"))).alias("iou"))


def object_metrics(truth: DataFrame, predicted: DataFrame, least: float = 0.5, by: list[str] = IMAGE) -> DataFrame:
    """By image: n_true, n_predicted, matched (pairs of an overlap above `least`; for 0.5
    and more no instance is in two), precision, recall, f1."""
    pairs = overlaps(truth, predicted, by).where(F.col("iou") > least).groupBy(*by).agg(F.count("*").alias("matched"))
    count = lambda m, name: m.groupBy(*by).agg(F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias(name))
    e = count(truth, "n_true").join(count(predicted, "n_predicted"), by, "full").join(pairs, by, "left").na.fill(0, ["n_true", "n_predicted", "matched"])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return e.withColumns({"precision": share("matched", "n_predicted"), "recall": share("matched", "n_true"), "f1": F.try_divide(2.0 * F.col("matched"), F.col("n_true") + F.col("n_predicted"))})


def pixel_metrics(truth: DataFrame, predicted: DataFrame, by: list[str] = IMAGE) -> DataFrame:
    """By image: dice and jaccard of the foregrounds."""
    both = truth.select(*by, "r", "c", (F.col("label") != 0).cast("int").alias("a")).join(predicted.select(*by, "r", "c", (F.col("label") != 0).cast("int").alias("b")), [*by, "r", "c"])
    s = both.groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("i"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return s.select(*by, F.try_divide(2.0 * F.col("i"), F.col("a") + F.col("b")).alias("dice"), F.try_divide(F.col("i").cast("double"), F.col("a") + F.col("b") - F.col("i")).alias("jaccard"))
