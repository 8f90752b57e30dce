"""Losses over rows: `by` names a sample, y is its truth and p its prediction for a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-7


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))


def softmax(df: DataFrame, by: list[str], value: str = "v", name: str = "p") -> DataFrame:
    own = Window.partitionBy(*by)
    e = df.withColumn(name, F.exp(F.col(value) - F.max(value).over(own)))
    return e.withColumn(name, F.col(name) / F.sum(name).over(own))


def cross_entropy(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """-sum of y * ln p, with p normalized over the sample and clipped; terms weighted."""
    own = F.col("p") / F.sum("p").over(Window.partitionBy(*by))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.withColumn("_t", F.col("y") * F.ln(clipped(own)) * w).groupBy(*by).agg((-F.sum("_t")).alias("loss"))


def with_class_weights(df: DataFrame, classes: int, label: str = "class") -> DataFrame:
    """`df` with weight: (1 / classes) * (all y) / (y of the class + 1)."""
    own = df.groupBy(label).agg(F.sum("y").alias("_k"))
    everything = own.agg(F.sum("_k").alias("_n"))
    w = own.join(F.broadcast(everything)).select(label, (1.0 / classes * F.col("_n") / (F.col("_k") + 1.0)).alias("weight"))
    return df.join(F.broadcast(w), label)  # a row for each class


def weighted_cross_entropy(df: DataFrame, by: list[str], classes: int) -> DataFrame:
    return cross_entropy(with_class_weights(df, classes), by, "weight")


def sample_cross_entropy(df: DataFrame, by: list[str]) -> DataFrame:
    """Cross-entropy of predictions that are masked by the truth before they are clipped."""
    own = F.col("p") / F.sum("p").over(Window.partitionBy(*by))
    return df.withColumn("_t", F.col("y") * F.ln(clipped(F.col("y") * own))).groupBy(*by).agg((-F.sum("_t")).alias("loss"))


def weighted_focal(df: DataFrame, by: list[str], classes: int, gamma: float = 2.0) -> DataFrame:
    own = clipped(F.col("p") / F.sum("p").over(Window.partitionBy(*by)))
    e = with_class_weights(df, classes).withColumn("_p", own)
    return e.withColumn("_t", F.col("weight") * F.pow(1 - F.col("_p"), gamma) * F.col("y") * F.ln("_p")).groupBy(*by).agg((-F.sum("_t")).alias("loss"))


def dice(df: DataFrame, by: list[str], smooth: float = 1.0) -> DataFrame:
    both = F.sum(F.col("y") * F.col("p"))
    return df.groupBy(*by).agg((-(2.0 * both + smooth) / (F.sum("y") + F.sum("p") + smooth)).alias("loss"))


def smooth_l1(y: Column, p: Column, sigma: float = 3.0) -> Column:
    """Quadratic below 1 / sigma**2, linear above."""
    s2 = sigma * sigma
    d = F.abs(y - p)
    return F.when(d < 1.0 / s2, 0.5 * s2 * d * d).otherwise(d - 0.5 / s2)


def focal(y: Column, p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Binary focal loss of one prediction."""
    q = clipped(p)
    hit = y == 1
    return F.when(hit, alpha).otherwise(1 - alpha) * F.pow(F.when(hit, 1 - q).otherwise(q), gamma) * -F.ln(F.when(hit, q).otherwise(1 - q))


def discriminative(points: DataFrame, by: list[str], near: float = 0.5, far: float = 1.5, weight: float = 1e-3) -> DataFrame:
    """The instance loss of embedded points (by, instance, point, dim, v): pull points to
    their instance's mean beyond `near`, push means apart below 2 * far, keep means small.
    The push averages all pairs of means, of an instance with itself as 0."""
    means = points.groupBy(*by, "instance", "dim").agg(F.avg("v").alias("m"))
    gap = points.join(means, [*by, "instance", "dim"]).groupBy(*by, "instance", "point").agg(F.sqrt(EPSILON + F.sum(F.pow(F.col("v") - F.col("m"), 2))).alias("d"))
    pull = gap.groupBy(*by, "instance").agg(F.avg(F.pow(F.greatest(F.col("d") - near, F.lit(0.0)), 2)).alias("s")).groupBy(*by).agg(F.avg("s").alias("pull"))
    other = means.select(*by, F.col("instance").alias("_j"), "dim", F.col("m").alias("_m"))
    pair = means.join(other, [*by, "dim"]).where("instance <> _j").groupBy(*by, "instance", "_j").agg(F.sqrt(EPSILON + F.sum(F.pow(F.col("m") - F.col("_m"), 2))).alias("d"))
    hinge = pair.groupBy(*by).agg(F.sum(F.pow(F.greatest(2 * far - F.col("d"), F.lit(0.0)), 2)).alias("h"))
    size = means.groupBy(*by, "instance").agg(F.sqrt(EPSILON + F.sum(F.pow("m", 2))).alias("l")).groupBy(*by).agg(F.avg("l").alias("keep"), F.count("*").alias("n"))
    e = pull.join(size, by).join(hinge, by, "left")
    push = F.coalesce("h", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return e.select(*by, (F.col("pull") + push + weight * F.col("keep")).alias("loss"))


def tensor_product(vector: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """A dense layer on an array column: x W + b, as an array."""
    dot = lambda w: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    columns = list(zip(*weights, strict=True))
    return F.array(*[dot(list(w)) + (bias[k] if bias else 0.0) for k, w in enumerate(columns)])
