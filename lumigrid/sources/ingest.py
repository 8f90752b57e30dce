"""One reader for files of several kinds, which their suffix tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.sources import arrays, images

#: The kind of file that each suffix names.
KINDS = {"tif": "tif", "tiff": "tif", "npz": "npz", "trk": "trks", "trks": "trks", "csv": "csv"}


def load_files(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """The files of a path or glob, with `file`, where each row is from. Pictures and archives
    are frames (arrays.FRAME); a TIFF is one frame of one channel without labels. A csv has
    its own columns by its header, typed by what they hold; a first column without a name is
    `index`. Options go to the reader. Other suffixes are an error."""
    kind = KINDS.get(pattern.rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"{pattern!r} does not end in one of {', '.join(KINDS)}")
    if kind == "csv":
        table = spark.read.options(**{"header": True, "inferSchema": True, **options}).csv(pattern)
        named = table.withColumnRenamed("_c0", "index") if table.columns[:1] == ["_c0"] else table
        return named.withColumn("file", F.col("_metadata.file_path"))
    if kind == "tif":
        zero, one = F.lit(0), F.lit(1)
        planes = images.load_planes(spark, pattern)
        return planes.select(F.col("path").alias("file"), zero.cast("long").alias("batch"), zero.alias("t"), "h", "w", one.alias("ch"), F.col("px").cast("array<float>").alias("px"), F.lit(None).cast("array<int>").alias("labels"))
    return arrays.load(spark, kind, [pattern], **options)
