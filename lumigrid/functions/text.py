"""Sort keys and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs as numbers: each run is filled with zeros to 20 digits."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def number_after_first(key: Column) -> Column:
    """The number of keys like C12."""
    return F.substring(key, 2, 20).cast("int")


def size_in_bytes(text: Column) -> Column:
    """Bytes of texts like "12 MB"."""
    parts = F.split(F.trim(text), r"\s+")
    unit = F.upper(F.get(parts, F.lit(1)))
    times = F.when(unit == "KB", 1024).when(unit == "MB", 1024**2).when(unit == "GB", 1024**3).otherwise(1)
    return (F.get(parts, F.lit(0)).cast("double") * times).cast("long")


def layer_options(text: Column) -> Column:
    """The options of a layer name like gcs-units:64-heads:2."""
    return F.str_to_map(F.regexp_replace(text, "^[^-]*-?", ""), F.lit("-"), F.lit(":"))


def feature_file(feature: Column, channel: Column, frame: Column, digits: int) -> Column:
    return F.concat(feature, F.lit("_"), channel, F.lit("_frame_"), F.lpad(frame.cast("string"), digits, "0"), F.lit(".tif"))


def decayed(rate: float, decay: float, epoch: Column) -> Column:
    return F.lit(rate) * F.pow(F.lit(decay), epoch)
