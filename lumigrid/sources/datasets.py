"""Named datasets: versions, splits, their files, and metadata tables."""

from __future__ import annotations

import tarfile
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.sources import arrays

SPLITS = ("train", "val", "test")
METADATA = "filename string, experiment string, pixel_size string, screening_passed string, time_step string, specimen string"


@dataclass
class Dataset:
    """Files of a dataset below a folder: {folder}/{version}/{split}.{kind}."""

    folder: str
    kind: str = "npz"
    versions: tuple[str, ...] = ("1.0",)
    version: str = "1.0"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.version not in self.versions:
            raise ValueError(f"no version {self.version!r}; there are {', '.join(self.versions)}")

    def load(self, spark: SparkSession, split: str = "train", rows: str = "frames") -> DataFrame:
        if split not in SPLITS:
            raise ValueError(f"no split {split!r}; there are {', '.join(SPLITS)}")
        return arrays.load(spark, self.kind, [f"{self.folder}/{self.version}/{split}.{self.kind}"], rows=rows, **self.options)

    def metadata(self, spark: SparkSession) -> DataFrame:
        """The splits' metadata tables in one, with their split."""
        out = None
        for split in SPLITS:
            part = spark.read.schema(METADATA).csv(f"{self.folder}/{self.version}/{split}-metadata.csv", header=True).withColumn("split", F.lit(split))
            out = part if out is None else out.unionByName(part)
        return out


def with_header(meta: DataFrame, column: str = "row", at: str = "i") -> DataFrame:
    """A table of string arrays whose first row (at = 0) names the columns."""
    names = meta.where(F.col(at) == 0).first()[column]
    return meta.where(F.col(at) > 0).select(*[F.get(column, F.lit(k)).alias(n) for k, n in enumerate(names)])


def extract(path: str, folder: str) -> bool:
    """Unpacks a tar or zip archive; False for other files."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    if tarfile.is_tarfile(path):
        with tarfile.open(path) as tar:
            tar.extractall(folder, filter="data")
        return True
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            z.extractall(folder)
        return True
    return False
