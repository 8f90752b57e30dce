"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: The folder that scratch() has opened in a session.
SCRATCH = "lumigrid.scratch"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All tables that operators write within go to one folder, which is deleted at the end.
    Results are lazy: write them to their own place before that."""
    folder = shared_dir(spark, "scratch")
    before = spark.conf.get(SCRATCH, None)
    spark.conf.set(SCRATCH, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(SCRATCH) if before is None else spark.conf.set(SCRATCH, before)
        store, path = at(folder)
        if store.get_file_info(path).type.name == "Directory":
            store.delete_dir(path)


@cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lumigrid-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only where that is unset and the master
    is local, as in tests, a temporary folder of this machine takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local()
    base = spark.conf.get(SCRATCH, None) or base
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts its lineage, so that
    a lost executor costs a read and not the plan above."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme, a local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def publish(uri: str, temporary: str) -> None:
    """Moves a finished file to its name. Attempts of one task write the same bytes under
    different temporary names, so whichever comes last leaves a whole file."""
    files, path = at(uri)
    files.move(at(temporary)[1], path)
