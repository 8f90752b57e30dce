"""Pictures as a sink: ``df.write.format("pictures")`` makes a PNG of each row name, h, w, px.

Each attempt of a task writes to a folder of its own below the job's. Once all tasks are
done, what attempts without success have left is deleted and a file _SUCCESS is written; if
the job fails, its whole folder goes. So a folder with _SUCCESS has each picture once."""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lumigrid.sources.arrays import _store

#: First bytes of a PNG, and its kinds of colour by the number of channels (fixed values).
MAGIC = b"\x89PNG\r\n\x1a\n"
COLOUR = {1: 0, 3: 2, 4: 6}


def encode_png(picture: np.ndarray) -> bytes:
    """A PNG of bytes: rows and columns, and 1, 3 or 4 channels if there are more axes."""
    a = np.asarray(picture, np.uint8)
    h, w, ch = a.shape if a.ndim == 3 else (*a.shape, 1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * ch)], axis=1)  # 0: a line as it is
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, COLOUR[ch], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def grey(px: Column) -> Column:
    """Values from 0 to 255: from the least of an image to its greatest, cut to whole
    numbers; all 0 if they are equal."""
    low = F.array_min(px)
    high = F.array_max(px) - low
    return F.transform(px, lambda v: F.when(high == 0, 0).otherwise(F.floor((v - low) / high * 255)).cast("int"))


def greatest_channel(px: Column, ch: Column) -> Column:
    """For each pixel of an image (channels last) the channel of its greatest value, the
    first of equal ones; as it is if there is one."""
    n = F.floor(F.size(px) / ch).cast("int")

    def first(k: Column) -> Column:
        own = F.slice(px, (k * ch + 1).cast("int"), ch.cast("int"))
        return (F.array_position(own, F.array_max(own)) - 1).cast("double")

    return F.when((ch == 1) | (n == 0), px.cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), first))


@dataclass
class _Done(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"job-{uuid.uuid4().hex}"

    def write(self, rows) -> _Done:
        store, local = _store(f"{self.path}/{self.job}/part-{uuid.uuid4().hex}")
        store.create_dir(local, recursive=True)
        for row in rows:
            if "/" in row.name or not row.name:
                raise ValueError(f"{row.name!r} is no name for a file")
            with store.open_output_stream(f"{local}/{row.name}.png") as f:
                f.write(encode_png(np.array(row.px).reshape(row.h, row.w, -1)))
        return _Done(local)

    def commit(self, messages) -> None:
        store, local = _store(self.path)
        store.create_dir(f"{local}/{self.job}", recursive=True)
        kept = {m.folder for m in messages if m}
        for f in store.get_file_info(fs.FileSelector(f"{local}/{self.job}")):
            if f.path not in kept:
                store.delete_dir(f.path)
        if self.overwrite:  # what was there goes only now
            for f in store.get_file_info(fs.FileSelector(local)):
                if f.type == fs.FileType.Directory and f.base_name.startswith("job-") and f.base_name != self.job:
                    store.delete_dir(f.path)
        with store.open_output_stream(f"{local}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages) -> None:
        store, local = _store(f"{self.path}/{self.job}")
        if store.get_file_info(local).type == fs.FileType.Directory:
            store.delete_dir(local)


class PictureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return "name string, h int, w int, px array<int>"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PictureSink)


def save_pictures(blocks: DataFrame, folder: str, prefix: str, semantic: int | None = None, overwrite: bool = False) -> None:
    """A grey picture of each image (image_id, h, w, ch, px, channels last): of the first
    channel, named {prefix}_{image_id}; or, of scores of the semantic head of that number,
    of the channel that is greatest, named y_{semantic}_{prefix}_{image_id}."""
    register(blocks.sparkSession)
    if semantic is None:
        first, name = F.filter("px", lambda _, i: i % F.col("ch") == 0), F.concat(F.lit(f"{prefix}_"), F.col("image_id").cast("string"))
    else:
        first, name = greatest_channel(F.col("px"), F.col("ch")), F.concat(F.lit(f"y_{semantic}_{prefix}_"), F.col("image_id").cast("string"))
    rows = blocks.select(name.alias("name"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), grey(first).alias("px"))
    rows.write.format("pictures").mode("overwrite" if overwrite else "append").save(folder)
