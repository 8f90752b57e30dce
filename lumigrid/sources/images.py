"""Pictures in and out: TIFF planes written by tasks, and read back as pixel blocks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.functions.text import feature_file

#: TIFF field types and the bytes of one value.
SHORT, LONG = 3, 4


def encode_tiff(plane: np.ndarray) -> bytes:
    """A single-strip, uncompressed 32-bit TIFF of whole or floating numbers."""
    kind = 3 if plane.dtype.kind == "f" else 2
    data = plane.astype("<f4" if kind == 3 else "<i4").tobytes()
    h, w = plane.shape
    fields = [(256, LONG, w), (257, LONG, h), (258, SHORT, 32), (259, SHORT, 1), (262, SHORT, 1), (273, LONG, 8), (277, SHORT, 1), (278, LONG, h), (279, LONG, len(data)), (339, SHORT, kind)]
    head = struct.pack("<2sHI", b"II", 42, 8 + len(data))
    return head + data + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, t, 1, v) for tag, t, v in fields) + struct.pack("<I", 0)


def decode_tiff(data: bytes) -> np.ndarray:
    """The plane of a TIFF as encode_tiff() writes it, or with 8 or 16 bits, any strips."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = {SHORT: 2, LONG: 4}.get(kind, 1)
        where = at + 10 + 12 * k if size * count <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        fields[tag] = struct.unpack(f"{order}{count}{ {1: 'B', 2: 'H', 4: 'I'}[size] }", data[where : where + size * count])
    if fields.get(259, (1,))[0] != 1:
        raise ValueError("a compressed TIFF")
    letter = {1: "u", 2: "i", 3: "f"}[fields.get(339, (1,))[0]]
    raw = b"".join(data[a : a + s] for a, s in zip(fields[273], fields[279], strict=True))
    return np.frombuffer(raw, f"{order}{letter}{fields[258][0] // 8}").reshape(fields[257][0], fields[256][0])


def save_planes(px: DataFrame, folder: str, feature: str = "feature", channel: int | None = None) -> DataFrame:
    """Writes a TIFF of whole numbers for each (image, t, ch) of pixel rows image_id, t,
    ch, r, c, v, and returns the names. Frames are filled with zeros to four digits."""
    if channel is not None:
        px = px.where(F.col("ch") == channel)
    named = px.withColumn("name", feature_file(F.lit(feature), F.col("ch"), F.col("t"), 4))

    def write(key, plane: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(plane.r.max()) + 1, int(plane.c.max()) + 1), np.int32)
        out[plane.r, plane.c] = plane.v
        path = f"{folder}/{key[0]}/{key[1]}"
        store, local = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        store.create_dir(local.rpartition("/")[0], recursive=True)
        with store.open_output_stream(local) as f:
            f.write(encode_tiff(out))
        return pd.DataFrame({"path": [path]})

    return named.groupBy("image_id", "name").applyInPandas(write, "path string")


def load_planes(spark: SparkSession, pattern: str) -> DataFrame:
    """path, h, w, px of the TIFFs that a path or glob names."""

    def read(batches):
        for b in batches:
            planes = [decode_tiff(x) for x in b.content]
            yield pd.DataFrame({"path": b.path, "h": [p.shape[0] for p in planes], "w": [p.shape[1] for p in planes], "px": [p.reshape(-1).astype(float).tolist() for p in planes]})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(read, "path string, h int, w int, px array<double>")


def with_digest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length and md5 of files, to check downloads."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.md5("content").alias("md5"))
