"""Image archives as data sources: ``npz`` (X, y) and ``trks`` (movies with lineages).

Paths may be globs. Files are dealt to partitions by their bytes, and a row is a frame: file
and position, t, h, w, ch, px (row-major, channels last), labels. ``channels_first`` archives
are turned on the way in. Options x and y name the arrays of an npz; rows="spots" reads y as
coordinates of spots instead of labels.
"""

from __future__ import annotations

import fnmatch
import io
import json
import tarfile

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME = "file string, batch long, t int, h int, w int, ch int, px array<float>, labels array<int>"
LINEAGE = "file string, batch long, label long, frames array<int>, parent long, daughters array<long>"
SPOTS = "file string, batch long, t int, h int, w int, ch int, px array<float>, spots array<struct<r: double, c: double>>"
#: Bytes of files that a partition reads, unless one file has more.
PARTITION = 128 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def listed(pattern: str) -> list[tuple[str, int]]:
    """Files of a path or a glob (of the last parts of it) with their bytes, by name; an
    error if there are none."""
    parts = pattern.split("/")
    fixed = next((k for k, p in enumerate(parts) if any(x in p for x in "*?[")), len(parts))
    base = "/".join(parts[:fixed])
    store, local = _store(base or "/")
    if fixed == len(parts):
        found = [(pattern, f.size) for f in [store.get_file_info(local)] if f.type == fs.FileType.File]
    else:
        files = store.get_file_info(fs.FileSelector(local, allow_not_found=True, recursive=fixed < len(parts) - 1))
        below = [(f.path[len(local.rstrip("/")) :].strip("/").split("/"), f.size) for f in files if f.type == fs.FileType.File]
        fits = lambda path: len(path) == len(parts) - fixed and all(fnmatch.fnmatchcase(x, p) for x, p in zip(path, parts[fixed:]))
        found = sorted(("/".join([base, *path]), size) for path, size in below if fits(path))
    if not found:
        raise FileNotFoundError(pattern)
    return found


def dealt(files: list[tuple[str, int]], most: int = PARTITION) -> list[list[str]]:
    """Files in runs of at most `most` bytes (or one file)."""
    runs, held = [], 0
    for path, size in files:
        if not runs or held + size > most:
            runs.append([])
            held = 0
        runs[-1].append(path)
        held += size
    return runs


def _open(path: str) -> io.BytesIO:
    store, local = _store(path)
    with store.open_input_file(local) as f:
        return io.BytesIO(f.read())


def frames(file: str, x: np.ndarray, y: np.ndarray | None, channels_first: bool):
    """FRAME rows of a batch of images (4-D) or movies (5-D)."""
    if y is not None and len(x) != len(y):
        raise ValueError(f"{file}: X has {len(x)} entries and y has {len(y)}")
    if x.ndim not in (4, 5):
        raise ValueError(f"{file}: X has rank {x.ndim}; images have 4 and movies 5")
    if channels_first:
        x = np.moveaxis(x, 1, -1)
        y = None if y is None else np.moveaxis(y, 1, -1)
    if x.ndim == 4:
        x, y = x[:, None], None if y is None else y[:, None]
    for b in range(len(x)):
        for t in range(x.shape[1]):
            h, w, ch = x[b, t].shape
            labels = None if y is None else y[b, t].reshape(-1).astype(np.int32).tolist()
            yield (file, b, t, h, w, ch, x[b, t].reshape(-1).astype(np.float32).tolist(), labels)


def spots(file: str, x: np.ndarray, y: np.ndarray, channels_first: bool):
    """SPOTS rows of images and, for each, its coordinates (n rows of r and c)."""
    if len(x) != len(y):
        raise ValueError(f"{file}: X has {len(x)} entries and y has {len(y)}")
    for row, at in zip(frames(file, x, None, channels_first), y, strict=True):
        yield (*row[:-1], [(float(r), float(c)) for r, c in np.asarray(at, float).reshape(-1, 2)])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.paths = [p for p in options["path"].split(",") if p]
        self.first = options.get("data_format", "channels_last") == "channels_first"
        self.rows, self.kind = options.get("rows", "frames"), kind
        self.lineage = self.rows == "lineage"
        self.x, self.y = options.get("x", "X"), options.get("y", "y")
        # arrays of arrays are pickled, and pickles can run code: only if asked for
        self.pickle = options.get("allow_pickle", "false").lower() == "true"

    def partitions(self):
        return [InputPartition(run) for run in dealt([f for p in self.paths for f in listed(p)])]

    def read(self, partition: InputPartition):
        for path in partition.value:
            yield from self.read_file(path)

    def read_file(self, path: str):
        if self.kind == "npz":
            with np.load(_open(path), allow_pickle=self.pickle) as a:
                if self.rows == "spots":
                    yield from spots(path, a[self.x], a[self.y], self.first)
                else:
                    yield from frames(path, a[self.x], a[self.y] if self.y in a else None, self.first)
            return
        with tarfile.open(fileobj=_open(path)) as tar:
            member = lambda n: io.BytesIO(tar.extractfile(n).read())
            if self.lineage:
                for b, tracks in enumerate(json.load(member("lineages.json"))):
                    for label, track in tracks.items():
                        parent = track.get("parent")
                        yield (path, b, int(label), track.get("frames"), None if parent is None else int(parent), track.get("daughters", []))
            else:
                yield from frames(path, np.load(member("raw.npy")), np.load(member("tracked.npy")), self.first)


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return {"lineage": LINEAGE, "spots": SPOTS}.get(self.options.get("rows"), FRAME)

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self.kind)


class NpzSource(_Source):
    kind = "npz"


class TrksSource(_Source):
    kind = "trks"


def register(spark: SparkSession) -> None:
    for source in (NpzSource, TrksSource):
        spark.dataSource.register(source)


def load(spark: SparkSession, kind: str, paths: list[str], **options) -> DataFrame:
    """Frames (or lineage rows: rows="lineage"; or spots of npz: rows="spots") of archives,
    which paths or globs name."""
    register(spark)
    reader = spark.read.format(kind).option("path", ",".join(paths))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def save_trks(frames: DataFrame, lineage: DataFrame, folder: str) -> int:
    """One archive for each batch of FRAME rows and their LINEAGE rows, written by the tasks
    that hold the batch; returns how many. A movie is a group, and movies are spread."""
    schema = "path string"

    def write(key, movie, tracks):
        import pandas as pd

        movie = movie.sort_values("t")
        h, w, ch = (int(movie[k].iloc[0]) for k in ("h", "w", "ch"))
        raw = np.stack([np.asarray(p, np.float32).reshape(h, w, ch) for p in movie.px])[None]
        tracked = np.stack([np.asarray(p, np.int32).reshape(h, w, 1) for p in movie["labels"]])[None]
        family = [{str(r.label): {"label": int(r.label), "frames": [int(f) for f in r.frames] if r.frames is not None else [], "parent": None if pd.isna(r.parent) else int(r.parent), "daughters": [int(x) for x in r.daughters]} for r in tracks.itertuples()}]
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, data in (("lineages.json", json.dumps(family).encode()), ("raw.npy", _npy(raw)), ("tracked.npy", _npy(tracked))):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        path = f"{folder}/{key[0]:06d}.trk"
        store, local = _store(path)
        store.create_dir(local.rpartition("/")[0], recursive=True)
        with store.open_output_stream(local) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"path": [path]})

    return frames.groupBy("batch").cogroup(lineage.groupBy("batch")).applyInPandas(write, schema).count()


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()
