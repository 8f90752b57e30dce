"""Archives and pictures: what is written is what is read."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.sources import arrays, images
from lumigrid.sources.datasets import Dataset, extract, with_header

RNG = np.random.default_rng(0)


def test_npz_images_and_movies(spark, tmp_path):
    x, y = RNG.random((4, 6, 5, 2)).astype(np.float32), RNG.integers(0, 3, (4, 6, 5, 1)).astype(np.int32)
    np.savez(tmp_path / "a.npz", X=x, y=y)
    np.savez(tmp_path / "b.npz", X=np.moveaxis(x, -1, 1), y=np.moveaxis(y, -1, 1))
    np.savez(tmp_path / "m.npz", X=x[None], y=y[None])
    for name, options, key in (("a", {}, "batch"), ("b", {"data_format": "channels_first"}, "batch"), ("m", {}, "t")):
        rows = arrays.load(spark, "npz", [str(tmp_path / f"{name}.npz")], **options).orderBy(key).collect()
        assert [(r.h, r.w, r.ch) for r in rows] == [(6, 5, 2)] * 4
        assert np.array_equal(np.array([r.px for r in rows], np.float32).reshape(x.shape), x)
        assert np.array_equal(np.array([r["labels"] for r in rows]).reshape(y.shape), y)
    np.savez(tmp_path / "bad.npz", X_bad=x, y=y)
    np.savez(tmp_path / "short.npz", X=x, y=y[:2])
    for name, what in (("bad", "X"), ("short", "entries")):
        with pytest.raises(Exception, match=what):
            arrays.load(spark, "npz", [str(tmp_path / f"{name}.npz")]).count()


def test_trks_round_trip(spark, tmp_path):
    raw, tracked = RNG.random((2, 3, 8, 8, 1)).astype(np.float32), RNG.integers(0, 4, (2, 3, 8, 8, 1)).astype(np.int32)
    family = [{"1": {"label": 1, "frames": [0, 1], "parent": None, "daughters": [2, 3]}, "2": {"label": 2, "frames": [2], "parent": 1, "daughters": []}, "3": {"label": 3, "frames": [2], "parent": 1, "daughters": []}}] * 2
    with tarfile.open(tmp_path / "x.trks", "w") as tar:
        for name, data in (("lineages.json", json.dumps(family).encode()), ("raw.npy", arrays._npy(raw)), ("tracked.npy", arrays._npy(tracked))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    frames = arrays.load(spark, "trks", [str(tmp_path / "x.trks")])
    lineage = arrays.load(spark, "trks", [str(tmp_path / "x.trks")], rows="lineage")
    assert frames.count() == 6 and lineage.count() == 6
    assert lineage.where("parent = 1").count() == 4
    assert arrays.save_trks(frames, lineage, str(tmp_path / "out")) == 2
    again = arrays.load(spark, "trks", [str(tmp_path / "out" / f"{k:06d}.trk") for k in (0, 1)])
    got = np.array([r.px for r in again.orderBy("file", "t").collect()], np.float32)
    assert np.array_equal(got.reshape(raw.shape), raw)
    kin = arrays.load(spark, "trks", [str(tmp_path / "out" / "000001.trk")], rows="lineage").orderBy("label").collect()
    assert [(r.label, r.frames, r.parent, r.daughters) for r in kin] == [(1, [0, 1], None, [2, 3]), (2, [2], 1, []), (3, [2], 1, [])]


def test_tiff_planes(spark, tmp_path):
    for a in (RNG.integers(-9, 9, (5, 7)).astype(np.int32), RNG.random((3, 4)).astype(np.float32)):
        assert np.array_equal(images.decode_tiff(images.encode_tiff(a)), a)
    rows = [(i, t, ch, r, c, float(i * 100 + t * 10 + ch + r - c)) for i in (0, 1) for t in (0, 1) for ch in (0, 1) for r in range(3) for c in range(4)]
    px = spark.createDataFrame(rows, "image_id long, t int, ch int, r int, c int, v double")
    names = sorted(r.path for r in images.save_planes(px, str(tmp_path / "o")).collect())
    assert len(names) == 8 and names[0].endswith("/0/feature_0_frame_0000.tif")
    assert images.save_planes(px, str(tmp_path / "z"), channel=0).count() == 4
    back = images.load_planes(spark, f"{tmp_path}/o/1/feature_1_frame_0001.tif").first()
    assert (back.h, back.w) == (3, 4) and back.px == [111.0 + r - c for r in range(3) for c in range(4)]
    assert len(images.with_digest(spark, f"{tmp_path}/o/0/*.tif").first().md5) == 32


def test_datasets(spark, tmp_path):
    folder = tmp_path / "1.0"
    folder.mkdir()
    for split in ("train", "val", "test"):
        np.savez(folder / f"{split}.npz", X=np.zeros((2, 4, 4, 1)), y=np.zeros((2, 4, 4, 1)))
        (folder / f"{split}-metadata.csv").write_text("filename,experiment,pixel_size,screening_passed,time_step,specimen\na,b,0.5,yes,1,cell\n")
    data = Dataset(str(tmp_path))
    assert data.load(spark, "val").count() == 2
    assert {r.split for r in data.metadata(spark).collect()} == {"train", "val", "test"}
    for wrong in (lambda: data.load(spark, "none"), lambda: Dataset(str(tmp_path), version="9")):
        with pytest.raises(ValueError):
            wrong()
    meta = spark.createDataFrame([(0, ["name", "kind"]), (1, ["a", "x"]), (2, ["b", "y"])], "i int, row array<string>")
    assert [tuple(r) for r in with_header(meta).orderBy("name").collect()] == [("a", "x"), ("b", "y")]
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("f.txt", "x")
    assert extract(str(tmp_path / "q.zip"), str(tmp_path / "un")) and (tmp_path / "un" / "f.txt").exists()
    assert not extract(str(folder / "val-metadata.csv"), str(tmp_path / "un2"))


def test_records_round_trip(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X=RNG.random((3, 4, 4, 1)), y=np.zeros((3, 4, 4, 1)))
    frames = arrays.load(spark, "npz", [str(tmp_path / "a.npz")])
    frames.write.parquet(str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    assert again.exceptAll(frames).count() == frames.exceptAll(again).count() == 0
    assert again.agg(F.sum(F.size("px"))).first()[0] == 48
