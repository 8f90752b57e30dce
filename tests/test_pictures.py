"""Files by glob and suffix, and the sink of pictures."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from lumigrid.sources import arrays, images, ingest, pictures

RNG = np.random.default_rng(4)


def decoded(data):
    """A PNG without filters, read chunk by chunk."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, held = 8, {}
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + body)
        held[name], at = body, at + 12 + n
    w, h, depth, colour = struct.unpack(">IIBB", held[b"IHDR"][:10])
    lines = np.frombuffer(zlib.decompress(held[b"IDAT"]), np.uint8).reshape(h, -1)
    assert depth == 8 and not lines[:, 0].any()
    return lines[:, 1:].reshape(h, w, {0: 1, 2: 3, 6: 4}[colour])


def test_png():
    for shape in ((5, 7), (1, 1), (4, 3, 3), (2, 2, 4)):
        a = RNG.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(decoded(pictures.encode_png(a)).reshape(shape), a)


def test_pictures_of_images_and_scores(spark, tmp_path):
    x = RNG.random((6, 4, 5, 3))
    x[2] = 1.0  # all equal
    blocks = spark.createDataFrame([(k, 4, 5, 3, p.reshape(-1).tolist()) for k, p in enumerate(x)], "image_id long, h int, w int, ch int, px array<double>").repartition(3)
    folder = str(tmp_path / "out")
    scaled = lambda p: np.floor((p - p.min()) / max(p.max() - p.min(), 1e-300) * 255).astype(np.uint8)
    for _ in range(2):  # written twice: the second takes the place of the first
        pictures.save_pictures(blocks, folder, "a", overwrite=True)
    pictures.save_pictures(blocks, folder, "a", semantic=1)
    found = {p.name: decoded(p.read_bytes())[..., 0] for p in Path(folder).rglob("*.png")}
    assert len(found) == 12 == len(list(Path(folder).rglob("*.png"))) and (tmp_path / "out" / "_SUCCESS").exists()
    for k, p in enumerate(x):
        assert np.array_equal(found[f"a_{k}.png"], scaled(p[..., 0]))
        assert np.array_equal(found[f"y_1_a_{k}.png"], scaled(p.argmax(-1).astype(float)))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    pictures.register(spark)
    rows = spark.createDataFrame([(name, 1, 1, [3]) for name in ("a", "b", "c/d")], "name string, h int, w int, px array<int>").repartition(3)
    with pytest.raises(Exception, match="no name"):
        rows.write.format("pictures").mode("append").save(str(tmp_path / "bad"))
    assert not list(tmp_path.rglob("*.png")) and not list(tmp_path.rglob("_SUCCESS"))


def test_files_by_glob_and_suffix(spark, tmp_path):
    x, y = RNG.random((2, 4, 3, 1)).astype(np.float32), RNG.integers(0, 3, (2, 4, 3, 1)).astype(np.int32)
    for day in ("d1", "d2"):
        (tmp_path / day).mkdir()
        for k in range(3):
            np.savez(tmp_path / day / f"m{k}.npz", X=x + k, y=y)
    (tmp_path / "d1" / "note.txt").write_text("x")
    got = ingest.load_files(spark, f"{tmp_path}/d*/m[01].npz")
    assert sorted({r.file.split("/")[-2:][0] + r.file[-6:] for r in got.select("file").collect()}) == ["d1m0.npz", "d1m1.npz", "d2m0.npz", "d2m1.npz"]
    assert got.count() == 8
    assert arrays.dealt([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]
    np.savez(tmp_path / "other.npz", spots_image=x, segmentation_image=y)
    row = ingest.load_files(spark, f"{tmp_path}/other.npz", x="spots_image", y="segmentation_image").orderBy("batch").first()
    assert row["labels"] == y[0].reshape(-1).tolist()
    (tmp_path / "p.tif").write_bytes(images.encode_tiff(x[0, ..., 0]))
    row = ingest.load_files(spark, f"{tmp_path}/*.tif").first()
    assert (row.h, row.w, row.ch, row["labels"]) == (4, 3, 1, None) and np.allclose(row.px, x[0].reshape(-1))
    (tmp_path / "code.csv").write_text(",name,r1\n0,g1,1\n1,g2,0\n")
    table = ingest.load_files(spark, f"{tmp_path}/code.csv")
    assert table.columns == ["index", "name", "r1", "file"] and [(r["index"], r["name"], r.r1) for r in table.orderBy("index").collect()] == [(0, "g1", 1), (1, "g2", 0)]
    for bad in ("x.jpg", "x"):
        with pytest.raises(ValueError):
            ingest.load_files(spark, bad)
    with pytest.raises(Exception, match="none-"):
        ingest.load_files(spark, f"{tmp_path}/none-*.npz").count()


def test_spots_of_images(spark, tmp_path):
    x = RNG.random((3, 4, 4, 1)).astype(np.float32)
    spots = np.empty(3, object)
    spots[:] = [np.array([[0.5, 1.0], [2.0, 3.5]]), np.zeros((0, 2)), np.array([[1.0, 1.0]])]
    np.savez(tmp_path / "s.npz", X=x, y=spots)
    rows = arrays.load(spark, "npz", [f"{tmp_path}/s.npz"], rows="spots", allow_pickle="true").orderBy("batch").collect()
    assert [[(p.r, p.c) for p in r.spots] for r in rows] == [[(0.5, 1.0), (2.0, 3.5)], [], [(1.0, 1.0)]]
    assert np.allclose([r.px for r in rows], x.reshape(3, -1))
    with pytest.raises(Exception, match="pickle"):
        arrays.load(spark, "npz", [f"{tmp_path}/s.npz"], rows="spots").count()
