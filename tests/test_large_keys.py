"""Keys whose products do not fit 64 bits."""

import math

from pyspark.sql import functions as F

from lumigrid.operators import tables


def drawn(key, seed):
    """As tables.draw(), with whole numbers of any size; % takes the sign of the key."""
    x = key * 2654435761 + seed * 40503 + 1
    x = int(math.copysign(abs(x) % 4294967296, x)) if x else 0
    return int(math.fmod(x, 2147483647)) * int(math.fmod(x, 2147483629)) % 2147483647


def test_draws_of_large_keys(spark):
    keys = [0, 1, 149, 3_474_000_000, 3_474_571_080, 9_000_027_000, 2**62, 2**63 - 1, -5, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.d for r in df.select("k", tables.draw(F.col("k"), 8).alias("d")).collect()}
    assert got == {k: drawn(k, 8) for k in keys}


def test_random_frames_of_large_tracks(spark):
    tracks = [3, 8_999, 10**12, 2**62]
    df = spark.createDataFrame([(k, list(range(19_700, 19_710))) for k in tracks], "track long, frames array<int>")
    for r in tables.random_frames(df, 4, 8).collect():
        assert r.frames == sorted(sorted(range(19_700, 19_709), key=lambda t: drawn(r.track * 1_000_003 + t, 8))[:4])


def test_windows_of_large_image_ids(spark):
    places = [(i, r, c) for i in (7, 10_255, 10**13) for r in range(4) for c in range(4)]
    mask = spark.createDataFrame([(*p, 1) for p in places], "image_id long, r int, c int, v int")
    got = [(r.image_id, r.r, r.c) for r in tables.sample_windows(mask, 1, "same", 9, 5).collect()]
    assert sorted(got) == sorted(sorted(places, key=lambda p: (drawn(p[0] * 1_000_003 + p[1] * 1009 + p[2], 5), p))[:9])
