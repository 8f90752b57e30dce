"""Trackings compared with what is true, and blocks of movies, against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import tables, trackmetrics, volumes

CELL, KIN = "movie string, t int, track long, x double, y double", "movie string, track long, last int, daughters array<long>"


def drawn(*key):
    k = int(hashlib.md5("/".join(map(str, key)).encode()).hexdigest()[:7], 16)
    x = (k * 2654435761 + 3 * 40503 + 1) % 4294967296
    return (x % 2147483647) * (x % 2147483629) % 2147483647


def test_tracks_matched_one_to_one(spark):
    draw = random.Random(5)
    nodes = [("ab"[k % 2], t, a, draw.randrange(40)) for k in range(2) for t in range(30) for a in draw.sample(range(40), 12)]
    common = {}
    for m, _, a, b in nodes:
        common[m, a, b] = common.get((m, a, b), 0) + 1
    want, used = set(), set()
    for (m, a, b), n in sorted(common.items(), key=lambda e: (-e[1], drawn(*e[0]), e[0][1:])):
        if (m, 0, a) not in used and (m, 1, b) not in used:
            used |= {(m, 0, a), (m, 1, b)}
            want.add((m, a, b, n))
    df = spark.createDataFrame(nodes, "movie string, t int, true long, found long").repartition(3)
    assert {tuple(r) for r in trackmetrics.matched_tracks(df).collect()} == want
    assert trackmetrics.matched_tracks(df.limit(0)).count() == 0


def life(track, first, last, x, y=0.0, movie="m"):
    return [(movie, t, track, float(x), float(y)) for t in range(first, last + 1)]


def told(spark, truth, found, kin, other, tolerance=1):
    tables_ = [spark.createDataFrame(rows, schema) for rows, schema in ((truth, CELL), (found, CELL), (kin, KIN), (other, KIN))]
    nodes = trackmetrics.matched_by_distance(tables_[0], tables_[1], 1.0)
    return tables_, nodes, trackmetrics.counts(*tables_, nodes, tolerance)


def test_divisions_and_links(spark):
    # tracks 1 -> 2, 3 in frames 0-4 and 5-9; found one frame late, with other names
    truth = life(1, 0, 4, 0) + life(2, 5, 9, 0) + life(3, 5, 9, 5)
    found = life(7, 0, 5, 0) + life(8, 6, 9, 0) + life(9, 5, 9, 5)
    kin = [("m", 1, 4, [2, 3]), ("m", 2, 9, None), ("m", 3, 9, [])]
    for other, tolerance, want in (
        ([("m", 7, 5, [9, 8])], 1, (1, 0, 0, 0, 1)),
        ([("m", 7, 5, [9, 8])], 0, (0, 0, 1, 1, 1)),  # too late
        ([("m", 7, 5, [8, 10])], 1, (0, 1, 0, 0, 1)),
        ([("m", 7, 5, [8])], 1, (0, 1, 0, 0, 1)),
        ([("m", 7, 5, [8, 9, 10])], 1, (0, 1, 0, 0, 1)),
        ([("m", 9, 5, [8, 7])], 1, (0, 0, 1, 1, 1)),  # another parent
        ([], 1, (0, 0, 0, 1, 1)),
    ):
        (a, b, *_), nodes, counts = told(spark, truth, found, kin, other, tolerance)
        row = counts.first()
        assert tuple(row[1:6]) == want
        # links: 4 + 4 + 4 true ones; that of track 2 from frame 5 to 6 is found in two tracks
        assert (row.aa_tp, row.aa_total, row.te_tp, row.te_total) == (11, 12, 14, 15)
    got = trackmetrics.identity(a, b, nodes).first()
    assert (got.idtp, got.n_true, got.n_found) == (14, 15, 15) and got.idf1 == pytest.approx(28 / 30)
    row = trackmetrics.summary(counts).first()
    assert row.missed == 1.0 and row.division_recall == 0.0 and row.division_precision is None and row.association_accuracy == pytest.approx(11 / 12)


def test_two_found_divisions_for_one(spark):
    truth = life(1, 0, 4, 0) + life(2, 5, 9, 0) + life(3, 5, 9, 5)
    # the parent's last frame is another track, which divides a frame early and wrongly
    found = life(1, 0, 3, 0) + life(4, 4, 4, 0) + life(2, 5, 9, 0) + life(3, 5, 9, 5)
    _, _, counts = told(spark, truth, found, [("m", 1, 4, [2, 3])], [("m", 1, 3, [4, 9]), ("m", 4, 4, [2, 3])])
    assert tuple(counts.first()[1:6]) == (1, 0, 1, 0, 1)  # the right one is taken, the near one too


def test_movies_of_one_side_empty_tables_and_masks(spark):
    _, _, counts = told(spark, life(1, 0, 2, 0, movie="a"), life(1, 0, 2, 0, movie="b"), [], [("b", 1, 2, [5, 6])])
    got = {r.movie: tuple(r[1:]) for r in counts.collect()}
    assert got == {"a": (0, 0, 0, 0, 0, 0, 2, 0, 3), "b": (0, 0, 1, 0, 0, 0, 0, 0, 0)}
    _, _, none = told(spark, [], [], [], [])
    assert none.count() == 0 and trackmetrics.summary(none).first().missed is None
    px = lambda rows: spark.createDataFrame([("m", 0, r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "movie string, t int, r int, c int, label int")
    one, two = px([[1, 1, 0, 2], [1, 1, 2, 2]]), px([[5, 5, 0, 6], [5, 0, 0, 0]])
    pairs = lambda least: {tuple(r)[2:] for r in trackmetrics.matched_by_overlap(one, two, least).collect()}
    assert pairs(0.5) == {(1, 5)} and pairs(0.3) == {(1, 5), (2, 6)} and pairs(0.75) == set()
    null = spark.createDataFrame([("m", 0, 1, None, 0.0)], CELL)
    assert trackmetrics.matched_by_distance(null, null, 1.0).count() == 0


def test_movie_windows_against_slices(spark):
    rng = np.random.default_rng(3)
    movies = {name: rng.random(shape) for name, shape in (("a", (6, 7, 9)), ("b", (1, 3, 3)))}
    frames = spark.createDataFrame([(m, t, *p.shape, p.reshape(-1).tolist()) for m, x in movies.items() for t, p in enumerate(x)], "movie string, t int, h int, w int, px array<double>")
    places = [(m, t, r, c) for m, x in movies.items() for t, r, c in zip(*np.nonzero(x > 0.6))]
    df = spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else int(v), p)) for p in places + places[:3]], "movie string, t int, r int, c int")
    for half, half_t in ((1, 2), (2, 0), (0, 1)):
        got = {tuple(r)[:4]: r.px for r in volumes.movie_windows(frames, df, half, half_t, outside=-1.0).collect()}
        assert set(got) == {(m, int(t), int(r), int(c)) for m, t, r, c in places}
        for (m, t, r, c), px in got.items():
            x = np.pad(movies[m], ((half_t,) * 2, (half,) * 2, (half,) * 2), constant_values=-1.0)
            assert px == x[t : t + 2 * half_t + 1, r : r + 2 * half + 1, c : c + 2 * half + 1].reshape(-1).tolist()


def test_volume_places(spark):
    mask = spark.createDataFrame([("m", t, r, c, (t + r + c) % 2) for t in range(5) for r in range(4) for c in range(4)], "movie string, t int, r int, c int, v int")
    every = {(r.t, r.r, r.c) for r in tables.sample_volumes(mask, 1, 1, padding="same").collect()}
    assert every == {(t, r, c) for t in range(5) for r in range(4) for c in range(4) if (t + r + c) % 2}
    inside = {(r.t, r.r, r.c) for r in tables.sample_volumes(mask, 1, 1).collect()}
    assert inside == {p for p in every if 1 < p[0] < 4 and 1 < p[1] < 3 and 1 < p[2] < 3}
    few = lambda seed: {(r.t, r.r, r.c) for r in tables.sample_volumes(mask.repartition(3), 1, 1, padding="same", most=7, seed=seed).collect()}
    assert len(few(1)) == 7 and few(1) == few(1) != few(2) and few(1) <= every
    with pytest.raises(ValueError):
        tables.sample_volumes(mask, 1, 1, padding="full")
