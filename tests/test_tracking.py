"""Tracking by parts of movies, and assignment by parts of frames, against the whole."""

import random

import numpy as np
import pytest

from lumigrid.operators import features
from lumigrid.plans import targets
from lumigrid.streaming import tracker

SCHEMA = "movie string, t int, detection long, x double, y double, area double"


def test_assignment_by_parts():
    draw = np.random.default_rng(1)
    for n, m in [(0, 3), (3, 0), (1, 1), (8, 5), (20, 25), (30, 30)]:
        distance = draw.uniform(0, 12, (n, m))
        distance[draw.random((n, m)) < 0.1] = np.nan
        got = tracker.matched(distance, 5.0, 4.0)
        cost = np.full((n, m + n), 1e9)
        cost[:, :m] = np.where(distance <= 5.0, distance, 1e9)
        cost[np.arange(n), m + np.arange(n)] = 4.0
        want = tracker.assign(cost) if n else np.zeros(0, int)
        assert got.tolist() == [int(k) if k < m else -1 for k in want]


@pytest.mark.parametrize("options", [{}, {"far": 2.0, "birth": 1.5, "division": 2.5, "gap": 3}])
def test_parts_of_movies(spark, options):
    draw = random.Random(2)
    rows = []
    for movie in ("a", "b"):
        at = [[draw.uniform(0, 40), draw.uniform(0, 40)] for _ in range(14)]
        for t in range(9):
            at = [[x + draw.gauss(0, 1), y + draw.gauss(0, 1)] for x, y in at]
            if t % 3 == 1:
                at.append([at[0][0] + 0.7, at[0][1] + 0.4])  # a daughter
            rows += [(movie, t, k * 7 % 1000, x, y, 1.0) for k, (x, y) in enumerate(at) if draw.random() < 0.85]
    rows.append(("c", 5, 1, None, None, 1.0))
    cells = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = sorted(map(tuple, tracker.track(cells, **options).collect()), key=str)
    parts = sorted(map(tuple, tracker.track_parts(cells, **options).select("movie", "t", "detection", "track", "parent").collect()), key=str)
    assert parts == whole and any(p is not None for *_, p in whole)
    assert tracker.track_parts(cells.limit(0)).count() == 0


def test_targets_and_features_by_name(spark):
    labels = spark.createDataFrame([(1, 0, r, c, int(r > 0)) for r in range(3) for c in range(3)], "image_id long, channel int, r int, c int, label int")
    for name, planes in targets.PLANES.items():
        rows = targets.label_targets(labels, (name,)).collect()
        want = planes or ("class0", "class1")
        assert {r.plane for r in rows} == set(want) and len(rows) == 9 * len(want) == len({(r.r, r.c, r.plane) for r in rows})
    with pytest.raises(ValueError):
        targets.label_targets(labels, ("edges",))
    df = spark.createDataFrame([(1, 2.0, 3.0)], "movie long, app double, temp_adj double")
    row = features.routed(df, ("movie",)).first()
    assert row.x.asDict() == {"appearances": 2.0} and row.y.asDict() == {"temporal_adj_matrices": 3.0}
    for bad in (df, df.drop("app"), df.withColumnRenamed("app", "apps")):
        with pytest.raises(ValueError):
            features.routed(bad, ("movie",) if bad is not df else ())
