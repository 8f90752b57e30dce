"""Points near each other by blocks, against comparing all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumigrid.operators import graph
from lumigrid.plans import adapters

CELL = "movie string, t int, track long, x double, y double"


def frames(spark):
    draw = random.Random(4)
    rows = [(m, t, k, draw.choice([draw.gauss(0, 3), draw.uniform(-500, 500), 64.0 * draw.randrange(-3, 3)]), draw.uniform(-40, 40)) for m in "ab" for t in range(2) for k in range(150)]
    rows += [("a", 0, 900 + k, 8.0, 8.0) for k in range(30)] + [("a", 1, None, 1.0, 2.0), ("b", 0, 901, None, 1.0), ("b", 0, 902, math.nan, 1.0), ("b", 1, 903, math.inf, 1.0), ("c", 0, 1, 4.0, 0.0), ("c", 0, 2, 0.0, 0.0), (None, 0, 1, 4.0, 0.0)]
    return rows, spark.createDataFrame(rows, CELL).repartition(5)


def plain_edges(rows):
    return [(m, t, i, j) for m, t, i, x, y in rows for n, u, j, a, b in rows if m == n and m and t == u and x is not None and a is not None and math.isfinite(x + a) and math.sqrt((x - a) ** 2 + (y - b) ** 2) < 4.0]


def test_edges_by_blocks(spark):
    rows, cells = frames(spark)
    want = sorted(plain_edges(rows), key=str)
    assert sorted(map(tuple, graph.adjacency(cells, 4.0).collect()), key=str) == want and len(want) > 2000
    edges = graph.adjacency(cells, 4.0)
    whole = sorted(map(tuple, graph.normalized(edges).collect()), key=str)
    assert sorted(map(tuple, graph.normalized_adjacency(cells, 4.0).collect()), key=str) == whole
    key = lambda r: str((r.movie, r.t, r.track))
    sums = sorted(graph.convolve(cells, graph.normalized(edges), "x").collect(), key=key)
    got = sorted(graph.neighbour_sums(cells, 4.0, "x").collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in sums] and [r.x for r in got] == pytest.approx([r.x for r in sums], abs=1e-9)


def test_edges_are_not_shuffled(spark):
    """Only cells are: no exchange comes after pairs are made."""
    cells = frames(spark)[1]
    for made in (graph.adjacency(cells, 4.0), graph.normalized_adjacency(cells, 4.0), graph.neighbour_sums(cells, 4.0, "x")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_sums_of_neighbours_do_not_depend_on_their_order(spark):
    """Terms whose sum in doubles differs by order give one result."""
    places = [0.1, 0.2, 0.3, 0.7, 1e3 + 0.3, 1e3 + 0.1, 0.6, 1.1]
    values = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16, 2.0, 0.7]
    seen = set()
    for k in range(8):
        rows = [("a", 0, (i * 3 + k) % 8, places[i] % 3, 0.0, values[i]) for i in range(8)]
        cells = spark.createDataFrame(rows, CELL + ", v double")
        seen |= {r.v for r in graph.neighbour_sums(cells, 4.0, "v").collect()}
    assert len(seen) == 1


def test_means_of_cells_are_of_events_in_order(spark, tmp_path):
    values = [0.1, 0.2, 0.3, 0.7, 0.05, None]
    rows = [(k, "2024-01-05 07:00:00", 3, "view", v) for k, v in enumerate(values)] + [(9, "2024-01-05 07:00:00", 4, "view", None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = 0.0
    for v in values[:-1]:
        want += v
    for way in (events.orderBy(F.desc("event_id")).coalesce(1), events.repartition(4, "event_id"), events.orderBy(F.col("event_id") % 2, "event_id").coalesce(1)):
        way.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        got = {r.track: (r.x, r.area) for r in adapters.cell_table(spark, str(tmp_path)).collect()}
        assert got == {3: (want / 5, 6), 4: (None, 1)}
