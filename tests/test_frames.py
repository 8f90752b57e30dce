"""All cells of a frame, or of two, as the SQL has them."""

from lumigrid.operators import graph


def test_other_cells_of_a_frame(spark):
    rows = [("a", 0, 5), ("a", 0, None), ("a", 0, 1), ("a", 0, 9), ("a", 1, 7), ("a", 2, None)]
    cells = spark.createDataFrame(rows, "movie string, t int, track long")
    got = {(r.t, r.track): r.different for r in graph.others(cells).collect()}
    # a track that is null differs from none and none from it
    assert got == {(0, 5): [1, 9], (0, None): [], (0, 1): [5, 9], (0, 9): [1, 5], (1, 7): [], (2, None): []}
