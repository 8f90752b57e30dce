"""Nearest neighbours against brute force."""

import numpy as np

from lumigrid.llm import ann, queries

SF = "/root/testdata/sf0.1"


def brute(ids, x, asked, k=5):
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in asked:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s = np.round(s, 12)
        order = np.lexsort((ids, -s))
        out[q] = [int(ids[i]) for i in order if ids[i] != q][:k]
    return out


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in want.items()])


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append(r.vec_id)
    return out


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = collected(queries.op5_ann(spark, SF))
    asked = ids[ids % 50 == 0]
    assert set(got) == set(asked) and all(len(v) == 5 for v in got.values())
    found = recall(got, brute(ids, x, asked))
    print("table recall", found, "parts", ann.parts_of(len(ids), ann.PART))
    assert found >= 0.9 and ann.parts_of(len(ids), ann.PART) >= 8


def probed(x, router):
    return router.probes / router.parts


def test_many_parts_on_clusters(spark):
    """Routing over 64 parts: a few of them hold nearly all neighbours of clustered data."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(400, 24))
    x = (np.repeat(centres, 50, axis=0) + 0.35 * rng.normal(size=(20_000, 24))).astype(float)
    rng.shuffle(x)
    router = ann.fit(x[:8192], 64)
    got = collected(ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 20_000, 50)], "vec_id long, embedding array<double>"), part=320))
    found = recall(got, brute(np.arange(20_000), x, range(0, 20_000, 50)))
    print("clusters: share probed", probed(x, router), "recall", found)
    assert probed(x, router) <= 1 / 3 and found >= 0.9


def test_two_levels(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(300, 12)), 30, axis=0) + 0.3 * rng.normal(size=(9000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collected(ann.search(df, df.where("vec_id % 50 = 0"), part=80, most=16))
    assert ann.parts_of(9000, 80) > 16
    found = recall(got, brute(np.arange(9000), x, range(0, 9000, 50)))
    print("two levels: recall", found)
    assert found >= 0.9


def test_clustered_copies_and_edges(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 150, axis=0) + 0.3 * rng.normal(size=(6000, 16))
    x[2000:4000] = x[7]  # a vector of a third of the rows
    rows = [(int(i), v.tolist(), 0.0) for i, v in enumerate(x)] + [(5, x[5].tolist(), 0.0), (9000, None, 0.0), (9050, [0.0] * 16, 0.0), (9100, [float("nan")] * 16, 0.0), (9150, [1.0] * 15 + [None], 0.0), (9200, [1.0], 0.0), (None, [1.0] * 16, 0.0), (9250, [float("inf")] + [1.0] * 15, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, SCORE double")
    found = ann.search(df, df.where("vec_id % 50 = 0"), sample=3000)
    got = collected(found)
    want = brute(np.arange(6000), x, range(0, 6000, 50))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert got[2050] == [7, 2000, 2001, 2002, 2003]  # ties go to the smaller ids
    for r in found.limit(50).collect():
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-14


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert collected(ann.search(df, df.where("vec_id % 50 = 0"))) == {0: [1, 50], 50: [1, 0]}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
