"""Toxicity scores: held-out accuracy, and edges."""

import random
import zlib

import numpy as np
import zstandard

from lumigrid.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = queries.op8_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    guess = np.array([r.predicted for r in rows])
    assert (guess == (score >= 0.3)).all() and (score >= 0).all() and (score <= 1).all()
    assert (score[y == 1][:, None] > score[y == 0][None, :]).mean() > 0.95  # area under the curve
    assert (guess == y).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (2, "word " * 50_000, 0.2), (3, "x" * 300_000, 0.0)], "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is None
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0] * 5
    texts = [(i, f"plain words of day {i} {'vile ' * (i % 4 == 0)} and of night {i * 7}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels, sample={1: 60, 0: 90})
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "a vile thing"), (2, "a fine thing"), (3, None)], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > max(got[2], got[3])
    assert len({r.score for r in toxicity.score(docs, model).where("doc_id = 1").collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_features_equal_a_plain_loop(spark):
    """Gains of windows, each compressed anew with both dictionaries."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["vile", "plain", "good", "day", "night", "uncommon", "VILEST", "é"]) for _ in range(30)) for _ in range(20)] + ["", None]
    docs = spark.createDataFrame([(i, f"plain day {i} {'vile thing ' * (i % 4 == 0)} {i * 7}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    for size in (1, 3):
        model = toxicity.fit(docs, labels, window=size)
        how = zstandard.ZstdCompressionParameters(window_log=16, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

        def length(window, content, how=how):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(b" " + window + b" " + bytes(12)))

        measure = model.scorer()
        for t in texts:
            w = toxicity.tokens(t)
            windows = [b" ".join(w[k : k + size]) for k in range(0, len(w), size)]
            gains = [min(max(length(x, model.ordinary) - length(x, model.toxic), 0), toxicity.STEPS) for x in windows]
            least = [sum(g >= k for g in gains) for k in range(1, toxicity.STEPS + 1)]
            want = [*np.log1p(least), *[x / max(len(windows), 1) * 10 for x in least], sum(x > 0 for x in least) / toxicity.STEPS, 1.0]
            assert np.allclose(measure.features(t), want)
            assert abs(measure(t) - 1 / (1 + np.exp(-np.dot(want, model.weights)))) < 1e-9
