"""What tasks hold at once, in Python and in the executors' JVM."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lumigrid.llm import decontaminate, quality, words

READ, SENT = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_few_texts_are_read_at_once(spark):
    session = spark.newSession()
    words.small_batches(SimpleNamespace(sparkSession=session))
    assert int(session.conf.get(READ)) <= 1000 and int(session.conf.get(SENT)) <= 1000
    own = spark.newSession()
    own.conf.set(READ, "2000")
    words.small_batches(SimpleNamespace(sparkSession=own))
    assert own.conf.get(READ) == "2000"  # what the session says holds


def test_ngrams_of_a_block_go_back_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(chr(97 + k) for k in rng.integers(0, 26, 300_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([text])], names=["block", "doc", "text"])
    monkeypatch.setattr(quality, "_flags", lambda folder, block, docs: (docs == 1, docs == 0))
    rows = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    got = list(quality.block_grams(rows, "", 5)([batch]))
    grams, n = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in ("gram", "n"))
    want, counts = np.unique(quality.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 5), return_counts=True)
    assert (grams == want).all() and (n == counts).all() and all(set(b.column("block").to_pylist()) == {7} for b in got)
    assert max(b.num_rows for b in got) <= 1 << 16 < len(want)


def test_suffixes_of_a_slice_take_little_memory(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 400)) for _ in range(2000)]
    items = [("a", " ".join(texts[3].split()[7:30]))]
    kept = {}
    monkeypatch.setattr(decontaminate, "append", lambda df, text, ddl, make, limit=words.SLICE_BYTES: kept.update(make=make, limit=limit) or df)
    docs = spark.createDataFrame([("x",)], "text string").selectExpr("text", "0L _n0", "array(array(0)) _hit0", "array('') _items0", "named_struct('words', 0L, 'before', 0L, 'item', '') _best0")
    decontaminate.scan(docs, spark.createDataFrame(items, "item_id string, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    compute = kept["make"]()
    tracemalloc.start()
    found = [i for piece in words.slices([batch], "text", kept["limit"]) for i in compute(piece.column(0))[2]]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for k, i in enumerate(found) if i] == [3]
    assert most < 50 << 20
