"""The quality decision against labels that the counts have not seen."""

import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lumigrid.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_shares(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").select("doc_id", "quality", "keep").collect()
    bad = [r.keep for r in rows if r.quality == 0]
    good = [r.keep for r in rows if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    print(f"quality 0 rejected: {bad.count(False)} of {len(bad)}; held-out quality 1 kept: {good.count(True)} of {len(good)}")
    assert bad.count(False) >= 0.85 * len(bad) and good.count(True) >= 0.99 * len(good)


def test_counts_of_a_block_take_little_memory(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join("abcde é"[k] for k in rng.integers(0, 7, 2000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 1000), pa.array(range(1000)), pa.array(texts)], names=["block", "doc", "text"])
    monkeypatch.setattr(quality, "_flags", lambda folder, block, docs: (docs % 3 == 0, docs % 15 == 0))
    rows = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    run = quality.block_grams(rows, "", 3)
    tracemalloc.start()
    (out,) = run([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for doc, text in enumerate(texts):
        raw = b"\0\0" + text.encode()
        grams = [int.from_bytes(raw[k - 2 : k + 1][::-1], "little") for k in range(2, len(raw))]
        want.update(grams if doc % 3 == 0 and doc % 15 else dict.fromkeys(grams, 0))
    assert set(out["block"].to_pylist()) == {7} and out["gram"].to_pylist() == sorted(want)
    assert dict(zip(out["gram"].to_pylist(), out["n"].to_pylist())) == want
    assert peak < 32 << 20
