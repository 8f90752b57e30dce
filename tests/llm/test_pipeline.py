"""Each stage of the pipeline against a plain version over its own input."""

import sentencepiece
from test_neardup import brute
from test_passages import by_hand

import corpus_pipeline
from lumigrid.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == docs.columns
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        kept = sorted(r.doc_id for r in after)
        texts = [(r.doc_id, r.text) for r in before]
        if k == 0:
            score = toxicity.fit(docs, labels).scorer()
            want = [i for i, t in texts if score(t) < toxicity.THRESHOLD]
        elif k == 1:
            want = [r.doc_id for r in quality.score(docs, labels).where("keep").collect()]
        elif k == 2:
            want = set(brute(texts).values())
        elif k == 3:
            want = [i for i, t in texts if by_hand(t, items)[1] == 0]
        else:
            want = [i for i, _ in texts]
            assert {r.doc_id: r.ids for r in after} == {i: library.encode(t) for i, t in texts}
            assert all(r.round_trip and r.n_ids == len(r.ids) for r in after)
        assert kept == sorted(want), name
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == len(kept)
