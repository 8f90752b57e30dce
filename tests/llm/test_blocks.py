"""Blocks are the same however a job splits its input, and one that is not known is an error."""

import os
import random

import pytest

from lumigrid.llm import quality
from lumigrid.llm.blocks import blocked, write_beside, without
from lumigrid.llm.shared import scratch

SPLITS = [
    {"spark.sql.leafNodeDefaultParallelism": "4", "spark.sql.files.maxPartitionBytes": "128m"},
    {"spark.sql.leafNodeDefaultParallelism": "13", "spark.sql.files.maxPartitionBytes": "100k"},
]


@pytest.fixture
def docs(spark, tmp_path):
    """A file of many row groups, with columns that clash with those of blocks."""
    keys = ["spark.sql.files.openCostInBytes", *SPLITS[0]]
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(400)), "en", 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, block int")
    df.coalesce(1).write.option("parquet.block.size", 50_000).parquet(str(tmp_path / "docs"))
    yield spark.read.parquet(str(tmp_path / "docs"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(spark, values):
    for k, v in values.items():
        spark.conf.set(k, v)


def test_blocks_do_not_depend_on_splits(spark, docs):
    seen, splits = [], []
    for how in SPLITS:
        put(spark, how)
        held = blocked(docs.drop("block").where("doc_id >= 0"), rows=500)
        splits.append(held.rdd.getNumPartitions())
        seen.append({(r.block, r.doc_id) for r in held.select("block", "doc_id").collect()})
    assert splits[0] != splits[1] and seen[0] == seen[1] and len({b for b, _ in seen[0]}) == 8


def test_decisions_hold_under_other_splits(spark, docs):
    put(spark, SPLITS[0])
    held = blocked(docs.drop("block"), rows=500)
    rest = without(held, held.where("doc_id % 2 = 0").select("block", "doc_id"), "doc_id")
    none = without(held, held.where("doc_id < 0").select("block", "doc_id"), "doc_id")
    assert rest.count() == 2000 and none.count() == 4000
    put(spark, SPLITS[1])
    late = rest.where("doc_id >= 0")
    assert late.count() == 2000 and late.where("doc_id % 2 = 0").count() == 0 and none.where("doc_id >= 0").count() == 4000


def test_unknown_blocks_are_an_error(spark, docs):
    held = blocked(docs.drop("block"), rows=500)
    rows = quality._rows(held, "doc_id", "text", "lang")
    folder = write_beside(rows.where("doc < 500").selectExpr("block", "doc", "true as calibrates"), "trusted", "doc")
    with pytest.raises(Exception, match="nothing was written"):
        quality.block_grams(rows, folder, 2).count()


def test_rows_of_no_file_and_clashing_names(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 4000, 3)], "doc_id long, quality int, toxic int")
    for df in (docs, docs.repartition(3), docs.union(docs.limit(5))):
        kept = quality.keep(df, labels, order=2)
        assert kept.columns == df.columns and kept.where("block <> 7").count() == 0
        assert kept.count() >= 0.9 * df.count()


def test_scratch_leaves_nothing(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 4000, 3)], "doc_id long, quality int, toxic int")
    with scratch(spark) as folder:
        quality.keep(docs, labels, order=2).write.parquet(str(tmp_path / "kept"))
        assert os.path.isdir(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://")) and spark.read.parquet(str(tmp_path / "kept")).count() >= 3600
