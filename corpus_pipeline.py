"""A corpus cleaned in stages; each reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm import decontaminate, neardup, quality, sentencepiece_lattice, toxicity
from lumigrid.llm.queries import TOKENIZER
from lumigrid.llm.shared import table


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove(docs, model)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above the line of trusted text of their language."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    pieces = sentencepiece_lattice.Pieces.load(TOKENIZER("piece_bpe_32k.model"))
    coded = sentencepiece_lattice.encode(docs.select("doc_id", "lang", "source", "text"), pieces)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("toxicity", harmless),
    ("quality classifier", good),
    ("near-duplicates", single),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece", encoded),
]

#: The stages train models and run suffix arrays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage{k}")
    return docs
