"""A cleaning pipeline over the documents table, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stargauge.llm import decontaminate, jaccard, language, pieces, toxicity
from stargauge.llm.common import table
from stargauge.llm.queries import tokenizer_path
from stargauge.sources.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no language prevails."""
    return language.identified(docs, language.fit(language.training_rows(docs)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents judged toxic by a model fitted to the labels of those it is given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.teaching())
    return toxicity.civil(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest key of each group of linked ones."""
    return jaccard.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and whether they decode to the text."""
    encoded = pieces.encode_and_decode(docs, tokenizer_path())
    return encoded.select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pieces", encode_pieces),
]
# Trained models and token ids have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
