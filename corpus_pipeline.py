"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourlens.llm import bpe_dropout, chosen_path, mixing, pii, toxicity
from labourlens.llm.queries import DROPOUT, PIECE_MODEL, SEED, TOXIC_AT
from labourlens.session import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents scored at TOXIC_AT or more go."""
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"), "text")  # the operators' own names can't clash with the columns of documents
    return toxicity.score(rows, model).filter(F.col("score") < TOXIC_AT).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near duplicates the document with the least id stays."""
    return chosen_path.keepers(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found becomes its kind in brackets; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document occurs as often as its source's target asks, none to twice."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(rows, seed=SEED).select("row", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return mixed.filter(F.col("copy") > 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece with merge-dropout: token ids in place of texts."""
    model = bpe_dropout.read_model(public_tokenizers.path(PIECE_MODEL))
    encoded = bpe_dropout.encode(docs.select("doc_id", "lang", "source", "text"), model, rate=DROPOUT, seed=SEED)
    return encoded.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("ngram_jaccard", keep_one_of_each), ("pii", mask_personal_data), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Not expressible: the scores come from compressors and a fitted model, the ids from a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
