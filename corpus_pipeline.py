"""Corpus pipeline: quality, exact dedup, near dedup, mixing, tokens; each stage works on all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm import exact_dedup, minhash_dedup, mixing, quality, tokenize_sp


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labelled ones among them, does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text"))
    scored = quality.score_quality(packed, model, keep_text=True)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*[F.col(f"row.`{c}`") if c != "text" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots in the mix, from file to file and row to row."""
    placed = mixing.mix_sources(docs)
    return placed.repartitionByRange("mix_slot", "stream", "in_block").sortWithinPartitions("mix_slot", "stream", "in_block").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; the digests allow a check of the round trip."""
    return tokenize_sp.encode_texts(docs, tokenize_sp.default_model())


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("tokens", tokens)]

#: The model of the first stage and the tokenizer have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
