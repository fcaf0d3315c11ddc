"""Ontology text: terms, synonyms and is_a edges from stanzas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """One stanza per row, column ``stanza``."""
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "stanza")


def parse_obo(stanzas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms ``id, name``; synonyms ``id, text, scope``; edges ``child, parent``) of ``[Term]`` stanzas."""
    line = F.split(F.trim(F.col("stanza"), F.lit("\n")), "\n", -1)
    terms = stanzas.select(line.alias("l")).where(F.get("l", F.lit(0)) == "[Term]")
    value = lambda key: F.regexp_extract(F.get(F.filter("l", lambda x: F.startswith(x, F.lit(f"{key}: "))), F.lit(0)), rf"^{key}: (.*)$", 1)
    keyed = terms.select(value("id").alias("id"), value("name").alias("name"), "l")
    lines = keyed.select("id", F.explode("l").alias("x"))
    synonym = r'^synonym: "((?:[^"\\]|\\.)*)" ([A-Z]+)'
    synonyms = lines.where(F.startswith("x", F.lit("synonym: "))).select("id", F.regexp_extract("x", synonym, 1).alias("text"), F.regexp_extract("x", synonym, 2).alias("scope"))
    edges = lines.where(F.startswith("x", F.lit("is_a: "))).select(F.col("id").alias("child"), F.regexp_extract("x", r"^is_a: ([^ ]+)", 1).alias("parent"))
    return keyed.select("id", "name"), synonyms, edges
