"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes each text to two of ``2**40`` cells and keeps the cells that more than one row reached
(8 bytes a cell travel, no text; equal texts combine before the shuffle). Those cells, folded to a size
that follows from their number and set down as 4 KB bitmaps, are the second filter: at most 256 MB
whatever the input, so it may be broadcast. It fills up with the number of repeated texts, not with the
number of rows. In pass 2 a row with a cell outside the filter is certainly unique and passes straight
through; only the rest shuffles, keyed by SHA-256, and is decided exactly. A filter that is too small
for the input sends more rows to the shuffle and never changes a result.

Defined results: a null text counts as empty; a null id is smaller than any id; rows that share both
text and id are one document recorded twice and share their decision; an empty table gives no rows;
other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm import bloom


def repeated_cells(hashed: DataFrame, sha: str, filter_bits: int | None = None) -> tuple[DataFrame, int]:
    """The second filter, bitmaps ``(bucket, bits)`` of cells reached by two rows or more, and its size in bits (a power of two)."""
    cells = hashed.select(F.explode(F.array(*bloom.cells(F.col(sha), bloom.WIDE))).alias("cell"))
    often = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell"), "often")
    size = filter_bits or bloom.bits_for(often.count())
    return bloom.bitmaps(often.select((1 + F.pmod(F.col("cell") - 1, F.lit(size))).alias("cell"))), size


def _parts(df: DataFrame, id_col: str, text_col: str, filter_bits: int | None, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that are certainly unique, and the others with their group's figures."""
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")] if carry else []
    hashed = df.select(F.col(f"`{id_col}`").alias("__id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("__sha"), *row)
    tested = bloom.maybe(hashed, "__sha", *repeated_cells(hashed.select("__sha"), "__sha", filter_bits))
    unique, rest = tested.where("not __maybe").drop("__maybe"), tested.where("__maybe").drop("__maybe")
    # written, so that the join's two sides come straight from shuffles and a hot group can be split
    groups = materialize(rest.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")), "groups")
    return unique, rest.join(groups.hint("merge"), "__sha")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    unique, rest = _parts(df, id_col, text_col, filter_bits, carry=False)
    alone = unique.select(F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    return alone.unionByName(rest.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256")))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    unique, rest = _parts(df, id_col, text_col, filter_bits, carry=True)
    return unique.select("__row.*").unionByName(rest.where(F.col("__id").eqNullSafe(F.col("__keep"))).select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
