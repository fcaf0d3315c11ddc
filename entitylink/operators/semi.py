"""A bounded bitmap that tells which keys cannot be in a table, to drop their rows before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize

#: Bits for each key, and of a whole filter at most (256 MB, which may be broadcast).
PER_KEY, MOST_BITS = 16, 2**31


def _cell(cols: list[str], bits: int) -> Column:
    return 1 + F.pmod(F.xxhash64(*cols), F.lit(bits))


def key_filter(table: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """Bitmaps ``(bucket, bits)`` of the keys of a table, written once, and the size of the filter in bits."""
    n = table.count()
    bits = min(MOST_BITS, max(2**15, 1 << (PER_KEY * max(n, 1) - 1).bit_length()))
    cells = table.select(_cell(cols, bits).alias("cell"))
    maps = cells.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
    return materialize(maps, "key-filter"), bits


def may_be_in(df: DataFrame, cols: list[str], maps: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be in the table: all that are, and about one in ``PER_KEY`` of the others.

    More of the others pass where the table has more keys than the largest filter has room for.
    """
    side = F.broadcast(maps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    placed = df.withColumn("__cell", _cell(cols, bits)).withColumn("__at", F.expr("bitmap_bit_position(__cell)"))
    met = placed.join(side, F.expr("bitmap_bucket_number(__cell)") == F.col("__bucket"))
    byte = "cast(conv(hex(substring(__bits, int(__at div 8) + 1, 1)), 16, 10) as int)"
    return met.where(f"({byte} & shiftleft(1, int(__at % 8))) <> 0").select(df.columns)
