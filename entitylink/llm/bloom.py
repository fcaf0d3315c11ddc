"""A bounded filter as 4 KB bitmaps, built and asked in DataFrame operations only.

Its size is at most ``filter_bits / 8`` bytes whatever the input, so it may be broadcast. A filter too
small for its keys answers "maybe" more often and never "no" for a key that is in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize

FILTER_BITS = 2**27
MAX_BITS = 2**31  # 256 MB, the largest filter that is broadcast
WIDE = 2**40  # cells that are only counted by a grouping, never held as bits


def bits_for(n: int) -> int:
    """Bits of a filter of n cells: 16 bits a cell or more, up to ``MAX_BITS``."""
    return min(MAX_BITS, max(2**20, 1 << (16 * n - 1).bit_length())) if n else 2**20


def cells(key: Column, filter_bits: int = FILTER_BITS) -> list[Column]:
    """Two cells (from 1) for a key."""
    return [1 + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(filter_bits)) for seed in (11, 23)]


def bitmaps(of: DataFrame) -> DataFrame:
    """Bitmaps ``(bucket, bits)`` of the column ``cell``, written to shared storage."""
    return materialize(of.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")), "bloom")


def filter_of(df: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The filter of all keys of a column."""
    return bitmaps(df.select(F.explode(F.array(*cells(F.col(key), filter_bits))).alias("cell")))


def maybe(df: DataFrame, key: str, filter_bitmaps: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``__maybe``: both of the key's cells are in the filter."""
    tests, out = [], df
    for i, cell in enumerate(cells(F.col(key), filter_bits)):
        side = F.broadcast(filter_bitmaps.select(F.col("bucket").alias(f"__b{i}"), F.col("bits").alias(f"__bits{i}")))
        out = out.withColumn(f"__cell{i}", cell).withColumn(f"__at{i}", F.expr(f"bitmap_bucket_number(__cell{i})"))
        out = out.join(side, F.col(f"__at{i}") == F.col(f"__b{i}"), "left")
        byte = f"conv(hex(substring(__bits{i}, int(bitmap_bit_position(__cell{i}) div 8) + 1, 1)), 16, 10)"
        tests.append(F.expr(f"__bits{i} is not null and (shiftright(cast({byte} as int), cast(bitmap_bit_position(__cell{i}) % 8 as int)) & 1) = 1"))
    return out.withColumn("__maybe", tests[0] & tests[1]).drop(*[f"{p}{i}" for p in ("__cell", "__at", "__b", "__bits") for i in (0, 1)])
