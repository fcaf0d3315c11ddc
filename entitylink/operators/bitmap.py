"""Bitmap index of links: which rows of a part hold a target, as bits of dense row numbers.

The index has one row per part, entity type, target and word of 64 rows with at least one bit. Rows that
stand together share words, so frequent targets take one row for 64 links and rare ones no more than their
links. Co-occurrence is AND of words, counting is popcount; the links themselves are read once, when the
index is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.operators.dictionary import union_parts
from entitylink.operators.names import small
from entitylink.operators.row_ids import row_ids

WORD = 64


def link_index(parts: dict[str, dict[str, DataFrame]], key: str = "raw_id", target: str = "target") -> DataFrame:
    """``part, kind, target, word, bits`` of the link tables of several parts; a row counts once per target."""
    links = [df.select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.col(key).alias("row"), F.col(target).alias("target")) for part, kinds in parts.items() for kind, df in kinds.items()]
    links = materialize(union_parts(links).where("row is not null and target is not null"), "links")
    rows = row_ids(links.select("part", "row").distinct(), "nth", ["part", "row"], start=0)
    placed = links.join(rows, ["part", "row"])
    bit = F.expr(f"shiftleft(1L, cast(nth % {WORD} as int))")
    return materialize(placed.groupBy("part", "kind", "target", F.expr(f"nth div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits")), "link-index")


def rows_with(index: DataFrame, values: dict[str, list]) -> DataFrame:
    """``part, word, bits``: the rows that hold one of the values of every entity type."""
    wanted = index.where(any_of(values))
    each = wanted.groupBy("part", "word", "kind").agg(F.bit_or("bits").alias("bits"))
    both = each.groupBy("part", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == len(values)) & (F.col("bits") != 0)).drop("n")


def any_of(values: dict[str, list]) -> Column:
    out = F.lit(False)
    for kind, targets in values.items():
        out |= (F.col("kind") == kind) & F.col("target").isin(targets)
    return out


def explore_index(index: DataFrame, core_type: str, values: dict[str, list] | None = None) -> DataFrame:
    """``part, target, n``: rows per part and target of an entity type, of rows that hold all the values.

    A part takes part only if it has all entity types asked for.
    """
    core = index.where(F.col("kind") == core_type)
    if not values:
        return core.groupBy("part", "target").agg(F.sum(F.bit_count("bits")).alias("n"))
    held = small(rows_with(index, values).withColumnRenamed("bits", "held"))
    both = core.join(held, ["part", "word"]).withColumn("n", F.bit_count(F.col("bits").bitwiseAND(F.col("held"))))
    return both.where("n > 0").groupBy("part", "target").agg(F.sum("n").alias("n"))


def co_occurring(index: DataFrame, one: str, two: str) -> DataFrame:
    """``part, target_a, target_b, n``: rows that hold a target of each of two entity types.

    Targets meet by word, so pairs that share no 64 rows never do.
    """
    side = lambda kind, name: index.where(F.col("kind") == kind).select("part", "word", F.col("target").alias(f"target_{name}"), F.col("bits").alias(f"bits_{name}"))
    both = side(one, "a").join(side(two, "b"), ["part", "word"]).withColumn("n", F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))))
    return both.where("n > 0").groupBy("part", "target_a", "target_b").agg(F.sum("n").alias("n"))
