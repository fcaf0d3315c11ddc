"""Dense row ids without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize


def row_ids(df: DataFrame, col: str, order_by: list, start: int = 1, replace: bool = False) -> DataFrame:
    """Number rows from ``start`` in the given total order.

    Rows are range-partitioned and written sorted; each written part is counted, the counts (one per
    part) are summed up, and every part numbers its own rows from its offset. ``replace`` renumbers an
    existing column, otherwise the column must be new.
    """
    if (col in df.columns) != replace:
        raise ValueError(f"column {col} {'is missing' if replace else 'exists'}")
    base = df.drop(col) if replace else df
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    keyed = base.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    keys = [f"__o{i}" for i in range(len(order))]
    parts = keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "row-ids")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))  # one row per part
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    out = parts.withColumn("__nth", local).join(offsets, "__part")
    return out.select((F.col("__offset") + F.col("__nth") + (start - 1)).alias(col), *[F.col(f"`{c}`") for c in base.columns])
