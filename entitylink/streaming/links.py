"""The stateless match stages against a fixed dictionary also run on a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.operators.names import normalize_name, small


def stream_links(rows: DataFrame, key: str, col: str, names: DataFrame, ids: DataFrame) -> DataFrame:
    """``key, query, target`` of a (streaming) frame by raw id, else by normalised name; unmatched rows go."""
    asked = rows.select(key, F.col(col).alias("query")).where("query is not null").withColumn("norm", normalize_name(F.col("query"))).where("norm <> ''")
    by_id = small(ids.select(F.col("target").alias("direct")))
    by_name = small(names.select("norm", F.col("target").alias("named")))
    found = asked.join(by_id, F.col("query") == F.col("direct"), "left").join(by_name, "norm", "left")
    return found.select(key, "query", F.coalesce("direct", "named").alias("target")).where("target is not null")
