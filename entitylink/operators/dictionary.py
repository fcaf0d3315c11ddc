"""Entity dictionaries from many contributing sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.columns import clean_df, drop_id_names, filter_too_long
from entitylink.operators.row_ids import row_ids


def union_parts(dfs: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), dfs)


def merge_mappings(dfs: list[DataFrame]) -> DataFrame:
    """All contributions, distinct."""
    return union_parts(dfs).distinct()


def restrict_to_main(df: DataFrame, main: DataFrame, target: str) -> DataFrame:
    """Only ids known to the main table."""
    return df.join(main.select(target).distinct(), target, "left_semi")


def unknown_ids(other: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids of other sources that the main source does not know."""
    return other.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(known.select(id_col).distinct(), id_col, "left_anti")


def id_difference(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    return a.select(id_col).subtract(b.select(id_col))


def concat_entries(known: DataFrame, new: DataFrame, id_col: str, order_by: list[str], copy: str) -> DataFrame:
    """Known and newly found entries in one table with a row id and a copy of the id."""
    return row_ids(known.unionByName(new, allowMissingColumns=True), id_col, order_by).withColumn(copy, F.col(id_col))


def numeric_suffix(col, prefix: str):
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, f"^{prefix}", "").try_cast("long")


def sort_prefixed(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Order by the integer after a fixed prefix, then by the text."""
    return df.orderBy(numeric_suffix(col, prefix), col)


def aggregate_sources(df: DataFrame, keys: list[str], *lists: str) -> DataFrame:
    """Distinct values per key as comma lists; several lists stay paired."""
    pairs = F.array_sort(F.collect_set(F.struct(*lists)))
    out = df.groupBy(*keys).agg(pairs.alias("__p"))
    return out.select(*keys, *[F.array_join(F.col("__p")[c], ",").alias(c) for c in lists])


def build_dict(dfs: list[DataFrame], target: str, prefix: str, max_name: int = 255, max_type: int = 100, main: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Contributions ``(target, name, [type], data_sources)`` -> numbered entities and numbered names."""
    rows = merge_mappings(dfs)
    if main is not None:
        rows = restrict_to_main(rows, main, target)
    rows = filter_too_long(drop_id_names(rows, target, "name"), "name", max_name)
    lists = ["data_sources"]
    if "type" in rows.columns:
        rows, lists = filter_too_long(rows, "type", max_type), ["data_sources", "type"]
    ids = rows.select(target).where(F.col(target).isNotNull()).distinct()
    entities = row_ids(ids, "id", [numeric_suffix(target, prefix), target])
    names = row_ids(aggregate_sources(clean_df(rows), [target, "name"], *lists), "id", [target, "name"])
    return entities, names
