"""Readers and writers of tables. All raw columns are read as text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entitylink.functions.columns import empty_to_null, keep_declared
from entitylink.operators.names import small
from entitylink.operators.row_ids import row_ids


def read_delimited(spark: SparkSession, path, sep: str = "\t", encoding: str = "UTF-8", comment: str | None = None, names: list[str] | None = None, skip: int = 0) -> DataFrame:
    """Text tables, gz too: comment lines dropped, ``skip`` lines before the header, given names if headerless.

    With ``skip``, lines count as they stand in the file, empty ones too, and the first lines of each file are
    dropped where they repeat those of the first file. Empty lines of the body are no rows.
    """
    if not skip:
        reader = spark.read.option("sep", sep).option("encoding", encoding).option("inferSchema", False).option("escape", "\\" if sep == "\t" else '"')
        reader = reader.option("comment", comment) if comment else reader
        return reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path) if names else reader.option("header", True).csv(path)
    text = spark.read.text(path)  # keeps empty lines, so that places are line numbers
    line = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() != "UTF-8" else F.col("value")
    head = [r["value"] for r in spark.read.text(min(text.inputFiles())).limit(skip + (not names)).select(line.alias("value")).collect()]  # lines before the header, and it unless names are given
    names = names or head[-1].split(sep)
    # rows of a file's first block are numbered without gaps, so these are the places of its first lines
    lines = text.select(line.alias("line"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    begin = lines.where("block = 0").groupBy("file").agg(F.min("at").alias("begin"))
    lines = lines.join(small(begin), "file", "left")
    top = [(F.col("at") - F.col("begin") == i) & (F.col("line") == F.lit(text)) for i, text in enumerate(head)]
    body = lines.where(~F.coalesce(reduce(Column.__or__, top), F.lit(False)) & (F.col("line") != ""))
    body = body if not comment else body.where(~F.startswith("line", F.lit(comment)))
    return body.select(F.from_csv("line", ", ".join(f"`{n}` string" for n in names), {"sep": sep}).alias("r")).select("r.*")


def read_select_columns(spark: SparkSession, path, keep: list[str], required: list[str], **options) -> DataFrame:
    """A fixed subset of a wide file; rows need all required columns."""
    return keep_declared(read_delimited(spark, path, **options), keep).na.drop(subset=required)


def read_json(spark: SparkSession, path, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """An array of records (or one record a line)."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml(spark: SparkSession, path, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def parse_xml(col: Column, schema: str) -> Column:
    """One XML record per value; attributes are fields that start with ``_``."""
    return F.from_xml(col, schema)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_col: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **properties) -> DataFrame:
    """A database table, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition_col:
        reader = reader.options(partitionColumn=partition_col, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "snappy") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite", compression: str = "none") -> None:
    df.write.mode(mode).options(sep=sep, header=True, escape="\\", compression=compression, emptyValue="").csv(path)


def load_table(df: DataFrame, target: str, nullable: list[str] = (), check: Callable[[DataFrame], bool] | None = None) -> int:
    """Replace a serving table: empty text of nullable columns as null.

    Rows are counted while they are written to a staging table, which takes the place of the old one only
    after it has as many rows and passes the caller's check; otherwise the old table stays as it was.
    """
    spark, staging, old = df.sparkSession, f"{target}__staging", f"{target}__old"
    out = df.select(*[empty_to_null(F.col(f"`{c}`")).alias(c) if c in nullable else F.col(f"`{c}`") for c in df.columns])
    seen = Observation()
    spark.sql(f"drop table if exists {staging}")
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.saveAsTable(staging)
    staged = spark.table(staging)
    there = staged.count()
    if there != seen.get["n"] or (check and not check(staged)):
        spark.sql(f"drop table {staging}")
        raise RuntimeError(f"{target}: staged {there} rows of {seen.get['n']}, or the check failed; the table is unchanged")
    spark.sql(f"drop table if exists {old}")
    if spark.catalog.tableExists(target):
        spark.sql(f"alter table {target} rename to {old}")
    spark.sql(f"alter table {staging} rename to {target}")
    spark.sql(f"drop table if exists {old}")
    return there


def merge_files(spark: SparkSession, paths: list[str], id_col: str | None = None, dedup: list[str] | None = None, order_by: list[str] | None = None, **options) -> DataFrame:
    """Many part files as one table: one row per key, and a new dense id if asked for."""
    df = read_delimited(spark, paths, **options)
    df = df.dropDuplicates(dedup) if dedup else df
    return row_ids(df, id_col, order_by or df.columns) if id_col else df


def backup(spark: SparkSession, tables: list[str], folder: str) -> None:
    for t in tables:
        write_delimited(spark.table(t), f"{folder}/{t}")


def restore(spark: SparkSession, tables: list[str], folder: str) -> None:
    for t in tables:
        read_delimited(spark, f"{folder}/{t}").write.mode("overwrite").saveAsTable(t)


def repair_ragged(lines: DataFrame, header: list[str], count_col: str, sep: str = "\t") -> DataFrame:
    """Lines whose comma list was expanded by tabs: n ids in ``count_col`` mean the next n cells are one."""
    at = header.index(count_col) + 1  # cells before the expanded ones
    cells = F.split("line", re.escape(sep), -1)
    n = F.when(F.coalesce(F.get("c", F.lit(at - 1)), F.lit("")) == "", 1).otherwise(F.size(F.split(F.get("c", F.lit(at - 1)), ",", -1)))
    rows = lines.select(cells.alias("c")).withColumn("n", n)
    fixed = F.concat(F.slice("c", 1, at), F.array(F.array_join(F.slice("c", F.lit(at + 1), F.col("n")), ",")), F.slice("c", F.col("n") + at + 1, F.size("c")))
    rows = rows.select(F.when((F.col("n") > 1) & (F.size("c") > len(header)), fixed).otherwise(F.col("c")).alias("c"))
    return rows.select(*[F.get("c", F.lit(i)).alias(name) for i, name in enumerate(header)])
