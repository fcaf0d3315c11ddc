"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylink.operators.names import fit_names, harmonize
from entitylink.operators.serve import explore
from entitylink.plans import q_columns, q_names, q_recipes, q_serve, q_sources, q_variants  # noqa: F401
from entitylink.plans.views import ORACLE, QUERIES, Tables


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary -> links -> how many rows of each part mention each entity."""
    t = Tables(spark, folder)
    names, ids = fit_names(t.names(), source_col="source")
    links = harmonize(t.raw(), "raw_id", ["said"], names, ids).where("harmonized")
    orders = harmonize(t.orders.select(F.col("o_orderkey").cast("string").alias("raw_id"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("who")), "raw_id", ["who"], names, ids).where("harmonized")
    return explore({"lineitem": {"name": links}, "orders": {"name": orders}}, "name")
