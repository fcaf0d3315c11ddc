"""Views over the driver's tables that stand in for source data, for Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(run):
        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return run

    return add


class Tables:
    """The tables of a folder, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def names(self) -> DataFrame:
        """Entities of three sources: id, name, source."""
        one = lambda df, p, k, n, s: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(n).alias("name"), F.lit(s).alias("source"))
        return one(self.supplier, "SUPP:", "s_suppkey", "s_name", "supplier").union(one(self.nation, "NAT:", "n_nationkey", "n_name", "nation")).union(one(self.customer, "CUST:", "c_custkey", "c_name", "customer"))

    def homonyms(self) -> DataFrame:
        """Many ids for few names."""
        return self.part.select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("type"), F.col("p_brand").alias("source"))

    def words(self) -> DataFrame:
        """Every word of a part name is an entity."""
        return self.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(F.concat(F.lit("TERM:"), "w").alias("id"), F.col("w").alias("name"))

    def raw(self) -> DataFrame:
        """Lineitem rows with a re-spelled supplier name and a customer's id."""
        l = self.lineitem
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        said = l.select(key.alias("raw_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
        said = said.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return said.select("raw_id", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.upper(F.regexp_replace("s_name", "#", " - ")).alias("said"), F.col("p_name").alias("item"))

    def links(self) -> dict[str, DataFrame]:
        """Links of lineitem rows to supplier and part entities."""
        r = self.raw()
        one = lambda p, c: r.select("raw_id", F.concat(F.lit(p), F.col(c).cast("string")).alias("target"))
        return {"supplier": one("SUPP:", "l_suppkey"), "part": one("PART:", "l_partkey")}

    def order_links(self) -> dict[str, DataFrame]:
        """Links of orders to customers, and to the suppliers of their lines."""
        o = self.orders.select(F.col("o_orderkey").cast("string").alias("raw_id"), F.concat(F.lit("CUST:"), F.col("o_custkey").cast("string")).alias("target"))
        s = self.lineitem.select(F.col("l_orderkey").cast("string").alias("raw_id"), F.concat(F.lit("SUPP:"), F.col("l_suppkey").cast("string")).alias("target")).distinct()
        return {"customer": o, "supplier": s}

    def hgvs(self) -> DataFrame:
        """Variant names of every kind from lineitem."""
        part, line, n = F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
        coding = F.concat(F.lit("NM_"), F.lpad(part, 6, "0"), F.lit("."), line, F.lit(":c."), n, F.lit("G>T"))
        protein = F.concat(F.lit("GENE"), part, F.lit(":p.V"), n, F.lit("E"))
        bare = F.concat(F.lit("GENE"), part, F.lit(":"), F.when(F.col("l_linenumber") < 4, F.concat(F.lit("V"), n, F.lit("E"))).otherwise("Loss"))
        broken = F.concat(F.lit("GENE"), part, F.lit(" amplification"))
        text = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "R", protein).when(F.col("l_returnflag") == "A", bare).otherwise(coding)).otherwise(F.when(F.col("l_returnflag") == "N", coding).otherwise(broken))
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        return self.lineitem.select(key.alias("raw_id"), text.alias("hgvs"))

    def tree(self) -> DataFrame:
        """Nations below regions below the world, and parts below the part of a third their number."""
        n = self.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
        r = self.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent"))
        p = self.part.where("p_partkey > 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("child"), F.concat(F.lit("P"), F.expr("p_partkey div 3").cast("string")).alias("parent"))
        return n.union(r).union(p)


NAMES = """names AS (SELECT 'SUPP:' || s_suppkey AS id, s_name AS name, 'supplier' AS source FROM supplier
  UNION ALL SELECT 'NAT:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'CUST:' || c_custkey, c_name, 'customer' FROM customer)"""
NORM = "lower(regexp_replace({}, '[^a-zA-z0-9]+', '', 'g'))"
INDEX = f"{NAMES}, idx AS (SELECT DISTINCT {NORM.format('t')} AS norm, id FROM (SELECT name AS t, id FROM names UNION ALL SELECT id, id FROM names) WHERE {NORM.format('t')} <> '')"
WORDS = "words AS (SELECT DISTINCT 'TERM:' || w AS id, w AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
WORD_INDEX = f"{WORDS}, idx AS (SELECT DISTINCT {NORM.format('t')} AS norm, id FROM (SELECT name AS t, id FROM words UNION ALL SELECT id, id FROM words) WHERE {NORM.format('t')} <> '')"
KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
RAW = f"""raw AS (SELECT {KEY} AS raw_id, l_orderkey, l_partkey, l_suppkey, l_returnflag,
  upper(replace(s_name, '#', ' - ')) AS said, p_name AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
LINKS = f"{RAW}, sl AS (SELECT raw_id, 'SUPP:' || l_suppkey AS target FROM raw), pl AS (SELECT raw_id, 'PART:' || l_partkey AS target FROM raw)"
ORDER_LINKS = """oc AS (SELECT o_orderkey::VARCHAR AS raw_id, 'CUST:' || o_custkey AS target FROM orders),
  os AS (SELECT DISTINCT l_orderkey::VARCHAR AS raw_id, 'SUPP:' || l_suppkey AS target FROM lineitem)"""
HGVS = f"""hgvs AS (SELECT {KEY} AS raw_id, CASE
  WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'GENE' || l_partkey || ':p.V' || l_quantity::INT || 'E'
  WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'GENE' || l_partkey || ':' || CASE WHEN l_linenumber < 4 THEN 'V' || l_quantity::INT || 'E' ELSE 'Loss' END
  WHEN l_linestatus = 'F' OR l_returnflag = 'N' THEN 'NM_' || lpad(l_partkey::VARCHAR, 6, '0') || '.' || l_linenumber || ':c.' || l_quantity::INT || 'G>T'
  ELSE 'GENE' || l_partkey || ' amplification' END AS hgvs FROM lineitem)"""
PARSED = HGVS + r""", parsed AS (SELECT *, CASE WHEN ver THEN split_part(r, '.', 1) ELSE r END AS ref, CASE WHEN ver THEN split_part(r, '.', 2) ELSE '' END AS ref_version,
  regexp_extract(d, '^([cgmnopr]?)\.?(.+)$', 1) AS desc_type, regexp_extract(d, '^([cgmnopr]?)\.?(.+)$', 2) AS "desc"
  FROM (SELECT raw_id, hgvs, split_part(hgvs, ':', 1) AS r, split_part(hgvs, ':', 2) AS d, regexp_matches(split_part(hgvs, ':', 1), '.+\.[0-9]+$') AS ver FROM hgvs WHERE regexp_matches(hgvs, '^[^:]+:[^:]+$')))"""
TREE = """tree AS (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R' || r_regionkey, 'world' FROM region
  UNION ALL SELECT 'P' || p_partkey, 'P' || (p_partkey // 3) FROM part WHERE p_partkey > 0)"""
