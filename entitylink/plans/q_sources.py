"""Queries on readers, writers and parsers: round trips through the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from entitylink.functions.columns import normalize_columns
from entitylink.functions.storage import scratch
from entitylink.operators.row_ids import row_ids
from entitylink.sources import files as S
from entitylink.sources import ontology, vcf
from entitylink.plans.views import Tables, query


def _folder(spark, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


CUSTOMER = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer"


def _customer(t):
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("read_delimited", CUSTOMER)
def _(spark, d):
    path = _folder(spark, "pipe")
    _customer(Tables(spark, d)).write.csv(path, sep="|", header=False)
    return S.read_delimited(spark, path, sep="|", names=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query("read_delimited_header_offset", CUSTOMER)
def _(spark, d):
    path = _folder(spark, "offset")
    rows = _customer(Tables(spark, d)).select(F.col("c_custkey").alias("o"), F.concat_ws("\t", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("value"))
    head = spark.createDataFrame([(-2, "#made for a test"), (-1, "c_custkey\tc_name\tc_nationkey\tc_mktsegment")], "o long, value string")
    head.union(rows).repartitionByRange(2, "o").sortWithinPartitions("o").select("value").write.text(path)
    return S.read_delimited(spark, path, skip=1)


@query("read_select_columns", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part WHERE p_brand <> 'Brand#2'")
def _(spark, d):
    path = _folder(spark, "wide")
    S.write_delimited(Tables(spark, d).part.withColumn("p_brand", F.nullif(F.col("p_brand"), F.lit("Brand#2"))), path)
    return S.read_select_columns(spark, path, ["p_partkey", "p_brand"], ["p_brand"])


@query("read_json_records", "SELECT c_custkey, c_name AS name, c_nationkey::BIGINT AS nation FROM customer")
def _(spark, d):
    path = _folder(spark, "json")
    Tables(spark, d).customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who")).write.json(path)
    return S.read_json(spark, path, "c_custkey long, who struct<name: string, nation: long>", multi_line=False).select("c_custkey", "who.name", "who.nation")


def _xml(t):
    c = t.customer
    return c.select("c_custkey", F.concat(F.lit('<drug id="'), F.col("c_custkey").cast("string"), F.lit('"><name>'), "c_name", F.lit("</name><groups><group>"), "c_mktsegment", F.lit("</group><group>x</group></groups></drug>")).alias("value"))


@query("parse_xml_records", "SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment || ',x' AS groups FROM customer")
def _(spark, d):
    schema = "_id string, name string, groups struct<group: array<string>>"
    return _xml(Tables(spark, d)).select("c_custkey", S.parse_xml(F.col("value"), schema).alias("x")).select("c_custkey", F.col("x._id").alias("id"), "x.name", F.array_join("x.groups.group", ",").alias("groups"))


@query("read_xml_file", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(spark, d):
    path = _folder(spark, "xml")
    Tables(spark, d).customer.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name")).write.format("xml").options(rowTag="drug", rootTag="drugs").save(path)
    return S.read_xml(spark, path, "drug", "_id long, name string").select(F.col("_id").alias("id"), "name")


HEADER = ["##INFO=<ID=AC,Number=A,Type=Integer,Description=x>", "##INFO=<ID=DB,Number=0,Type=Flag,Description=x>", "##INFO=<ID=DP,Number=1,Type=Integer,Description=x>", "##INFO=<ID=CSQ,Number=.,Type=String,Description=x>"]


def vcf_lines(t):
    """Orders as a VCF body: two ALT alleles for open orders, one otherwise."""
    s = lambda c: F.col(c).cast("string")
    two = F.col("o_orderstatus") == "O"
    info = F.concat(F.lit("AC="), s("o_custkey"), F.when(two, F.concat(F.lit(","), s("o_orderkey"))).otherwise(""), F.when(F.col("o_orderstatus") == "F", ";DB").otherwise(""), F.lit(";DP="), s("o_custkey"), F.lit(";CSQ=T|"), s("o_custkey"), F.lit(",C|"), s("o_orderkey"))
    return t.orders.select(F.concat_ws("\t", F.lit("7"), s("o_orderkey"), F.lit("."), F.lit("A"), F.when(two, "T,C").otherwise("T"), F.lit("."), F.lit("PASS"), info).alias("line"))


@query("parse_vcf", "SELECT '7' AS chrom, o_orderkey AS pos, NULL::VARCHAR AS id, 'A' AS ref, CASE WHEN o_orderstatus = 'O' THEN 'T,C' ELSE 'T' END AS alt, 'PASS' AS filter, o_custkey AS info_dp, o_orderstatus = 'F' AS info_db FROM orders")
def _(spark, d):
    return vcf.parse_vcf(vcf_lines(Tables(spark, d)), HEADER).select("chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), "filter", "info_dp", "info_db")


@query("vcf_typed_info", "SELECT o_orderkey AS pos, o_custkey || CASE WHEN o_orderstatus = 'O' THEN ',' || o_orderkey ELSE '' END AS ac, 'T|' || o_custkey || ';C|' || o_orderkey AS csq FROM orders")
def _(spark, d):
    rows = vcf.parse_vcf(vcf_lines(Tables(spark, d)), HEADER)
    return rows.select("pos", F.array_join(F.transform("info_ac", lambda x: x.cast("string")), ",").alias("ac"), F.array_join("info_csq", ";").alias("csq"))


@query("vcf_explode_alt", """SELECT row_number() OVER (ORDER BY pos, nth) AS row_no, pos, alt, info_ac, alts FROM (SELECT o_orderkey AS pos, 1 AS nth, 'T' AS alt, o_custkey AS info_ac, CASE WHEN o_orderstatus = 'O' THEN 'T,C' ELSE 'T' END AS alts FROM orders
  UNION ALL SELECT o_orderkey, 2, 'C', o_orderkey, 'T,C' FROM orders WHERE o_orderstatus = 'O')""")
def _(spark, d):
    rows = vcf.explode_alt(vcf.parse_vcf(vcf_lines(Tables(spark, d)), HEADER), ["info_ac"])
    rows = rows.select("pos", "alt", "info_ac", F.array_join("alts", ",").alias("alts"))
    return row_ids(rows, "row_no", ["pos", F.col("alt") != "T"])


def obo_stanzas(t):
    """Nations, regions and the tree of parts as ontology text."""
    s = lambda c: F.col(c).cast("string")
    nation = t.nation.select(F.concat(F.lit("[Term]\nid: N:"), s("n_nationkey"), F.lit("\nname: "), "n_name", F.lit('\nsynonym: "nation '), s("n_nationkey"), F.lit('" EXACT []\nsynonym: "broad" RELATED []\nis_a: R:'), s("n_regionkey"), F.lit(" ! region")).alias("stanza"))
    region = t.region.select(F.concat(F.lit("[Term]\nid: R:"), s("r_regionkey"), F.lit("\nname: "), "r_name", F.lit("\nis_a: W:0 ! world")).alias("stanza"))
    up = F.when(F.col("p_partkey") < 3, "W:0").otherwise(F.concat(F.lit("P:"), F.expr("p_partkey div 3").cast("string")))
    part = t.part.select(F.concat(F.lit("[Term]\nid: P:"), s("p_partkey"), F.lit("\nname: "), "p_name", F.lit('\nsynonym: "'), "p_brand", F.lit('" EXACT []\nis_a: '), up, F.lit(" ! part")).alias("stanza"))
    return nation.union(region).union(part).union(t.region.limit(1).select(F.lit("[Typedef]\nid: part_of\nname: part of").alias("stanza")))


PART_UP = "CASE WHEN p_partkey < 3 THEN 'W:0' ELSE 'P:' || (p_partkey // 3) END"


@query("parse_ontology", f"""SELECT 'term' AS kind, 'N:' || n_nationkey AS id, n_name AS value, '' AS more FROM nation UNION ALL SELECT 'term', 'R:' || r_regionkey, r_name, '' FROM region
  UNION ALL SELECT 'synonym', 'N:' || n_nationkey, 'nation ' || n_nationkey, 'EXACT' FROM nation UNION ALL SELECT 'synonym', 'N:' || n_nationkey, 'broad', 'RELATED' FROM nation
  UNION ALL SELECT 'edge', 'N:' || n_nationkey, 'R:' || n_regionkey, '' FROM nation UNION ALL SELECT 'edge', 'R:' || r_regionkey, 'W:0', '' FROM region
  UNION ALL SELECT 'term', 'P:' || p_partkey, p_name, '' FROM part UNION ALL SELECT 'synonym', 'P:' || p_partkey, p_brand, 'EXACT' FROM part UNION ALL SELECT 'edge', 'P:' || p_partkey, {PART_UP}, '' FROM part""")
def _(spark, d):
    path = _folder(spark, "obo")
    obo_stanzas(Tables(spark, d)).write.option("lineSep", "\n\n").text(path)
    terms, synonyms, edges = ontology.parse_obo(ontology.read_obo(spark, path))
    kind = lambda k: F.lit(k).alias("kind")
    return terms.select(kind("term"), "id", F.col("name").alias("value"), F.lit("").alias("more")).union(synonyms.select(kind("synonym"), "id", "text", "scope")).union(edges.select(kind("edge"), "child", "parent", F.lit("")))


@query("read_jdbc_table", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    """Through the database of the setting ``spark.entitylink.jdbc.url``, which all executors must reach.

    Without that setting, on a local master, a database in memory stands for it.
    """
    url = spark.conf.get("spark.entitylink.jdbc.url", None)
    if not url and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.entitylink.jdbc.url to a database that all executors reach")
    driver = {} if url else {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    url, table = url or f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", f"supplier_{uuid.uuid4().hex}"
    rows = Tables(spark, d).supplier.select("s_suppkey", "s_name")
    rows.write.jdbc(url, table, properties=driver)
    low, high = rows.agg(F.coalesce(F.min("s_suppkey"), F.lit(0)), F.coalesce(F.max("s_suppkey"), F.lit(0))).first()
    return normalize_columns(S.read_jdbc(spark, url, table, "s_suppkey", low, high + 1, spark.sparkContext.defaultParallelism, **driver))


@query("read_write_parquet", "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    path, o = _folder(spark, "parquet"), Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    S.write_parquet(o, path, compression="gzip")
    S.write_parquet(o.where("o_orderstatus = 'P'"), path, mode="append")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey")


@query("write_delimited", CUSTOMER)
def _(spark, d):
    path = _folder(spark, "tsv")
    S.write_delimited(_customer(Tables(spark, d)), path, compression="gzip")
    return S.read_delimited(spark, path)


@query("load_table", "SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer")
def _(spark, d):
    table = f"t_{uuid.uuid4().hex}"
    df = Tables(spark, d).customer.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("segment"))
    S.load_table(df, table, ["segment"])
    return spark.table(table)


@query("merge_part_files", "SELECT row_number() OVER (ORDER BY c_custkey::VARCHAR) AS id, c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def _(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name")
    paths = [_folder(spark, "merge") for _ in range(2)]
    S.write_delimited(c, paths[0], compression="gzip")
    S.write_delimited(c.where("c_custkey > 10"), paths[1], compression="gzip")
    return S.merge_files(spark, paths, "id", ["c_custkey"], ["c_custkey"])


@query("backup_restore", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def _(spark, d):
    table, folder = f"t_{uuid.uuid4().hex}", _folder(spark, "backup")
    Tables(spark, d).supplier.select("s_suppkey", "s_name").write.saveAsTable(table)
    S.backup(spark, [table], folder)
    S.restore(spark, [table], folder)
    return spark.table(table)


@query("repair_ragged_rows", "SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN '7,9' WHEN 'O' THEN '7' ELSE '' END AS assertion_ids, CASE o_orderstatus WHEN 'F' THEN 'u1,u2' WHEN 'O' THEN 'u1' ELSE '' END AS urls, 'rest' AS last FROM orders")
def _(spark, d):
    cells = F.when(F.col("o_orderstatus") == "F", "7,9\tu1\tu2").when(F.col("o_orderstatus") == "O", "7\tu1").otherwise("\t")
    lines = Tables(spark, d).orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("\t"), cells, F.lit("\trest")).alias("line"))
    return S.repair_ragged(lines, ["id", "assertion_ids", "urls", "last"], "assertion_ids")
