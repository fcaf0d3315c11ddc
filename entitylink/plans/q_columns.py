"""Queries on headers, cleaning and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.functions import columns as C
from entitylink.operators import dictionary as D
from entitylink.operators.mapping import propose_mapping
from entitylink.operators.names import normalize_name
from entitylink.operators.row_ids import row_ids
from entitylink.plans.views import NAMES, NORM, RAW, Tables, query


@query("normalize_columns", 'SELECT c_custkey AS customer_id, c_name AS full_names, c_mktsegment AS market_segment, c_nationkey AS nation_hgvs FROM customer')
def _(spark, d):
    return C.normalize_columns(Tables(spark, d).customer.selectExpr("c_custkey as `Customer/ID`", "c_name as `Full@ name(s)`", "c_mktsegment as `Market  (Segment)`", "c_nationkey as `nationHGVS`"))


@query("check_columns", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    df = Tables(spark, d).customer.select("c_custkey", "c_name")
    C.check_columns(df, ["c_custkey", "c_name"], hard=True)
    return df


@query("keep_declared", "SELECT c_name, c_custkey FROM customer")
def _(spark, d):
    return C.keep_declared(Tables(spark, d).customer, ["c_name", "absent", "c_custkey"])


@query("serialize_nested", """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS json__who FROM customer""")
def _(spark, d):
    return C.serialize_nested(Tables(spark, d).customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who")))


@query("deserialize_nested", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def _(spark, d):
    df = Tables(spark, d).events.select("event_id", F.col("props").alias("json__props"))
    return C.deserialize_nested(df, {"props": "k int"}).select("event_id", "props.k")


@query("row_ids", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_no, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return row_ids(Tables(spark, d).lineitem.select(*keys), "row_no", keys)


@query("merge_raw_columns", "SELECT o_orderkey, o_orderstatus AS raw_status, o_orderpriority AS raw_priority FROM orders")
def _(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", F.col("o_orderstatus").alias("raw_status")).join(o.select("o_orderkey", F.col("o_orderpriority").alias("raw_priority")), "o_orderkey")


@query("process_hook", "SELECT p_partkey, upper(p_name) AS p_name FROM part WHERE p_size > 10")
def _(spark, d):
    return C.process_hook(Tables(spark, d).part, lambda df: df.where("p_size > 10").select("p_partkey", F.upper("p_name").alias("p_name")))


@query("entity_modifier", "SELECT p_partkey, p_brand || ' ' || p_name AS x_gene FROM part")
def _(spark, d):
    return C.entity_modifier(Tables(spark, d).part.select("p_partkey", "p_brand", "p_name"), lambda df: df.withColumn("x_gene", F.concat_ws(" ", "p_brand", "p_name"))).select("p_partkey", "x_gene")


@query("filter_species", "SELECT p_partkey, p_type FROM part WHERE p_type = 'ECONOMY'")
def _(spark, d):
    return C.filter_species(Tables(spark, d).part.select("p_partkey", "p_type"), "p_type", "ECONOMY")


@query("quarantine_multi_value", "SELECT conv_id, turn, contains(text, ',') AS bad FROM conversations")
def _(spark, d):
    kept, bad = C.quarantine(Tables(spark, d).conversations, "text", ",")
    return kept.select("conv_id", "turn", F.lit(False).alias("bad")).union(bad.select("conv_id", "turn", F.lit(True).alias("bad")))


@query("filter_prefixed_ids", "SELECT c_custkey, substr(c_name, 10) AS c_name FROM customer WHERE starts_with(c_name, 'Customer#')")
def _(spark, d):
    return C.filter_prefixed(Tables(spark, d).customer.select("c_custkey", "c_name"), "c_name", "Customer#")


@query("clean_df", "SELECT DISTINCT lang, nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, '') AS src FROM documents WHERE nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, '') IS NOT NULL AND lang IS NOT NULL")
def _(spark, d):
    return C.clean_df(Tables(spark, d).documents.select("lang", F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("src")))


@query("filter_too_long", "SELECT doc_id, length(text) AS n FROM documents WHERE NOT coalesce(length(text) > 2000, false)")
def _(spark, d):
    return C.filter_too_long(Tables(spark, d).documents, "text", 2000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("filter_id_equals_name", "SELECT p_partkey, p_brand FROM part WHERE NOT coalesce(p_brand = 'Brand#' || (p_size // 10), false)")
def _(spark, d):
    df = Tables(spark, d).part.withColumn("id", F.concat(F.lit("Brand#"), F.expr("p_size div 10").cast("string")))
    return C.drop_id_names(df, "id", "p_brand").select("p_partkey", "p_brand")


@query("format_columns", "SELECT p_partkey, p_name, 'size ' || p_size AS p_size, upper(p_brand) AS p_brand FROM part")
def _(spark, d):
    df = Tables(spark, d).part.select("p_partkey", "p_name", "p_size", "p_brand")
    return C.display(df, {"p_size": lambda c: F.concat(F.lit("size "), c.cast("string")), "p_brand": F.upper})


IDS = "SELECT CASE WHEN l_returnflag = 'R' THEN 'HGNC:' || l_partkey WHEN l_returnflag = 'A' THEN 'ENSG' || lpad(l_partkey::VARCHAR, 11, '0') WHEN l_linestatus = 'F' THEN 'rs' || l_partkey ELSE l_partkey::VARCHAR END AS v FROM lineitem"


def _ids(t):
    p = F.col("l_partkey").cast("string")
    return t.lineitem.select(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("HGNC:"), p)).when(F.col("l_returnflag") == "A", F.concat(F.lit("ENSG"), F.lpad(p, 11, "0"))).when(F.col("l_linestatus") == "F", F.concat(F.lit("rs"), p)).otherwise(p).alias("v"))


@query("predicate_term", f"SELECT v, count(*) AS n, bool_or(regexp_matches(v, '^[0-9]+$')) AS entrez, bool_or(regexp_matches(v, '^ENSG[0-9]+')) AS gene, bool_or(regexp_matches(v, '^HGNC:[0-9]+')) AS hgnc, bool_or(regexp_matches(v, '^rs[0-9]+')) AS dbsnp FROM ({IDS}) GROUP BY v")
def _(spark, d):
    terms = {"entrez": "entrez", "gene": "ensembl_gene", "hgnc": "hgnc", "dbsnp": "dbsnp"}
    return _ids(Tables(spark, d)).groupBy("v").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(C.is_term(F.col("v"), t)).alias(a) for a, t in terms.items()])


@query("profile_column_terms", """SELECT c AS "column", count(*) AS n, count(*) FILTER (regexp_matches(v, '^[0-9]+$')) AS entrez, count(*) FILTER (regexp_matches(v, '^HGNC:[0-9]+')) AS hgnc
FROM (SELECT 'o_orderkey' AS c, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders) WHERE v IS NOT NULL GROUP BY c""")
def _(spark, d):
    return C.profile_terms(Tables(spark, d).orders, ["o_orderkey", "o_orderpriority", "o_custkey"], ("entrez", "hgnc"))


MAPPED = f"""{RAW}, vals AS (SELECT DISTINCT c, norm FROM (SELECT 'said' AS c, {NORM.format('said')} AS norm FROM raw UNION ALL SELECT 'item', {NORM.format('item')} FROM raw UNION ALL SELECT 'l_returnflag', {NORM.format('l_returnflag')} FROM raw) WHERE norm <> ''),
  dict AS (SELECT DISTINCT 'supplier' AS kind, {NORM.format('s_name')} AS norm FROM supplier UNION SELECT DISTINCT 'part', {NORM.format('p_name')} FROM part UNION SELECT DISTINCT 'nation', {NORM.format('n_name')} FROM nation),
  pairs AS (SELECT c, kind FROM (SELECT DISTINCT c FROM vals), (SELECT DISTINCT kind FROM dict)),
  shares AS (SELECT c, kind, (SELECT count(*) FROM vals v WHERE v.c = pairs.c) AS n, (SELECT count(*) FROM vals v JOIN dict d USING (norm) WHERE v.c = pairs.c AND d.kind = pairs.kind) AS hits FROM pairs)"""


@query("propose_mapping", f"""WITH {MAPPED} SELECT c AS "column", kind, n, hits, hits / n AS share, hits / n >= 0.5 AND rank() OVER (PARTITION BY c ORDER BY hits / n DESC) = 1 AND rank() OVER (PARTITION BY kind ORDER BY hits / n DESC) = 1 AS chosen FROM shares""")
def _(spark, d):
    t = Tables(spark, d)
    names = lambda df, c: df.select(normalize_name(F.col(c)).alias("norm"))
    return propose_mapping(t.raw(), {"supplier": names(t.supplier, "s_name"), "part": names(t.part, "p_name"), "nation": names(t.nation, "n_name")}, ["said", "item", "l_returnflag"], exact=True)


@query("validate_targets", f"SELECT v, regexp_matches(v, '^HGNC:') AS gene, regexp_matches(v, '^[^:]+:[^:]+$') AS variant FROM ({IDS})")
def _(spark, d):
    return _ids(Tables(spark, d)).select("v", C.valid_target(F.col("v"), "gene").alias("gene"), C.valid_target(F.col("v"), "variant").alias("variant"))


@query("filter_enum", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(spark, d):
    o = Tables(spark, d).orders
    return o.where(C.in_enum(F.col("o_orderstatus"), ["F", "P"])).select("o_orderkey", "o_orderstatus")


@query("split_column", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first, len(string_split(o_orderpriority, '-'))::INT AS n FROM orders")
def _(spark, d):
    parts = C.split_column(F.col("o_orderpriority"), "-")
    return Tables(spark, d).orders.select("o_orderkey", F.get(parts, F.lit(0)).alias("first"), F.size(parts).alias("n"))


@query("parallel_explode", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(['a' || l_partkey, 'b']) AS x, unnest(['c', 'd' || l_suppkey]) AS y FROM lineitem")
def _(spark, d):
    df = Tables(spark, d).lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(F.lit("a"), F.col("l_partkey").cast("string"), F.lit(";b")).alias("x"), F.concat(F.lit("c;d"), F.col("l_suppkey").cast("string")).alias("y"))
    return C.parallel_explode(df, ["x", "y"])


@query("clean_drug_list", "SELECT p_partkey, unnest(string_split(p_name || ';' || p_brand || ',' || p_type, ';')) AS drug FROM (SELECT p_partkey, p_name, p_brand || ';' || p_type AS p_brand, '' AS p_type FROM part) WHERE false UNION ALL SELECT p_partkey, unnest([p_name, p_brand, p_type]) FROM part")
def _(spark, d):
    df = Tables(spark, d).part.withColumn("drugs", F.concat(F.lit("["), "p_name", F.lit(";"), "p_brand", F.lit(","), "p_type", F.lit("]")))
    return df.select("p_partkey", F.explode(C.clean_drug_list(F.col("drugs"))).alias("drug"))


@query("strip_prefix", "SELECT s_suppkey, replace(s_name, 'Supplier#', '') AS v FROM supplier")
def _(spark, d):
    return Tables(spark, d).supplier.select("s_suppkey", C.strip_prefix(F.col("s_name"), "Supplier#").alias("v"))


@query("strip_transcript", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'GENE' || l_partkey || CASE WHEN l_returnflag = 'N' THEN '_X' ELSE '' END AS v FROM lineitem")
def _(spark, d):
    gene = F.concat(F.lit("GENE"), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "N", "_X").otherwise("_ENST0001.2"))
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.strip_transcript(gene).alias("v"))


@query("prefix_id", "SELECT o_orderkey, 'HGNC:' || o_custkey AS v FROM orders")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", C.prefix_id(F.col("o_custkey"), "HGNC:").alias("v"))


@query("strip_name_qualifiers", "SELECT p_partkey, p_name || CASE WHEN p_size > 20 THEN ' (NEW)' ELSE '' END AS v FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", C.strip_qualifiers(F.concat("p_name", F.when(F.col("p_size") > 20, " (NEW)").otherwise(" (USAN, INN)"))).alias("v"))


def _nested(t):
    synonyms = F.array(F.struct(F.lit("english").alias("language"), F.col("p_name").alias("text")), F.struct(F.when(F.col("p_size") > 20, "german").otherwise("latin").alias("language"), F.col("p_brand").alias("text")))
    ids = F.array(F.struct(F.lit("ChEMBL").alias("resource"), F.concat(F.lit("CHEMBL"), F.col("p_partkey").cast("string")).alias("identifier")), F.struct(F.lit("other").alias("resource"), F.col("p_type").alias("identifier")))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", synonyms.alias("synonyms"), ids.alias("ids"))


@query("synonyms_by_language", "SELECT p_partkey, p_name || CASE WHEN p_size > 20 THEN ';' || p_brand ELSE '' END AS v FROM part")
def _(spark, d):
    return _nested(Tables(spark, d)).select("p_partkey", F.array_join(C.synonyms_by_language(F.col("synonyms")), ";").alias("v"))


@query("external_ids", "SELECT p_partkey, 'CHEMBL' || p_partkey AS v FROM part")
def _(spark, d):
    return _nested(Tables(spark, d)).select("p_partkey", F.explode(C.external_ids(F.col("ids"))).alias("v"))


@query("nested_field_list", "SELECT p_partkey, 'CHEMBL' || p_partkey || ',' || p_type AS v FROM part")
def _(spark, d):
    return _nested(Tables(spark, d)).select("p_partkey", F.array_join(C.field_list(F.col("ids"), "identifier"), ",").alias("v"))


@query("merge_columns_to_list", "SELECT p_partkey, concat_ws('; ', p_name, nullif(p_brand, 'Brand#2'), p_type) AS tissues FROM part")
def _(spark, d):
    df = Tables(spark, d).part.select("p_partkey", "p_name", F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("p_brand"), "p_type")
    return C.merge_columns(df, ["p_name", "p_brand", "p_type"], "tissues")


@query("melt_names", "SELECT DISTINCT * FROM (SELECT p_partkey, 'p_name' AS type, p_name AS name FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part)")
def _(spark, d):
    return C.melt_names(Tables(spark, d).part, "p_partkey", ["p_name", "p_brand", "p_type"])


@query("empty_to_null", "SELECT doc_id, nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, '') AS v FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", C.empty_to_null(F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))).alias("v"))


@query("raw_query_column", "SELECT o_orderkey, CASE WHEN o_orderstatus = o_orderpriority THEN o_orderstatus ELSE o_orderstatus || ';' || o_orderpriority END AS q FROM orders")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", C.raw_query(F.col("o_orderstatus"), F.lit(""), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("q"))


# ---- dictionaries, sets and orders ---------------------------------------------------------------


@query("restrict_to_main", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    t = Tables(spark, d)
    return D.restrict_to_main(t.orders.select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id").distinct()


@query("merge_mappings", f"WITH {NAMES} SELECT DISTINCT id, name, source FROM names")
def _(spark, d):
    names = Tables(spark, d).names()
    return D.merge_mappings([names, names])


@query("aggregate_sources", "SELECT p_name AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS source FROM part GROUP BY p_name")
def _(spark, d):
    return D.aggregate_sources(Tables(spark, d).homonyms(), ["name"], "source")


@query("build_dict", """WITH c AS (SELECT 'PART:' || p_partkey AS id_, p_name AS name, lower(p_type) AS type, 'a' AS s FROM part
  UNION SELECT 'PART:' || p_partkey, p_name, lower(p_type), 'b' FROM part WHERE p_size > 25 UNION SELECT 'PART:' || p_partkey, 'PART:' || p_partkey, 'x', 'c' FROM part UNION SELECT 'PART:' || p_partkey, p_brand, 'brand', 'b' FROM part),
 e AS (SELECT 'entity' AS kind, row_number() OVER (ORDER BY substr(target, 6)::BIGINT) AS id, target, NULL AS name, NULL AS data_sources, NULL AS type FROM (SELECT DISTINCT id_ AS target FROM c WHERE id_ <> name)),
 g AS (SELECT id_ AS target, name, string_agg(s, ',' ORDER BY s, type) AS data_sources, string_agg(type, ',' ORDER BY s, type) AS type FROM c WHERE id_ <> name GROUP BY 1, 2)
 SELECT * FROM e UNION ALL SELECT 'name', row_number() OVER (ORDER BY target, name), target, name, data_sources, type FROM g""")
def _(spark, d):
    t = Tables(spark, d)
    base = t.homonyms().select("id", "name", "type")
    brand = t.homonyms().select("id", F.col("source").alias("name"), F.lit("brand").alias("type"), F.lit("b").alias("data_sources"))
    big = t.part.where("p_size > 25").select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("type"), F.lit("b").alias("data_sources"))
    own = base.select("id", F.col("id").alias("name"), F.lit("x").alias("type"), F.lit("c").alias("data_sources"))
    parts = [df.withColumnRenamed("id", "target") for df in (base.withColumn("data_sources", F.lit("a")), big, own, brand)]
    entities, names = D.build_dict(parts, "target", "PART:")
    text = lambda: F.lit(None).cast("string")
    first = entities.select(F.lit("entity").alias("kind"), "id", "target", text().alias("name"), text().alias("data_sources"), text().alias("type"))
    return first.unionByName(names.select(F.lit("name").alias("kind"), "id", "target", "name", "data_sources", "type"))


@query("sort_prefixed", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS nth FROM supplier")
def _(spark, d):
    df = Tables(spark, d).supplier.select("s_suppkey", F.concat(F.lit("HGNC:"), F.col("s_suppkey").cast("string")).alias("id"))
    return row_ids(D.sort_prefixed(df, "id", "HGNC:"), "nth", [D.numeric_suffix("id", "HGNC:"), "id"]).select("s_suppkey", "nth")


@query("union_parts", "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def _(spark, d):
    t = Tables(spark, d)
    return D.union_parts([t.nation.select(F.col("n_name").alias("v")), t.region.select(F.col("r_name").alias("v")), t.supplier.select(F.col("s_name").alias("v"))])


@query("concat_entries", "SELECT row_number() OVER (ORDER BY name) AS id, name, kind, row_number() OVER (ORDER BY name) AS entry_id FROM (SELECT s_name AS name, 'known' AS kind FROM supplier UNION ALL SELECT c_name, NULL FROM customer)")
def _(spark, d):
    t = Tables(spark, d)
    known = t.supplier.select(F.col("s_name").alias("name"), F.lit("known").alias("kind"))
    return D.concat_entries(known, t.customer.select(F.col("c_name").alias("name")), "id", ["name"], "entry_id")


@query("id_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def _(spark, d):
    t = Tables(spark, d)
    return D.id_difference(t.customer.select(F.col("c_custkey").alias("id")), t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("id")), "id")


@query("unknown_ids", "SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_partkey IS NOT NULL)")
def _(spark, d):
    t = Tables(spark, d)
    return D.unknown_ids(t.part.select(F.col("p_partkey").alias("id")), t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id")
