"""Queries on variant names, alleles and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.functions import variants as V
from entitylink.operators import graph as G
from entitylink.operators.names import fit_names, match_cascade
from entitylink.operators.serve import map_ref_to_gene
from entitylink.plans.views import HGVS, PARSED, TREE, Tables, query


@query("hgvs_like", f"WITH {HGVS} SELECT raw_id, regexp_matches(hgvs, '^[^:]+:[^:]+$') AS ok FROM hgvs")
def _(spark, d):
    return Tables(spark, d).hgvs().select("raw_id", V.hgvs_like(F.col("hgvs")).alias("ok"))


def _parsed(t):
    return t.hgvs().where(V.hgvs_like(F.col("hgvs"))).select("raw_id", "hgvs", V.hgvs_split(F.col("hgvs")).alias("p")).select("raw_id", "hgvs", "p.*")


@query("hgvs_split", f'WITH {PARSED} SELECT raw_id, hgvs, ref, ref_version, desc_type, "desc" FROM parsed')
def _(spark, d):
    return _parsed(Tables(spark, d))


@query("hgvs_length_filter", "SELECT doc_id FROM documents WHERE length('D' || doc_id || ':c.' || text) <= 131 AND length('D' || doc_id) <= 30 AND length(text) <= 100")
def _(spark, d):
    ref = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    return Tables(spark, d).documents.where(V.hgvs_length_ok(F.concat(ref, F.lit(":c."), "text"), ref, F.col("text"))).select("doc_id")


@query("aa1_to_aa3", f"""WITH {PARSED} SELECT raw_id, CASE WHEN desc_type = 'p' THEN 'Val' || regexp_extract("desc", '[0-9]+') || 'Glu' ELSE "desc" END AS v FROM parsed""")
def _(spark, d):
    return _parsed(Tables(spark, d)).select("raw_id", F.when(F.col("desc_type") == "p", V.aa1_to_aa3(F.col("desc"))).otherwise(F.col("desc")).alias("v"))


@query("guess_desc_type", f"""WITH {PARSED} SELECT raw_id, CASE WHEN desc_type = '' AND regexp_matches("desc", '^(p\\.)?(\\D{{1,3}})(\\d+)(\\D{{1,3}})') THEN 'p' ELSE desc_type END AS v FROM parsed""")
def _(spark, d):
    return _parsed(Tables(spark, d)).select("raw_id", V.guess_desc_type(F.col("desc_type"), F.col("desc")).alias("v"))


@query("modify_flags", "SELECT o_orderkey, ((o_orderstatus = 'F')::INT + 2 * (o_custkey > 100)::INT + 4 * (o_totalprice > 100000)::INT)::INT AS flags FROM orders")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", V.modify_flags(F.col("o_orderstatus") == "F", F.col("o_custkey") > 100, F.col("o_totalprice") > 100000).alias("flags"))


HARMONIZED = PARSED + """, h AS (SELECT raw_id, hgvs, ref, ref_version, CASE WHEN desc_type = 'p' THEN 'Val' || regexp_extract("desc", '[0-9]+') || 'Glu' ELSE "desc" END AS "desc",
  CASE WHEN desc_type = '' AND regexp_matches("desc", '^V[0-9]+E') THEN 'p' ELSE desc_type END AS desc_type,
  CASE WHEN desc_type = '' AND regexp_matches("desc", '^V[0-9]+E') THEN 1 WHEN desc_type = 'p' THEN 2 ELSE 0 END AS modify_flags FROM parsed)"""


@query("harmonize_variants", f"""WITH {HARMONIZED} SELECT raw_id, 'hgvs' AS "column", hgvs, ref, ref_version, "desc", desc_type, modify_flags, CASE WHEN desc_type = '' THEN 'unknown_desc_type' ELSE '' END AS unmapped_type, desc_type <> '' AS harmonized FROM h
  UNION ALL SELECT raw_id, 'hgvs', hgvs, '', '', '', '', 0, 'not_hgvs', false FROM hgvs WHERE NOT regexp_matches(hgvs, '^[^:]+:[^:]+$')""")
def _(spark, d):
    return V.harmonize_variants(Tables(spark, d).hgvs(), "raw_id", ["hgvs"])


@query("map_ref_to_gene", f"""WITH {HARMONIZED} SELECT raw_id, CASE WHEN starts_with(ref, 'GENE') THEN 'HGNC:' || substr(ref, 5) ELSE ref END AS ref, (modify_flags + CASE WHEN starts_with(ref, 'GENE') THEN 4 ELSE 0 END)::INT AS modify_flags FROM h WHERE desc_type <> ''""")
def _(spark, d):
    t = Tables(spark, d)
    genes = t.part.select(F.concat(F.lit("HGNC:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("GENE"), F.col("p_partkey").cast("string")).alias("name"))
    variants = V.harmonize_variants(t.hgvs(), "raw_id", ["hgvs"]).where("harmonized")
    # references of changes that are not harmonised are asked for as well, and meet no variant
    matches = match_cascade(V.references(t.hgvs(), "hgvs"), *fit_names(genes))
    return map_ref_to_gene(variants, matches).select("raw_id", "ref", "modify_flags")


@query("hgvs_format", f"""WITH {PARSED} SELECT raw_id, ref || CASE WHEN ref_version <> '' THEN '.' || ref_version ELSE '' END || ':' || CASE WHEN desc_type <> '' THEN desc_type || '.' ELSE '' END || "desc" AS v FROM parsed""")
def _(spark, d):
    return _parsed(Tables(spark, d)).select("raw_id", V.hgvs_format(F.col("ref"), F.col("ref_version"), F.col("desc_type"), F.col("desc")).alias("v"))


@query("clean_clinvar_hgvs", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'NM_' || l_partkey || '.' || l_linenumber || ':c.' || l_quantity::INT || 'G>T' AS v FROM lineitem")
def _(spark, d):
    s = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("NM_"), s("l_partkey"), F.lit("."), s("l_linenumber"), F.lit("(G"), s("l_suppkey"), F.lit("):c."), F.col("l_quantity").cast("int").cast("string"), F.lit("G>T (p.Arg330Met)"))
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.clean_hgvs_name(name).alias("v"))


@query("make_hgvs", "SELECT p_partkey, p_brand || ':' || nullif(p_type, 'ECONOMY') AS v FROM part")
def _(spark, d):
    return Tables(spark, d).part.select("p_partkey", V.make_hgvs(F.col("p_brand"), F.nullif(F.col("p_type"), F.lit("ECONOMY"))).alias("v"))


@query("make_hgvs_known", "SELECT p_partkey, CASE WHEN p_size > 20 THEN p_brand || ':V' || p_size || 'E' ELSE '' END AS v FROM part")
def _(spark, d):
    change = F.when(F.col("p_size") > 20, F.concat(F.lit("V"), F.col("p_size").cast("string"), F.lit("E"))).otherwise("fusion")
    return Tables(spark, d).part.select("p_partkey", V.make_hgvs_known(F.col("p_brand"), change).alias("v"))


@query("cluster_variants", """WITH c AS (SELECT o_custkey, min(o_orderkey) AS head FROM orders GROUP BY 1), n AS (SELECT o_custkey, dense_rank() OVER (ORDER BY head) AS variant_id FROM c)
  SELECT 'C' || o_custkey AS name, variant_id FROM n UNION ALL SELECT 'O' || o_orderkey, variant_id FROM orders JOIN n USING (o_custkey)""")
def _(spark, d):
    o = Tables(spark, d).orders
    pairs = o.select(F.col("o_orderkey").alias("variant_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("hgvs"))
    return G.cluster_variants(pairs.union(o.select("o_orderkey", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")))))


@query("merge_variant_sets", """WITH n AS (SELECT n_nationkey, dense_rank() OVER (ORDER BY least(coalesce(s, 1e18), (SELECT max(s_suppkey) FROM supplier) + c)) AS variant_id FROM nation
  JOIN (SELECT s_nationkey AS n_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS n_nationkey, min(c_custkey) AS c FROM customer GROUP BY 1) USING (n_nationkey) USING (n_nationkey))
  SELECT 'N' || n_nationkey AS name, variant_id FROM n""".replace("JOIN (SELECT s_nationkey AS n_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS n_nationkey, min(c_custkey) AS c FROM customer GROUP BY 1) USING (n_nationkey) USING (n_nationkey)", "LEFT JOIN (SELECT s_nationkey AS n_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1) USING (n_nationkey) LEFT JOIN (SELECT c_nationkey AS n_nationkey, min(c_custkey) AS c FROM customer GROUP BY 1) USING (n_nationkey) WHERE s IS NOT NULL OR c IS NOT NULL"))
def _(spark, d):
    t = Tables(spark, d)
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string")).alias("hgvs")
    return G.merge_variant_sets([t.supplier.select(F.col("s_suppkey").alias("variant_id"), name("s_nationkey")), t.customer.select(F.col("c_custkey").alias("variant_id"), name("c_nationkey"))])


@query("extend_variant_sets", """WITH kn AS (SELECT s_nationkey AS n, dense_rank() OVER (ORDER BY min(s_suppkey)) AS num FROM supplier GROUP BY 1),
  link AS (SELECT c_custkey, c_nationkey AS n, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey - c_nationkey % 2 ELSE c_nationkey END AS m FROM customer),
  names AS (SELECT n FROM kn UNION SELECT n FROM link UNION SELECT m FROM link),
  g AS (SELECT n, CASE WHEN n % 2 = 1 AND n IN (SELECT n FROM link WHERE m <> n) THEN n - 1 ELSE n END AS g FROM names),
  old AS (SELECT g, min(num) AS num FROM g JOIN kn USING (n) GROUP BY g),
  fresh AS (SELECT g, (SELECT max(num) FROM kn) + row_number() OVER (ORDER BY min(c_custkey)) AS num FROM g JOIN (SELECT c_custkey, n FROM link UNION ALL SELECT c_custkey, m FROM link) USING (n) WHERE g NOT IN (SELECT g FROM old) GROUP BY g)
  SELECT 'N' || n AS name, num AS variant_id FROM g JOIN (SELECT * FROM old UNION ALL SELECT * FROM fresh) USING (g)""")
def _(spark, d):
    t = Tables(spark, d)
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string")).alias("hgvs")
    known = G.cluster_variants(t.supplier.select(F.col("s_suppkey").alias("variant_id"), name("s_nationkey")))
    even = t.customer.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_nationkey") - F.col("c_nationkey") % 2).alias("c_nationkey"))
    new = t.customer.select("c_custkey", "c_nationkey").union(even).select(F.col("c_custkey").alias("variant_id"), name("c_nationkey"))
    return G.extend_variant_sets(known, new)[0]


@query("ontology_closure", f"WITH RECURSIVE {TREE}, up AS (SELECT child AS descendant, parent AS ancestor FROM tree UNION SELECT up.descendant, tree.parent FROM up JOIN tree ON up.ancestor = tree.child) SELECT * FROM up")
def _(spark, d):
    return G.closure(Tables(spark, d).tree())


@query("csq_allele", """SELECT o_orderkey, CASE WHEN x <> '' THEN x WHEN length(a) > length(b) THEN '-' ELSE substr(b, length(a) + 1) END AS v FROM (SELECT o_orderkey, a, b,
  coalesce(list_aggregate(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN substr(b, i, 1) ELSE '' END), 'string_agg', ''), '') AS x FROM (SELECT o_orderkey, o_custkey::VARCHAR AS a, o_orderkey::VARCHAR AS b FROM orders))""")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", V.csq_allele(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("v"))


def _entries():
    return F.array(*[F.concat(F.lit(a), F.lit("|"), F.col(c).cast("string")) for a, c in (("F", "o_custkey"), ("O", "o_orderkey"), ("P", "o_custkey"))])


@query("filter_csq", "SELECT o_orderkey, o_orderstatus || '|' || CASE o_orderstatus WHEN 'O' THEN o_orderkey ELSE o_custkey END AS v FROM orders")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", F.array_join(V.filter_csq(_entries(), F.col("o_orderstatus")), ",").alias("v"))


@query("csq_columns", "SELECT o_orderkey, 'F' AS Allele, o_custkey::VARCHAR AS Gene, NULL::VARCHAR AS Impact FROM orders")
def _(spark, d):
    names = V.csq_names('Consequence annotations. Format: Allele|Gene|Impact">')
    return Tables(spark, d).orders.select("o_orderkey", V.csq_fields(_entries()[0], names).alias("e")).select("o_orderkey", "e.*")
