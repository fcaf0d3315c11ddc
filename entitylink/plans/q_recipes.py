"""Queries on the source recipes, over views shaped like the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.plans import recipes as R
from entitylink.plans.q_columns import _nested
from entitylink.plans.q_sources import HEADER, PART_UP, obo_stanzas, vcf_lines
from entitylink.plans.views import KEY, Tables, query
from entitylink.sources.files import repair_ragged
from entitylink.sources.ontology import parse_obo


@query("recipe_gene_names_wide", """WITH m AS (SELECT DISTINCT * FROM (SELECT 'HGNC:' || p_partkey AS hgnc_id, 'approved_symbol' AS type, p_name AS name FROM part UNION ALL SELECT 'HGNC:' || p_partkey, 'alias_name', p_brand FROM part UNION ALL SELECT 'HGNC:' || p_partkey, 'ncbi_gene_id', p_size::VARCHAR FROM part))
  SELECT row_number() OVER (ORDER BY substr(hgnc_id, 6)::BIGINT, type, name) AS row_no, hgnc_id, type, name, 'wide' AS data_sources FROM m""")
def _(spark, d):
    p = Tables(spark, d).part
    wide = p.select(F.concat(F.lit("HGNC:"), F.col("p_partkey").cast("string")).alias("hgnc_id"), F.col("p_name").alias("approved_symbol"), F.col("p_brand").alias("alias_name"), F.col("p_size").alias("ncbi_gene_id"), F.col("p_type").alias("status"))
    return R.gene_names_wide(wide, "hgnc_id", "wide", "HGNC:")


@query("recipe_gene_xref", """WITH m AS (SELECT DISTINCT * FROM (SELECT 'HGNC:' || p_partkey AS hgnc_id, 'gene' AS type, p_brand AS name FROM part WHERE p_type <> 'SMALL' UNION ALL SELECT 'HGNC:' || p_partkey, 'protein', p_type FROM part WHERE p_type <> 'SMALL'))
  SELECT row_number() OVER (ORDER BY substr(hgnc_id, 6)::BIGINT, type, name) AS row_no, hgnc_id, type, name, 'xref' AS data_sources FROM m""")
def _(spark, d):
    p = Tables(spark, d).part
    ids = p.select(F.concat(F.lit("HGNC:"), F.col("p_partkey").cast("string")).alias("hgnc_id"), F.col("p_brand").alias("gene"), F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type")).alias("protein"))
    return R.gene_xref(ids, "hgnc_id", "xref", "HGNC:")


@query("recipe_drug_claims", """SELECT DISTINCT 'CHEMBL' || p_partkey AS concept_id, name, 'claims' AS data_sources FROM (SELECT p_partkey, p_name AS name FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 20)""")
def _(spark, d):
    p = Tables(spark, d).part
    claims = p.select(F.concat(F.when(F.col("p_size") > 20, "chembl:").otherwise("other:"), F.lit("CHEMBL"), F.col("p_partkey").cast("string")).alias("concept_id"), F.col("p_name").alias("drug_name"), F.col("p_brand").alias("drug_claim_name"))
    return R.drug_claims(claims, "concept_id", ["drug_name", "drug_claim_name"], "chembl:", "claims")


@query("recipe_drug_nested", "SELECT DISTINCT 'CHEMBL' || p_partkey AS id, name, 'nested' AS data_sources FROM (SELECT p_partkey, p_type AS name FROM part UNION ALL SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size > 20)")
def _(spark, d):
    return R.drug_nested(_nested(Tables(spark, d)), "p_type", "synonyms", "ids", "nested")


@query("recipe_drug_synonyms", "SELECT DISTINCT 'CHEMBL' || p_partkey AS id, name, 'entries' AS data_sources FROM (SELECT p_partkey, p_name AS name FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size > 20)")
def _(spark, d):
    df = _nested(Tables(spark, d)).withColumn("id", F.concat(F.lit("CHEMBL"), F.col("p_partkey").cast("string")))
    codes = F.array("p_name", F.concat("p_brand", F.lit(" (USAN, INN)")), F.lit(""))
    more = F.when(F.col("p_size") > 20, F.array("p_type"))
    return R.drug_synonyms(df, "id", [codes, more, F.transform("synonyms", lambda x: F.when(x["language"] == "english", x["text"]))], "entries")


def _ontology(t):
    return parse_obo(obo_stanzas(t))


OWN_NAMES = """own AS (SELECT 'N:' || n_nationkey AS id, n_name AS name FROM nation UNION SELECT 'N:' || n_nationkey, 'nation ' || n_nationkey FROM nation UNION SELECT 'R:' || r_regionkey, r_name FROM region
  UNION SELECT 'P:' || p_partkey, p_name FROM part UNION SELECT 'P:' || p_partkey, p_brand FROM part)"""


@query("recipe_ontology_names", f"WITH {OWN_NAMES} SELECT * FROM own")
def _(spark, d):
    return R.ontology_names(*_ontology(Tables(spark, d)), "W:0")


@query("recipe_ontology_names_expanded", f"""WITH RECURSIVE {OWN_NAMES}, edge AS (SELECT 'N:' || n_nationkey AS child, 'R:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'W:0' FROM region UNION ALL SELECT 'P:' || p_partkey, {PART_UP} FROM part),
  pairs AS (SELECT child AS low, parent AS high FROM edge UNION SELECT low, parent FROM pairs JOIN edge ON high = child)
  SELECT id, name FROM own UNION SELECT low, name FROM own JOIN pairs ON id = high UNION SELECT high, name FROM own JOIN pairs ON id = low WHERE high <> 'W:0'""")
def _(spark, d):
    return R.ontology_names(*_ontology(Tables(spark, d)), "W:0", expand=True)


def _links(found: dict[str, DataFrame]) -> DataFrame:
    """Links of several entity types in one frame."""
    parts = [df.select(F.lit(k).alias("kind"), "raw_id", F.col("hgvs" if k == "variant" else "target").alias("target")) for k, df in found.items()]
    return reduce(DataFrame.union, parts)


def _dictionaries(t):
    genes = t.part.select(F.concat(F.lit("HGNC:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("GENE"), F.col("p_partkey").cast("string")).alias("name"))
    drugs = t.supplier.select(F.concat(F.lit("CHEMBL"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    cancers = t.nation.select(F.concat(F.lit("DOID:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return {"gene": genes, "drug": drugs, "cancer_type": cancers}


def _source(t):
    """Lineitem rows with the columns of a biomarker or mutation source."""
    s = lambda c: F.col(c).cast("string")
    key = F.concat_ws("-", *[s(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    n = F.col("l_quantity").cast("int").cast("string")
    return t.lineitem.join(supplier, "l_suppkey").select(key.alias("raw_id"), F.concat(F.lit("GENE"), s("l_partkey")).alias("symbol"), s("l_partkey").alias("gene_no"), "s_name", F.concat(F.lit("NATION_"), s("s_nationkey")).alias("nation"), s("s_nationkey").alias("nation_no"), "l_returnflag", n.alias("n"), s("l_linenumber").alias("line"))


SOURCE = f"src AS (SELECT DISTINCT {KEY} AS raw_id, 'GENE' || l_partkey AS symbol, l_partkey::VARCHAR AS gene_no, s_suppkey, s_name, s_nationkey, l_returnflag, l_quantity::INT::VARCHAR AS n, l_linenumber::VARCHAR AS line FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
GENE_LINK = "SELECT 'gene' AS kind, raw_id, 'HGNC:' || gene_no AS target FROM src"
DRUG_LINK = "SELECT 'drug', raw_id, 'CHEMBL' || s_suppkey FROM src"
CANCER_LINK = "SELECT 'cancer_type', raw_id, 'DOID:' || s_nationkey FROM src"


@query("recipe_biomarkers", f"""WITH {SOURCE} SELECT * FROM ({GENE_LINK} UNION {DRUG_LINK} UNION {CANCER_LINK} UNION SELECT 'variant', raw_id, symbol || ':p.V' || n || 'E' FROM src UNION SELECT 'variant', raw_id, 'NM_' || gene_no || '.' || line || ':c.' || n || 'G>T' FROM src WHERE l_returnflag <> 'N')
  WHERE raw_id NOT IN (SELECT raw_id FROM src WHERE l_returnflag = 'R')""")
def _(spark, d):
    t = Tables(spark, d)
    mutation = F.concat("symbol", F.lit(":p.V"), "n", F.lit("E"))
    raw = _source(t).select(
        "raw_id", F.concat("symbol", F.lit(";zzz")).alias("gene"), F.concat(F.lit("["), "s_name", F.lit(",none]")).alias("drug"), F.concat("nation", F.lit(";other")).alias("tumor"),
        F.concat(mutation, F.when(F.col("l_returnflag") == "R", ",x").otherwise("")).alias("individual_mutation"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("NM_"), "gene_no", F.lit("."), "line")).alias("transcript"), F.concat(F.lit("c."), "n", F.lit("G>T")).alias("c_dna"),
    )
    return _links(R.biomarkers(raw, _dictionaries(t)))


@query("recipe_variant_summary", f"WITH {SOURCE} {GENE_LINK} UNION SELECT 'variant', raw_id, 'NM_' || gene_no || '.' || line || ':c.' || n || 'G>T' FROM src")
def _(spark, d):
    t = Tables(spark, d)
    name = F.concat(F.lit("NM_"), "gene_no", F.lit("."), "line", F.lit("("), "symbol", F.lit("):c."), "n", F.lit("G>T (p.Arg330Met)"))
    raw = _source(t).select("raw_id", name.alias("name"), F.col("symbol").alias("gene_symbol"), F.concat(F.lit("HGNC:"), "gene_no").alias("hgnc_id"))
    return _links(R.variant_summary(raw, _dictionaries(t)))


@query("recipe_mutations", f"WITH {SOURCE} {GENE_LINK} UNION {CANCER_LINK} UNION SELECT 'variant', raw_id, symbol || ':p.V' || n || 'E' FROM src UNION SELECT 'variant', raw_id, 'NM_' || gene_no || '.' || line || ':c.' || n || 'G>T' FROM src UNION SELECT 'variant', raw_id, '7:g.' || n || 'G>T' FROM src WHERE l_returnflag = 'N'")
def _(spark, d):
    t = Tables(spark, d)
    raw = _source(t).select(
        "raw_id", F.concat("symbol", F.lit("_ENST0000.1")).alias("gene_name"), F.col("gene_no").alias("hgnc_id"), F.lit("carcinoma").alias("primary_histology"), F.col("nation").alias("subtype_1"), F.lit(None).cast("string").alias("subtype_2"), F.lit("NS").alias("subtype_3"),
        F.concat("symbol", F.lit(":p.V"), "n", F.lit("E")).alias("hgvsp"), F.concat(F.lit("NM_"), "gene_no", F.lit("."), "line", F.lit(":c."), "n", F.lit("G>T")).alias("hgvsc"), F.when(F.col("l_returnflag") == "N", F.concat(F.lit("7:g."), "n", F.lit("G>T"))).alias("hgvsg"),
    )
    return _links(R.mutations(raw, _dictionaries(t)))


@query("recipe_vcf_frequencies", "SELECT o_orderkey AS pos, 'T' AS alt, o_custkey AS info_ac, 'T|' || o_custkey AS csq FROM orders UNION ALL SELECT o_orderkey, 'C', o_orderkey, 'C|' || o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    return R.vcf_frequencies(vcf_lines(Tables(spark, d)), HEADER, ["info_ac"], "info_csq").select("pos", "alt", "info_ac", F.array_join("info_csq", ";").alias("csq"))


@query("recipe_pathways", f"WITH {SOURCE} SELECT DISTINCT raw_id, 'HGNC:' || gene_no AS target FROM src WHERE l_returnflag = 'A'")
def _(spark, d):
    t = Tables(spark, d)
    raw = _source(t).select("raw_id", F.col("symbol").alias("ensembl_gene_id"), F.when(F.col("l_returnflag") == "A", "Homo sapiens").otherwise("Mus musculus").alias("species"))
    return R.pathways(raw, _dictionaries(t)["gene"])


@query("recipe_evidence", f"WITH {SOURCE} {GENE_LINK} UNION {DRUG_LINK} UNION {CANCER_LINK}")
def _(spark, d):
    t = Tables(spark, d)
    raw = _source(t).select("raw_id", F.col("symbol").alias("gene"), F.when(F.col("l_returnflag") == "A", F.col("nation")).alias("disease"), F.concat(F.lit("DOID:"), "nation_no").alias("doid"), F.concat("s_name", F.lit(",unknown")).alias("drugs"))
    return _links(R.evidence(raw, _dictionaries(t)))


CODING = "'NM_' || gene_no || '.' || line || ':c.' || n || 'G>T'"
PROTEIN = "symbol || ':p.V' || n || 'E'"
BUILT = "SELECT 'variant', raw_id, 'NM_' || gene_no || '.' || line || ':V' || n || 'E' FROM src WHERE l_returnflag <> 'N'"


def _coding():
    return F.concat(F.lit("NM_"), "gene_no", F.lit("."), "line", F.lit(":c."), "n", F.lit("G>T"))


def _curated(spark, d, name, *cols):
    """Links of a declared source whose columns are these expressions over the lineitem view."""
    t = Tables(spark, d)
    return _links(R.curated(_source(t).select("raw_id", *cols), R.source(name), _dictionaries(t)))


def _known():
    change = F.when(F.col("l_returnflag") == "N", "Fusion").otherwise(F.concat(F.lit("V"), "n", F.lit("E")))
    return F.col("symbol").alias("hugo_symbol"), F.concat(F.lit("NM_"), "gene_no", F.lit("."), "line").alias("ref_seq"), change.alias("alteration")


@query("recipe_actionable", f"WITH {SOURCE} {GENE_LINK} UNION {DRUG_LINK} UNION {CANCER_LINK} UNION {BUILT}")
def _(spark, d):
    return _curated(spark, d, "actionable", *_known(), F.col("nation").alias("cancer_type"), F.col("s_name").alias("drugs"))


@query("recipe_annotated", f"WITH {SOURCE} {GENE_LINK} UNION {BUILT}")
def _(spark, d):
    return _curated(spark, d, "annotated", *_known())


@query("recipe_curated_mutations", f"WITH {SOURCE} {GENE_LINK} UNION {CANCER_LINK} UNION SELECT 'variant', raw_id, {CODING} FROM src UNION SELECT 'variant', raw_id, {PROTEIN} FROM src")
def _(spark, d):
    return _curated(spark, d, "curated_mutations", _coding().alias("hgvs"), F.col("symbol").alias("gene"), F.concat(F.lit("p.V"), "n", F.lit("E")).alias("amino_acid"), F.concat("nation", F.lit(",other")).alias("diseases"))


@query("recipe_census", f"WITH {SOURCE} {GENE_LINK} UNION {CANCER_LINK} WHERE l_returnflag <> 'N'")
def _(spark, d):
    germline = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("none,"), "nation"))
    return _curated(spark, d, "census", F.col("symbol").alias("gene_symbol"), F.when(F.col("l_returnflag") == "A", F.concat("nation", F.lit(",other"))).alias("tumour_types_somatic"), germline.alias("tumour_types_germline"))


@query("recipe_interpretations", f"WITH {SOURCE} {GENE_LINK} UNION {CANCER_LINK}")
def _(spark, d):
    return _curated(spark, d, "interpretations", F.col("symbol").alias("gene"), F.concat(F.lit("other, "), "nation").alias("tumor_types"))


@query("recipe_interactions", f"WITH {SOURCE} {GENE_LINK} UNION {DRUG_LINK}")
def _(spark, d):
    by_id = F.col("l_returnflag") == "R"
    number = F.regexp_extract("s_name", "([1-9][0-9]*|0)$", 1)
    return _curated(
        spark, d, "interactions", F.col("symbol").alias("gene_name"), F.when(~by_id, F.col("s_name")).alias("drug_claim_name"), F.lit("none").alias("drug_claim_primary_name"),
        F.lit(None).cast("string").alias("drug_name"), F.when(by_id, F.concat(F.lit("chembl:CHEMBL"), number)).alias("drug_concept_id"),
    )


@query("recipe_clinical_variants", f"WITH {SOURCE} {GENE_LINK} UNION SELECT 'variant', raw_id, {CODING} FROM src UNION SELECT 'variant', raw_id, {PROTEIN} FROM src WHERE l_returnflag <> 'N'")
def _(spark, d):
    t = Tables(spark, d)
    protein = F.when(F.col("l_returnflag") == "N", "none").otherwise(F.concat("symbol", F.lit(":p.V"), "n", F.lit("E")))
    ragged = F.when(F.col("l_returnflag") == "R", "7,9\tu1\tu2").otherwise("7\tu1")
    lines = _source(t).select(F.concat_ws("\t", "raw_id", ragged, "symbol", F.concat(_coding(), F.lit(","), protein)).alias("line"))
    raw = repair_ragged(lines, ["raw_id", "assertion_ids", "urls", "gene", "hgvs_expressions"], "assertion_ids")
    return _links(R.curated(raw, R.source("clinical_variants"), _dictionaries(t)))


@query("recipe_trial_conditions", f"WITH {SOURCE} SELECT 'cancer_type' AS kind, raw_id, 'DOID:' || s_nationkey AS target FROM src")
def _(spark, d):
    return _curated(spark, d, "trial_conditions", F.concat(F.lit("advanced "), "nation").alias("name"))


@query("recipe_predictions", f"WITH {SOURCE} SELECT * FROM ({GENE_LINK} UNION SELECT 'variant', raw_id, {CODING} FROM src UNION SELECT 'variant', raw_id, {PROTEIN} FROM src) WHERE raw_id NOT IN (SELECT raw_id FROM src WHERE l_returnflag = 'N')")
def _(spark, d):
    return _curated(
        spark, d, "predictions", F.col("symbol").alias("genename"), _coding().alias("hgvsc"), F.concat("symbol", F.lit(":p.V"), "n", F.lit("E")).alias("hgvsp"),
        F.lit("V").alias("aaref"), F.when(F.col("l_returnflag") != "N", "E").alias("aaalt"),
    )
