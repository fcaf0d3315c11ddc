"""Source recipes: end-to-end jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions import columns as C
from entitylink.functions import variants as V
from entitylink.functions.storage import materialize
from entitylink.operators.dictionary import numeric_suffix, union_parts
from entitylink.operators.graph import closure
from entitylink.operators.names import DEFAULT_TYPES, by_keys, dedupe_links, fit_names, harmonize, link_all, small, split_harmonized, unusual_keys, union_all
from entitylink.operators.row_ids import row_ids
from entitylink.sources.vcf import explode_alt, parse_vcf


@dataclass
class Recipe:
    """How one raw table is prepared and harmonised.

    ``entities``: entity type -> columns. ``modifiers``: column -> split pattern or function of a column.
    ``adds``: new column -> expression. ``task``: a change of the raw frame first.
    """

    entities: dict[str, list[str]]
    modifiers: dict[str, dict | Callable[[Column], Column]] = field(default_factory=dict)
    adds: dict[str, Column] = field(default_factory=dict)
    task: Callable[[DataFrame], DataFrame] | None = None
    json: dict[str, str] = field(default_factory=dict)

    def prepare(self, raw: DataFrame) -> DataFrame:
        df = C.process_hook(raw, self.task)
        df = C.deserialize_nested(df, self.json) if self.json else df
        df = df.withColumns(self.adds) if self.adds else df
        return df.withColumns({c: C.modify(F.col(c), m) for c, m in self.modifiers.items()}) if self.modifiers else df


def as_text(df: DataFrame, c: str) -> Column:
    """A list column joined by ``;``, others as text."""
    return F.array_join(c, ";") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")


def harmonize_part(raw: DataFrame, recipe: Recipe, kind: str, dictionary: DataFrame | None = None, key: str = "raw_id", types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, rows that were not matched, raw query text per row) of one entity type of a raw table."""
    df, cols = recipe.prepare(raw), recipe.entities[kind]
    queries = df.select(key, C.raw_query(*[as_text(df, c) for c in cols]).alias("query"))
    if kind == "variant":
        found = V.harmonize_variants(df, key, cols)
        links, rest = split_harmonized(found)
        return links.dropDuplicates([key, "hgvs"]), rest, queries
    names, ids = fit_names(dictionary)
    links, rest = split_harmonized(harmonize(df, key, cols, names, ids, types or DEFAULT_TYPES[kind]))
    return dedupe_links(links, key, ["target"]), rest, queries


def links_of(raw: DataFrame, recipe: Recipe, dictionaries: dict[str, DataFrame], key: str = "raw_id") -> dict[str, DataFrame]:
    """Links of every entity type of a raw table; the values of all types but variants are matched in one pass.

    Only keys that stand in several rows, or in rows with long lists, take a distinct over all rows.
    """
    raw = materialize(C.process_hook(raw, recipe.task), "raw")
    df = replace(recipe, task=None).prepare(raw)
    named = {k: cols for k, cols in recipe.entities.items() if k != "variant"}
    unusual = unusual_keys(df, key, named)
    out = link_all(df, key, named, {k: fit_names(dictionaries[k]) for k in named}, unusual) if named else {}
    if "variant" in recipe.entities:
        cols = recipe.entities["variant"]
        alone, rest = by_keys(df, key, unusual)
        parts = [] if alone is None else [V.harmonize_variants(C.first_of_each(alone, cols), key, cols).where("harmonized")]
        parts += [] if rest is None else [V.harmonize_variants(rest, key, cols).where("harmonized").dropDuplicates([key, "hgvs"])]
        out["variant"] = union_all(parts)
    return out


def gene_names_wide(df: DataFrame, id_col: str, source: str, prefix: str) -> DataFrame:
    """Wide gene table -> ``row_no, id, type, name, data_sources``: id and all name-like columns, melted."""
    long = C.melt_names(df, id_col, pattern="(_symbol|_name|_accession|_id)$").withColumn("data_sources", F.lit(source))
    return row_ids(long, "row_no", [numeric_suffix(id_col, prefix), "type", "name"])


def gene_xref(df: DataFrame, id_col: str, source: str, prefix: str) -> DataFrame:
    """Id cross references -> the same shape: complete distinct rows, all columns melted."""
    long = C.melt_names(C.clean_df(df), id_col).withColumn("data_sources", F.lit(source))
    return row_ids(long, "row_no", [numeric_suffix(id_col, prefix), "type", "name"])


def drug_claims(df: DataFrame, id_col: str, name_cols: list[str], prefix: str, source: str) -> DataFrame:
    """Rows with a prefixed id -> distinct ``id, name, data_sources``."""
    long = C.melt_names(C.filter_prefixed(df, id_col, prefix), id_col, name_cols)
    return long.select(id_col, "name").distinct().withColumn("data_sources", F.lit(source))


def drug_nested(df: DataFrame, name: str, synonyms: str, identifiers: str, source: str, languages=("english", "german"), resource: str = "ChEMBL") -> DataFrame:
    """Nested drug records -> every external id with the name and with each synonym."""
    names = F.concat(F.array(name), C.synonyms_by_language(F.col(synonyms), languages))
    out = df.select(F.explode(C.external_ids(F.col(identifiers), resource)).alias("id"), names.alias("names"))
    return out.select("id", F.explode("names").alias("name")).na.drop().distinct().withColumn("data_sources", F.lit(source))


def drug_synonyms(df: DataFrame, id_col: str, lists: list[Column], source: str) -> DataFrame:
    """Drug entries -> cleaned distinct names from several lists."""
    rows = df.select(id_col, F.explode(F.concat(*[C.as_list(x) for x in lists])).alias("name")).where("name is not null and name <> ''").distinct()
    return rows.withColumn("name", C.strip_qualifiers(F.col("name"))).distinct().withColumn("data_sources", F.lit(source))


def ontology_names(terms: DataFrame, synonyms: DataFrame, edges: DataFrame, root: str, expand: bool = False) -> DataFrame:
    """``id, name`` of all descendants of a root (without it): names and exact synonyms.

    With ``expand`` a term's names also count for all its descendants and ancestors under the root.
    """
    names = union_parts([terms.select("id", "name"), synonyms.where("scope = 'EXACT'").select("id", F.col("text").alias("name"))]).where("name <> ''").distinct()
    if not expand:
        below = closure(edges, root=root).select(F.col("descendant").alias("id")).distinct()
        return names.join(below, "id", "left_semi")
    edges = materialize(edges, "edges")
    pairs = closure(edges)
    below = materialize(pairs.where(F.col("ancestor") == root).select(F.col("descendant").alias("id")), "below")
    own = materialize(names.join(below, "id", "left_semi"), "own")
    # what is below a term under the root is itself under the root; above it may stand few others, as the root
    others = edges.select(F.col("parent").alias("ancestor")).where("ancestor is not null").distinct().join(below.withColumnRenamed("id", "ancestor"), "ancestor", "left_anti")
    pairs = pairs.join(small(materialize(others, "others")), "ancestor", "left_anti")
    down = pairs.select(F.col("ancestor").alias("id"), F.col("descendant").alias("other"))
    up = pairs.select(F.col("descendant").alias("id"), F.col("ancestor").alias("other"))
    more = own.join(down.union(up), "id").select(F.col("other").alias("id"), "name")
    return own.union(more).distinct()


def vcf_frequencies(lines: DataFrame, header: list[str], a_cols: list[str], csq_col: str) -> DataFrame:
    """VCF lines -> one row per allele with the consequences of that allele only."""
    rows = explode_alt(parse_vcf(lines, header), a_cols)
    return rows.withColumn(csq_col, V.filter_csq(F.col(csq_col), V.csq_allele(F.col("ref"), F.col("alt"))))


def curated(raw: DataFrame, recipe: Recipe, dictionaries: dict[str, DataFrame], key: str = "raw_id") -> dict[str, DataFrame]:
    """Links of every entity type of a declared source."""
    return links_of(raw, recipe, dictionaries, key)


def source(name: str) -> Recipe:
    """Sources that need a declaration only."""
    # a variant of a reference sequence and an alteration, where that is a change of an amino acid
    known = {"built": V.make_hgvs_known(F.col("ref_seq"), F.col("alteration"))}
    comma = {"pat": ","}
    return {
        "actionable": Recipe({"gene": ["hugo_symbol"], "cancer_type": ["cancer_type"], "drug": ["drugs"], "variant": ["built"]}, adds=known),
        "annotated": Recipe({"gene": ["hugo_symbol"], "variant": ["built"]}, adds=known),
        "curated_mutations": Recipe({"variant": ["hgvs", "built"], "gene": ["gene"], "cancer_type": ["diseases"]}, {"diseases": comma}, {"built": V.make_hgvs(F.col("gene"), F.col("amino_acid"))}),
        "census": Recipe({"gene": ["gene_symbol"], "cancer_type": ["tumour_types_somatic", "tumour_types_germline"]}, {"tumour_types_somatic": comma, "tumour_types_germline": comma}),
        "interpretations": Recipe({"gene": ["gene"], "cancer_type": ["tumor_types"]}, {"tumor_types": {"pat": ", "}}),
        "interactions": Recipe({"gene": ["gene_name"], "drug": ["drug_claim_name", "drug_claim_primary_name", "drug_name", "drug_concept_id"]}, {"drug_concept_id": lambda c: C.strip_prefix(c, "chembl:")}),
        "clinical_variants": Recipe({"variant": ["hgvs_expressions"], "gene": ["gene"]}, {"hgvs_expressions": comma}),
        "trial_conditions": Recipe({"cancer_type": ["name"]}),
        "predictions": Recipe({"gene": ["genename"], "variant": ["hgvsc", "hgvsp"]}, task=lambda df: df.na.drop(subset=["aaref", "aaalt"])),
    }[name]


def biomarkers(raw: DataFrame, dictionaries: dict[str, DataFrame], key: str = "raw_id") -> dict[str, DataFrame]:
    """Multi-value individuals set apart; list columns split; a variant built from transcript and change."""
    kept = C.quarantine(raw, "individual_mutation", ",")[0]
    recipe = Recipe(
        {"gene": ["gene"], "drug": ["drug"], "cancer_type": ["tumor"], "variant": ["individual_mutation", "built"]},
        {"gene": {"pat": ";"}, "drug": C.clean_drug_list, "tumor": {"pat": ";"}},
        {"built": V.make_hgvs(F.col("transcript"), F.col("c_dna"))},
    )
    return links_of(kept, recipe, dictionaries, key)


def variant_summary(raw: DataFrame, dictionaries: dict[str, DataFrame], key: str = "raw_id") -> dict[str, DataFrame]:
    """Cleaned variant names; genes by symbol and id."""
    recipe = Recipe({"variant": ["name"], "gene": ["gene_symbol", "hgnc_id"]}, {"name": V.clean_hgvs_name})
    return links_of(raw, recipe, dictionaries, key)


def mutations(raw: DataFrame, dictionaries: dict[str, DataFrame], key: str = "raw_id", prefix: str = "HGNC:") -> dict[str, DataFrame]:
    """Transcripts stripped off gene names, ids prefixed, three variant columns, four histology columns."""
    recipe = Recipe(
        {"gene": ["gene_name", "hgnc_id"], "cancer_type": ["primary_histology", "subtype_1", "subtype_2", "subtype_3"], "variant": ["hgvsp", "hgvsc", "hgvsg"]},
        {"gene_name": C.strip_transcript, "hgnc_id": lambda c: C.prefix_id(c, prefix)},
    )
    return links_of(raw, recipe, dictionaries, key)


def pathways(raw: DataFrame, dictionary: DataFrame, key: str = "raw_id", species: str = "Homo sapiens") -> DataFrame:
    """One species; genes by their Ensembl id."""
    recipe = Recipe({"gene": ["ensembl_gene_id"]}, task=lambda df: C.filter_species(df, "species", species))
    return harmonize_part(raw, recipe, "gene", dictionary, key)[0]


def evidence(raw: DataFrame, dictionaries: dict[str, DataFrame], key: str = "raw_id") -> dict[str, DataFrame]:
    """Genes, diseases (name and id) and comma-separated drugs."""
    recipe = Recipe({"gene": ["gene"], "cancer_type": ["disease", "doid"], "drug": ["drugs"]}, {"drugs": {"pat": ","}})
    return links_of(raw, recipe, dictionaries, key)
