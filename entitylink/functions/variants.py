"""Sequence-variant names (HGVS) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions.columns import tagged

#: Length limits of a whole name, its reference and its description.
MAX_HGVS, MAX_REF, MAX_DESC = 131, 30, 100

#: Letters of description types.
DESC_TYPES = "cgmnopr"

#: Bits of what was changed in a variant.
GUESSED_TYPE, RECODED, MAPPED_REF = 1, 2, 4

#: One-letter and three-letter amino-acid codes.
AMINO_ACIDS = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met",
    "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "X": "Xaa", "*": "Ter",
}

def hgvs_like(col: Column) -> Column:
    """Exactly one colon with text on both sides."""
    return F.coalesce(F.rlike(col, F.lit("^[^:]+:[^:]+$")), F.lit(False))


def _goes_on(col: Column) -> Column:
    """A second character that ends no line."""
    second = F.substr(col, F.lit(2), F.lit(1))
    return (second != "") & ~second.isin("\n", "\r", "\x85", "\u2028", "\u2029")


def _versioned(ref: Column) -> Column:
    """Ends with a dot and digits; only a reference with a dot takes a regular expression."""
    return F.contains(ref, F.lit(".")) & F.rlike(ref, F.lit(r".+\.[0-9]+$"))


def _kind(desc: Column) -> Column:
    """The type letter, if more follows it."""
    first = F.substr(desc, F.lit(1), F.lit(1))
    return F.when(F.contains(F.lit(DESC_TYPES), first) & _goes_on(desc), first).when(desc.isNotNull(), F.lit(""))


def _untyped(desc: Column, kind: Column) -> Column:
    return F.when(kind != "", F.substr(desc, F.lit(2))).otherwise(desc)


def _split_of(ref: Column, versioned: Column, kind: Column, rest: Column) -> Column:
    """Struct of the parts of a name; ``rest`` is what follows the type letter."""
    return F.struct(
        F.when(versioned, F.substring_index(ref, ".", 1)).otherwise(ref).alias("ref"),
        F.when(versioned, F.substring_index(F.substring_index(ref, ".", 2), ".", -1)).otherwise(F.lit("")).alias("ref_version"),
        kind.alias("desc_type"),
        F.when(F.startswith(rest, F.lit(".")) & _goes_on(rest), F.substr(rest, F.lit(2))).otherwise(rest).alias("desc"),
    )


def hgvs_split(col: Column) -> Column:
    """Struct ``ref, ref_version, desc_type, desc``; the dot after the type letter is optional."""
    ref, desc = F.substring_index(col, ":", 1), F.substring_index(col, ":", -1)
    return _split_of(ref, _versioned(ref), _kind(desc), _untyped(desc, _kind(desc)))


def hgvs_length_ok(whole: Column, ref: Column, desc: Column) -> Column:
    return (F.length(whole) <= MAX_HGVS) & (F.length(ref) <= MAX_REF) & (F.length(desc) <= MAX_DESC)


def _body(col: Column) -> Column:
    """A description without the mark ``p.``."""
    return F.when(F.startswith(col, F.lit("p.")), F.substr(col, F.lit(3))).otherwise(col)


def _number(body: Column) -> Column:
    return F.regexp_extract(body, "[0-9]+", 0)


def _before(body: Column, number: Column) -> Column:
    return F.call_function("substring_index", body, number, F.lit(1))


def _after(body: Column, number: Column) -> Column:
    """The character behind the first number."""
    return F.substr(body, F.length(_before(body, number)) + F.length(number) + 1, F.lit(1))


def _aa3(mark: Column, before: Column, number: Column, after: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in AMINO_ACIDS.items() for x in pair])
    letter = lambda c: F.coalesce(F.try_element_at(names, c), F.lit(""))
    return F.concat(mark, letter(before), number, letter(after))


def _is_aa1(before: Column, number: Column, after: Column) -> Column:
    """At most one letter (or star), a number, a letter (or star)."""
    code = lambda c: (F.length(c) == 1) & F.contains(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ*"), c)
    return F.coalesce((number != "") & ((before == "") | code(before)) & code(after), F.lit(False))


def _is_change(before: Column, number: Column, after: Column) -> Column:
    """Up to three characters, a number, one more character."""
    return F.coalesce((number != "") & F.length(before).between(1, 3) & (after != ""), F.lit(False))


def aa1_to_aa3(col: Column) -> Column:
    """One-letter protein change -> three letters; text after the change is dropped, others unchanged."""
    body = _body(col)
    number = _number(body)
    mark = F.when(F.startswith(col, F.lit("p.")), "p.").otherwise("")
    return F.when(aa1_like(col), _aa3(mark, _before(body, number), number, _after(body, number))).otherwise(col)


def aa1_like(col: Column) -> Column:
    """Starts like a one-letter change."""
    body = _body(col)
    number = _number(body)
    return _is_aa1(_before(body, number), number, _after(body, number))


def guess_desc_type(desc_type: Column, desc: Column) -> Column:
    """Empty type and a description that starts like an amino-acid change -> ``p``."""
    return F.when(guessed(desc_type, desc), F.lit("p")).otherwise(desc_type)


def guessed(desc_type: Column, desc: Column) -> Column:
    """No type, and a description that starts like a change."""
    body = _body(desc)
    number = _number(body)
    return (desc_type == "") & _is_change(_before(body, number), number, _after(body, number))


def modify_flags(guessed_type: Column, recoded: Column, mapped_ref: Column) -> Column:
    bits = [F.when(c, F.lit(b)).otherwise(F.lit(0)) for c, b in ((guessed_type, GUESSED_TYPE), (recoded, RECODED), (mapped_ref, MAPPED_REF))]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def hgvs_format(ref: Column, version: Column, desc_type: Column, desc: Column) -> Column:
    """``ref[.version]:[type.]desc``"""
    has = lambda c: c.isNotNull() & (c != "")
    return F.concat(ref, F.when(has(version), F.concat(F.lit("."), version)).otherwise(""), F.lit(":"), F.when(has(desc_type), F.concat(desc_type, F.lit("."))).otherwise(""), desc)


#: Brackets that are removed, at the end of a reference and after a description.
GENE_BRACKET, NOTE_BRACKET = r"\([^)]+\):", r"([^:]+):([^ ]+) \(([^)]+)\)"


def clean_hgvs_name(col: Column) -> Column:
    """Remove the bracket before the colon (a gene), and a bracketed note after the description."""
    return F.regexp_replace(F.regexp_replace(col, GENE_BRACKET, ":"), NOTE_BRACKET, "$1:$2")


def make_hgvs(ref: Column, desc: Column) -> Column:
    return F.concat(ref, F.lit(":"), desc)


def make_hgvs_known(ref: Column, alteration: Column) -> Column:
    """Only where the alteration starts like a change of an amino acid; else empty."""
    return F.when(F.rlike(alteration, F.lit("^[A-Z][0-9]+[A-Z]")), make_hgvs(ref, alteration)).otherwise(F.lit(""))


def harmonize_variants(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per variant text of the columns (lists exploded, nulls dropped).

    ``key, column, hgvs, ref, ref_version, desc, desc_type, modify_flags, unmapped_type, harmonized``;
    the class is empty, ``unknown_desc_type`` or ``not_hgvs``. Names that are too long are dropped.
    """
    is_list = {f.name: f.dataType.typeName() == "array" for f in df.schema}
    values = F.concat(*[tagged(F.col(c), is_list[c], c, "column", "hgvs") for c in cols])
    rows = df.select(F.col(key), F.explode(values).alias("v")).select(key, "v.column", "v.hgvs").where("hgvs is not null")
    # in steps of columns: each part is found once, and the code of a step stays small enough to be compiled by the JVM
    rows = rows.withColumn("like", hgvs_like(F.col("hgvs")))
    rows = rows.withColumns({f"__{c}": F.when(F.col("like"), F.substring_index("hgvs", ":", i)) for c, i in (("ref", 1), ("desc", -1))})
    rows = rows.withColumns({"__versioned": _versioned(F.col("__ref")), "__kind": _kind(F.col("__desc"))})
    rows = rows.withColumn("__rest", _untyped(F.col("__desc"), F.col("__kind")))
    # lists of one are exploded, so that a later filter on what was parsed does not parse once more below
    parts = F.when(F.col("like"), _split_of(*[F.col(f"__{c}") for c in ("ref", "versioned", "kind", "rest")]))
    rows = rows.select(key, "column", "hgvs", "like", F.explode(F.array(parts)).alias("p"))
    rows = rows.where(~F.col("like") | hgvs_length_ok(F.col("hgvs"), F.col("p.ref"), F.col("p.desc")))
    # parts of the change as columns of their own, so that each is found once
    rows = rows.withColumn("body", F.when(F.col("p.desc_type").isin("p", ""), _body(F.col("p.desc")))).withColumn("number", _number(F.col("body")))
    rows = rows.withColumns({"before": _before(F.col("body"), F.col("number")), "after": _after(F.col("body"), F.col("number"))})
    change = F.col("before"), F.col("number"), F.col("after")
    # only descriptions with a type are recoded, and only those without one are guessed
    rows = rows.withColumns({"recoded": F.coalesce((F.col("p.desc_type") == "p") & _is_aa1(*change), F.lit(False)), "guessed": F.coalesce((F.col("p.desc_type") == "") & _is_change(*change), F.lit(False))})
    mark = F.when(F.startswith(F.col("p.desc"), F.lit("p.")), "p.").otherwise("")
    rows = rows.withColumn("desc", F.when(F.col("recoded"), _aa3(mark, *change)).otherwise(F.col("p.desc")))
    kind = F.when(F.col("guessed"), "p").otherwise(F.col("p.desc_type"))
    unmapped = F.when(~F.col("like"), "not_hgvs").when(kind == "", "unknown_desc_type").otherwise("")
    blank = lambda c: F.coalesce(c, F.lit(""))
    parsed = F.struct(blank(F.col("p.ref")).alias("ref"), blank(F.col("p.ref_version")).alias("ref_version"), blank(F.col("desc")).alias("desc"), blank(kind).alias("desc_type"), modify_flags(F.col("guessed"), F.col("recoded"), F.lit(False)).alias("modify_flags"), unmapped.alias("unmapped_type"))
    out = rows.select(key, "column", "hgvs", F.explode(F.array(parsed)).alias("v")).select(key, "column", "hgvs", "v.*")
    return out.withColumn("harmonized", F.col("unmapped_type") == "")


def references(df: DataFrame, col: str, name: str = "query") -> DataFrame:
    """The references alone of a column's variant names, null for other text: what a dictionary is asked for.

    Descriptions are not parsed, so references of names that are not harmonised are among them.
    """
    ref = F.col("__ref")
    rows = df.select(F.when(hgvs_like(F.col(col)), F.substring_index(col, ":", 1)).alias("__ref"))
    # a list of one is exploded, so that a later filter does not build and split the text once more below
    return rows.select(F.explode(F.array(F.when(_versioned(ref), F.substring_index(ref, ".", 1)).otherwise(ref))).alias(name))


# ---- alleles and consequences --------------------------------------------------------------------


def csq_allele(ref: Column, alt: Column) -> Column:
    """Consequence allele: characters of alt that differ by place; else ``-`` for a deletion, else alt's rest."""
    size = F.least(F.length(ref), F.length(alt))
    differ = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.when(F.substr(ref, i, F.lit(1)) != F.substr(alt, i, F.lit(1)), F.substr(alt, i, F.lit(1))).otherwise("")), "")
    return F.when(differ != "", differ).when(F.length(ref) > F.length(alt), F.lit("-")).otherwise(F.substr(alt, F.length(ref) + 1))


def filter_csq(entries: Column, allele: Column) -> Column:
    """Entries whose first pipe-separated field is the allele."""
    return F.filter(entries, lambda x: F.substring_index(x, "|", 1) == allele)


def csq_names(description: str) -> list[str]:
    """Field names from a header description that ends in ``Format: A|B|C``."""
    return [x.strip() for x in description.rpartition("Format:")[2].strip(' ">').split("|")]


def csq_fields(entry: Column, names: list[str]) -> Column:
    """A consequence entry as a struct of named fields; missing fields are null."""
    parts = F.split(entry, r"\|", -1)
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
