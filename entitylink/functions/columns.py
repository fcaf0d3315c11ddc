"""Header, cleaning and reshaping helpers: columns in, columns or frames out."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_PREFIX = "json__"


# ---- header and schema ---------------------------------------------------------------------------


def normalize_column(name: str) -> str:
    """A header as snake case."""
    name = re.sub(r"s\(s\)$", "s", name.replace("GRCh", "grch"))
    name = re.sub(r"([A-Z]+)s$", r"\1S", name)
    name = re.sub(r"([^A-Z]+)([A-Z]+)", r"\1_\2", name).replace("(s)", "s").replace("/", "_")
    name = re.sub(r"[@#]+", "", re.sub(r"[()]", " ", name)).lower()
    return re.sub(r"_+", "_", name.strip().replace(" ", "_").replace("-", "_"))


def normalize_columns(df: DataFrame) -> DataFrame:
    """All headers as snake case; no pass over the data."""
    return df.toDF(*[normalize_column(c) for c in df.columns])


def check_columns(df: DataFrame, expected: Iterable[str], hard: bool = False) -> tuple[list[str], list[str]]:
    """(missing, unknown) columns. Missing ones warn, or raise when ``hard``; unknown ones warn."""
    expected = list(expected)
    missing, unknown = [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]
    if missing and hard:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for kind, found in (("missing", missing), ("unknown", unknown)):
        if found:
            warnings.warn(f"{kind} columns: {', '.join(found)}", stacklevel=2)
    return missing, unknown


def keep_declared(df: DataFrame, declared: Iterable[str]) -> DataFrame:
    """The declared columns that exist, in declared order."""
    return df.select(*[F.col(f"`{c}`") for c in declared if c in df.columns])


def serialize_nested(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Structs, maps and arrays become JSON text in a prefixed column."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    cols = [f.name for f in df.schema if isinstance(f.dataType, nested)] if cols is None else list(cols)
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(JSON_PREFIX + c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def deserialize_nested(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The inverse: prefixed JSON columns become typed columns of their plain name."""
    plain = {JSON_PREFIX + c: c for c in schemas}
    return df.select(*[F.from_json(F.col(f"`{c}`"), schemas[plain[c]]).alias(plain[c]) if c in plain else F.col(f"`{c}`") for c in df.columns])


def process_hook(df: DataFrame, task: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """A user's change of a raw table before harmonisation."""
    return df.transform(task) if task else df


def entity_modifier(df: DataFrame, add: Callable[[DataFrame], DataFrame], prefix: str = "x_") -> DataFrame:
    """A user's function that adds columns; every new column must carry the prefix."""
    out = add(df)
    if bad := [c for c in out.columns if c not in df.columns and not c.startswith(prefix)]:
        raise ValueError(f"new columns need the prefix {prefix}: {', '.join(bad)}")
    return out


# ---- scalar cleaners -----------------------------------------------------------------------------


def split_column(col: Column, pattern: str) -> Column:
    """Split to a list without trimming; a pattern of one character is literal, a longer one a regex."""
    return F.split(col, re.escape(pattern) if len(pattern) == 1 else pattern, -1)


def modify(col: Column, modifier: dict | Callable[[Column], Column] | None) -> Column:
    """A column modifier: ``{"pat": pattern}`` to split, a function of the column, or nothing."""
    if modifier is None:
        return col
    return split_column(col, modifier["pat"]) if isinstance(modifier, dict) else modifier(col)


def clean_drug_list(col: Column) -> Column:
    """Remove brackets, split at ``;`` or ``,``."""
    return F.split(F.translate(col, ";[]", ","), ",", -1)


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.when(F.startswith(col, F.lit(prefix)), F.substring(col, len(prefix) + 1, 2**31 - 1)).otherwise(col)


#: Fixed value: a gene symbol with a transcript.
TRANSCRIPT = r"^(.+)_ENST.+"


def strip_transcript(col: Column) -> Column:
    """``SYMBOL_ENST...`` -> ``SYMBOL``, at the last mark with text after it."""
    return F.regexp_replace(col, TRANSCRIPT, "$1")


def prefix_id(col: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), col.cast("string"))


#: Marks of naming authorities after a drug name.
QUALIFIERS = ["BAN", "INN", "MI", "FDA", "JAN", "USAN", "USP", "DCF", "NF"]


def strip_qualifiers(col: Column) -> Column:
    """Drop a bracketed list of naming authorities."""

    def cleaned(part: Column) -> Column:
        inside = F.split(F.substring_index(part, ")", 1), ", ", -1)
        only = F.contains(part, F.lit(")")) & (F.size(F.array_except(inside, F.array(*map(F.lit, QUALIFIERS)))) == 0)
        return F.when(only, F.substr(part, F.instr(part, ")") + 1)).otherwise(F.concat(F.lit(" ("), part))

    parts = F.split(col, r" \(", -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), cleaned), ""))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def as_list(col: Column) -> Column:
    """Null -> empty list."""
    return F.coalesce(col, F.array())


def synonyms_by_language(col: Column, languages: Iterable[str] = ("english", "german")) -> Column:
    """Texts of nested synonyms ``array<struct<language, text>>`` in one of the languages."""
    return F.coalesce(F.transform(F.filter(col, lambda x: x["language"].isin(*languages)), lambda x: x["text"]), F.array().cast("array<string>"))


def external_ids(col: Column, resource: str = "ChEMBL") -> Column:
    """Distinct identifiers of one resource from ``array<struct<resource, identifier>>``."""
    return F.array_distinct(F.transform(F.filter(col, lambda x: x["resource"] == resource), lambda x: x["identifier"]))


def tagged(col: Column, is_list: bool, tag: str, tag_name: str, value_name: str) -> Column:
    """A value, or each value of a list, with the name of its column; null lists are empty."""
    kind = f"array<struct<{tag_name}:string,{value_name}:string>>"
    each = F.transform(col if is_list else F.array(col), lambda v: F.struct(F.lit(tag).alias(tag_name), v.alias(value_name)))
    return F.coalesce(each, F.array().cast(kind))


def first_of_each(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every text only where it first stands in a row's columns: null, or gone from its list, behind that."""
    is_list = {f.name: f.dataType.typeName() == "array" for f in df.schema}
    out, before = {}, []
    for c in cols:
        if is_list[c]:
            seen = [F.coalesce(b, F.array().cast("array<string>")) if listed else F.array(b) for b, listed in before]
            value = F.array_except(F.col(c), F.concat(*seen)) if seen else F.array_distinct(c)
        else:
            value = F.col(c).cast("string")
            seen = [F.coalesce(F.array_contains(b, value) if listed else b == value, F.lit(False)) for b, listed in before]
            value = F.when(~reduce(Column.__or__, seen), value) if seen else value
        out[c] = value
        before.append((F.col(c) if is_list[c] else F.col(c).cast("string"), is_list[c]))
    return df.withColumns(out)


def field_list(col: Column, field: str) -> Column:
    """A list of structs -> the list of one field."""
    return F.transform(col, lambda x: x[field])


def raw_query(*cols: Column) -> Column:
    """Distinct non-empty values of an entity's columns in order, joined by ``;`` (lists joined first)."""
    return F.array_join(F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))), ";")


def display(df: DataFrame, formatters: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The declared columns as the text that is shown for them; others stay."""
    return df.withColumns({c: show(F.col(f"`{c}`")).cast("string") for c, show in formatters.items() if c in df.columns})


# ---- reshaping -----------------------------------------------------------------------------------


def parallel_explode(df: DataFrame, cols: list[str], sep: str = ";") -> DataFrame:
    """Explode several separated lists in lock-step; other columns repeat. A shorter list ends in nulls."""
    zipped = F.explode(F.arrays_zip(*[split_column(F.col(c), sep).alias(c) for c in cols]))
    return df.withColumn("__z", zipped).select(*[F.col("__z")[c].alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def merge_columns(df: DataFrame, cols: list[str], out: str, sep: str = "; ") -> DataFrame:
    """Join columns to one text, nulls skipped; the joined columns go."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], F.concat_ws(sep, *[F.col(f"`{c}`") for c in cols]).alias(out))


def melt_names(df: DataFrame, id_col: str, cols: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Wide id and name columns -> distinct ``(id, type, name)`` without nulls."""
    cols = [c for c in df.columns if c != id_col and (pattern is None or re.search(pattern, c))] if cols is None else cols
    text = df.select(F.col(id_col), *[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot(id_col, cols, "type", "name").na.drop().distinct()


def clean_df(df: DataFrame) -> DataFrame:
    """Distinct rows, empty text as null, then only rows without nulls."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.distinct().select(*[empty_to_null(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns]).na.drop("any")


def filter_species(df: DataFrame, col: str = "species", value: str = "Homo sapiens") -> DataFrame:
    return df.where(F.col(col) == value)


def quarantine(df: DataFrame, col: str, sep: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): rows whose column holds the separator are set apart."""
    bad = F.coalesce(F.contains(F.col(col), F.lit(sep)), F.lit(False))
    return df.where(~bad), df.where(bad)


def filter_prefixed(df: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Rows whose id has the prefix, without it."""
    return df.where(F.coalesce(F.startswith(F.col(id_col), F.lit(prefix)), F.lit(False))).withColumn(id_col, strip_prefix(F.col(id_col), prefix))


def filter_too_long(df: DataFrame, col: str, most: int) -> DataFrame:
    return df.where(~F.coalesce(F.length(col) > most, F.lit(False)))


def drop_id_names(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(id_col) == F.col(name_col), F.lit(False)))


def in_enum(col: Column, values: Iterable[str]) -> Column:
    return F.coalesce(col.isin(*values), F.lit(False))


# ---- terms ---------------------------------------------------------------------------------------

#: The shapes of public identifiers, anchored at the start.
TERMS = {
    "entrez": r"^[0-9]+$",
    "ensembl_gene": r"^ENSG[0-9]+",
    "ensembl_transcript": r"^ENST[0-9]+",
    "ensembl_protein": r"^ENSP[0-9]+",
    "hgnc": r"^HGNC:[0-9]+",
    "dbsnp": r"^rs[0-9]+",
    "hgvs": r"^[^:]+:[^:]+$",
    "hgvs_g": r"^[^:]+:g\.",
    "hgvs_c": r"^[^:]+:c\.",
    "hgvs_p": r"^[^:]+:p\.",
}

#: What an entity id of each kind starts with.
TARGETS = {"gene": r"^HGNC:", "drug": r"^CHEMBL", "cancer_type": r"^DOID:", "variant": r"^[^:]+:[^:]+$"}


def is_term(col: Column, term: str) -> Column:
    return F.coalesce(F.rlike(col, F.lit(TERMS[term])), F.lit(False))


def valid_target(col: Column, core_type: str) -> Column:
    return F.coalesce(F.rlike(col, F.lit(TARGETS[core_type])), F.lit(False))


def profile_terms(df: DataFrame, cols: list[str] | None = None, terms: Iterable[str] = tuple(TERMS)) -> DataFrame:
    """Per column the number of values and how many match each term: one pass, one row per column."""
    cols = cols or df.columns
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value").where("value is not null")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_term(F.col("value"), t)).alias(t) for t in terms])
