"""Variant call files: header-driven types, one row per allele."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
TYPES = {"Integer": "bigint", "Float": "double", "Flag": "boolean", "String": "string", "Character": "string"}


def parse_header(header: list[str]) -> dict[str, tuple[str, str]]:
    """INFO fields of the header lines: id -> (Number, Type)."""
    found = [re.match(r"##INFO=<ID=([^,]+),Number=([^,]+),Type=([^,>]+)", line) for line in header]
    return {m[1]: (m[2], m[3]) for m in found if m}


def missing(col: Column) -> Column:
    """``.`` stands for no value."""
    return F.nullif(col, F.lit("."))


def typed_info(info: Column, fields: dict[str, tuple[str, str]], alts: Column, parsers: dict[str, Callable[[Column], Column]] | None = None) -> list[Column]:
    """Flags -> presence; Number 1 -> scalar; A -> list as long as ALT; R and G -> text; others -> list."""
    pairs, out = F.str_to_map(F.coalesce(missing(info), F.lit("")), F.lit(";"), F.lit("=")), []
    for name, (number, kind) in fields.items():
        value = missing(F.try_element_at(pairs, F.lit(name)))
        sql = TYPES.get(kind, "string")
        if parsers and name in parsers:
            col = parsers[name](value)
        elif kind == "Flag":
            col = F.map_contains_key(pairs, F.lit(name))
        elif number == "1":
            col = value.try_cast(sql)
        elif number in ("R", "G"):
            col = value
        else:
            items = F.transform(F.split(value, ",", -1), lambda x: missing(x).try_cast(sql))  # noqa: B023
            blank = F.lit("") if sql == "string" else F.lit(None).cast(sql)
            col = F.coalesce(items, F.array_repeat(blank, F.size(alts))) if number == "A" else items
        out.append(col.alias(f"info_{name.lower()}"))
    return out


def parse_vcf(lines: DataFrame, header: list[str], parsers: dict[str, Callable[[Column], Column]] | None = None, process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Lines of a VCF body (column ``line``) -> chrom .. filter and typed ``info_*`` columns."""
    fields = parse_header(header)
    cells = F.split("line", "\t", -1)
    rows = lines.where(~F.startswith("line", F.lit("#"))).select(*[F.get(cells, F.lit(i)).alias(n.lower()) for i, n in enumerate(FIXED)])
    rows = rows.withColumn("alt", F.split(missing(F.col("alt")), ",", -1))
    rows = rows.select("chrom", F.col("pos").try_cast("bigint").alias("pos"), missing(F.col("id")).alias("id"), "ref", "alt", missing(F.col("qual")).try_cast("double").alias("qual"), missing(F.col("filter")).alias("filter"), *typed_info(F.col("info"), fields, F.col("alt"), parsers))
    return rows.transform(process) if process else rows


def explode_alt(df: DataFrame, a_cols: list[str], alts: str = "alt") -> DataFrame:
    """One row per ALT allele with its own value of every ``A`` column; the full list stays in ``alts``."""
    zipped = F.explode(F.arrays_zip(F.col(alts).alias("alt"), *[F.col(c).alias(c) for c in a_cols]))
    others = [c for c in df.columns if c not in (alts, *a_cols)]
    return df.select(*others, F.col(alts).alias("alts"), zipped.alias("z")).select(*others, "alts", F.col("z.alt").alias("alt"), *[F.col("z")[c].alias(c) for c in a_cols])
