"""Proposing which column of a new source holds which kind of entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.operators.dictionary import union_parts
from entitylink.operators.names import normalize_name, small

#: Values of a column's sketch; the share's standard error is at most 0.5 / sqrt(SKETCH), here 0.8 hundredths.
SKETCH = 4096
LEAST_SHARE = 0.5


def column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct ``column, norm``: the normalised values of the columns (lists value by value).

    Texts are made distinct first, so that each is normalised once and not once a row. They are written, as a
    distinct below another one would be dropped from the plan.
    """
    lists = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    pairs = F.concat(*[_named(c, F.col(f"`{c}`") if c in lists else F.array(F.col(f"`{c}`").cast("string"))) for c in cols])
    texts = df.select(F.explode(pairs).alias("v")).select("v.column", "v.value").where("value is not null").distinct()
    rows = materialize(texts, "texts").select("column", normalize_name(F.col("value")).alias("norm"))
    return rows.where("norm is not null and norm <> ''").distinct()


def _named(column: str, values):
    return F.coalesce(F.transform(values, lambda v: F.struct(F.lit(column).alias("column"), v.alias("value"))), F.array().cast("array<struct<column:string,value:string>>"))


def value_sketch(values: DataFrame, size: int = SKETCH) -> DataFrame:
    """``column, norm`` of the values with the smallest hashes of each column: a sample that any two parts of a
    source agree on, so sketches of parts can be united and cut again.
    """
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.xxhash64("norm"), "norm"))
    return values.withColumn("__n", place).where(F.col("__n") <= size).drop("__n")


def containment(values: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """``column, kind, n, hits, share``: how many of a column's values (or of its sketch) are names of a kind."""
    names = union_parts([df.select(F.lit(kind).alias("kind"), "norm") for kind, df in dictionaries.items()]).distinct()
    hits = values.join(small(names), "norm").groupBy("column", "kind").agg(F.count(F.lit(1)).alias("hits"))
    sizes = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.select("*", F.explode(F.array(*map(F.lit, dictionaries))).alias("kind"))
    out = every.join(small(hits), ["column", "kind"], "left").select("column", "kind", "n", F.coalesce("hits", F.lit(0)).alias("hits"))
    return out.withColumn("share", F.col("hits") / F.col("n"))


def assign(shares: dict[tuple[str, str], float], least: float = LEAST_SHARE) -> dict[str, str]:
    """Column of each kind: one-to-one, with the largest sum of shares of at least ``least``.

    Works on columns x kinds numbers, column by column over the sets of kinds given so far.
    """
    columns, kinds = (sorted({k[i] for k in shares}) for i in (0, 1))
    best: dict[frozenset, tuple[float, dict[str, str]]] = {frozenset(): (0.0, {})}
    for column in columns:
        for used, (total, chosen) in list(best.items()):
            for kind in kinds:
                share = shares.get((column, kind), 0.0)
                if kind in used or share < least:
                    continue
                more = total + share, chosen | {kind: column}
                if more[0] > best.get(used | {kind}, (-1.0,))[0]:
                    best[used | {kind}] = more
    return max(best.values(), key=lambda x: (x[0], len(x[1])))[1]


def propose_mapping(df: DataFrame, dictionaries: dict[str, DataFrame], cols: list[str] | None = None, exact: bool = False, least: float = LEAST_SHARE) -> DataFrame:
    """``containment`` of a source's columns in dictionaries of ``norm``, and which are ``chosen`` for a recipe."""
    values = column_values(df, cols or df.columns)
    values = materialize(values if exact else value_sketch(values), "values")
    table = materialize(containment(values, dictionaries), "containment")  # columns x kinds rows
    chosen = assign({(r["column"], r["kind"]): r["share"] for r in table.collect()}, least)
    picked = [(F.col("kind") == k) & (F.col("column") == c) for k, c in chosen.items()]
    test = F.lit(False)
    for p in picked:
        test |= p
    return table.withColumn("chosen", test)
