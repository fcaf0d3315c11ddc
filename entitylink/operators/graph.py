"""Iterative operators on edges: connected components and transitive closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.operators.dictionary import union_parts as union_all


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of each node's component: ``(node, component)``.

    Large-star / small-star rounds on an edge table that never grows beyond twice its size; every
    round is written to the shared folder, and the loop ends when all that is left is stars. Minima are
    combined before each shuffle.
    Edges with a null end are ignored; a self edge makes a component of one.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = materialize(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first, so that a hub's edges meet them in a join that can be split
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v"), "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
        heads = now.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
        left = heads.where("v <> w").select("v").union(heads.join(now.select(F.col("u").alias("v")), "v", "left_semi").select("v"))
        if left.isEmpty():  # every node hangs on one head, and no head on another
            break
    return nodes.join(now.withColumnRenamed("u", "node").hint("merge"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def cluster_variants(pairs: DataFrame, id_col: str = "variant_id", name_col: str = "hgvs") -> DataFrame:
    """Ids that share a name collapse; components are numbered 1..n by their smallest id: ``(name, variant_id)``."""
    from entitylink.operators.row_ids import row_ids

    given = pairs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).where("id is not null and name is not null").distinct()
    first = given.groupBy("name").agg(F.min("id").alias("head"))
    # every id is tied to the smallest id of each of its names: a star per name instead of all pairs
    parts = connected_components(given.join(first.hint("merge"), "name").select("id", "head"), "id", "head")
    numbers = row_ids(parts.select("component").distinct(), "variant_id", ["component"])
    named = first.join(parts, F.col("head") == F.col("node")).select("name", "component")
    return named.join(numbers, "component").select("name", "variant_id")


def merge_variant_sets(sets: list[DataFrame], id_col: str = "variant_id", name_col: str = "hgvs") -> DataFrame:
    """Id sets of several sources: each is shifted past the ones before it, then all are clustered at once."""
    shift, moved = 0, []
    for df in sets:
        top = df.agg(F.max(id_col)).first()[0] or 0
        moved.append(df.select((F.col(id_col) + shift).alias(id_col), name_col))
        shift += top + 1  # ids may start at 0
    out = moved[0]
    for df in moved[1:]:
        out = out.unionByName(df)
    return cluster_variants(out, id_col, name_col)


def extend_variant_sets(known: DataFrame, new: DataFrame, id_col: str = "variant_id", name_col: str = "hgvs") -> tuple[DataFrame, DataFrame]:
    """Clusters ``(name, variant_id)`` with one more id set, without clustering the known ones again.

    Known clusters are contracted to their numbers: of them only those take part whose names the new set
    has, so the graph that is clustered has the size of the new set. Clusters that it joins go on under the
    smallest of their numbers, new ones are numbered behind the known. Second result: ``(variant_id, now)``
    of the known numbers that changed. In order of number the clusters are those of all sets at once.
    """
    from entitylink.operators.names import small
    from entitylink.operators.row_ids import row_ids

    top = known.agg(F.max("variant_id")).first()[0] or 0
    given = new.select((F.col(id_col) + (top + 1)).alias("id"), F.col(name_col).alias("name")).where("id is not null and name is not null").distinct()
    given = materialize(given, "new-set")
    met = known.join(small(given.select("name").distinct()), "name", "left_semi").select("name", F.col("variant_id").alias("node"))
    # a name's head is its known cluster, else the smallest new id
    heads = given.groupBy("name").agg(F.min("id").alias("first")).join(met, "name", "left")
    heads = materialize(heads.select("name", F.coalesce("node", "first").alias("head"), F.col("node").isNull().alias("fresh")), "heads")
    parts = materialize(connected_components(given.join(heads.hint("merge"), "name").select("id", "head"), "id", "head"), "parts")
    numbers = row_ids(parts.where(F.col("component") > top).select("component").distinct(), "number", ["component"], start=top + 1)
    parts = parts.join(numbers, "component", "left").select("node", F.coalesce("number", "component").alias("now"))
    changed = materialize(parts.where((F.col("node") <= top) & (F.col("node") != F.col("now"))).select(F.col("node").alias("variant_id"), "now"), "changed")
    old = known.join(small(changed), "variant_id", "left").select("name", F.coalesce("now", "variant_id").alias("variant_id"))
    names = heads.where("fresh").join(parts, F.col("head") == F.col("node")).select("name", F.col("now").alias("variant_id"))
    return old.unionByName(names), changed


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", root=None) -> DataFrame:
    """All ``(descendant, ancestor)`` pairs of a hierarchy; with a root, only its descendants.

    Path doubling: beside the pairs within 2**k steps go those of exactly 2**k steps. A pair within twice as
    many steps is one of the latter followed by one of the former, so rounds grow with the logarithm of the
    depth. The loop ends when a round adds nothing, also where cycles let exact steps go on for ever.
    """
    given = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct()
    exact = materialize(given, "edges")
    new = exact if root is None else exact.where(F.col("p") == root)
    new = materialize(new.select(F.col("c").alias("descendant"), F.col("p").alias("ancestor")), "closure")
    parts = [new]
    while not new.isEmpty():
        within = union_all(parts)
        step = exact.join(within, F.col("p") == F.col("descendant")).select(F.col("c").alias("descendant"), "ancestor").distinct()
        new = materialize(step.join(within, ["descendant", "ancestor"], "left_anti"), "closure")
        parts.append(new)
        ahead = exact.select(F.col("c").alias("p"), F.col("p").alias("over"))
        exact = materialize(exact.join(ahead, "p").select("c", F.col("over").alias("p")).distinct(), "steps")
    return union_all(parts)
