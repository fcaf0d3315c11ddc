"""Name dictionaries and the match cascade from free text to entity ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.operators.semi import key_filter, may_be_in

MATCH_TYPES = ("direct", "exact", "substring", "partial", "filtered_partial")

#: Default cascades by kind of entity.
DEFAULT_TYPES = {"gene": ("direct", "exact"), "drug": ("direct", "exact", "substring"), "cancer_type": ("direct", "exact", "substring")}

#: A dictionary of at most this many bytes in memory may be broadcast. Spark's estimate of a plan over files
#: counts compressed bytes, which ``EXPANSION`` turns into bytes in memory.
BROADCAST_BYTES = 64 << 20
EXPANSION = 8


def normalize_name(col: Column) -> Column:
    """Keep letters, digits and the marks between ``Z`` and ``a`` in the character table (a fixed range); lower-case."""
    return F.lower(F.regexp_replace(col, "[^a-zA-z0-9]+", ""))


def is_small(df: DataFrame) -> bool:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * EXPANSION <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if its estimated size allows it; otherwise joins shuffle."""
    return F.broadcast(df) if is_small(df) else df


def row_bytes(cols: list[str]) -> Column:
    """About what a row takes in a broadcast table."""
    return F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in cols])) + (48 + 16 * len(cols))


def fits(df: DataFrame) -> bool:
    """As ``is_small``, but what passes that is measured: an estimate knows neither lists nor made-up text."""
    return is_small(df) and (df.agg(F.sum(row_bytes(df.columns))).first()[0] or 0) <= BROADCAST_BYTES


def fit_names(df: DataFrame, id_col: str = "id", name_col: str = "name", source_col: str | None = None, type_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Index ``(norm, target, sources, types)`` of names and of the ids themselves, and the raw ids."""
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    kind = F.col(type_col) if type_col else F.lit(None).cast("string")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("target"), F.explode(F.array(name_col, id_col)).alias("name"), source.alias("source"), kind.alias("type"))
    names = rows.withColumn("norm", normalize_name(F.col("name"))).where("norm is not null and norm <> ''")
    names = names.groupBy("norm", "target").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("type")).alias("types"))
    return names, df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("target")).distinct()


def word_ngrams(col: Column, most: int = 1, sep: str = " ") -> Column:
    """Words of a text, and runs of up to ``most`` of them."""
    words = F.split(col, sep, -1)

    def runs(n: int) -> Column:
        if n == 1:
            return words
        size = F.greatest(F.size(words) - (n - 1), F.lit(0))
        out = F.slice(words, F.lit(1), size)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(words, F.lit(k + 1), size), lambda x, y: F.concat(x, F.lit(sep), y))
        return out

    return F.concat(*[runs(n) for n in range(1, most + 1)])


# ---- stages that look a key up -------------------------------------------------------------------

#: Types of match whose queries become keys of one index: raw ids or normalised names.
KEYED = ("direct", "exact", "substring")


def name_index(names: DataFrame, ids: DataFrame, kind: str = "") -> DataFrame:
    """``kind, is_id, key, target``: raw ids and normalised names as one table to look keys up in."""
    one = lambda df, is_id, key: df.select(F.lit(kind).alias("kind"), F.lit(is_id).alias("is_id"), F.col(key).alias("key"), "target")
    return one(ids, True, "target").unionByName(one(names, False, "norm"))


def _keys(types: Iterable[str], first: int, n_grams: int, sep: str) -> Column:
    """The keys of a query, tagged with the place of their type of match in the cascade.

    A query without letters and digits has none, not even as an id. This is tested here, on distinct queries.
    """
    key = lambda stage, is_id, text: F.struct(F.lit(stage).alias("stage"), F.lit(is_id).alias("is_id"), text.alias("key"))

    def keys(stage: int, kind: str) -> Column:
        if kind == "substring":
            # queries are distinct, so distinct tokens within a row are enough and long texts do not shuffle
            tokens = F.array_distinct(F.transform(word_ngrams(F.col("query"), n_grams, sep), normalize_name))
            return F.transform(tokens, lambda w: key(stage, False, w))
        norm = normalize_name(F.col("query"))
        return F.array(key(stage, kind == "direct", F.when(norm != "", F.col("query")) if kind == "direct" else norm))

    return F.concat(*[keys(stage, kind) for stage, kind in enumerate(types, first)])


def match_keyed(asked: DataFrame, index: DataFrame, types: dict[str, tuple[str, ...]], first: int = 0, n_grams: int = 1, sep: str = " ") -> DataFrame:
    """Distinct ``kind, query`` looked up for all types of match in one join; the earliest type with a hit wins.

    An index too large to broadcast is met by shuffle, but only by keys that pass a bitmap of its keys.
    ``kind, query, match_type, matched_name, target, distance``.
    """
    kinds = [F.when(F.col("kind") == k, _keys(t, first, n_grams, sep)) for k, t in types.items() if t]
    label = F.create_map(*[x for k, t in types.items() for i, kind in enumerate(t) for x in (F.lit(f"{k}/{first + i}"), F.lit(kind))])
    keys = asked.select("kind", "query", F.explode(F.coalesce(*kinds)).alias("k")).select("kind", "query", "k.*").where("key is not null and (is_id or key <> '')")
    on = ["kind", "is_id", "key"]
    if is_small(index):
        hits = keys.join(F.broadcast(index), on)
    else:  # most words of a text are no names, so a filter of the names spares their shuffle
        index = materialize(index, "index")
        hits = may_be_in(keys, on, *key_filter(index, on)).join(index, on)
    hits = best_with_ties(hits, ["kind", "query"], "stage") if any(len(t) > 1 for t in types.values()) else hits
    name = F.when(~F.col("is_id"), F.col("key"))
    return hits.select("kind", "query", F.try_element_at(label, F.concat_ws("/", "kind", F.col("stage").cast("string"))).alias("match_type"), name.alias("matched_name"), "target", F.lit(None).cast("int").alias("distance"))


def _one(queries: DataFrame, index: DataFrame, kind: str, **options) -> DataFrame:
    return match_keyed(queries.select(F.lit("").alias("kind"), "query"), index, {"": (kind,)}, **options).drop("kind")


def match_direct(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """The raw query is a raw id."""
    return _one(queries, ids.select(F.lit("").alias("kind"), F.lit(True).alias("is_id"), F.col("target").alias("key"), "target"), "direct")


def match_exact(queries: DataFrame, names: DataFrame) -> DataFrame:
    """The normalised query is a normalised name."""
    return _one(queries, name_index(names, names.limit(0)), "exact")


def match_substring(queries: DataFrame, names: DataFrame, n_grams: int = 1, sep: str = " ") -> DataFrame:
    """Every word (or run of words) of the raw query that is a name."""
    return _one(queries, name_index(names, names.limit(0)), "substring", n_grams=n_grams, sep=sep)


# ---- edit distance -------------------------------------------------------------------------------

#: Normalised names use about forty characters, so there are at most 43**3 different grams of this length.
GRAM = 3


def _gram_size(length: Column, reach: Column) -> Column:
    """Length of a name's grams: ``reach`` edits must leave one of them whole."""
    return F.least(F.lit(GRAM), F.floor((length - reach) / (reach + 1)).cast("int"))


def _grams(df: DataFrame, text: str, size: str) -> DataFrame:
    """One row per place of a gram: ``gram, pos``."""
    places = F.sequence(F.lit(0), F.length(text) - F.col(size))
    each = F.transform(places, lambda p: F.struct(p.alias("pos"), F.substr(F.col(text), p + 1, F.col(size)).alias("gram")))
    return df.where(F.col(size) >= 1).where(F.length(text) >= F.col(size)).select("*", F.explode(each).alias("__g")).select("*", "__g.*").drop("__g")


def _rare(df: DataFrame, often: DataFrame, text: str) -> DataFrame:
    """A text's ``g * r + 1`` rarest grams (with all places of the last one) that occur in names at all."""
    order = F.rank().over(Window.partitionBy(text, "g").orderBy(F.coalesce("often", F.lit(0)), "gram"))
    ranked = df.join(often, "gram", "left").withColumn("__r", order)
    return ranked.where((F.col("__r") <= F.col("g") * F.col("r") + 1) & F.col("often").isNotNull()).drop("__r", "often")


def _cell(x: Column, bound: int) -> Column:
    return F.floor(x / bound).cast("int")


def spelled_names(known: DataFrame, bound: int, reach: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """All grams of names, and how often each occurs; a table bounded by the characters of normalised names."""
    n = F.length("name")
    known = known.select("name", n.alias("n"), F.least(F.lit(bound), reach(n)).alias("r")).where("r >= 1")
    spelled = _grams(known.withColumn("g", _gram_size(F.col("n"), F.col("r"))), "name", "g")
    return spelled, F.broadcast(spelled.groupBy("gram").agg(F.count(F.lit(1)).alias("often")))


def name_keys(spelled: DataFrame, often: DataFrame, bound: int) -> DataFrame:
    """The keys of names: a rare gram, its place and the name's length in steps of the bound."""
    return _rare(spelled, often, "name").select("gram", _cell(F.col("pos"), bound).alias("at"), _cell(F.col("n"), bound).alias("size"), "name", "n", "pos", "r")


def near_pairs(asked: DataFrame, known: DataFrame, bound: int, reach: Callable[[Column], Column]) -> DataFrame:
    """``q, name``: pairs that may lie within ``asked.reach`` edits, at most ``bound``, and all that do.

    A prefix filter on positional grams. d edits spoil at most d * g grams of length g, so of the d * g + 1
    grams that are rarest among all names, one is left in both of two names within d edits, moved by no more
    than the edits before it; the edits after it make up for the rest of the difference in length. Only
    names that share a rare gram at such places meet: what many names have in common is no key.
    ``reach`` gives the distance looked for around a name of a length.
    """
    m = F.length("q")
    asked = asked.select("q", m.alias("m"), F.least(F.lit(bound), "reach").alias("r")).where("r >= 1").distinct()
    lengths = F.sequence(F.greatest(F.col("m") - F.col("r"), F.lit(1)), F.col("m") + F.col("r"))
    sizes = F.array_distinct(F.transform(lengths, lambda x: _gram_size(x, F.least(F.lit(bound), reach(x)))))
    spelled, often = spelled_names(known, bound, reach)
    cells = lambda x: F.explode(F.sequence(_cell(F.greatest(x - F.col("r"), F.lit(0)), bound), _cell(x + F.col("r"), bound)))
    left = _rare(_grams(asked.withColumn("g", F.explode(sizes)), "q", "g"), often, "q").withColumn("at", cells(F.col("pos"))).withColumn("size", cells(F.col("m")))
    left = left.select("gram", "at", "size", "q", "m", F.col("pos").alias("p"), F.col("r").alias("rq"))
    moved = F.col("pos") - F.col("p")
    met = left.join(name_keys(spelled, often, bound), ["gram", "at", "size"])
    return met.where(F.abs(moved) + F.abs(F.col("n") - F.col("m") - moved) <= F.least("r", "rq")).select("q", "name").distinct()


def near_distances(asked: DataFrame, known: DataFrame, bound: int, reach: Callable[[Column], Column]) -> DataFrame:
    """``q, name, dist`` of all pairs within ``asked.reach`` edits, at most ``bound``."""
    measured = near_pairs(asked, known, bound, reach).withColumn("dist", F.expr(f"levenshtein(q, name, {bound})")).where("dist >= 0")
    return measured.join(asked.select("q", "reach"), "q").where("dist <= reach").drop("reach")


def rising_search(asked: DataFrame, known: DataFrame, most: Callable[[Column], Column], reach: Callable[[Column], Column], by_ratio: bool) -> tuple[DataFrame, DataFrame]:
    """(``q, name, dist`` of all names at the smallest value, texts without one) for distinct ``asked.q``.

    The bound on the distance doubles from round to round, up to ``most`` of a text's length, and only texts
    that a larger distance could still answer go on. The value is the distance, or (``by_ratio``) the distance
    as a share of the longer length, where a larger distance to a longer name may be the smaller share.
    """
    same = asked.join(known.select(F.col("name").alias("q")), "q", "left_semi")
    found = [same.select("q", F.col("q").alias("name"), F.lit(0).alias("dist"))]
    active = materialize(asked.join(same, "q", "left_anti").withColumn("reach", most(F.length("q"))), "unanswered")
    none, bound = [active.where("reach < 1").select("q")], 1
    active = active.where("reach >= 1")
    while not active.isEmpty():
        near = materialize(near_distances(active, known, bound, reach), "near")
        m, seen = F.length("q"), F.least(F.lit(bound), "reach")
        value = F.col("dist") / F.greatest(m, F.length("name")) if by_ratio else F.col("dist")
        best = near.withColumn("value", value).groupBy("q").agg(F.min("value").alias("best"))
        beaten = (seen + 1) / (m + seen + 1) if by_ratio else seen + 1  # the least value of a larger distance
        state = materialize(active.join(best, "q", "left").withColumn("done", (F.col("reach") <= bound) | F.coalesce(F.col("best") < beaten, F.lit(False))), "unanswered")
        hits = near.withColumn("value", value).join(state.where("done").select("q", "best"), "q").where("value = best")
        found.append(hits.select("q", "name", "dist"))
        none.append(state.where("done and best is null").select("q"))
        active, bound = state.where("not done").select("q", "reach"), 2 * bound
    return union_all(found), union_all(none)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


#: Names that stand for all when no near one exists.
PIVOTS = 16
FIRST = 4  # names measured for the upper bound of each text


def pivot_search(asked: DataFrame, known: DataFrame, allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """``q, name, dist``: all names at the smallest distance of each ``asked.q``, by the triangle inequality.

    Every name knows its distances to a few pivots. A text's distances to the pivots bound its smallest one
    from above, and its distance to any name from below: a name stands in the ring of its nearest pivot, and
    only rings that the bound reaches are met. Differing characters and lengths bound from below as well. The
    names of smallest lower bound are measured first, which lowers the upper bound for the rest. With
    ``allowed``, a distance for each length, what is smallest is the distance as a share of the longer length.
    """
    pivots = [r["name"] for r in known.orderBy(F.xxhash64("name"), "name").limit(PIVOTS).collect()]  # a fixed number
    if not pivots:
        return asked.select("q", F.lit("").alias("name"), F.lit(0).alias("dist")).limit(0)
    to = lambda c: F.array(*[F.levenshtein(F.col(c), F.lit(p)) for p in pivots])
    ring = F.array_min("there")
    names = known.select("name", to("name").alias("there")).select("name", "there", (F.array_position("there", ring) - 1).cast("int").alias("pivot"), ring.alias("ring"), F.length("name").alias("n"))
    names = materialize(names, "pivots")
    m = F.length("q")
    texts = asked.select("q", to("q").alias("here")).withColumn("high", allowed(m) if allowed else F.array_min("here"))
    texts = texts.withColumn("n", F.explode(F.sequence(F.greatest(m - F.col("high"), F.lit(0)), m + F.col("high"))))
    rings = names.select("pivot", "ring", "n").distinct()
    texts = texts.join(rings, "n").where(F.abs(F.get("here", F.col("pivot")) - F.col("ring")) <= F.col("high"))
    low = F.greatest(F.array_max(F.zip_with("here", "there", lambda x, y: F.abs(x - y))), bag_distance(F.col("q"), F.col("name")))
    near = materialize(texts.join(names, ["pivot", "ring", "n"]).select("q", "name", "high", low.alias("low")).where("low <= high"), "bounded")
    measured = F.levenshtein("q", "name")
    if allowed:
        rest = near.withColumn("dist", measured).where("dist <= high").withColumn("value", F.col("dist") / F.greatest(m, F.length("name")))
        return best_with_ties(rest, ["q"], "value").select("q", "name", "dist")
    place = F.row_number().over(Window.partitionBy("q").orderBy("low", "name"))
    first = near.withColumn("__n", place).where(F.col("__n") <= FIRST).groupBy("q").agg(F.min(measured).alias("least"))
    rest = near.join(first, "q").where(F.col("low") <= F.least("least", "high")).withColumn("dist", measured)
    return best_with_ties(rest.select("q", "name", "dist"), ["q"], "dist")


def bag_distance(a: Column, b: Column) -> Column:
    """Least number of edits between two texts, whatever the order of their characters."""
    held = lambda x, c: F.length(x) - F.length(F.replace(x, c))
    extra = lambda x, y: F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0), lambda s, c: s + F.greatest(held(x, c) - held(y, c), F.lit(0)))
    return F.greatest(extra(a, b), extra(b, a))


def nearest_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``query, name, dist``: every query's names at the smallest edit distance, however large.

    By rising distance while grams can tell (a third of the length), by pivots for what is left.
    """
    known = materialize(names.select(F.col("norm").alias("name")).distinct(), "known")
    asked = materialize(queries.select("query", normalize_name(F.col("query")).alias("q")).where("q is not null"), "asked")
    third, half = lambda n: F.floor((n - 1) / 3).cast("int"), lambda n: F.floor((n - 1) / 2).cast("int")
    near, rest = rising_search(asked.select("q").distinct(), known, third, half, by_ratio=False)
    return asked.join(near.unionByName(pivot_search(rest, known)), "q").select("query", "name", "dist")


def best_with_ties(candidates: DataFrame, key: list[str], value: str) -> DataFrame:
    """All candidates at the smallest value per key."""
    return candidates.withColumn("__r", F.rank().over(Window.partitionBy(*key).orderBy(value))).where("__r = 1").drop("__r")


def match_partial(queries: DataFrame, names: DataFrame, threshold: float = 0.2, kind: str = "partial") -> DataFrame:
    """All names at the smallest edit distance, if that is at most ``threshold`` of the longer length."""
    per = threshold / (1 - threshold)
    known = materialize(names.select(F.col("norm").alias("name")).distinct(), "known")
    asked = materialize(queries.select("query", normalize_name(F.col("query")).alias("q")).where("q <> ''"), "asked")
    allowed = lambda n: F.floor(n * F.lit(per) + F.lit(1e-9)).cast("int")
    third, half = lambda n: F.floor((n - 1) / 3).cast("int"), lambda n: F.floor((n - 1) / 2).cast("int")
    wide = allowed(F.length("q")) > third(F.length("q"))  # texts so short that near ones need not share a gram
    texts = asked.select("q").distinct()
    near = rising_search(texts.where(~wide), known, allowed, lambda n: F.least(allowed(n), half(n)), by_ratio=True)[0]
    if threshold > 0.2:  # below, no length is wide
        near = near.unionByName(pivot_search(texts.where(wide), known, allowed))
    hits = asked.join(near.where(F.col("dist") / F.greatest(F.length("q"), F.length("name")) <= threshold), "q")
    return _result(hits.join(small(names.select(F.col("norm").alias("name"), "target")), "name"), kind, F.col("name"), F.col("dist"))


def match_filtered_partial(queries: DataFrame, names: DataFrame, threshold: float = 0.2) -> DataFrame:
    """As partial, without queries that start like letters and a number (a fixed rule)."""
    return match_partial(queries.where(~F.rlike("query", F.lit("^[a-zA-Z]*[0-9]+"))), names, threshold, "filtered_partial")


# ---- the cascade ---------------------------------------------------------------------------------


def _result(df: DataFrame, kind: str, name: Column, distance: Column) -> DataFrame:
    return df.select("query", F.lit(kind).alias("match_type"), name.alias("matched_name"), "target", distance.alias("distance"))


def match_cascade(queries: DataFrame, names: DataFrame, ids: DataFrame, types: Iterable[str] = ("direct", "exact"), threshold: float = 0.2, n_grams: int = 1, extended: bool = False) -> DataFrame:
    """Distinct queries through the match types in order; the first type with a hit wins for each query.

    Types that look a key up and follow each other are one join. ``query, match_type, matched_name, target,
    distance``, with the names' sources and types if extended.
    """
    left = queries.select("query").where("query is not null").distinct()
    index, out, types = name_index(names, ids), None, tuple(types)
    for keyed, group in groupby(types, lambda t: t in KEYED):
        for step in [tuple(group)] if keyed else [(t,) for t in group]:
            if keyed:
                hits = match_keyed(left.select(F.lit("").alias("kind"), "query"), index, {"": step}, n_grams=n_grams).drop("kind")
            else:
                hits = (match_partial if step == ("partial",) else match_filtered_partial)(left, names, threshold)
            out = hits if out is None else out.unionByName(hits)
            if step[-1] != types[-1]:
                left = left.join(hits.select("query").distinct(), "query", "left_anti")
    if extended:
        known = names.select(F.col("norm").alias("__n"), F.col("target").alias("__t"), "sources", "types")
        same = (F.coalesce("matched_name", normalize_name(F.col("target"))) == F.col("__n")) & (F.col("target") == F.col("__t"))
        out = out.join(small(known), same, "left").drop("__n", "__t")
    return out


def harmonize(df: DataFrame, key: str, cols: list[str], names: DataFrame, ids: DataFrame, types: Iterable[str] = ("direct", "exact"), **options) -> DataFrame:
    """``key, column, query, target, match_type, harmonized``: one row per value and id, or one without id.

    Values are distinct before they are matched, so popular names are matched once.
    """
    rows = tagged_values(df, key, {"": cols}).drop("kind")
    found = materialize(match_cascade(rows.select("query"), names, ids, types, **options).groupBy("query").agg(F.first("match_type").alias("match_type"), F.array_sort(F.collect_set("target")).alias("targets")), "matches")
    return _joined(rows, found, ["query"], key)


def tagged_values(df: DataFrame, key: str, entities: dict[str, list[str]]) -> DataFrame:
    """``key, kind, column, query``: the values of all columns of all entity types, in one pass."""
    is_list = {f.name: f.dataType.typeName() == "array" for f in df.schema}
    item = lambda kind, c, value: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column"), value.cast("string").alias("query"))
    of_list = lambda kind, c: F.coalesce(F.transform(F.col(c), lambda v: item(kind, c, v)), F.array().cast("array<struct<kind:string,column:string,query:string>>"))
    pairs = [(kind, c) for kind, cols in entities.items() for c in cols]
    plain = [item(kind, c, F.col(c)) for kind, c in pairs if not is_list[c]]
    each = ([F.array(*plain)] if plain else []) + [of_list(kind, c) for kind, c in pairs if is_list[c]]
    return df.select(F.col(key), F.explode(F.concat(*each)).alias("v")).select(key, "v.*").where("query is not null")


def _joined(rows: DataFrame, found: DataFrame, on: list[str], key: str, how: str = "left") -> DataFrame:
    out = rows.join(small(found), on, how).select(*[c for c in on if c != "query"], key, "column", "query", "match_type", F.explode_outer("targets").alias("target"))
    return out.withColumn("harmonized", F.col("target").isNotNull())


def harmonize_all(df: DataFrame, key: str, entities: dict[str, list[str]], dictionaries: dict[str, tuple[DataFrame, DataFrame]], types: dict[str, tuple[str, ...]] | None = None, matched_only: bool = False) -> DataFrame:
    """``kind`` and what ``harmonize`` gives, for several entity types at once (``matched_only``: without rows without id).

    One pass over the rows, one distinct over all values, one look-up in all dictionaries, one join back.
    Only types of match that look a key up.
    """
    types = types or {k: DEFAULT_TYPES[k] for k in entities}
    rows = tagged_values(df, key, entities)
    asked = rows.select("kind", "query").distinct()
    index = union_all([name_index(*dictionaries[k], k) for k in entities])
    found = match_keyed(asked, index, types).groupBy("kind", "query").agg(F.first("match_type").alias("match_type"), F.array_sort(F.collect_set("target")).alias("targets"))
    return _joined(rows, materialize(found, "matches"), ["kind", "query"], key, "inner" if matched_only else "left")


#: Places of a list column that are looked up within their row; the keys of longer lists go the general way.
PLACES = 3


def unusual_keys(df: DataFrame, key: str, entities: dict[str, list[str]]) -> DataFrame:
    """``__h``: hashes of keys that stand in several rows or in a row with a long list, and so need a distinct over all rows."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array" and any(f.name in cols for cols in entities.values())]
    long = reduce(Column.__or__, [F.coalesce(F.size(c) > PLACES, F.lit(False)) for c in lists], F.lit(False))
    each = df.select(F.xxhash64(key).alias("__h"), long.alias("long")).groupBy("__h").agg(F.count(F.lit(1)).alias("n"), *([F.bool_or("long").alias("long")] if lists else []))
    return materialize(each.where("n > 1 or long" if lists else "n > 1").select("__h"), "unusual-keys")


def by_keys(df: DataFrame, key: str, unusual: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(Rows whose links need no distinct over all rows, the others); unusual keys too many to broadcast are all rows'."""
    if unusual.isEmpty():
        return df, None
    if not fits(unusual):
        return None, df
    marked = df.join(F.broadcast(unusual.withColumn("__more", F.lit(True))), F.xxhash64(key) == F.col("__h"), "left")
    return marked.where("__more is null").drop("__h", "__more"), marked.where("__more").drop("__h", "__more")


def link_all(df: DataFrame, key: str, entities: dict[str, list[str]], dictionaries: dict[str, tuple[DataFrame, DataFrame]], unusual: DataFrame) -> dict[str, DataFrame]:
    """Distinct ``key, target`` of several entity types.

    Values are matched once, as in ``harmonize_all``. Where a key stands in one row, its links meet within that
    row, value by value, so only unusual keys take a distinct over all rows. Matches that may be broadcast move
    no rows; others move a row's key once per plain column, or the list values that pass a bitmap of the matches.
    """
    asked = tagged_values(df, key, entities).select("kind", "query").distinct()
    index = union_all([name_index(*dictionaries[k], k) for k in entities])
    found = match_keyed(asked, index, {k: DEFAULT_TYPES[k] for k in entities}).groupBy("kind", "query").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    found = materialize(found, "matches")
    size = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.sum(row_bytes(["query", "targets"])).alias("n")).collect()}
    alone, rest = by_keys(df, key, unusual)
    out = {}
    for kind, cols in entities.items():
        known, broadcast = found.where(F.col("kind") == kind).drop("kind"), size.get(kind, 0) <= BROADCAST_BYTES
        parts = [] if alone is None else [_links_in_rows(alone, key, cols, known, broadcast)]
        parts += [] if rest is None else [_links_over_rows(rest, key, cols, known, broadcast)]
        out[kind] = union_all(parts)
    return out


def _links_over_rows(df: DataFrame, key: str, cols: list[str], known: DataFrame, broadcast: bool) -> DataFrame:
    values = tagged_values(df, key, {"": cols}).select(key, "query")
    if broadcast:
        met = values.join(F.broadcast(known), "query")
    else:
        met = may_be_in(values, ["query"], *key_filter(known, ["query"])).join(known.hint("shuffle_hash"), "query")
    return met.select(key, F.explode("targets").alias("target")).distinct()


def _links_in_rows(df: DataFrame, key: str, cols: list[str], known: DataFrame, broadcast: bool) -> DataFrame:
    is_list = {f.name: f.dataType.typeName() == "array" for f in df.schema}
    places = [x.cast("string") for c in cols for x in ([F.get(c, F.lit(i)) for i in range(PLACES)] if is_list[c] else [F.col(c)])]
    if not broadcast and len(places) > 2:
        return _links_over_rows(df, key, cols, known, broadcast)
    row = df.select(key, *[x.alias(f"__q{i}") for i, x in enumerate(places)])
    for i in range(len(places)):
        side = known.select(F.col("query").alias(f"__q{i}"), F.col("targets").alias(f"__t{i}"))
        row = row.join(F.broadcast(side) if broadcast else side.hint("shuffle_hash"), f"__q{i}", "left" if len(places) > 1 else "inner").drop(f"__q{i}")
    none = F.array().cast("array<string>")
    targets = F.array_distinct(F.concat(*[F.coalesce(f"__t{i}", none) for i in range(len(places))])) if len(places) > 1 else F.col("__t0")
    return row.select(key, F.explode(targets).alias("target"))


def split_harmonized(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("harmonized"), df.where("not harmonized")


def dedupe_links(df: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """One link per row and target."""
    return df.select(key, *targets).dropDuplicates([key, *targets])


def sort_links(df: DataFrame, key: str, targets: list[str]) -> DataFrame:
    return df.orderBy(key, *targets)


def lookup(queries: DataFrame, names: DataFrame, ids: DataFrame, entities: DataFrame, types: Iterable[str] = ("direct", "exact")) -> DataFrame:
    """Ad-hoc batch lookup joined to the entities ``(id, target)``; every distinct query is kept."""
    found = match_cascade(queries, names, ids, types)
    asked = queries.select("query").where("query is not null").distinct()
    return asked.join(found, "query", "left").join(small(entities), "target", "left").select("query", F.coalesce("match_type", F.lit("none")).alias("match_type"), "matched_name", "target", F.col("id").alias("entity_id"))


# ---- assessment ----------------------------------------------------------------------------------


def assess(df: DataFrame, found: str = "found", expected: str = "expected") -> DataFrame:
    """TP / FP / FN / TN per query from the found ids (a list) and the expected id."""
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    label = F.when(F.col(expected).isNull(), F.when(some, "FP").otherwise("TN")).when(F.coalesce(F.array_contains(F.col(found), F.col(expected)), F.lit(False)), "TP").when(~some, "FN").otherwise("FP")
    return df.withColumn("label", label)


def evaluate(df: DataFrame, found: str = "found", expected: str = "expected") -> DataFrame:
    """Is any of the expected ids among the found ones?"""
    return df.withColumn("correct", F.coalesce(F.arrays_overlap(found, expected), F.lit(False)))


def match_report(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: match type (or ``none``), edit distance, names and ids."""
    each = found.groupBy("query").agg(F.first("match_type").alias("match_type"), F.min("distance").alias("distance"), F.array_join(F.array_sort(F.collect_set("matched_name")), ";").alias("names"), F.array_join(F.array_sort(F.collect_set("target")), ";").alias("targets"))
    return queries.select("query").distinct().join(each, "query", "left").select("query", F.coalesce("match_type", F.lit("none")).alias("match_type"), "distance", F.coalesce("names", F.lit("")).alias("names"), F.coalesce("targets", F.lit("")).alias("targets"))
