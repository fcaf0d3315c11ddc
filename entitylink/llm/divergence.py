"""Audit of how the sources of a language differ, by their terms.

Tasks count terms per language and source before anything is shuffled; the sums are written once. A
language keeps the terms that enough of its documents hold. Every group (language and source) and every
language gives each kept term a smoothed whole-number probability, and two of these have a divergence.

*Terms of a group* (the ten that set it apart most) come from a dominance skyband: a term that at least k
others dominate, with a higher count in the group, a lower one in the language and an earlier place in
UTF-8, cannot be among the k best, because the value never falls with the group's count, never rises with
the language's, and ties go to the earlier term. Each partition keeps its skyband per group, skybands are
merged by parts of the terms, and only what is left is ranked.

*Pairs of sources* are compared over all kept terms. Sources are dealt to tiles of ``TILE``; a term's
counts meet as a short vector per pair of tiles, and tasks add up whole tiles of sums. Terms that neither
tile holds all have the same value, so they are counted and not visited. Sums are exact integers.

Defined results: null text, language or source count as empty strings; each row is a document, also where
ids repeat; a group without terms has pairs and no terms; a language without kept terms has pairs of
value 0; a lone source has no pairs; an empty table gives no rows. Other columns take no part, whatever
their names. Texts are taken whole, in pieces; the different terms of one text are held at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm.common import slices, trimmed

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000  # fixed by the contract
TILE = 256
PIECE = 1 << 20
HELD = 200_000  # counted terms that a task holds before it hands them on
BUCKET_TERMS = 50_000  # terms of a tile pair for one task, on average
SMALL = 50_000  # rows of a counted table that may be broadcast
SPREAD = 16  # parts in which a group's skybands are merged
#: A-Z become lower-case; other bytes below 0x80 that are no letters become spaces.
LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in bytes(range(256)).lower())


def _words(text: str | None) -> Iterator[list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` added up over a task, in parts of bounded size."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            rows = len(terms)
            columns = [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for b in slices(batches, 200):
        for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text")), strict=True):
            n, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _words(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from out()
    yield from out()


# ---- skybands -------------------------------------------------------------------------------------


def skyband(high: np.ndarray, low: np.ndarray, term: np.ndarray, k: int = TOP, step: int = 512) -> np.ndarray:
    """Places of the rows that fewer than k others dominate: as high, as low and of an earlier term.

    It is enough to look at rows that stay themselves, in order of the terms.
    """
    order = np.argsort(term, kind="stable")
    high, low, kept = high[order], low[order], np.zeros(0, np.int64)
    for a in range(0, len(order), step):
        new = np.arange(a, min(a + step, len(order)))
        by = ((high[kept] >= high[new, None]) & (low[kept] <= low[new, None])).sum(1)
        new = new[by < k]
        inside = np.tril((high[new] >= high[new, None]) & (low[new] <= low[new, None]), -1)
        by = by[by < k] + inside.sum(1)  # all earlier rows count, staying or not: k of them are enough
        kept = np.concatenate([kept, new[by < k]])
    return order[kept]


def skybands(k: int, held: int = HELD):
    """A function on batches of ``lang, source, term, n, total`` that keeps each group's skyband of what it has read."""

    def reduced(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        key = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
        code = key[0].indices.to_numpy().astype(np.int64) * len(key[1].dictionary) + key[1].indices.to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        n, total = table.column("n").to_numpy(), table.column("total").to_numpy()
        terms = np.array(table.column("term").cast(pa.binary()).to_pylist(), object)
        stay = [rows[skyband(n[rows], total[rows], terms[rows], k)] for rows in np.split(order, cuts)]
        return table.take(pa.array(np.sort(np.concatenate(stay))))

    def run(batches):
        kept, new, rows = None, [], 0
        for b in batches:
            new.append(b)
            rows += b.num_rows
            if rows >= held:
                kept = reduced(pa.concat_tables([*([kept] if kept is not None else []), pa.Table.from_batches(new)]))
                new, rows = [], 0
                if kept.num_rows > held:  # many groups: hand them on, they meet again
                    yield from kept.to_batches(10_000)
                    kept = None
        if new:
            kept = reduced(pa.concat_tables([*([kept] if kept is not None else []), pa.Table.from_batches(new)]))
        if kept is not None:
            yield from kept.to_batches(10_000)

    return run


# ---- arithmetic -----------------------------------------------------------------------------------


def share(count: str, every: str, terms: str = "n_terms") -> Column:
    """1 + floor(UNIT * (count + 2) / (every + 2 * terms)), exact for counts below 2**62; needs a term."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20, 0)) * cast({UNIT} as decimal(10, 0))) div cast({every} + 2 * {terms} as decimal(20, 0))")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most UNIT + 1, so all of it fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


# ---- pairs of sources -----------------------------------------------------------------------------


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of divergences over the terms of one pair of tiles after the other: ``lang, ta, tb, i, j, total, seen``.

    A part begins with the shares of a term that no source holds (``first``); slots from ``TILE`` on are
    sources of the second tile.
    """
    now, base, total, seen, split = None, None, None, 0, 0

    def out():
        i, j = np.indices(total.shape).reshape(2, -1)
        rows = len(i)
        columns = [pa.array([now[0]] * rows, pa.string()), pa.array(np.full(rows, now[1], np.int32)), pa.array(np.full(rows, now[2], np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(rows, seen))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "ta", "tb", "i", "j", "total", "seen"])

    for b in slices(batches, 512):
        key = list(zip(*(b.column(c).to_pylist() for c in ("lang", "ta", "tb")), strict=True))
        first = b.column("first").to_numpy(zero_copy_only=False)
        held = b.column("held")
        cuts = held.offsets.to_numpy() - held.offsets[0].as_py()
        flat = held.flatten()
        slot, p = flat.field("slot").to_numpy().astype(np.int64), flat.field("p").to_numpy()
        # a part's first row starts it; the terms after it form one block
        starts = sorted({0, b.num_rows, *np.flatnonzero(first).tolist(), *(np.flatnonzero(first) + 1).tolist()})
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            mine, share_of = slot[cuts[x] : cuts[y]], p[cuts[x] : cuts[y]]
            if first[x]:
                if key[x] != now:
                    if now is not None:
                        yield from out()
                    now, seen = key[x], 0
                    split = int((mine < TILE).sum())
                    second = len(mine) - split if now[1] != now[2] else split
                    total = np.zeros((split, second), np.int64)
                base = np.zeros(len(mine), np.int64)
                base[np.where(mine < TILE, mine, mine - TILE + split)] = share_of
                continue
            block = np.tile(base, (y - x, 1))
            block[np.repeat(np.arange(y - x), np.diff(cuts[x : y + 1])), np.where(mine < TILE, mine, mine - TILE + split)] = share_of
            one, two = block[:, :split], block[:, split:] if now[1] != now[2] else block
            for i in range(split):
                gap = one[:, i : i + 1] - two
                total[i] += (gap * gap // (one[:, i : i + 1] + two)).sum(0)
            seen += y - x
    if now is not None:
        yield from out()


def _pair_sums(rows: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """``lang, one, two, total, seen`` for places ``one`` and ``two`` of two sources: summed over the ``seen`` terms that their tiles hold."""
    tiles = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_sources - 1) div {TILE} as int)"))).alias("other")
    tile, slot = F.expr(f"cast(place div {TILE} as int)"), F.expr(f"cast(place % {TILE} as int)")
    both = lambda df, *cols: df.select("lang", *cols, tile.alias("tile"), slot.alias("slot"), "p", tiles).select("lang", *cols, F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.struct((F.col("slot") + F.when(F.col("tile") > F.col("other"), TILE).otherwise(0)).alias("slot"), "p").alias("held"))
    terms = both(rows, "term").groupBy("lang", "ta", "tb", "term").agg(F.collect_list("held").alias("held"))
    terms = terms.select("lang", "ta", "tb", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("first"), "held")
    base = both(groups.withColumn("p", F.col("base"))).groupBy("lang", "ta", "tb").agg(F.collect_list("held").alias("held"))
    base = base.select("lang", "ta", "tb", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(True).alias("first"), "held")
    dealt = terms.unionByName(base).repartition("lang", "ta", "tb", "bucket").sortWithinPartitions("lang", "ta", "tb", "bucket", F.desc("first"))
    sums = dealt.mapInArrow(trimmed(tile_sums), "lang string, ta int, tb int, i int, j int, total long, seen long")
    sums = sums.select("lang", (F.col("ta") * TILE + F.col("i")).alias("one"), (F.col("tb") * TILE + F.col("j")).alias("two"), "total", "seen").where("one < two")
    return sums.groupBy("lang", "one", "two").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))


# ---- the audit ------------------------------------------------------------------------------------


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: the terms and the other sources of every group."""
    clean = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    given = df.select(clean(lang_col, "lang"), clean(source_col, "source"), F.col(f"`{text_col}`").alias("text"))
    counted = given.mapInArrow(trimmed(count_terms), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "term-counts")
    kept = materialize(counted.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    rows = materialize(counted.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_lang"))
    in_lang = Window.partitionBy("lang")
    groups = given.select("lang", "source").distinct().join(rows.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({"n_group": F.coalesce("n_group", F.lit(0)), "n_terms": F.coalesce("n_terms", F.lit(0)), "place": F.row_number().over(in_lang.orderBy("source")) - 1, "n_sources": F.count(F.lit(1)).over(in_lang)})
    groups = groups.withColumn("base", F.when(F.col("n_terms") > 0, share("0", "n_group")))
    groups = materialize(groups, "groups")
    held = F.broadcast(groups) if groups.count() <= SMALL else groups
    shares = rows.join(held.drop("base"), ["lang", "source"]).withColumn("p", share("n", "n_group"))

    # terms: only those above the language's share can be listed, and the same holds for what dominates them
    above = shares.withColumn("q", share("total", "n_lang")).where("p > q").select("lang", "source", "term", "n", "total", "p", "q")
    band = above.schema
    local = above.mapInArrow(trimmed(skybands(top)), band)
    merged = local.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SPREAD))).mapInArrow(trimmed(skybands(top)), band)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = merged.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    sums = _pair_sums(shares, groups.where("n_terms > 0"), max(SPREAD, rows.count() // BUCKET_TERMS))
    side = lambda s: groups.select("lang", F.col("source").alias(f"source{s}"), F.col("place").alias(f"place{s}"), F.col("base").alias(f"base{s}"), *(["n_terms"] if s == 1 else []))
    pairs = side(1).join(side(2), "lang").where("place1 <> place2").withColumns({"one": F.least("place1", "place2"), "two": F.greatest("place1", "place2")})
    pairs = pairs.join(sums, ["lang", "one", "two"], "left")
    rest = (F.col("n_terms") - F.coalesce("seen", F.lit(0))) * divergence("base1", "base2")
    pairs = pairs.select("lang", F.col("source1").alias("source"), F.lit("pair").alias("part"), F.col("source2").alias("item"), F.coalesce(F.coalesce("total", F.lit(0)) + rest, F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT nth, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT nth) >= 10),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * v.v))::BIGINT AS p,
      (1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v))::BIGINT AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM f WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
