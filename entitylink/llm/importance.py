"""Importance resampling towards a target distribution, by hashed word n-grams.

Features are runs of one to three words, hashed to a fixed number of buckets. One pass over the corpus
and one over the target count the buckets; the gains, one number per bucket, are the only thing that is
broadcast (``BUCKETS`` numbers, whatever the input). A second pass scores each document by looking its
buckets up in the array of gains, adds Gumbel noise drawn from the id, and writes the scores. The lowest
score that is drawn is then found by bisection: each exact count job over the written scores settles
``HALVINGS`` halvings of the interval, and so for the largest id among the documents tied there. The drawn
rows alone are range-partitioned and ranked.

Defined results: a null text has no words; a null id counts as the empty string in the noise and comes
before every other id among ties; rows that share score and id are ranked by their number of features, and
each takes a rank. With no target text every gain follows from the corpus alone; an empty corpus gives no
rows. Other columns take no part, whatever their names. A text is taken in pieces of ``PIECE`` bytes with
the last words carried over, so a very long one needs no more memory than others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm.common import slices, trimmed
from entitylink.operators.row_ids import row_ids

BUCKETS = 10_000
RUN = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
HALVINGS = 5
PIECE = 1 << 20
#: A-Z become lower-case; every other byte below 0x80 that is no letter or digit becomes a space.
PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

# ---- crc32 of joined words, from the words' own ---------------------------------------------------

_BYTES = np.arange(256, dtype=np.uint32)
SHORT = 64


def _zero_byte(x: np.ndarray) -> np.ndarray:
    return _LINEAR[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _linear_step() -> np.ndarray:
    """The register after one byte of value 0, from the register's low byte: the table of the polynomial, by its rule."""
    out = _BYTES.copy()
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1)).astype(np.uint32)
    return out


_LINEAR = _linear_step()


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & np.uint32(255)] ^ table[1][(x >> np.uint32(8)) & np.uint32(255)] ^ table[2][(x >> np.uint32(16)) & np.uint32(255)] ^ table[3][x >> np.uint32(24)]


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """Table (4 x 256) of what n zero bytes do to a register, by its four bytes."""
    if n == 0:
        return np.stack([_BYTES << np.uint32(8 * k) for k in range(4)])
    half = _shift(n // 2)
    twice = np.stack([_apply(half, half[k]) for k in range(4)])
    return np.stack([_zero_byte(twice[k]) for k in range(4)]) if n % 2 else twice


_SHORT = np.stack([_shift(n) for n in range(SHORT + 1)])


def join_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings one after the other, from their own and the length of the second."""
    near, low = np.minimum(length, SHORT), np.uint32(255)
    out = _SHORT[near, 0, first & low] ^ _SHORT[near, 1, (first >> np.uint32(8)) & low] ^ _SHORT[near, 2, (first >> np.uint32(16)) & low] ^ _SHORT[near, 3, first >> np.uint32(24)]
    for n in np.unique(length[length > SHORT]).tolist():
        at = length == n
        out[at] = _apply(_shift(n), first[at])
    return out ^ second


def _with_space(crc: np.ndarray) -> np.ndarray:
    """crc32 after one more byte, a space."""
    raw = ~crc
    return ~(_LINEAR[(raw ^ np.uint32(32)) & np.uint32(255)] ^ (raw >> np.uint32(8)))


# ---- buckets of texts -----------------------------------------------------------------------------


def pieces(text: str | None, size: int = PIECE) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in pieces, and how many of each piece's words were counted with the one before."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    carry: list[bytes] = []
    at = 0
    while at < len(data) or not at:
        end = at + size
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        words = data[at:end].split()
        yield carry + words, len(carry)
        carry = (carry + words)[1 - RUN :]
        at = end + 1


def runs(parts: list[tuple[list[bytes], int]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and place of its part, of every run of words that a part adds."""
    words = [w for part, _ in parts for w in part]
    sizes = np.fromiter((len(p) for p, _ in parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    done = np.repeat(np.fromiter((c for _, c in parts), np.int64, len(parts)), sizes)
    length = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(crc32, words), np.uint32, len(words))
    run, of, to = word, [], []
    for n in range(RUN):
        if n:
            run = join_crc(_with_space(run[:-1]), word[n:], length[n:])
        last = len(words) - n  # runs of n + 1 words start before this
        if last <= 0:
            break
        new = (owner[:last] == owner[n:]) & (place[n:] >= done[n:])
        of.append(run[new] % np.uint32(buckets))
        to.append(owner[:last][new])
    return (np.concatenate(of).astype(np.int64), np.concatenate(to)) if of else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(column: pa.Array) -> Iterator[tuple[list[int], list[tuple[list[bytes], int]]]]:
    """Pieces of a column of texts, about ``PIECE`` bytes at a time, with the row of each."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(column):
        for part in pieces(text.as_py()):
            rows.append(i)
            parts.append(part)
            size += sum(map(len, part[0]))
            if size >= PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over all texts; each task sends one number per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, 500):
            for _, parts in _blocks(b.column(0)):
                total += np.bincount(runs(parts, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(trimmed(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of how much likelier the target is), from smoothed counts."""
    all_corpus, all_target, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    odds = (target + 1.0) * (all_corpus + float(buckets)) / ((corpus + 1.0) * (all_target + float(buckets)))
    return np.array([math.floor(1000 * math.log(x)) for x in odds.tolist()], np.int64)


def score_weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` of every document."""
    sent = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = sent.value
        for b in slices(batches, 500):
            n, words, features, weight = b.num_rows, *np.zeros((3, b.num_rows), np.int64)
            for rows, parts in _blocks(b.column("text")):
                rows = np.array(rows)
                bucket, part = runs(parts, len(gain))
                words += np.bincount(rows, [len(p) - c for p, c in parts], n).astype(np.int64)
                features += np.bincount(rows[part], minlength=n)
                weight += np.bincount(rows[part], gain[bucket], n).astype(np.int64)  # exact below 2**53
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(words), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) that depends on the seed and the id only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def bisect(df: DataFrame, col: str, most: int, halvings: int = HALVINGS) -> int | None:
    """The smallest value v such that at least ``most`` rows have ``col <= v``, by exact counts; None if there are too few."""
    edge = df.agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count(col).alias("n")).first()
    if most <= 0 or edge["n"] < most:
        return None
    low, high = edge["low"], edge["high"]  # the answer is from low to high
    while low < high:
        gap = high - low
        cuts = sorted({low + gap * i // 2**halvings for i in range(1, 2**halvings)} - {high}) or [low]
        counts = df.agg(*[F.count_if(F.col(col) <= c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        reached = next((i for i, n in enumerate(counts) if n >= most), len(cuts))
        low, high = (cuts[reached - 1] + 1 if reached else low), (cuts[reached] if reached < len(cuts) else high)
    return low


def draw(scored: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` to the k rows of highest ``score``, ties to the smaller id; ``scored`` is a written table.

    Only rows with ``able`` can be drawn.
    """
    # the smallest id stands for none: where both occur, the null comes first by the order below
    keyed = scored.withColumn("__down", -F.col("score")).withColumn("__id", F.coalesce("id", F.lit(-(2**63))))
    able = keyed.where("able")
    cut = bisect(able, "__down", k)
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    left = k - able.where(F.col("__down") < cut).count()
    last = bisect(able.where(F.col("__down") == cut), "__id", left)
    inside = F.col("able") & ((F.col("__down") < cut) | ((F.col("__down") == cut) & (F.col("__id") <= last)))
    order = ["__down", F.col("id").asc_nulls_first(), "n_features", "nth"]
    drawn = row_ids(keyed.where(inside).withColumn("__none", F.col("id").isNotNull().cast("int")), "rank", [order[0], "__none", "__id", *order[2:]])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = keyed.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null unless drawn."""
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_text, buckets))
    scored = score_weights(df, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = materialize(scored.withColumns({"able": F.col("n_words") >= least_words, "nth": F.monotonically_increasing_id()}), "scores")
    return draw(scored, percent * scored.where("able").count() // 100).drop("able", "nth")


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = resample(read("documents").select("doc_id", "text"), read("benchmark").select("text"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"

#: crc32 bit by bit gives the table of a byte; the bytes of a feature are folded with it.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS tab FROM range(256) r(b)),
df AS (SELECT nth, {_RUNS} AS f FROM d), bf AS (SELECT {_RUNS} AS f FROM b),
x AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(rtrim(regexp_replace(hex(encode(f)), '(..)', '\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT)),
      lambda c, y: xor(c >> 8, tab[1 + (xor(c, y) & 255)]))) % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
s AS (SELECT bucket, count(*) AS n FROM df JOIN x USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bf JOIN x USING (f) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT nth, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN x USING (f) JOIN g USING (bucket) GROUP BY nth),
r AS (SELECT nth, doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (nth)),
o AS (SELECT nth, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM r LEFT JOIN o USING (nth)
"""
