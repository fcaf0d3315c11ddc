"""Exact top-k by integer inner product with block-at-a-time pruning.

Candidates are dealt evenly and written once; from then on they stay where they are stored. Queries travel:
groups of bounded size are broadcast one after the other and meet all candidates in one pass over the stored
rows, without a shuffle. A task takes its candidates in shards, a shard is cut into blocks of ``BLOCK``
vectors in id order; a block's forward index is its matrix, its term maxima are the largest and smallest
component per dimension. For each query the blocks are visited by decreasing bound, the sum over dimensions
of the query component times the maximum (or minimum, if negative), and a query stops at the first bound
below its k-th score. That score is carried from shard to shard, and begins with the one that the group has
in a first shard of its own, so most blocks are never scored. Each task returns k rows a query at most; the k
best of these are the exact result.

Defined results: rows with a null id or vector, or with null or non-finite components, take no part. A
shorter vector counts as padded with zeros. Equal queries (same id and vector) are one query; repeated
candidates each take a place; rows with the query's id are never its candidates. Ties go to the smaller id.
An empty table gives no rows. Scores are exact up to 2**42 in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize

K = 20
SCALE = 64
QUERY_GROUP = 16_384
SHARD = 32_768
COMPONENTS = 4_000_000  # of the vectors of one group or shard, at most
BLOCK = 256
_SHIFT = 20


def integer_vector(col: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component; null unless all components are finite numbers."""
    limit = F.lit(float("inf"))
    good = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.when(good, F.transform(col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(rows), dims))
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.values.to_numpy()[rows.offsets[0].as_py() : rows.offsets[-1].as_py()]
    if len(sizes):
        at = np.repeat(np.arange(len(sizes)), sizes)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


NONE = np.iinfo(np.int64).min


def prune_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each query row its best k candidates: (query row, candidate id, score). ``ids`` must be sorted.

    ``floor``: a score per query below which no candidate is wanted.
    """
    n, nq = len(ids), len(q_ids)
    if n >= 1 << _SHIFT:
        raise ValueError("too many rows for one shard")
    floor = np.full(nq, NONE) if floor is None else floor
    cuts = [(a, min(n, a + block)) for a in range(0, n, block)]
    high, low = np.stack([x[a:b].max(0) for a, b in cuts]), np.stack([x[a:b].min(0) for a, b in cuts])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((nq, k), NONE)  # score << shift, minus the place in the shard: larger is better
    active = np.arange(nq)
    for turn in range(len(cuts)):
        kth = best[active].min(1)
        here = order[active, turn]
        go = ((kth == NONE) | (bound[active, here] >= ((kth + (1 << _SHIFT) - 1) >> _SHIFT))) & (bound[active, here] >= floor[active])
        active, here = active[go], here[go]
        for blk in np.unique(here):
            rows, (a, b) = active[here == blk], cuts[blk]
            score = (q[rows] @ x[a:b].T).astype(np.int64)
            key = (score << _SHIFT) - np.arange(a, b)
            key[q_ids[rows][:, None] == ids[a:b][None, :]] = NONE
            both = np.concatenate([best[rows], key], axis=1)
            best[rows] = -np.partition(-np.maximum(both, NONE + 1), k - 1, axis=1)[:, :k] if both.shape[1] > k else both
        if not len(active):
            break
    row, col = np.nonzero(best > NONE + 1)
    key = best[row, col]
    score = (key + (1 << _SHIFT) - 1) >> _SHIFT
    wanted = score >= floor[row]
    return row[wanted], ids[((score << _SHIFT) - key)[wanted]], score[wanted]


def best_of(row: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query row: by score, then by smaller id."""
    order = np.lexsort((found, -score, row))
    first = np.flatnonzero(np.concatenate([np.full(min(1, len(row)), True), np.diff(row[order]) != 0]))
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
    return order[place < k]


def _search(sent: Broadcast, k: int, shard: int, dims: int):
    """Candidates ``id, v`` -> each query's best among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, floor = sent.value
        floor, kept = floor.copy(), tuple(np.zeros(0, np.int64) for _ in range(3))
        for table in shards_of(batches, shard):
            ids = table.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            found = prune_top_k(q_ids, q, ids[order], _matrix(table.column("v"), dims)[order], k, floor=floor)
            both = tuple(np.concatenate(x) for x in zip(kept, found, strict=True))
            stay = best_of(*both, k)
            kept = tuple(c[stay] for c in both)
            full = np.bincount(kept[0], minlength=len(q_ids)) == k
            least = np.full(len(q_ids), np.iinfo(np.int64).max)
            np.minimum.at(least, kept[0], kept[2])
            floor[full] = np.maximum(floor[full], least[full])
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2]), pa.array(kept[0])], names=["query_id", "vec_id", "score", "place"])

    return run


def shards_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at most so many rows."""
    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            if n + part.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, group: int | None = None, shard: int | None = None) -> DataFrame:
    """Each query's k best other rows: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vec_col), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    rows = materialize(rows, "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dims = size["d"] or 1
    few = lambda most: max(BLOCK, min(most, COMPONENTS // dims))
    shard, group = few(shard or SHARD), few(group or QUERY_GROUP)
    tasks = max(1, -(-size["n"] // shard), min(spark.sparkContext.defaultParallelism, size["n"] // (8 * BLOCK)))
    stored = materialize(rows.select("id", "v").repartition(tasks), "candidates")  # dealt evenly whatever the values, and only once
    asks = rows.where("asks").select("id", "v").distinct()
    groups = max(1, -(-2 * asks.count() // group)) if size["n"] else 0
    asks = materialize(asks.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")), "queries") if groups else asks
    first = materialize(stored.limit(shard), "first")  # any shard does, it only saves work
    parts, row = [], "query_id long, vec_id long, score long, place long"
    for g in range(groups):
        mine = asks.where(F.col("g") == g).select("id", "v").toArrow()  # about half of ``group`` rows
        if not mine.num_rows:
            continue
        q_ids, q = mine.column("id").to_numpy(), _matrix(mine.column("v"), dims)
        sent = spark.sparkContext.broadcast((q_ids, q, np.full(len(q_ids), NONE)))
        start = first.mapInArrow(_search(sent, k, shard, dims), row).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toArrow()
        floor = np.full(len(q_ids), NONE)
        floor[start.column("place").to_numpy()] = start.column("least").to_numpy()
        sent = spark.sparkContext.broadcast((q_ids, q, floor))
        parts.append(materialize(stored.mapInArrow(_search(sent, k, shard, dims), row), "nearest"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = reduce(DataFrame.unionByName, parts)
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
