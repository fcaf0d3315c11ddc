"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is a stream of blocks of ``block`` rows. With integer share a out of ``resolution`` slots,
block j of a stream (from 0) is released at slot floor(j * resolution / a) and due before slot
ceil((j + 1) * resolution / a). In each slot the released block with the earliest deadline goes next.
Shares add up to the resolution, so the schedule repeats after ``resolution`` slots and holds every
release and deadline: after any number of slots a stream is less than one block from its target.
One period is therefore all that has to be scheduled, by a fold over the parameters alone; its size
never depends on the data. Rows get their slot by arithmetic from their rank in the stream.

Ranks come from the order of ``md5(seed, id)``: the hash range is cut into buckets of about
``bucket_rows`` rows, buckets are counted, and each bucket is numbered from its offset, so that a
source with a third of all rows is spread over many tasks.

Defined results: every row is kept. A source without a weight, a null source included, belongs to the
stream of the ``rest`` share. A stream that has run out leaves its slots empty; the order of the other
streams stays. Rows equal in id and text get neighbouring places in any order; a null id counts as
empty text. An empty table gives no rows.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8
RESOLUTION = 1000
BUCKET_ROWS = 2_000
#: Production weights: the largest source is held to a tenth, the others follow a fixed ladder.
WEIGHTS = {"src0": 0.10, **{f"src{i}": 0.03 + 0.01 * (i % 3) for i in range(1, 20)}}
REST = 0.05


def shares(weights: dict[str, float], rest: float, resolution: int = RESOLUTION) -> list[int]:
    """Integer slots per stream by largest remainder, at least one each; the last is the rest's."""
    wanted = [*weights.values(), rest]
    if any(w <= 0 for w in wanted) or len(wanted) > resolution:
        raise ValueError("weights must be positive and no more than the resolution")
    exact = [w * (resolution - len(wanted)) / sum(wanted) for w in wanted]
    out = [1 + floor(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (floor(exact[i]) - exact[i], i))[: resolution - sum(out)]:
        out[i] += 1
    return out


def period(spark, share: list[int]) -> DataFrame:
    """One period of the schedule: ``stream, nth, slot, release, deadline``."""
    total, given = sum(share), f"array({', '.join(f'{a}L' for a in share)})"
    pick = f"array_min(transform(s.done, (d, i) -> named_struct('due', if(d * {total} div given[i] <= t, ((d + 1) * {total} + given[i] - 1) div given[i], {10 * total}L), 'i', i))).i"
    fold = f"aggregate(sequence(0L, {total - 1}L), named_struct('done', transform(given, a -> 0L), 'plan', cast(array() as array<int>)), (s, t) -> named_struct('done', transform(s.done, (d, i) -> if(i = {pick}, d + 1, d)), 'plan', concat(s.plan, array({pick}))), s -> s.plan)"
    plan = spark.range(1).select(F.expr(given).alias("given")).selectExpr("given", f"{fold} as plan")
    slots = plan.selectExpr("given", "posexplode(plan) as (slot, stream)").withColumn("nth", F.row_number().over(Window.partitionBy("stream").orderBy("slot")) - 1)
    return slots.selectExpr("stream", "cast(nth as long) nth", "cast(slot as long) slot", f"nth * {total} div given[stream] as release", f"((nth + 1) * {total} + given[stream] - 1) div given[stream] as deadline", "given[stream] as share")


def mix_sources(
    df: DataFrame, weights: dict[str, float] | None = None, rest: float = REST, id_col: str = "doc_id", source_col: str = "source",
    block: int = BLOCK, resolution: int = RESOLUTION, bucket_rows: int = BUCKET_ROWS, seed: str = "mix", rows: int | None = None,
) -> DataFrame:
    """All rows as struct ``row`` with ``stream, block_no, release, deadline, mix_slot, in_block``.

    Ordered by (mix_slot, in_block) the rows follow the target weights. ``rows``: the row count, if known.
    """
    spark, weights = df.sparkSession, weights or WEIGHTS
    share = shares(weights, rest, resolution)
    n = df.count() if rows is None else rows
    buckets = max(1, -(-n // bucket_rows))
    by_name = F.create_map(*[F.lit(x) for i, s in enumerate(weights) for x in (s, i)])
    hashed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.try_element_at(by_name, F.coalesce(F.col(f"`{source_col}`"), F.lit(""))), F.lit(len(weights))).alias("stream"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary")).alias("h"),
        F.col(f"`{id_col}`").alias("__id"),
    ).withColumn("bucket", F.expr(f"cast(conv(substr(h, 1, 8), 16, 10) as long) * {buckets} div 4294967296"))
    sizes = hashed.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stream", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    local = Window.partitionBy("stream", "bucket").orderBy("h", "__id")
    ranked = hashed.withColumn("nth_in_bucket", F.row_number().over(local) - 1).join(offsets.hint("merge"), ["stream", "bucket"]).withColumn("rank", F.col("offset") + F.col("nth_in_bucket"))
    slots = F.broadcast(period(spark, share))  # exactly ``resolution`` rows
    placed = ranked.withColumn("block_no", F.expr(f"rank div {block}")).withColumn("share", F.element_at(F.array(*[F.lit(a).cast("long") for a in share]), F.col("stream") + 1))
    placed = placed.withColumn("nth", F.expr("block_no % share")).join(slots.drop("share"), ["stream", "nth"])
    turn = F.expr(f"(block_no div share) * {resolution}")
    return placed.select("row", "stream", "block_no", (F.col("release") + turn).alias("release"), (F.col("deadline") + turn).alias("deadline"), (F.col("slot") + turn).alias("mix_slot"), F.expr(f"cast(rank % {block} as int)").alias("in_block"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("row.doc_id", "row.source", "block_no", "release", "deadline", "mix_slot", "in_block")


def oracle() -> str:
    share = shares(WEIGHTS, REST)
    named = ", ".join(f"('{s}', {i})" for i, s in enumerate(WEIGHTS))
    given = ", ".join(f"({i}, {a}::BIGINT)" for i, a in enumerate(share))
    n, last = RESOLUTION, len(WEIGHTS)
    return f"""
WITH RECURSIVE names(source, stream) AS (VALUES {named}), given(stream, share) AS (VALUES {given}),
jobs AS (SELECT stream, share, j AS nth, j * {n} // share AS release, ((j + 1) * {n} + share - 1) // share AS deadline
         FROM given, LATERAL (SELECT unnest(range(share)) AS j)),
edf AS (SELECT -1::BIGINT AS slot, -1 AS stream, list_transform(range({len(share)}), lambda x: 0::BIGINT) AS done
        UNION ALL
        SELECT slot + 1, pick, list_transform(done, lambda d, i: CASE WHEN i - 1 = pick THEN d + 1 ELSE d END)
        FROM (SELECT e.slot, e.done,
                     (SELECT arg_min(j.stream, (j.deadline, j.stream)) FROM jobs j
                      WHERE j.nth = e.done[j.stream + 1] AND j.release <= e.slot + 1) AS pick
              FROM edf e WHERE e.slot < {n - 1})),
slots AS (SELECT slot, stream, row_number() OVER (PARTITION BY stream ORDER BY slot) - 1 AS nth FROM edf WHERE slot >= 0),
ranked AS (SELECT doc_id, d.source, coalesce(stream, {last}) AS stream,
                  row_number() OVER (PARTITION BY coalesce(stream, {last}) ORDER BY md5('mix' || doc_id::VARCHAR), doc_id) - 1 AS rank
           FROM documents d LEFT JOIN names USING (source))
SELECT doc_id, r.source, rank // {BLOCK} AS block_no, j.release + (rank // {BLOCK} // share) * {n} AS release,
       j.deadline + (rank // {BLOCK} // share) * {n} AS deadline, slot + (rank // {BLOCK} // share) * {n} AS mix_slot,
       (rank % {BLOCK})::INT AS in_block
FROM ranked r JOIN jobs j ON j.stream = r.stream AND j.nth = (rank // {BLOCK}) % j.share
JOIN slots s ON s.stream = j.stream AND s.nth = j.nth
"""
