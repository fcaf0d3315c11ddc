"""Near-duplicate documents with SetSketch registers.

A document's set is its distinct word shingles. Register i of its sketch is the smallest of exponentially
distributed hashes of the shingles, stored as a truncated exponent ``floor(1 - log_b)``: exponentially
spaced minima. Sketches merge by the larger register and two registers are equal with a probability close
to the similarity, so bands of ``ROWS`` registers find candidates. For a candidate pair the counts of
larger, smaller and equal registers give the joint maximum-likelihood estimate of the similarity; pairs
far below the threshold (``SIGMAS`` standard errors) stop there, and the others are verified on the full
shingle sets of their texts.

Documents with equal sets are one class from the start, so copies never meet in pairs. Classes that share
a band's bucket are not paired with each other: each is compared with one head of the bucket, links merge
classes into components, and buckets inside one component are done. What is left is compared by sketch, in
blocks of at most ``MEMBERS`` members, each pair in the first band that it shares; counts of shingles in
``PARTS`` parts bound the overlap of a pair from above and rule out most of those just below the threshold
for certain. Sets of more than ``LONG`` shingles also carry a bitmap of ``MARKS`` bits: the bits set in two
bitmaps together count the union, which settles pairs of long texts below about 0.75 without their texts
(again ``SIGMAS`` standard errors). Only likely pairs leave a block: first each member's best partners in other components, then, when those have merged, all
likely partners still in other components. So no candidate is left out and no group is unbounded. Components come from large-star / small-star rounds on the links.

With 50 bands of 5 registers a pair at similarity 0.8 is missed with a probability below 1e-8. Classes
are identified by their size and two 64-bit sums of shingle hashes, and numbered when they are written.

Defined results: a null or empty text (no words) has an empty set, links with nothing and stays. A text
with fewer words than a shingle has one shingle, all its words. Rows with equal id and text are copies of
each other. A null id is larger than any id: such a document stays only if nothing it links to has an id.
An empty table gives no rows. Other columns are untouched by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm import bloom
from entitylink.llm.common import Words, mix64, rolling, row_key, slices, trim
from entitylink.llm.substring_dedup import pieces
from entitylink.operators.graph import connected_components

SHINGLE = 5
THRESHOLD = 80
BANDS, ROWS = 50, 5
REGISTERS = 251  # a prime, so that steps through the registers visit each once
BASE = 1.05
LARGEST = 20.0
TOP = 2**15 - 1
SIGMAS = 6.0
PARTS = 512
FULL = 2**15 - 1  # a part's count that may be larger in truth, so that it bounds nothing
#: After the round of heads: which of a member's likely partners, by estimate, each round verifies.
WINDOWS = ((0, 2), (2, 2**40))
MEMBERS = 512
LONG = 1000
MARKS = 2**16


def shingle_sets(texts: list[str | None], words: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    w = Words(texts, lower=True)
    runs = rolling(w.hash, words)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(mix64(rolling(w.hash[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets x ``REGISTERS``); each element's hashes come in rising order."""
    m = REGISTERS
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    e = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    low = np.full((len(sets), m), np.inf, np.float32)
    flat = low.ravel()
    at, step = (e % np.uint64(m)).astype(np.int64), 1 + ((e >> np.uint64(24)) % np.uint64(m - 1)).astype(np.int64)
    x = np.zeros(len(e), np.float32)
    for j in range(m):
        u = (mix64(e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)).astype(np.float32)
        x = x - np.log((u + np.float32(0.5)) * np.float32(2.0**-24)) / np.float32(m - j)
        if j:
            go = x < low.max(1)[owner]
            e, owner, at, step, x = e[go], owner[go], at[go], step[go], x[go]
        if not len(e):
            break
        np.minimum.at(flat, owner * m + at, x)
        at = (at + step) % m
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low.astype(np.float64) / LARGEST) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.int16)


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, for an advantage of x."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Maximum-likelihood similarity from register comparisons and the set sizes (golden section)."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        return larger * np.log(up) + smaller * np.log(down) + (m - larger - smaller) * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        right = value(a) < value(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def _regs(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, REGISTERS)


def part_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many of a set's elements fall in each of ``PARTS`` parts; the smaller counts of two sets add up to at least their overlap."""
    counts = [np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=PARTS), FULL) for s in sets]
    return np.stack(counts).astype(np.int16) if sets else np.zeros((0, PARTS), np.int16)


def bitmap(elements: np.ndarray) -> bytes:
    """One bit for each element's hash modulo ``MARKS``."""
    marks = np.zeros(MARKS, np.uint8)
    marks[mix64(elements ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(MARKS - 1)] = 1
    return np.packbits(marks).tobytes()


def most_marks(n: np.ndarray, threshold: int) -> np.ndarray:
    """Bits that two sets of n elements in sum set together at most, when they are as similar as the threshold asks.

    The union then has at most ``n / (1 + threshold)`` elements; mean and variance are those of occupied cells.
    """
    load = n / (1 + threshold / 100) / MARKS
    free = np.exp(-load)
    return MARKS * (1 - free) + SIGMAS * np.sqrt(MARKS * free * np.maximum(1 - (1 + load) * free, 0))


class Scan:
    def __init__(self, words: int, threshold: int, low: int = 0, high: int = 2**40) -> None:
        self.words, self.threshold, self.low, self.high = words, threshold, low, high

    def sketch(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, k1, k2, text -> id, k1, k2, n, s1, s2, regs."""
        for b in slices(batches):
            texts = b.column(3).to_pylist()
            for i, j in pieces(texts, 1_000_000):
                sets = shingle_sets(texts[i:j], self.words)
                s1 = [int(mix64(s).sum(dtype=np.uint64)) for s in sets]
                s2 = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
                sums = [pa.array(np.array(s, np.uint64).view(np.int64)) for s in (s1, s2)]
                regs = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * REGISTERS, pa.array(registers(sets).ravel()))
                n = pa.array([len(s) for s in sets], pa.int64())
                parts = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * PARTS, pa.array(part_counts(sets).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), n, *sums, regs, parts], ["id", "k1", "k2", "n", "s1", "s2", "regs", "parts"])
        trim()

    def floor(self) -> float:
        """Estimates below this are ``SIGMAS`` standard errors under the threshold."""
        t = self.threshold / 100
        return t - SIGMAS * np.sqrt(t * (1 - t) / REGISTERS)

    def across(self, block: pa.Table) -> pa.Table:
        """Likely pairs across components in two blocks of one bucket (or inside one block)."""
        node, c, n, side, band = (block.column(x).to_numpy() for x in ("node", "c", "n", "side", "band"))
        regs, pairs = _regs(block.column("regs").combine_chunks()), []
        parts = block.column("parts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
        full = (parts == FULL).any(1) if len(parts) else np.zeros(0, bool)
        first, last = side.min(), side.max()
        right = np.flatnonzero(side == last)
        for i in np.flatnonzero(side == first):
            j = right[node[right] > node[i]] if first == last else right
            if not (c[j] != c[i]).any():
                continue
            j = j[100 * np.minimum(n[j], n[i]) >= self.threshold * np.maximum(n[j], n[i])]
            if not len(j):
                continue
            before = regs[j, : band[i] * ROWS] == regs[i, : band[i] * ROWS]
            same = ~before.reshape(len(j), band[i], ROWS).all(2).any(1)  # no earlier band is shared
            j = j[same]
            overlap = np.minimum(parts[j], parts[i]).sum(1, dtype=np.int64)  # at most this many are shared
            overlap = np.where(full[j] | full[i], np.minimum(n[j], n[i]), overlap)
            if len(j := j[100 * overlap >= self.threshold * (n[j] + n[i] - overlap)]):
                pairs.append(np.stack([np.full(len(j), i), j, (regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1)]))
        x, y, more, less = np.concatenate(pairs, 1) if pairs else np.zeros((4, 0), np.int64)
        guess = joint_estimate(n[x].astype(float), n[y].astype(float), more, less) if len(x) else np.zeros(0)
        x, y, guess = (v[guess >= self.floor()] for v in (x, y, guess))
        fits = self.fit(block.column("marks"), n, x, y)
        x, y, guess = x[fits], y[fits], guess[fits]
        order = np.lexsort((node[y], -guess, x))
        x, y = x[order], y[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)  # of a partner among all of a member's likely ones
        take = (rank >= self.low) & (rank < self.high) & (c[x] != c[y])
        a, b = node[x[take]], node[y[take]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def fit(self, column: pa.ChunkedArray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs that their bitmaps do not rule out."""
        has = ~column.is_null().to_numpy()
        place = np.cumsum(has) - 1
        marks = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint64).reshape(-1, MARKS // 64)
        out = np.ones(len(x), bool)
        both = np.flatnonzero(has[x] & has[y])
        most = most_marks((n[x] + n[y]).astype(float), self.threshold)
        for i in range(0, len(both), 1000):
            k = both[i : i + 1000]
            out[k] = np.bitwise_count(marks[place[x[k]]] | marks[place[y[k]]]).sum(1, dtype=np.int64) <= most[k]
        return out

    def mark(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, text -> node, marks."""
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for i, j in pieces(texts):
                marks = [bitmap(s) for s in shingle_sets(texts[i:j], self.words)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(marks, pa.binary())], ["node", "marks"])
        trim()

    def likely(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose estimate is not far below the threshold."""
        for b in batches:
            if b.num_rows:
                x, y = _regs(b.column("regs_a")), _regs(b.column("regs_b"))
                j = joint_estimate(b.column("n_a").to_numpy().astype(float), b.column("n_b").to_numpy().astype(float), (x > y).sum(1), (x < y).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(j >= self.floor()))

    def verify(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose full shingle sets reach the threshold."""
        for b in batches:
            ta, tb = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            good = np.zeros(len(ta), bool)
            for i, j in pieces([f"{x or ''}{y or ''}" for x, y in zip(ta, tb, strict=True)]):
                for k, x, y in zip(range(i, j), shingle_sets(ta[i:j], self.words), shingle_sets(tb[i:j], self.words), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = both > 0 and 100 * both >= self.threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good))


def _side(df: DataFrame, name: str, *cols: str) -> DataFrame:
    return df.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])


def links(sketched: DataFrame, keyed: DataFrame, scan: Scan) -> DataFrame | None:
    """Components ``(n, s1, s2, component)`` of classes with at least one link; None if there is none.

    ``sketched``: id, k1, k2, n, s1, s2, regs, parts. ``keyed``: k1, k2, text.
    """
    classes = sketched.where("n > 0").groupBy("n", "s1", "s2").agg(F.first("regs").alias("regs"), F.first("parts").alias("parts"), F.min(F.struct("k1", "k2")).alias("key"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "regs", "parts", "key.k1", "key.k2"), "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("regs", i * ROWS + 1, ROWS)))
    buckets = classes.select("node", F.posexplode(band).alias("band", "bh"))
    shared = materialize(buckets.groupBy("bh").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bh"), "buckets")
    maybe = bloom.maybe(buckets, "bh", bloom.filter_of(shared, "bh")).where("__maybe").select("bh", "band", "node")
    live = materialize(maybe.join(shared.hint("merge"), "bh"), "members")
    known = materialize(classes.join(live.select("node").distinct().hint("merge"), "node"), "sketches")
    found = bloom.maybe(keyed, "k1", bloom.filter_of(known, "k1")).where("__maybe").select("k1", "k2", "text")
    texts = materialize(found.join(known.select("node", "k1", "k2").hint("merge"), ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]), "texts")

    def likely(pairs: DataFrame) -> DataFrame:
        close = pairs.join(_side(known, "b", "n", "regs").hint("merge"), "b").join(_side(known, "a", "n", "regs").hint("merge"), "a")
        close = close.where(f"100 * least(n_a, n_b) >= {scan.threshold} * greatest(n_a, n_b)")
        return close.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(scan.likely, "a long, b long")

    def confirm(close: DataFrame) -> DataFrame:
        both = close.join(_side(texts, "b", "text").hint("merge"), "b").join(_side(texts, "a", "text").hint("merge"), "a")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(scan.verify, "a long, b long"), "links")

    edges = tested = component = marks = None
    for turn in range(1 + len(WINDOWS)):
        labelled = live.withColumn("c", F.col("node")) if component is None else live.join(component.hint("merge"), "node", "left").select("bh", "band", "node", F.coalesce("component", "node").alias("c"))
        order = F.xxhash64(F.lit(turn), "node")
        heads = labelled.groupBy("bh").agg(F.min(F.struct(order, "node", "c")).alias("h"), F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("k")).where("low <> high")
        heads = materialize(heads.select("bh", F.col("h.node").alias("head"), F.col("h.c").alias("hc"), "k"), "heads")
        members = materialize(labelled.join(heads.hint("merge"), "bh"), "members")
        if not turn:
            tested = materialize(members.where("c <> hc").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")
            close = likely(tested)
        else:
            if marks is None:
                asked = members.select("node").join(known.where(f"n > {LONG}").select("node").hint("merge"), "node").distinct()
                marks = materialize(texts.join(asked.hint("merge"), "node").select("node", "text").mapInArrow(scan.mark, "node long, marks binary"), "marks")
            close = across(members, known, marks, Scan(scan.words, scan.threshold, *WINDOWS[turn - 1])).join(tested.hint("merge"), ["a", "b"], "left_anti")
        live = members.select("bh", "band", "node")
        close = materialize(close, "likely")
        if close.isEmpty():
            continue
        new = confirm(close)
        edges = new if edges is None else edges.union(new)
        component = materialize(connected_components(edges), "components")
    return component and component.join(classes.select("node", "n", "s1", "s2").hint("merge"), "node").select("n", "s1", "s2", "component")


def across(members: DataFrame, known: DataFrame, marks: DataFrame, scan: Scan) -> DataFrame:
    """Likely pairs across components: every bucket's members in blocks, each pair of blocks in one group."""
    rows = members.join(known.select("node", "n", "regs", "parts").hint("merge"), "node").join(marks.hint("merge"), "node", "left")
    blocks = F.ceil(F.col("k") / MEMBERS).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), "node"), blocks).cast("int")
    rows = rows.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bh", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "band", "node", "c", "n", "regs", "parts", "marks")
    return rows.groupBy("bh", "p", "q").applyInArrow(lambda block: scan.across(block), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept`` (and the row's key k1, k2)."""
    scan = Scan(words, threshold)
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(f"k{i + 1}") for i, c in enumerate(row_key(f"`{id_col}`", f"`{text_col}`"))], F.col(f"`{text_col}`").alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    sketched = materialize(keyed.mapInArrow(scan.sketch, f"id {kind}, k1 long, k2 long, n long, s1 long, s2 long, regs array<short>, parts array<short>"), "sketched")
    component = links(sketched, keyed.select("k1", "k2", "text"), scan)
    rows = sketched.where("n > 0").select("id", "k1", "k2", "n", "s1", "s2")
    if component is None:
        rows = rows.withColumn("component", F.lit(None).cast("long"))
    else:
        rows = rows.join(component.hint("merge"), ["n", "s1", "s2"], "left")
    # a group is a component, or a class without links
    one = F.col("component").isNull()
    rows = rows.select("id", "k1", "k2", "n", one.alias("g0"), F.coalesce("component", "s1").alias("g1"), F.when(one, F.col("s2")).otherwise(0).alias("g2"), F.when(one, F.col("n")).otherwise(0).alias("g3"))
    group = ["g0", "g1", "g2", "g3"]
    rows = materialize(rows, "grouped")
    smallest = materialize(rows.groupBy(*group).agg(F.min("id").alias("component_id")), "smallest")
    linked = rows.join(smallest.hint("merge"), group).select("id", "n", "component_id", "k1", "k2")
    alone = sketched.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "k1", "k2")
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "k1", "k2")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows that stay, with all their columns; rows that are surely kept do not shuffle."""
    gone = near_duplicates(df, id_col, text_col, words, threshold).where("not kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    gone = materialize(gone, "gone")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *row_key(f"`{id_col}`", f"`{text_col}`"))
    asked = bloom.maybe(keyed, "__k1", bloom.filter_of(gone, "__k1"))
    stay = asked.where("__maybe").join(gone.hint("merge"), ["__k1", "__k2"], "left_anti")
    return asked.where("not __maybe").select("__row.*").unionByName(stay.select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4).drop("k1", "k2")
