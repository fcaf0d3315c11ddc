"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words; its minimiser is the smallest hash among its runs of ``MINI``
words (the leftmost, if equal). Consecutive windows that share a minimiser form a super-k-mer, which
travels as one packed string of its words to the minimiser's bucket, where the windows are sorted and
counted. Equal windows have equal minimisers at equal places, so they meet in one bucket and come from
different super-k-mers.

Two measures, neither of which changes a result, keep the work in proportion. A first pass counts the
minimisers; only super-k-mers whose minimiser occurs twice can hold a repeated window, and a filter of
``FILTER_BITS`` bits (a fixed size, so it may be broadcast) lets no others travel; a filter that is too
small for the input lets more of them through. A minimiser that occurs more than ``HOT`` times (or the
2**-20th part of all, so at most 2**20 of them, which bounds that broadcast) would fill one bucket: its
windows travel one by one as 128-bit hashes, counted by a grouping that combines before the shuffle.

Words are packed as 48 bits of their 64-bit hash; windows are compared word by word on these. What comes
back for a super-k-mer is the bit mask of its repeated windows, joined by the packed string's 128-bit
hash, and then gathered per document, whose own length bounds it.

Defined results: a null text has no words. Texts of fewer than ``WINDOW`` words lose nothing. Rows equal
in id and text are different documents, so each repeats the other's windows. An empty table gives no
rows. Other columns are kept by ``remove_repeats``; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm.common import Words, extended, mix64, rolling, row_key

WINDOW = 35
MINI = 6
FILTER_BITS = 27
HOT = 2000
WORD_BYTES = 6
PIECE = 3_000_000
_B1, _B2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded total length (one text at least)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def super_kmers(w: Words, window: int = WINDOW, mini: int = MINI) -> tuple[np.ndarray, ...]:
    """Text number, first window's word (within the batch), count of windows and minimiser of each super-k-mer."""
    n = len(w.hash) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    small = mix64(rolling(w.hash, mini))
    span = window - mini + 1
    place = np.empty(n, np.int64)
    for a in range(0, n, 200_000):
        b = min(n, a + 200_000)
        place[a:b] = np.lib.stride_tricks.sliding_window_view(small[a : b + span - 1], span).argmin(1)
    place += np.arange(n)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inside = doc[:n] == doc[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    ends = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return doc[starts], starts, ends - starts + 1, small[place[starts]]


def _cell(mini: np.ndarray, bits: int) -> np.ndarray:
    return (mini >> np.uint64(64 - bits)).astype(np.int64)


def _pack(hashes: np.ndarray) -> np.ndarray:
    """48 bits of each word's hash, as bytes."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]


def _codes(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64(2 ** (8 * WORD_BYTES) - 1)


def _two(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(codes, width, _B1).view(np.int64), rolling(codes, width, _B2).view(np.int64)


def _run_hashes(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each packed string (its words in order, and their number)."""
    if not len(size):
        return (np.zeros(0, np.int64),) * 2
    out = []
    for base in (_B1, _B2):
        step = np.full(int(size.max(initial=0)) + 1, base, np.uint64)
        step[0] = 1
        power = np.multiply.accumulate(step)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        inner = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        terms = np.concatenate([[0], np.cumsum(mix64(codes[at] + np.uint64(base % 2**32)) * power[inner])]).astype(np.uint64)
        edge = np.concatenate([[0], np.cumsum(size)])
        out.append(mix64((terms[edge[1:]] - terms[edge[:-1]]) + size.astype(np.uint64) * np.uint64(base)).view(np.int64))
    return out[0], out[1]


class Repeats:
    """The three scans of the texts; ``seen`` is (filter, sorted hot minimisers) as a broadcast."""

    def __init__(self, window: int, mini: int, bits: int, seen=None) -> None:
        self.window, self.mini, self.bits, self.seen = window, mini, bits, seen

    def minimisers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in pieces(texts):
                found, n = np.unique(super_kmers(Words(texts[i:j]), self.window, self.mini)[3].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["mini", "n"])

    def _kept(self, texts: list[str | None]):
        """Super-k-mers that the filter lets through, and which of them are hot."""
        w = Words(texts)
        doc, start, count, mini = super_kmers(w, self.window, self.mini)
        seen, hot = self.seen.value
        cell = _cell(mini, self.bits)
        keep = (seen[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        doc, start, count, mini = doc[keep], start[keep], count[keep], mini[keep].view(np.int64)
        return _codes(w.hash), w, doc, start, count, mini, np.isin(mini, hot)

    def _single(self, codes: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places and hashes of all windows of some super-k-mers."""
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        h1, h2 = _two(codes, self.window)
        return at, h1[at], h2[at]

    def packed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in pieces(texts):
                codes, _, _, start, count, mini, hot = self._kept(texts[i:j])
                start, count, mini = start[~hot], count[~hot], mini[~hot]
                if not len(start):
                    continue
                size = count + self.window - 1
                h1, h2 = _run_hashes(codes, start, size)
                _, first, n = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True, return_counts=True)
                raw = _pack(codes)
                strings = [raw[s : s + k].tobytes() for s, k in zip(start[first], size[first], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(mini[first]), pa.array(h1[first]), pa.array(h2[first]), pa.array(n), pa.array(strings, pa.binary())], ["mini", "h1", "h2", "n", "words"])

    def hot_windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in pieces(texts):
                codes, _, _, start, count, _, hot = self._kept(texts[i:j])
                if not hot.any():
                    continue
                _, h1, h2 = self._single(codes, start[hot], count[hot])
                pairs, n = np.unique(np.stack([h1, h2], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["h1", "h2", "n"])

    def occurrences(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, k1, k2 = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, j in pieces(texts):
                codes, w, doc, start, count, _, hot = self._kept(texts[i:j])
                if not len(start):
                    continue
                h1, h2 = _run_hashes(codes, start[~hot], count[~hot] + self.window - 1)
                at, g1, g2 = self._single(codes, start[hot], count[hot]) if hot.any() else (np.zeros(0, np.int64),) * 3
                who = np.concatenate([doc[~hot], np.repeat(doc[hot], count[hot])])
                first = np.concatenate([start[~hot], at]) - w.first[who]
                cols = [k1[i + who], k2[i + who], first.astype(np.int32), np.concatenate([h1, g1]), np.concatenate([h2, g2])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "first", "h1", "h2"])

    def count_sorted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed strings in order of minimiser -> masks of the windows that occur twice or more."""
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            mini = t.column("mini").to_numpy()
            cut = int(np.searchsorted(mini, mini[-1])) if len(mini) else 0
            rest = t.slice(cut)
            if cut:
                yield from self._masks(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from self._masks(rest)

    def _masks(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        mini, weight = t.column("mini").to_numpy(), t.column("n").to_numpy()
        more = np.zeros(len(mini), bool)  # a bucket with one string of one occurrence has no repeats
        more[1:] |= mini[1:] == mini[:-1]
        more[:-1] |= mini[1:] == mini[:-1]
        at = np.flatnonzero(more | (weight > 1))
        if not len(at):
            return
        t, weight = t.take(at), weight[at]
        strings = t.column("words").to_pylist()
        size = np.fromiter((len(s) // WORD_BYTES for s in strings), np.int64, len(strings))
        raw = np.zeros((int(size.sum()), 8), np.uint8)
        raw[:, :WORD_BYTES] = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, WORD_BYTES)
        codes = raw.view("<u8").ravel()
        count = size - self.window + 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        owner = np.repeat(np.arange(len(size)), count)
        first = np.concatenate([[0], np.cumsum(count)])
        place, h, _ = self._single(codes, begin, count)
        total = exact_counts(codes, place, h, weight[owner], self.window)
        again = total > 1
        hit = np.add.reduceat(again, first[:-1]) > 0
        if hit.any():
            masks = [np.packbits(again[first[i] : first[i + 1]], bitorder="little").tobytes() for i in np.flatnonzero(hit)]
            keep = t.filter(pa.array(hit)).combine_chunks()
            yield pa.RecordBatch.from_arrays([keep.column("h1").combine_chunks(), keep.column("h2").combine_chunks(), pa.array(masks, pa.binary())], ["h1", "h2", "mask"])


def exact_counts(codes: np.ndarray, place: np.ndarray, h: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """For each window its total weight over equal windows: sort by hash, then compare word by word."""
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    pairs = np.flatnonzero(same)
    unequal = np.zeros(len(pairs), bool)
    for i in range(width):
        unequal |= codes[place[order[pairs]] + i] != codes[place[order[pairs - 1]] + i]
    if unequal.any():  # a hash stands for several windows: sort by the words themselves
        view = codes[place[:, None] + np.arange(width)]
        order = np.lexsort(view.T[::-1])
        same = np.zeros(len(h), bool)
        same[1:] = (view[order][1:] == view[order][:-1]).all(1)
    group = np.cumsum(~same) - 1
    out = np.empty(len(h), np.int64)
    out[order] = np.bincount(group, weight[order]).astype(np.int64)[group]
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, mini: int = MINI, bits: int = FILTER_BITS, hot: int = HOT, text_col: str = "text") -> DataFrame:
    """Per document key (``k1, k2``) the set of (first window, mask) of its repeated windows.

    ``docs`` has the columns text, k1, k2.
    """
    spark = docs.sparkSession
    text = docs.select(text_col)
    scan = Repeats(window, mini, bits)
    often = text.mapInArrow(scan.minimisers, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))
    often = materialize(often.where("n > 1"), "minimisers")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(hot, total >> 20)
    heavy = np.sort(often.where(F.col("n") > most).select("mini").toPandas()["mini"].to_numpy(np.int64))
    cell = F.shiftrightunsigned("mini", 64 - bits)
    bitmaps = often.select((cell + 1).alias("cell")).groupBy(F.expr("bitmap_bucket_number(cell)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
    seen = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for row in bitmaps.toLocalIterator():  # at most 2**bits / 8 bytes in all
        seen[(row["at"] - 1) * 4096 : row["at"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    scan = Repeats(window, mini, bits, spark.sparkContext.broadcast((seen, heavy)))
    packed = text.mapInArrow(scan.packed, "mini long, h1 long, h2 long, n long, words binary")
    masks = packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(scan.count_sorted, "h1 long, h2 long, mask binary")
    # a string that came from several tasks has its mask several times
    masks = masks.groupBy("h1", "h2").agg(F.max("mask").alias("mask"))
    if len(heavy):
        single = text.mapInArrow(scan.hot_windows, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        masks = masks.unionByName(single.where("n > 1").select("h1", "h2", F.lit(b"\x01").alias("mask")))
    masks = materialize(masks, "masks")
    found = docs.select(text_col, "k1", "k2").mapInArrow(scan.occurrences, "k1 long, k2 long, first int, h1 long, h2 long")
    found = found.join(masks.hint("merge"), ["h1", "h2"])
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "mask")).alias("runs"))


def covered(n_words: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    edge = np.zeros(n_words + window + 1, np.int64)
    for r in runs or []:
        at = r["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["mask"], np.uint8), bitorder="little"))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n_words] > 0


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, mini: int = MINI, bits: int = FILTER_BITS, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """The other columns with ``n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text``."""
    added = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]
    others = [c for c in df.columns if c != text_col and c not in added]
    keyed = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").alias("__text"), *row_key(f"`{id_col}`", f"`{text_col}`"))
    runs = repeated_windows(keyed.select(F.col("__text").alias("text"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2")), window, mini, bits, hot)
    runs = runs.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("runs").alias("__runs"))
    joined = keyed.join(runs, ["__k1", "__k2"], "left").select(*[f"`{c}`" for c in others], "__text", "__runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column("__text").to_pylist(), b.column("__runs").to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes.split() parts at exactly these six characters
                gone = covered(len(words), found, window) if found else ()
                kept = b" ".join([x for x, g in zip(words, gone, strict=True) if not g] if found else words)
                rows.append((len(words), int(sum(gone)), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * keep_text))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in added]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], [*others, *added])

    return joined.mapInArrow(run, extended(df.select(*[f"`{c}`" for c in others]).schema, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
