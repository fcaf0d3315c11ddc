"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are cut into at most ``BINS`` bins. Cyclic boosting visits one feature after another and
adds a shallow tree's leaf values to that feature's lookup table; then the pairs of features whose
residual interaction is largest get two-dimensional tables in the same way. A score is the sum of table
entries, one per feature and pair, added for a whole batch at once, through the logistic function.

The model is fitted on a bounded sample of labelled rows: the ``SAMPLE`` training labels that come first
in the order of their id's hash (all of them, if fewer). Only those ids are broadcast and only their
``FEATURES`` numbers reach the driver. Every document is scored over its whole text.

A text longer than ``PIECE`` characters is looked at alone and whole. Of repeated ids the row with the least
features teaches.

Defined results: a null or empty text has all features zero and gets a score as any other. Without
labelled rows every score is 0.5; with one class only it is the smoothed share of that class. Null labels
and labels of unknown documents teach nothing. A null id counts as the empty string in the hold-out rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.llm.common import Words, crc_mod, extended, slices, trimmed

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
RATE = 0.1
LEAVES = 3
PIECE = 500_000  # characters whose features are computed together
THRESHOLD = 0.3
FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "symbol", "bang", "bar", "non_ascii", "distinct", "repeats", "top_word", "odd_end", "words_per_line", "same_lines"]

_CLASS = np.zeros((7, 256), np.int64)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, list(b".,;:?'\"()-")] = 1
_CLASS[3, list(b"#$%&*@^~_=+<>/\\{}[]")] = 1
_CLASS[4, list(b"!")] = 1
_CLASS[5, list(b"|")] = 1
_CLASS[6, 128:] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text, in pieces of bounded size."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > PIECE:
            out.append(_features(texts[begin : i + 1]))
            begin, size = i + 1, 0
    out.append(_features(texts[begin:]))
    return np.concatenate(out)


def _features(texts: list[str | None]) -> np.ndarray:
    w, n = Words(texts, lower=True), len(texts)
    data = np.frombuffer(w.buffer, np.uint8)
    bounds = w.offset
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    n_bytes, n_words = np.diff(bounds) - 1, np.diff(w.first)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0], x[:, 1] = np.log1p(n_bytes), np.log1p(n_words)
    in_words = np.concatenate([[0], np.cumsum(w.end - w.start)])
    x[:, 2] = (in_words[w.first[1:]] - in_words[w.first[:-1]]) / per_word
    for j in range(7):
        x[:, 3 + j] = count(_CLASS[j][data]) / per_byte
    doc = np.repeat(np.arange(n), n_words)
    if len(doc):
        order = np.lexsort((w.hash, doc))
        new = np.ones(len(order), bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        starts = np.flatnonzero(new)
        runs = np.diff(np.concatenate([starts, [len(order)]]))
        owner = doc[order][starts]
        x[:, 10] = np.bincount(owner, minlength=n) / per_word
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner, runs)
        x[:, 12] = top / per_word
        again = np.zeros(len(doc), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        x[:, 11] = np.bincount(doc, again, n) / per_word
        x[:, 13] = np.bincount(doc, (_CLASS[3] + _CLASS[4])[data[w.end - 1]] > 0, n) / per_word
    for i, t in enumerate(texts):
        lines = [s for s in (t or "").split("\n") if s]
        x[i, 14] = np.log1p(n_words[i] / max(1, len(lines)))
        x[i, 15] = 1 - len(set(lines)) / max(1, len(lines))
    return x


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``score`` is a sum of table entries through the logistic function."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.single, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        small = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for p in self.pairs for j in p}
        for (a, b), t in zip(self.pairs, self.double, strict=True):
            z += t[small[a], small[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaf_values(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A best-first tree of at most ``LEAVES`` leaves over ordered bins, as a value per bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    leaves = [(0, len(g))]
    for _ in range(LEAVES - 1):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = gain_of(a, cut) + gain_of(cut, b) - gain_of(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(cut[gain.argmax()]))
        if not best[2]:
            break
        a, b = leaves[best[1]]
        leaves[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    model.edges, model.coarse = [_cuts(x[:, j], BINS) for j in range(d)], [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)
    p = lambda: 1 / (1 + np.exp(-z))
    for _ in range(ROUNDS):
        for j in range(d):
            q, size = p(), len(model.single[j])
            step = RATE * _leaf_values(np.bincount(at[j], y - q, size), np.bincount(at[j], q * (1 - q), size))
            model.single[j] += step
            z += step[at[j]]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
    cell = lambda a, b: small[a] * shape(a, b)[1] + small[b]
    q = p()
    gains = []
    for a, b in combinations(range(d), 2):
        size = int(np.prod(shape(a, b)))
        g, h = np.bincount(cell(a, b), y - q, size), np.bincount(cell(a, b), q * (1 - q), size)
        gains.append((float((g**2 / (h + 5.0)).sum()), (a, b)))
    model.pairs = [ab for _, ab in sorted(gains, key=lambda t: (-t[0], t[1]))[:PAIRS]]
    model.double = [np.zeros(shape(*ab)) for ab in model.pairs]
    for _ in range(ROUNDS // 4):
        for k, (a, b) in enumerate(model.pairs):
            q, c, size = p(), cell(a, b), model.double[k].size
            g, h = np.bincount(c, y - q, size).reshape(shape(a, b)), np.bincount(c, q * (1 - q), size).reshape(shape(a, b))
            cut = min(range(1, g.shape[0]), key=lambda i: -sum(gg.sum() ** 2 / (hh.sum() + 1) for gg, hh in ((g[:i], h[:i]), (g[i:], h[i:]))), default=0)
            step = np.zeros(g.shape)
            for rows in (slice(0, cut), slice(cut, None)):
                if g[rows].size:
                    step[rows] = RATE * _leaf_values(g[rows].sum(0), h[rows].sum(0) + 4.0)
            model.double[k] += step
            z += step.ravel()[c]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """Fit on at most ``sample`` labelled rows outside the held-out fifth."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0))
    ids = known.groupBy(id_col).agg(F.max(label_col).cast("double").alias("__y")).withColumn("__h", F.xxhash64(id_col)).orderBy("__h", id_col).limit(sample)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["h", "y", "x"])

    rows = docs.select(id_col, F.col(text_col).alias("__t")).join(F.broadcast(ids), id_col).select("__h", "__y", "__t")
    # one row per id, the least of equal ids, so that no more than the sample reaches the driver
    rows = rows.mapInArrow(run, "h long, y double, x array<double>").groupBy("h", "y").agg(F.min("x").alias("x"))
    table = rows.toPandas().sort_values(["h", "y"], kind="stable")
    if not len(table):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(table["x"].to_list()), table["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], table["h"].to_numpy()))
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", keep_text: bool = False, out: str = "score") -> DataFrame:
    """Adds the score; drops the text unless asked to keep it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != out and (keep_text or c != text_col)]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score(features(b.column(text_col).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(s, pa.float64())], [*others, out])

    return docs.mapInArrow(run, extended(docs.select(*[f"`{c}`" for c in others]).schema, f"`{out}` double"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
