"""Language identification as inference in a mixture of languages.

Training counts hashed letter trigrams per language over all training rows (partial counts by task,
summed by key in a shuffle). A document is a mixture: its trigram counts come from proportions of the
learned languages. Expectation-maximisation estimates the proportions. Starting from the likeliest
language, the set takes the best of all additions, removals and exchanges of one language, until none
raises the log likelihood less ``PENALTY * log(trigrams)`` a language. The prediction is the language
with the largest proportion, the score that proportion.

Only the table of ``2**BITS`` trigram probabilities per language is broadcast; its size is fixed by
the number of languages, which must not exceed ``MAX_LANGUAGES``.

Defined results: a null text, or one without any letter, gives ``und`` and score 0; so does every text
if no training row has letters. Ties go to the language first in order. Null languages teach nothing;
a null id counts as the empty string in the hold-out rule. Texts are read whole, ``PIECE`` characters at
a time, which changes no count. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.llm.common import crc_mod, extended, slices

BITS = 15
MAX_LANGUAGES = 500
SMOOTH = 0.1
PENALTY = 3.0
STEPS = 25
PIECE = 500_000
MARGIN = 1e-6


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)


def trigrams(text: str | None, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Hashed trigrams of the lower-cased text, in pieces; every run of other characters counts as one blank."""
    text, held, any_letter = (text or "").lower(), np.zeros(1, np.uint32), False
    for i in range(0, len(text), piece):
        code = np.frombuffer(text[i : i + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        any_letter |= bool(letter.any())
        code = np.where(letter, code, 0)
        code = np.concatenate([held, code[letter | np.concatenate([[held[-1] != 0], letter[:-1]])]])
        yield _hashed(code)
        held = code[-2:]
    if any_letter and held[-1]:
        yield _hashed(np.concatenate([held, [0]]))


def _hashed(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.uint64)
    h = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def gram_counts(text: str | None) -> np.ndarray:
    return sum((np.bincount(g, minlength=2**BITS) for g in trigrams(text)), np.zeros(2**BITS, np.int64))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Learned languages in order, and log-free trigram probabilities (``2**BITS`` x languages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in trigrams(text):
                    if lang not in counts:
                        counts[lang] = np.zeros(2**BITS, np.int64)
                    counts[lang] += np.bincount(g, minlength=2**BITS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "gram", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = known.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = parts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = [r["lang"] for r in by_lang]
    p = np.full((2**BITS, len(langs)), SMOOTH)
    table = parts.toPandas()  # at most languages x 2**BITS rows
    if len(table):
        p[table["gram"].to_numpy(), np.searchsorted(np.array(langs, object), table["lang"].to_numpy(object))] += table["n"].to_numpy()
    return langs, p / p.sum(0) if langs else p


def em(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions and log likelihood of gram counts ``n`` with likelihoods ``p`` (grams x languages)."""
    k = p.shape[1]
    share = np.full(k, 1.0 / k)
    if k > 1:
        total = n.sum()
        for _ in range(STEPS):
            new = share * (p.T @ (n / (p @ share))) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
    return share, float(n @ np.log(p @ share))


def infer(counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Proportions of all languages from trigram counts; zero for those outside the selected set."""
    at = np.flatnonzero(counts)
    n, q = counts[at].astype(float), p[at]
    cost, total, langs = PENALTY * np.log(n.sum() + 1), n.sum(), range(p.shape[1])
    chosen = [int(np.argmax(n @ np.log(q)))]
    share, best = em(q[:, chosen], n)
    while True:
        # the likelihood is concave in the proportions, so its slopes bound what a changed set can gain
        slope = q.T @ (n / (q[:, chosen] @ share)) - total
        rest, inner = [i for i in langs if i not in chosen], max(0.0, slope[chosen].max())
        moves = [([*chosen, i], max(inner, slope[i]) - cost) for i in rest]
        if len(chosen) > 1:
            for i in chosen:
                less = [j for j in chosen if j != i]
                moves += [(less, inner + cost)] + [([*less, j], max(inner, slope[j])) for j in rest]
        gain, found = MARGIN, None
        for trial, bound in sorted(moves, key=lambda m: -m[1]):
            if bound <= gain:
                break
            trial = sorted(trial)
            parts, value = em(q[:, trial], n)
            if (more := value - best - cost * (len(trial) - len(chosen))) > gain:
                gain, found = more, (trial, parts, value)
        if found is None:
            break
        chosen, share, best = found
    out = np.zeros(p.shape[1])
    out[chosen] = share
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``lang_set`` (the selected languages, largest share first)."""
    langs, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p)
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "lang_set")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pred, score, sets = [], [], []
            for text in b.column(text_col).to_pylist():
                g = gram_counts(text)
                if not langs or not g.any():
                    pred.append("und"), score.append(0.0), sets.append([])
                    continue
                share = infer(g, shared.value)
                top = int(share.argmax())
                pred.append(langs[top]), score.append(min(1.0, float(share[top])))
                sets.append([langs[i] for i in np.argsort(-share, kind="stable") if share[i] > 0])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [*others, "lang_pred", "score", "lang_set"])

    schema = extended(docs.select(*[f"`{c}`" for c in others]).schema, "lang_pred string, score double, lang_set array<string>")
    return docs.select(*[f"`{c}`" for c in [*others, text_col]]).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 5) == 0
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
