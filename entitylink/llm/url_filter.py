"""URL filter: rules first, then host word segmentation with multinomial naive Bayes.

Host labels are concatenated names; a unigram Viterbi search splits them into words, weighed by their
counts over the text of all pages. The segmented host words and the path's words are the tokens of a
multinomial naive Bayes model. Its labels come from the rules: every url that a rule fits teaches the
model that rule's verdict, and the model judges the urls that no rule fits.

The counts of all words, of any length, stay in a table. Substrings of the distinct label parts, of the
lengths that words have, pass a Bloom filter of the words and are joined to the counts, so each part gets
just the words that occur in it. A part is searched once and its split joined back by way of the distinct
hosts. Broadcast are that filter (``2**27`` bits), the lengths, and the naive Bayes table of
``2**BUCKET_BITS`` hashed tokens.

Defined results: a null url, or one without ``://``, has empty host and path and is judged on no
tokens, by the classes' priors; a tie is ``allow``; without any rule-labelled url every verdict is
``allow``, and with one class only it is that class. Null html teaches nothing. Repeated urls count as
often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm.common import Words, ascii_lower, extended

#: (verdict, rule): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
FILTER_BITS = 27
BUCKET_BITS = 18
SMOOTH = 1.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def lexicon(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Counts ``(w, n)`` of all words of all pages' text."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"<[^<>]*>|&[a-z]+;", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).where("w != ''")
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def segment(label: str, logp: dict[str, float], unknown: float | None = None) -> list[str]:
    """Most likely split of a name by unigram Viterbi; unknown letters cost more than any known word."""
    if unknown is None:
        unknown = min(logp.values(), default=-10.0) - 5.0
    longest = max(map(len, logp), default=0)
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        options = [(best[end - 1] + unknown, end - 1)]
        for begin in range(max(0, end - longest), end):
            if (p := logp.get(label[begin:end])) is not None:
                options.append((best[begin] + p, begin))
        score, begin = max(options)
        best.append(score)
        back.append(begin)
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def parts_of(host: str) -> list[str]:
    """The runs of letters in all labels of a host but the last."""
    labels = [x for x in host.split(".") if x]
    return [part for label in labels[:-1] for part in re.findall(r"[^\W\d_]+", label)]


def _cells(words: list[str]) -> np.ndarray:
    return (Words(words).hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64) if words else np.zeros(0, np.int64)


def word_filter(counts: DataFrame) -> np.ndarray:
    """Bits of the hashes of all words, built by page of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.unique(_cells(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])

    pages = counts.select("w").mapInArrow(run, "cell long").groupBy(F.expr("bitmap_bucket_number(cell + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("bits"))
    bits = np.zeros(2 ** (FILTER_BITS - 3), np.uint8)
    for r in pages.toLocalIterator():
        page = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(page)] = page
    return bits


def host_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, words)``: the split of every distinct host that has a part to split."""
    spark = urls.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, i, p) for h in b.column(0).to_pylist() for i, p in enumerate(parts_of(h))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["host", "i", "part"])

    places = materialize(urls.select("host").distinct().mapInArrow(cut, "host string, i int, part string"), "hosts")
    s = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least")).first()
    total = float(s["total"] or 1)
    unknown = (log(s["least"] / total) if s["total"] else -10.0) - 5.0
    lengths = sorted(r[0] for r in counts.select(F.length("w")).distinct().collect())
    shared = spark.sparkContext.broadcast((lengths, word_filter(counts)))

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bits = shared.value
        for b in batches:
            for part in b.column(0).to_pylist():
                for k in lengths:
                    if k > len(part):
                        break
                    some = list({part[i : i + k] for i in range(len(part) - k + 1)})
                    cell = _cells(some)
                    held = [some[i] for i in np.flatnonzero(bits[cell >> 3] >> (cell & 7) & 1)]
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.string()), pa.array(held, pa.string())], ["part", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(0).to_pylist()
            found = [segment(p, {x["w"]: log(x["n"] / total) for x in ws or ()}, unknown) for p, ws in zip(parts, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["part", "words"])

    parts = places.select("part").distinct()
    known = parts.mapInArrow(substrings, "part string, w string").join(counts, "w").groupBy("part").agg(F.collect_list(F.struct("w", "n")).alias("ws"))
    splits = materialize(parts.join(known, "part", "left").mapInArrow(split, "part string, words array<string>"), "splits")
    placed = places.join(splits, "part").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("i", "words"))).alias("found"))
    return placed.select("host", F.flatten("found.words").alias("words"))


def tokens_of(host: str, path: str, words: list[str]) -> list[str]:
    """Prefixed tokens: the host's last label, segmented host words, path words (digits by length)."""
    out = [f"t:{x}" for x in [x for x in host.split(".") if x][-1:]]
    out += [f"h:{w}" for w in words]
    for part in re.findall(r"[^\W_]+", path.lower()):
        out.append(f"p:{part[0]}#{len(part)}" if part.isdigit() else f"p:{part}")
    return out


def with_tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``tokens`` to rows with host and path; ``counts`` is the table of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens_of(h, p, w or []) for h, p, w in zip(*(b.column(c).to_pylist() for c in ("host", "path", "words")), strict=True)]
            kept = [(b.column(i), name) for i, name in enumerate(b.schema.names) if name != "words"]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(found, pa.list_(pa.string()))], [n for _, n in kept] + ["tokens"])

    split = urls.join(host_words(urls, counts), "host", "left").select(*urls.columns, "words")
    return materialize(split.mapInArrow(run, extended(urls.schema, "tokens array<string>")), "urls")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict``, ``log_odds`` (of block) and ``tokens``."""
    spark, rules = pages.sparkSession, RULES if rules is None else rules
    counts = materialize(lexicon(pages, html_col), "lexicon")
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = with_tokens(urls.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)), counts)
    bucket = lambda token: F.pmod(F.xxhash64(token), F.lit(2**BUCKET_BITS)).cast("int")
    block = (F.col("hit.verdict") == "block").cast("long")
    labelled = urls.where("hit is not null")
    docs = labelled.agg(F.coalesce(F.sum(block), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n_block, n_allow = docs["b"], docs["n"] - docs["b"]
    seen = labelled.select(block.alias("y"), F.explode("tokens").alias("token")).groupBy(bucket(F.col("token")).alias("bucket"))
    seen = seen.agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("a"))
    totals = seen.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("v")).first()
    b_all, a_all = totals["b"] + SMOOTH * (totals["v"] + 1), totals["a"] + SMOOTH * (totals["v"] + 1)
    table = seen.select("bucket", (F.log((F.col("b") + SMOOTH) / b_all) - F.log((F.col("a") + SMOOTH) / a_all)).alias("w")).toPandas()
    weights = spark.sparkContext.broadcast(dict(zip(table["bucket"].tolist(), table["w"].tolist(), strict=True)))
    prior = log((n_block + SMOOTH) / (n_allow + SMOOTH))
    unseen = log(SMOOTH / b_all) - log(SMOOTH / a_all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            odds = [prior + sum(w.get(k, unseen) for k in ks) for ks in b.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odds, pa.float64())], [*b.schema.names, "log_odds"])

    scored = urls.withColumn("buckets", F.transform("tokens", bucket))
    scored = scored.mapInArrow(run, extended(scored.schema, "log_odds double"))
    model = F.when(F.col("log_odds") > 0, "block").otherwise("allow") if n_block and n_allow else F.lit("block" if n_block else "allow")
    return scored.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), model).alias("verdict"), "log_odds", "tokens")


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("tokens")
