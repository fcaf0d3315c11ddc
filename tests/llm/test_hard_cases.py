"""Cases that small random fixtures do not hold: families just below a threshold, hubs, long texts, noisy labels, all splits."""

import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entitylink.llm import minhash_dedup, quality, substring_dedup, url_filter

RND = random.Random(31)
VOCABULARY = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 6))) for _ in range(4000)]
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def prose(n):
    return [RND.choice(VOCABULARY) for _ in range(n)]


def changed(words, places):
    out = list(words)
    for i in places:
        out[i] = RND.choice(VOCABULARY) + "x"
    return out


def family():
    """A hub with members that link to it alone, a family between 0.5 and 0.8, and a long text with a near copy."""
    hub, base, long = prose(400), prose(500), prose(15_000)
    texts = [hub] + [changed(hub, range(5 + 7 * k, 400, 70)) for k in range(6)]
    texts += [changed(base, RND.sample(range(500), 14)) for _ in range(25)]
    texts += [long, changed(long, RND.sample(range(15_000), 120)), long[:9000], prose(9000)]
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def components(rows, words, threshold=80):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    near = 0
    for i in range(len(sets)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            near += 50 * all_ <= 100 * both < threshold * all_
            if 100 * both >= threshold * all_:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))], near


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_of_families(spark, words):
    rows = family()
    want, near = components(rows, words)
    assert near > 50 and len(set(want)) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash_dedup.near_duplicates(docs, words=words).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == list(enumerate(want))
    kept = minhash_dedup.drop_near_duplicates(docs, words=words)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def members_of(similarity, k, n):
    """k sets of n elements, every two of them with about this similarity."""
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, int(n * 2 * similarity / (1 + similarity)), dtype=np.uint64)
    return [np.unique(np.concatenate([core, rng.integers(0, 2**63, n - len(core), dtype=np.uint64)])) for _ in range(k)]


def block_of(sets, marked=True):
    k = len(sets)
    return pa.table({
        "node": list(range(k)), "c": list(range(k)), "n": [len(s) for s in sets], "side": [0] * k, "band": [0] * k,
        "regs": list(minhash_dedup.registers(sets)), "parts": list(minhash_dedup.part_counts(sets)),
        "marks": pa.array([minhash_dedup.bitmap(s) if marked and i % 10 else None for i, s in enumerate(sets)], pa.binary()),
    })


@pytest.mark.parametrize(("similarity", "n"), [(0.72, 4000), (0.74, 1500), (0.74, 30_000)])
def test_bitmaps_settle_families_below_the_threshold(similarity, n):
    scan, sets = minhash_dedup.Scan(5, 80), members_of(similarity, 40, n)
    without = scan.across(block_of(sets, marked=False))
    pairs = scan.across(block_of(sets)).to_pylist()
    assert without.num_rows > 300
    assert all(p["a"] % 10 == 0 or p["b"] % 10 == 0 for p in pairs)  # only those that lack a bitmap


@pytest.mark.parametrize("n", [1001, 4000, 60_000])
def test_bitmaps_lose_no_link(n):
    scan, sets = minhash_dedup.Scan(5, 80), members_of(0.803, 30, n)
    linked = {(a, b) for b in range(30) for a in range(b) if 1.8 * len(np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]))}
    assert len(linked) > 400
    assert linked <= {(p["a"], p["b"]) for p in scan.across(block_of(sets)).to_pylist()}


def test_near_duplicates_of_a_family_of_long_texts(spark):
    """Texts of over ``LONG`` shingles around 0.7, a few pairs of them above the threshold, beside short ones."""
    base, short = prose(1600), prose(300)
    texts = [changed(base, RND.sample(range(1600), 60)) for _ in range(24)] + [changed(short, RND.sample(range(300), 8)) for _ in range(12)]
    texts += [changed(texts[i], RND.sample(range(1600), 12)) for i in (2, 3, 3, 11)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want, near = components(rows, 5)
    assert near > 200 and 20 < len(set(want)) < len(rows)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == list(enumerate(want))


def test_substrings_of_long_texts(spark, tmp_path):
    long = prose(20_000)
    texts = [long, prose(300) + long[4_000:4_120] + prose(200), prose(50) + long[19_990:], long[:34], long[10:45] + prose(3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    starts = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 34):
            starts.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + k) for at in starts.values() if len(at) > 1 for d, i in at for k in range(35)}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in substring_dedup.query(spark, str(tmp_path)).collect()}
    assert {d: r["n_removed"] for d, r in got.items()} == {d: sum(x == d for x, _ in gone) for d in range(len(texts))}
    assert got[1]["n_removed"] == 120 and got[4]["n_removed"] == 35


def test_viterbi_against_all_splits():
    for _ in range(60):
        lexicon = {"".join(RND.choice("ab") for _ in range(RND.randint(1, 4))): -RND.random() * 9 for _ in range(RND.randint(0, 8))}
        unknown = min(lexicon.values(), default=-10.0) - 5.0
        name = "".join(RND.choice("abc") for _ in range(RND.randint(1, 9)))
        best = -1e9
        for cuts in product([False, True], repeat=len(name) - 1):
            parts = [""]
            for c, cut in zip(name, (False, *cuts), strict=True):
                parts = [*parts, c] if cut else [*parts[:-1], parts[-1] + c]
            cost = [lexicon.get(p, unknown if len(p) == 1 else None) for p in parts]
            if None not in cost:
                best = max(best, sum(cost))
        got = url_filter.segment(name, lexicon)
        assert "".join(got) == name
        assert abs(sum(lexicon.get(p, unknown) for p in got) - best) < 1e-9


def test_long_host(spark):
    word = "".join(RND.choice("abcdefgh") for _ in range(3000))
    pages = spark.createDataFrame([(1, f"http://{word}zebra.example.org/x", "zebra zebra tiger")], "page_id long, url string, html string")
    tokens = url_filter.judge_urls(pages).first()["tokens"]
    assert "h:zebra" in tokens


def test_quality_of_noisy_labels(spark):
    """Labels that follow two features with noise: held-out ranking, not only separable classes."""

    def document(i):
        marks, shout = RND.random(), RND.random()
        words = [w.upper() if RND.random() < shout else w for w in prose(60)]
        text = " ".join(w + ("!" if RND.random() < marks else "") for w in words)
        return i, text, int(RND.random() < (0.95 if marks + shout < 1 else 0.1))

    rows = [document(i) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.train(docs.where(F.col("doc_id") % 3 != 0), labels)).collect()}
    good, bad = ([score[i] for i, _, y in rows if i % 3 == 0 and y == k] for k in (1, 0))
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert area > 0.8
