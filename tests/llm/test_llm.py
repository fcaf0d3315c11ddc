"""The training-data operators against brute force on small fixtures with hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylink.llm import bloom, exact_dedup, language_id, lm_score, minhash_dedup, mixing, quality, substring_dedup, tokenize_sp, topk, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
RND = random.Random(7)
VOCABULARY = ["".join(RND.choice("abcdefgé") for _ in range(RND.randint(1, 6))) for _ in range(300)]


def sentence(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def documents():
    base = [sentence(RND.randint(30, 120)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "two words", "Three short WORDS", "one"]
    texts += base + base[:4] * 3
    for t in base[:6]:  # near copies
        for k in (1, 2, 5):
            w = t.split()
            for _ in range(k):
                w[RND.randrange(len(w))] = RND.choice(VOCABULARY)
            texts.append(" ".join(w))
    passage = sentence(60)
    texts += [sentence(20) + " " + passage + "\n" + sentence(15) for _ in range(5)] + ["Ab " * 200, " ".join([sentence(40)] * 3), sentence(6000), "x\u00a0y \u2028 z\x1cq " * 30]
    rows = [(i, t, RND.choice(["en", "de", None]), RND.choice(["src0", "src0", "src3", "other", None]), None, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(None, base[0], "en", "src1", 1, "x", "y"), rows[9]]


ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def words(text, lower=False):
    b = (text or "").encode()
    return WORD.findall(b.lower() if lower else b)


def test_exact_dedup(docs, empty):
    best, size = {}, Counter()
    for d, t, *_ in ROWS:
        size[t or ""] += 1
        best[t or ""] = max([x for x in (best.get(t or ""), d) if x is not None], default=None)
    want = [(d, best[t or ""], size[t or ""], d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ROWS]
    same(exact_dedup.exact_duplicates(docs).collect(), want)
    same(exact_dedup.exact_duplicates(docs, filter_bits=2**15).collect(), want)
    # the filter grows with the repeated cells, and holds both cells of every repeated text
    assert [bloom.bits_for(n) for n in (0, 1, 2**16, 2**16 + 1, 10**12)] == [2**20, 2**20, 2**20, 2**21, 2**31]
    hashed = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    twice = {r["sha"] for r in hashed.groupBy("sha").count().where("count > 1").collect()}
    maybe = {r["sha"] for r in bloom.maybe(hashed, "sha", *exact_dedup.repeated_cells(hashed, "sha")).where("__maybe").collect()}
    assert maybe == twice
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    same(kept.collect(), [r for r in ROWS if r[0] == best[r[1] or ""]])
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_mixing(spark, docs, empty):
    share = mixing.shares({"src0": 0.5, "src1": 0.3}, 0.2, 10)
    assert share == [5, 3, 2]
    plan = mixing.period(spark, share).orderBy("slot").collect()
    assert [r["slot"] for r in plan] == list(range(10))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in plan)
    for weights in ({"src0": 0.1, **{f"src{i}": 0.01 * i for i in range(1, 12)}}, mixing.WEIGHTS):
        share = mixing.shares(weights, 0.05)
        plan = mixing.period(spark, share).orderBy("slot").collect()
        done = np.zeros(len(share))
        for r in plan:
            done[r["stream"]] += 1
            assert (np.abs(done - np.array(share) * (r["slot"] + 1) / sum(share)) < 1).all()
    out = mixing.mix_sources(docs, {"src0": 0.5, "src3": 0.3}, 0.2, block=2, resolution=10, bucket_rows=7).collect()
    same([r["row"] for r in out], ROWS)
    per = {}
    for r in sorted(out, key=lambda r: (r["mix_slot"], r["in_block"])):
        per.setdefault(r["stream"], []).append((r["block_no"], r["in_block"]))
    for s, places in per.items():
        assert places == [(i // 2, i % 2) for i in range(len(places))]
    assert mixing.mix_sources(empty).count() == 0


def test_url_filter(spark):
    html = "<p>red blue green apple banana</p> " * 20
    urls = ["http://WWW.RedBlue.example.com/en/1?x", "http://a.example.com/en/7x", "ftp://green.net/de/2#q", "http://x.example.net/de/88", "nothing", None, "http://", "a://b.org/es/x", "http://applebanana.com/fr/1", "http://com/en/", "x://y://z.net/de/", "http://notexample.com/en/7"]
    pages = spark.createDataFrame([(i, u, html if i else None, "v") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    want = {0: ("www.redblue.example.com", "/en/1", "com/en/", "block"), 1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("green.net", "/de/2", "net/de/", "allow"), 3: ("x.example.net", "/de/88", "example.net/de/8", "block"), 7: ("b.org", "/es/x", "org/es/", "block"), 9: ("com", "/en/", "com/en/", "block"), 10: ("y:", "//z.net/de/", None, None), 11: ("notexample.com", "/en/7", "com/en/", "block")}
    for k, (host, path, rule, verdict) in want.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert verdict is None or got[k]["verdict"] == verdict
    for k in (4, 5):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == ("", "", None)
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    logp = {"red": -1.0, "blue": -1.5, "redb": -9.0, "lue": -9.0}
    assert url_filter.segment("redblue", logp) == ["red", "blue"]
    assert url_filter.segment("redxblue", logp) == ["red", "x", "blue"]
    # naive Bayes by hand
    rows = list(got.values()) * 2
    label = lambda r: {"com/en/": 1, "org/es/": 1, "example.net/de/8": 1}.get(r["rule"], 0)
    known = [r for r in rows if r["rule"]]
    count = [Counter(t for r in known if label(r) == y for t in r["tokens"]) for y in (0, 1)]
    size = len(set(count[0]) | set(count[1])) + 1
    for r in got.values():
        odds = math.log((sum(map(label, known)) + 1) / (sum(1 - label(x) for x in known) + 1))
        odds += sum(math.log((count[1][t] + 1) / (sum(count[1].values()) + size)) - math.log((count[0][t] + 1) / (sum(count[0].values()) + size)) for t in r["tokens"])
        assert abs(odds - r["log_odds"]) < 1e-9


def test_url_filter_knows_all_words(spark):
    """Rare, one-letter and long words of a large vocabulary split hosts; the total counts all words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [f"q{letters[i // 17576]}{letters[i // 676 % 26]}{letters[i // 26 % 26]}{letters[i % 26]}" for i in range(52_000)]
    long = "rindfleischetikettierungsgesetz"
    html = " ".join(many * 2) + f" zebra tiger {long} y zebra"
    urls = ["http://zebratiger.example.org/x", f"http://tiger{long}.a-b.net/", "http://yzebray.com/", "http://yzebray.zebra.com/7", "http://zzz/", None]
    pages = spark.createDataFrame([(i, u, None if i else html) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["tokens"] for r in url_filter.judge_urls(pages).collect()}
    host = lambda i: [t[2:] for t in got[i] if t.startswith("h:")]
    count = Counter(html.split())
    logp = {w: math.log(n / sum(count.values())) for w, n in count.items()}
    split = lambda *parts: [w for p in parts for w in url_filter.segment(p, logp)]
    assert host(0) == ["zebra", "tiger", *split("example")]
    assert host(1) == ["tiger", long, "a", "b"]
    assert host(2) == ["y", "zebra", "y"] == host(3)[:3] and host(3)[3:] == ["zebra"]
    assert host(4) == host(5) == [] and len(got) == len(urls)


def test_language_id(spark, docs, empty):
    rnd = random.Random(2)
    make = lambda alphabet: " ".join("".join(rnd.choice(alphabet) for _ in range(5)) for _ in range(80))
    train = spark.createDataFrame([("aa", make("abcde")) for _ in range(20)] + [("bb", make("vwxyz")) for _ in range(20)] + [(None, "q"), ("aa", None)], "lang string, text string")
    model = language_id.train(train)
    assert model[0] == ["aa", "bb"]
    mixed = make("abcde") + " " + make("abcde") + " " + make("vwxyz")
    asked = spark.createDataFrame([(0, make("abcde")), (1, make("vwxyz")), (2, mixed), (3, None), (4, "12 !?"), (5, ""), (6, make("abcde") * 300)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["aa", "bb", "aa", "und", "und", "und", "aa"]
    assert got[2]["lang_set"] == ["aa", "bb"] and abs(got[2]["score"] - 2 / 3) < 0.05
    assert got[0]["score"] == 1.0 and got[3]["score"] == 0.0
    assert {r["lang_pred"] for r in language_id.identify(asked, language_id.train(train.limit(0))).collect()} == {"und"}
    # proportions by plain expectation-maximisation
    g = np.concatenate(list(language_id.trigrams(mixed)))
    p, share = model[1][g], np.array([0.5, 0.5])
    for _ in range(200):
        r = share * p
        share = (r / r.sum(1, keepdims=True)).mean(0)
    assert np.allclose(language_id.infer(language_id.gram_counts(mixed), model[1]), share, atol=1e-3)
    # pieces of any size give the same trigrams
    for text in (mixed, " 12 a", "a-", "", None, "!?", "ab  -- cd 7é"):
        whole = np.concatenate([np.zeros(0, np.int64), *language_id.trigrams(text)])
        for size in (1, 2, 7):
            assert np.array_equal(np.concatenate([np.zeros(0, np.int64), *language_id.trigrams(text, size)]), whole)
    # clashing columns are replaced, other ones and null ids stay; an empty table has no rows
    out = language_id.identify(docs.withColumn("lang_pred", F.lit(1)).withColumn("lang_set", F.lit(2)), model)
    assert sorted(out.columns) == sorted(["doc_id", "lang", "source", "n_chars", "kept", "lang_pred", "score", "lang_set"])
    assert sorted(r["doc_id"] is None for r in out.collect()) == sorted(d is None for d, *_ in ROWS)
    assert language_id.identify(empty, model).count() == 0
    assert language_id.train(empty)[0] == []


def test_language_sets_beside_siblings(spark):
    """A second language is found behind the main language's sibling, however little that was trained on."""
    rnd = random.Random(3)
    pool = lambda n, alphabet: ["".join(rnd.choice(alphabet) for _ in range(5)) for _ in range(n)]
    both, far = pool(200, "abcdefghij"), pool(200, "uvwxyz")
    words_of = {"es": both + pool(40, "abcdefghij"), "pt": both + pool(40, "abcdefghij"), "zh": far, "zz": pool(200, "klmno")}
    make = lambda lang, n: [rnd.choice(words_of[lang]) for _ in range(n)]
    for rows in ({"es": 20, "pt": 20, "zh": 20, "zz": 20}, {"es": 20, "pt": 3, "zh": 20, "zz": 20}):
        model = language_id.train(spark.createDataFrame([(k, " ".join(make(k, 150))) for k, n in rows.items() for _ in range(n)], "lang string, text string"))
        for share in (0.55, 0.7):
            text = make("es", int(300 * share)) + make("zh", 300 - int(300 * share))
            got = language_id.identify(spark.createDataFrame([(0, " ".join(text))], "doc_id long, text string"), model).first()
            assert got["lang_pred"] == "es" and got["lang_set"] == ["es", "zh"] and abs(got["score"] - share) < 0.08
        # the chosen set is the best of all sets by the penalised likelihood
        g = n = language_id.gram_counts(" ".join(make("es", 80) + make("zh", 40) + make("zz", 60)))
        at = np.flatnonzero(n)
        cost = language_id.PENALTY * np.log(n.sum() + 1)
        sets = [[i for i in range(4) if k >> i & 1] for k in range(1, 16)]
        best = max(sets, key=lambda c: language_id.em(model[1][at][:, c], n[at].astype(float))[1] - cost * len(c))
        assert np.flatnonzero(language_id.infer(g, model[1])).tolist() == best


def test_lm_score(docs, empty):
    out = lm_score.score_texts(docs).collect()
    assert len(out) == len(ROWS)
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 10 == 0
    tokens = [words(t, lower=True) + [None] for _, t, *_ in ROWS]
    count = Counter(w for (d, *_), ws in zip(ROWS, tokens, strict=True) if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    want = sorted(((d if d is not None else -1, len(ws), sum(count[w] > 0 for w in ws), n, round(base(ws), 6)) for (d, *_), ws in zip(ROWS, tokens, strict=True)))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) and math.isfinite(r["bits_per_byte"]) for r in out)
    assert lm_score.score_texts(empty).count() == 0
    none = lm_score.score_texts(docs, train_on=F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_lm_score_reads_texts_in_order(spark):
    """Word order counts, and how a text is cut into pieces does not."""
    rnd = random.Random(8)
    ring = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(40)]
    make = lambda: [ring[(b + k) % 40] for b in [rnd.randrange(40)] for k in range(80)]
    rows = [(i, " ".join(make())) for i in range(150)]
    mixed = rows[0][1].split()
    rnd.shuffle(mixed)
    df = spark.createDataFrame([*rows, (150, " ".join(mixed))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score_texts(df, train_on=F.col("doc_id").between(1, 149)).collect()}
    assert abs(got[0]["base_score"] - got[150]["base_score"]) < 1e-6
    assert got[0]["score"] / 81 > got[150]["score"] / 81 + 0.3
    # pieces of any size are the same units
    texts = [sentence(300), None, "", "a b c d e", "x" * 500 + " y", sentence(40), " \t lead and trail \n\n"]
    classes = np.sort(lm_score.Words(VOCABULARY[:40]).hash)
    whole = list(lm_score.pieces_of(texts, classes))[0]
    for most in (1, 50, 700):
        parts = list(lm_score.pieces_of(texts, classes, most))
        assert np.array_equal(np.concatenate([p.units for p in parts]), whole.units)
        assert sum(int(p.own.sum()) for p in parts) == len(whole.words.hash)


def brute_force_bits(train, texts, common, model):
    """Natural log probability of each text, bit by bit from dictionaries of whole contexts."""
    counts = {}

    def bits(text):
        ws = [w.decode("latin-1").lower() if w.isascii() else w.lower().decode("latin-1") for w in WORD.findall((text or "").encode())]
        stream, before, place = "", [], []
        for i, w in enumerate(ws):
            stream += w + (" " if i < len(ws) - 1 else "\n")
            before += [ws[i - 1] if i else None] * (len(w) + 1)
            place += range(len(w) + 1)
        stream, before, place = stream or "\n", before or [None], place or [0]
        for i, c in enumerate(stream):
            past = ("\n" * 8 + stream[:i])[-max(lm_score.ORDERS) :]
            word = re.split("[ \n]", past)[-1]
            seen = before[i] if before[i] in common and place[i] < lm_score.NEAR else None
            keys = [*(past[-k:] for k in lm_score.ORDERS), word, (word, seen)]
            code = f"{ord(c):08b}"
            for j in range(8):
                yield [(k, key, code[:j]) for k, key in enumerate(keys)], int(code[j]), int("1" + code[:j], 2)

    for t in train:
        for keys, bit, _ in bits(t):
            for k in keys:
                counts.setdefault(k, [0, 0])[bit] += 1
    out = []
    for t in texts:
        total = 0.0
        for keys, bit, seen in bits(t):
            got = [counts.get(k, [0, 0]) for k in keys]
            step = [0 if not n else 1 + (n > 2) + (n > 14) + (n > 62) for n in map(sum, got)]
            gate = ([0] + [(k + 1) * lm_score.STEPS + s - 1 for k, s in enumerate(step[: len(lm_score.ORDERS)]) if s])[-1] * (lm_score.STEPS + 1) + step[len(lm_score.ORDERS)]
            z = sum((model.weights[0][gate][k] + model.weights[1][seen][k]) * math.log((o + lm_score.DELTA) / (n + lm_score.DELTA)) for k, (n, o) in enumerate(got))
            z = max(-lm_score.LIMIT, min(lm_score.LIMIT, z))
            at = (z + lm_score.LIMIT) / (2 * lm_score.LIMIT) * (lm_score.BINS - 1)
            low = min(int(at), lm_score.BINS - 2)
            p = model.refine[seen][low] * (1 - at + low) + model.refine[seen][low + 1] * (at - low)
            p = (p + 1 / (1 + math.exp(-z))) / 2
            total += math.log(p if bit else 1 - p)
        out.append(total)
    return out


def test_lm_score_is_the_sum_of_its_bits(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "Ab", "cab", "é", "bad"]) for _ in range(rnd.randint(0, 12))) for _ in range(12)] + [None, "new words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taught = [t for i, t in enumerate(texts) if i % 3]
    got = {r["doc_id"]: r for r in lm_score.score_texts(df, train_on=F.col("doc_id") % 3 != 0).collect()}
    common = {"the", "ab", "cab", "é", "bad", "new", "words", "here"}
    hashes = np.sort(lm_score.Words(sorted({w for t in taught for w in words(t, lower=True)})).hash)
    model, _ = lm_score.train(df.where("doc_id % 3 != 0").select("text"), hashes)
    want = brute_force_bits(taught, texts, {w.encode().decode("latin-1") for w in common}, model)
    for i, w in enumerate(want):
        assert abs(got[i]["score"] - w / math.log(10)) < 1e-3, i
        assert abs(got[i]["bits_per_byte"] + w / math.log(2) / max(1, len((texts[i] or "").encode()))) < 1e-2
    # over all bytes after a context the probabilities add up to one
    unit = np.uint64(int.from_bytes(b"e the \0", "big")) + np.arange(256, dtype=np.uint64)
    assert abs(np.exp(model.coded(unit)).sum() - 1) < 1e-6


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(400)] + [(None, 1, 1), (3, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    data = spark.createDataFrame([(i, sentence(40) if i % 2 else sentence(20).replace(" ", "!! ### ")) for i in range(400)], "doc_id long, text string")
    model = quality.train(data, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(data, model).collect()}
    assert all((out[i] >= 0.5) == bool(i % 2) for i in range(400))
    assert len(quality.score_quality(docs, model).collect()) == len(ROWS)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.train(data, labels.limit(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    one = quality.train(data, labels.where("quality = 1"))
    assert 0.9 < one.score(np.zeros((1, len(quality.FEATURES))))[0] < 1
    # scoring by loops over the tables
    x = quality.features([t for _, t, *_ in ROWS])
    for row, s in zip(x, model.score(x), strict=True):
        z = model.base + sum(t[int((e <= v).sum())] for e, t, v in zip(model.edges, model.single, row, strict=True))
        z += sum(t[int((model.coarse[a] <= row[a]).sum()), int((model.coarse[b] <= row[b]).sum())] for (a, b), t in zip(model.pairs, model.double, strict=True))
        assert abs(1 / (1 + math.exp(-max(-30, min(30, z)))) - s) < 1e-9


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, empty, hot):
    count = Counter()
    for _, t, *_ in ROWS:
        w = words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for d, t, *_ in ROWS:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = substring_dedup.remove_repeats(docs, hot=hot)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect(), want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_minhash_dedup(docs, empty):
    sets = []
    for _, t, *_ in ROWS:
        w = words(t, lower=True)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    head = list(range(len(ROWS)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, *_) in enumerate(ROWS):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    want = []
    for i, (d, *_) in enumerate(ROWS):
        c = ids.get(find(i)) if sets[i] else d
        want.append((d, len(sets[i]), c, d == c))
    same(minhash_dedup.near_duplicates(docs, words=4).drop("k1", "k2").collect(), want)
    kept = minhash_dedup.drop_near_duplicates(docs, words=4)
    assert kept.columns == docs.columns
    same(kept.collect(), [r for r, w in zip(ROWS, want, strict=True) if w[3]])
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_joint_estimate_is_close():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.8, 0.95):
        n = 400
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        regs = minhash_dedup.registers([np.unique(x[:n]), np.unique(x[-n:])]).astype(int)
        got = minhash_dedup.joint_estimate(np.array([float(n)]), np.array([float(n)]), np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]))[0]
        assert abs(got - both / (2 * n - both)) < 0.12
    union = minhash_dedup.registers([np.unique(x)])[0]
    assert (union == regs.max(0)).all()  # sketches merge by the larger register


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = tokenize_sp.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = tokenize_sp.encode_texts(docs, model)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "kept", "score", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, *_ in ROWS:
        ids = sp.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), ids))
    same(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect(), want)
    t, rnd = tokenize_sp.table(model), random.Random(11)
    pool = [" ", "   ", "\n", "\t", "▁", "é", "中", "🙂", "\x00", "==", "<0x0A>", "</s>", "\u0301", *[p.replace("▁", " ") for p in t.pieces[259:]]]
    for _ in range(3000):
        text = "".join(rnd.choice(pool if rnd.random() < 0.7 else pool[:13]) for _ in range(rnd.randint(0, 10)))
        assert t.encode(text) == sp.encode(text), text
        assert t.decode(sp.encode(text)) == sp.decode(sp.encode(text)) == t.encoded(text)[1]
    assert tokenize_sp.encode_texts(empty, model).count() == 0
    # long texts in parts, words that are not kept, and caches that run full change nothing
    old = tokenize_sp.WHOLE, tokenize_sp.PART, tokenize_sp.CACHE, tokenize_sp.PAIRS, tokenize_sp.LONG
    tokenize_sp.WHOLE, tokenize_sp.PART, tokenize_sp.CACHE, tokenize_sp.PAIRS, tokenize_sp.LONG = 0, 3, 500, 5, 6
    for text in [t for _, t, *_ in ROWS[:30]] + ["x" * 5000, " a\n\n b" * 40]:
        ids, plain = zip(*t.parts(text), strict=True) if text else ((), ())
        assert [int(i) for part in ids for i in part.split(",")] == sp.encode(text or "")
        assert "".join(plain) == sp.decode(sp.encode(text or ""))
    tokenize_sp.WHOLE, tokenize_sp.PART, tokenize_sp.CACHE, tokenize_sp.PAIRS, tokenize_sp.LONG = old


def test_topk(spark):
    rnd = random.Random(4)
    data = [(i, [rnd.choice([-1.0, 0.3, 0.5, rnd.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    data += [(300, None), (None, [1.0] * 6), (301, [float("nan")] * 6), (302, [None] * 6), (303, [1.0, 2.0]), (20, data[20][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string").repartition(4)
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in dict((i, v) for i, v in good if i % 20 == 0).items():
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    old = topk.BLOCK, topk.SHARD, topk.QUERY_GROUP
    for topk.BLOCK, topk.SHARD, topk.QUERY_GROUP in ((256, 16384, 2048), (4, 50, 4)):
        same(topk.top_k(df, F.col("vec_id") % 20 == 0).collect(), want)
    topk.BLOCK, topk.SHARD, topk.QUERY_GROUP = old
    # one row that holds most of the table is spread over the shards, and all its copies count
    topk.BLOCK, topk.SHARD = 4, 64
    hot = spark.createDataFrame([(7, [1.0, 1.0])] * 500 + [(i, [float(i % 3), 0.5]) for i in range(20, 60)], "vec_id long, embedding array<float>").repartition(4)
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(hot, F.col("vec_id") == 23).orderBy("rank").collect()]
    vec = lambda i: [64, 64] if i == 7 else [64 * (i % 3), 32]
    dots = sorted((-sum(a * b for a, b in zip(vec(23), vec(i), strict=True)), i) for i in [7] * 500 + [j for j in range(20, 60) if j != 23])
    assert got == [(i, -s) for s, i in dots[:20]]
    topk.BLOCK, topk.SHARD, topk.QUERY_GROUP = old
    few = topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0)
    assert [r["vec_id"] for r in few.collect()] == [1]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # pruning skips blocks without changing the result
    x = np.sort(np.random.default_rng(1).normal(size=(4000, 2)) * 50, axis=0).round()
    row, ids, score = topk.prune_top_k(np.arange(3), x[:3], np.arange(10, 4010), x, 20, 100)
    for i in range(3):
        s = x @ x[i]
        best = sorted(zip(-s, range(10, 4010), strict=True))[:20]
        assert sorted(zip(-score[row == i], ids[row == i], strict=True)) == best
    with pytest.raises(ValueError):
        topk.prune_top_k(np.zeros(1), np.zeros((1, 1)), np.zeros(1 << 20), np.zeros((1 << 20, 1)))


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    table = docs.drop("kept", "score")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    # brute force: with one class all are kept; then copies; then near copies of five-word shingles
    rows_, best = [r[:5] for r in ROWS], {}
    for r in rows_:
        best[r[1] or ""] = max([x for x in (best.get(r[1] or ""), r[0]) if x is not None], default=None)
    rows_ = [r for r in rows_ if r[0] == best[r[1] or ""]]
    shingles = []
    for r in rows_:
        w = words(r[1], lower=True)
        shingles.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    head = list(range(len(rows_)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows_)):
        for j in range(i):
            if shingles[i] and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: (rows_[k][0] is None, rows_[k][0]))
                head[b] = a
    left = [r for i, r in enumerate(rows_) if find(i) == i]
    assert sorted((r["doc_id"] for r in got)) == sorted(r[0] for r in left)
    t = tokenize_sp.table(tokenize_sp.default_model())
    text = {r[0]: r[1] for r in left}
    for r in got:
        assert r["ids"] == t.encode(text[r["doc_id"]])
    order = corpus_pipeline.mix(spark, table, folder)
    same(order.collect(), table.collect())
