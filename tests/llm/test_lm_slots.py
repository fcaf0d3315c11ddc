"""The table of bit counts: slots that several contexts share, and units dealt to many tasks."""

import random
from collections import defaultdict

import numpy as np
import pytest

from entitylink.llm import lm_score

RND = random.Random(21)
WORDS = ["".join(RND.choice("abcdé") for _ in range(RND.randint(1, 8))) for _ in range(150)]
TEXTS = [" ".join(RND.choices(WORDS, k=RND.randint(1, 200))) for _ in range(40)] + ["the cat", "", None]
CLASSES = np.sort(lm_score.Words(WORDS[:20]).hash)


def counted():
    tally = lm_score.Tally()
    for piece in lm_score.pieces_of(TEXTS, CLASSES):
        tally.add(piece.units)
    return tally.take()


def brute(units, times):
    """Winner of each slot from dictionaries of whole contexts: most frequent, then by tag and ones."""
    seen = defaultdict(lambda: [0, 0])
    for k, codes in enumerate(lm_score.contexts(units)):
        for code, unit, n in zip(codes.tolist(), units.tolist(), times.tolist(), strict=True):
            before = 1
            for i in range(8):
                bit = (unit & 255) >> (7 - i) & 1
                seen[k, code, before][bit] += n
                before = before * 2 + bit
    best = {}
    for (k, code, before), (zeros, ones) in seen.items():
        h = np.array([(code + before * 0xD1B54A32D192ED03) * lm_score._ODD % 2**64], np.uint64)
        key = (zeros + ones, int(lm_score.tag(h)[0]), min(ones, lm_score.MOST))
        at = int(lm_score.slot(h, k)[0])
        if at not in best or key > best[at][0]:
            most = max(zeros, ones, lm_score.MOST)
            best[at] = key, (-(-zeros * lm_score.MOST // most), -(-ones * lm_score.MOST // most))
    assert len(best) < 0.8 * len(seen)  # slots are shared
    return best


def as_best(winners):
    out = {}
    for slots, ranks, counts in winners:
        for s, r, c in zip(slots.tolist(), ranks.tolist(), counts.tolist(), strict=True):
            if s not in out or r > out[s][0]:
                out[s] = r, c
    return {s: ((r >> 22, r >> 10 & 4095, r & 1023), (c >> 10, c & 1023)) for s, (r, c) in out.items()}


@pytest.mark.parametrize("bits", [6, 11])
@pytest.mark.parametrize("most", [40, 2000])
def test_shared_slots(monkeypatch, bits, most):
    monkeypatch.setattr(lm_score, "SLOT_BITS", bits)
    units, times = counted()
    want = brute(units, times)
    byte = (units & np.uint64(255)).astype(np.uint8)
    assert as_best(lm_score.best_slots(code, byte, times, k) for k, code in enumerate(lm_score.contexts(units))) == want
    # the same units dealt by the bytes before, short contexts added up across tasks
    crowded, left = {}, units
    for length in range(lm_score.NEAREST, lm_score.REACH):
        endings, n = np.unique(lm_score.suffix(left, length), return_counts=True)
        crowded[length] = endings[n > most]
        left = left[np.isin(lm_score.suffix(left, length), crowded[length])]
    level, length = lm_score.levels(units, crowded), lm_score.word_length(units)
    task = np.array([int(lm_score.suffix(u, int(n))) * 7 + int(n) for u, n in zip(units, level, strict=True)]) % 5
    winners, rest = [], defaultdict(int)
    for t in range(5):
        mine = task == t
        for k, code in enumerate(lm_score.contexts(units[mine])):
            whole = (lm_score.ORDERS[k] if k < len(lm_score.ORDERS) else length[mine]) >= level[mine]
            winners.append(lm_score.best_slots(code[whole], byte[mine][whole], times[mine][whole], k))
            for c, b, n in zip(code[~whole].tolist(), byte[mine][~whole].tolist(), times[mine][~whole].tolist(), strict=True):
                rest[k, c, b] += n
    assert (most == 40) == any(len(x) for x in crowded.values())
    for k in {k for k, _, _ in rest}:
        code, b, n = (np.array(x) for x in zip(*[(np.uint64(c), b, n) for (kind, c, b), n in rest.items() if kind == k], strict=True))
        winners.append(lm_score.best_slots(code.astype(np.uint64), b.astype(np.uint8), n, k))
    assert as_best(winners) == want


def test_table_does_not_depend_on_tasks(spark, monkeypatch):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    tables = []
    for shard in (1_500_000, 900, 60):
        monkeypatch.setattr(lm_score, "SHARD", shard)
        tables.append(lm_score.train(texts, CLASSES)[0].table.packed)
    assert (tables[0] > 0).sum() > 1000
    assert all((t == tables[0]).all() for t in tables)
