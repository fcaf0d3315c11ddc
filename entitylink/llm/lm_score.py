"""Language-model scores by online logistic context mixing along the text.

A text is coded as its words in order (A-Z lower-cased), each closed by a space and the last one by a line
end, byte by byte and each byte bit by bit; a text without words is its line end. For every bit, one
predictor per context reads the counts of zeros and ones seen after the hash of the context and the bits so
far. Contexts are the last bytes by ``ORDERS``, across spaces, and at word level the word so far (its last
``REACH`` bytes) with the whole word before it, where that one is among the ``FREQUENT`` commonest words and
the byte is one of the first ``NEAR`` of its word, and once more without that word. The stretched probabilities are combined by
weights from two sets, one selected by a gate (the longest context seen, how often it was, and how often the
word so far was), the other by the byte's bits so far. An adaptive table, indexed by the bits so far and the mixed prediction, refines the result.
The sum of these bits is the text's score; nothing else enters it.

All a byte's prediction depends on fits a 64-bit key, its unit: the byte, the ``REACH`` bytes before it and
the class of the word before. So the work is done once per distinct unit, exactly:

- Tasks turn their running training texts into units and count them; the counts are summed in a shuffle and
  grow with the corpus.
- The bits of the counted units make a table of ``CONTEXTS * 2**SLOT_BITS`` slots, a fixed size that may be
  broadcast. A slot belongs to the most frequent of the contexts that share it, told apart by a tag; the
  others count as unseen there, so that they lend no false counts and shorter contexts speak for them. Units
  are dealt by the last bytes before theirs, so a task has every context of at least that length whole;
  shorter ones (the start of a word, endings that very many units share) are added up by context first. So
  the table does not depend on the number of tasks.
- Weights and refinement are learned online over the counted units: a batch, each unit weighing as often as
  it occurs, is predicted with one occurrence of its own taken out of the counts, then the weights are
  corrected before the next batch. Tasks start alike and are averaged by the occurrences they saw.
- Scoring passes the running texts again and looks scored units up in a table of fixed size per worker, which
  begins with the commonest units; others are scored when they are met.

Token counts, for the base score, are summed by 64-bit hash of the word. Words with at least a ``HEAVY``-th
of all tokens, of which there can be no more than ``HEAVY``, are broadcast; a text's other words travel to
their counts, and the parts are summed per document by two 64-bit hashes of its id and text.

Defined results: a null text counts as empty and has one token, its end. Without any training text every
count is zero, the base score is log10(0.1 / 0.1) per token, and every bit has probability one half. Rows
equal in id and text are returned as often as they occur. A null id counts as the empty string in the
hold-out rule. Words of any length are coded whole; long texts are cut between words, each piece with the
words before it as context, which changes no result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm.common import _LOWER, _SPACES, Words, crc_mod, mix64, row_key, slices, trimmed

ORDERS = (2, 3, 4, 6)
REACH = max(ORDERS)
CONTEXTS = len(ORDERS) + 2
SLOT_BITS = 20
FREQUENT = 255
NEAR = 4
HEAVY = 500_000
PIECE = 1 << 19  # bytes of running text that are looked at together
UNITS = 1_500_000  # distinct units that a task gathers before it learns from them
TASK = 2_000_000  # words of running text that one task gathers units from, at least, beyond FEW tasks
FEW = 8
TYPES = 500_000  # distinct words that a task gathers before it hands them on
SHARD = 1_500_000  # distinct units whose bits one task adds up, on average
NEAREST = min(ORDERS)  # bytes before a unit that it is dealt by, at least
LESSON = 500_000  # distinct units that one task learns from
BATCH = 4096
CHUNK = 1 << 16
RATE = 0.3
DELTA = 0.05
STEPS = 4  # confidence steps of the gate
GATES = (len(ORDERS) + 1) * STEPS * (STEPS + 1)
MOST = 1023  # larger counts of zeros and ones are scaled down together
BINS = 33
LIMIT = 11.0
MEMO_BITS = 22  # places of scored units in a worker

_ODD = 0x9E3779B97F4A7C15
_END, _SPACE = 10, 32
_BLANK = re.compile(b"[\x20\x09-\x0d]")
_FLAT = _LOWER.translate(bytes(_SPACE if b in _SPACES else b for b in range(256)))
_SHARED = np.array([8 - x.bit_length() for x in range(256)], np.int8)
_LOG = np.log(np.arange(MOST + 1) + DELTA).astype(np.float32)


# ---- running text as units ---------------------------------------------------------------------


@dataclass
class Piece:
    """Some consecutive texts or parts of one long text: words, and the units of all bytes in order."""

    words: Words
    own: np.ndarray  # words that are no mere context
    word_text: np.ndarray  # text number of each word
    units: np.ndarray
    ends: np.ndarray  # places in units where the segments end
    texts: np.ndarray  # text number of each segment


def cut_texts(texts: list[str | None], most: int) -> Iterator[list[tuple[int, bytes, int, bool]]]:
    """Groups of segments: text number, bytes, how many words are only context, does the text end here."""
    held, n = [], 0
    for k, text in enumerate(texts):
        raw, begin, lead = (text or "").encode().rstrip(_SPACES), 0, []
        while begin is not None:
            gap = _BLANK.search(raw, begin + most)
            end = gap.start() if gap else len(raw)
            segment = b" ".join([*lead, raw[begin:end]])
            held.append((k, segment, len(lead), gap is None))
            n += end - begin + 1
            if n >= most:
                yield held
                held, n = [], 0
            lead = segment.rsplit(None, 3)[-3:] if gap else []
            begin = end if gap else None
    if held:
        yield held


def pieces_of(texts: list[str | None], classes: np.ndarray, most: int = PIECE) -> Iterator[Piece]:
    """``classes``: sorted hashes of the words that make a context for the next word."""
    for segments in cut_texts(texts, most):
        number, raw, lead, last = (np.array(x) if i != 1 else x for i, x in enumerate(zip(*segments, strict=True)))
        w = Words(raw, lower=True)
        data = np.frombuffer(w.buffer.translate(_FLAT), np.uint8).copy()
        keep = data != _SPACE
        keep[w.end] = True
        size, count = w.end - w.start + 1, np.diff(w.first)
        closing = w.end[w.first[1:][last & (count > 0)] - 1]
        lone = w.offset[1:][last & (count == 0)] - 1
        data[closing], data[lone], keep[lone] = _END, _END, True
        stream = data[keep]
        until = np.concatenate([[0], np.cumsum(size)])
        sizes = np.where(last & (count == 0), 1, until[w.first[1:]] - until[w.first[:-1]])
        ends = np.cumsum(sizes)
        units = stream.astype(np.uint64)
        for k in range(1, REACH + 1):
            units[k:] |= stream[:-k].astype(np.uint64) << np.uint64(8 * k) if k < len(stream) else np.uint64(0)
        # before a text's start all bytes count as line ends
        tens = np.uint64(int.from_bytes(bytes([_END] * (REACH + 1)), "big"))
        for k in range(REACH):
            at = (ends - sizes + k)[sizes > k]
            inside = np.uint64((1 << 8 * (k + 1)) - 1)
            units[at] = units[at] & inside | tens & ~inside
        if len(classes):
            at = np.minimum(np.searchsorted(classes, w.hash), len(classes) - 1)
            cls = np.where(classes[at] == w.hash, at + 1, 0).astype(np.uint64) << np.uint64(8 * (REACH + 1))
            cls[1:] = cls[:-1]
            cls[w.first[:-1][count > 0]] = 0
            begin = until[:-1] + np.repeat(np.cumsum(sizes - (until[w.first[1:]] - until[w.first[:-1]])), count)
            for k in range(NEAR):
                near = size > k
                units[begin[near] + k] |= cls[near]
        own = np.ones(len(size), bool)
        if lead.any():
            skip = np.zeros(len(units), bool)
            for s in np.flatnonzero(lead):
                a, b = w.first[s], w.first[s] + lead[s]
                own[a:b] = False
                skip[ends[s] - sizes[s] : ends[s] - sizes[s] + until[b] - until[a]] = True
            ends = np.cumsum(np.concatenate([[0], ~skip]))[ends]
            units = units[~skip]
        yield Piece(w, own, np.repeat(number, count), units, ends, number)


class Tally:
    """How often each 64-bit value occurs; sorted runs that are merged as they grow."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        if len(values):
            v = np.sort(values)
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            self._keep(v[first], np.diff(np.concatenate([first, [len(v)]])))

    def _keep(self, v: np.ndarray, n: np.ndarray) -> None:
        self.runs.append((v, n.astype(np.uint32)))
        self.size += len(v)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.runs) > 1:
            v, n = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            self.runs, self.size = [], 0
            order = np.argsort(v, kind="stable")
            v, n = v[order], n[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            self._keep(v[first], np.add.reduceat(n, first))
        return self.runs[0] if self.runs else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """When there are more than ``most`` values, the rarer of them; the others stay."""
        if self.size <= 1.5 * most:
            return None
        v, n = self.merged()
        if len(v) <= most:
            return None
        rare = n <= np.partition(n, len(n) - most // 2)[len(n) - most // 2]
        self.runs, self.size = [], 0
        self._keep(v[~rare], n[~rare])
        return v[rare], n[rare].astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        v, n = self.merged()
        self.runs, self.size = [], 0
        return v, n.astype(np.int64)


# ---- the model ---------------------------------------------------------------------------------


def contexts(units: np.ndarray) -> Iterator[np.ndarray]:
    """Hash of every context of each unit's byte, one kind of context after another."""
    before = units >> np.uint64(8) & np.uint64((1 << 8 * REACH) - 1)
    low = lambda k: before & np.uint64((1 << 8 * k) - 1)
    for k in ORDERS:
        yield mix64(low(k) | np.uint64(k << 56))
    word, inside, length = np.zeros_like(units), np.ones(len(units), bool), np.zeros_like(units)
    for k in range(1, REACH + 1):
        b = units >> np.uint64(8 * k) & np.uint64(255)
        inside &= (b != _SPACE) & (b != _END)
        word = np.where(inside, low(k), word)
        length += inside
    cls = units >> np.uint64(8 * (REACH + 1))
    word |= length << np.uint64(8 * REACH)
    yield mix64(word | np.uint64(1 << 60))
    yield mix64(word | cls << np.uint64(8 * REACH + 3))


def planes(units: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """For bit 0 to 7: the bits, the hashes by context of what precedes them, and the bits so far after a one."""
    codes, byte = list(contexts(units)), (units & np.uint64(255)).astype(np.int32)
    seen = np.ones(len(units), np.int32)
    for i in range(8):
        step, bit = seen.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), byte >> (7 - i) & 1
        yield bit, [(code + step) * np.uint64(_ODD) for code in codes], seen
        seen = seen * 2 + bit


def slot(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32) + np.int32(k << SLOT_BITS)


def tag(h: np.ndarray) -> np.ndarray:
    """What tells contexts in one slot apart."""
    return (h >> np.uint64(52 - SLOT_BITS)).astype(np.uint32) & np.uint32(4095)


def steps(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, or 1 to ``STEPS`` by how often it was seen."""
    return (n > 0).view(np.uint8) + (n > 2) + (n > 14) + (n > 62)


def gates(often: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(often[0]), np.uint8)
    for k, o in enumerate(often[: len(ORDERS)]):
        out = np.where(o > 0, np.uint8((k + 1) * STEPS - 1) + o, out)
    return out * np.uint8(STEPS + 1) + often[len(ORDERS)]


def mixed(weights: tuple[np.ndarray, np.ndarray], x: list[np.ndarray], gate: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Every gate and every sequence of bits so far has its weights; both are added."""
    z = np.zeros(len(gate), np.float32)
    for k, row in enumerate(x):
        z += (weights[0][k][gate] + weights[1][k][seen]) * row
    return np.clip(z, -LIMIT, LIMIT)


class Table:
    """Tag (12 bits), zeros and ones (10 bits each) by slot, each slot for the context with its tag."""

    def __init__(self) -> None:
        self.packed = np.zeros(CONTEXTS << SLOT_BITS, np.uint32)

    def counts(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones after contexts with these hashes; none for a context that is not held."""
        got = self.packed[slot(h, k)]
        got *= (got >> np.uint32(20)) == tag(h)
        return (got >> np.uint32(10) & np.uint32(MOST)).astype(np.int32), (got & np.uint32(MOST)).astype(np.int32)


@dataclass
class Model:
    """Bit counts, gated weights and refinement table; without the counts where those travel on their own."""

    table: Table | None
    weights: tuple[np.ndarray, np.ndarray]
    refine: np.ndarray
    classes: np.ndarray
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))  # units with their scores
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def refined(self, z: np.ndarray, seen: np.ndarray) -> np.ndarray:
        at = (z + np.float32(LIMIT)) * np.float32((BINS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype(np.int32), BINS - 2)
        part = at - low
        flat, cell = self.refine.ravel(), seen * BINS + low
        p = flat[cell] * (1 - part) + flat[cell + 1] * part
        return np.clip((p + 1 / (1 + np.exp(-z.astype(np.float64)))) / 2, 1e-6, 1 - 1e-6)

    def coded(self, units: np.ndarray) -> np.ndarray:
        """Natural log probability of each unit's byte."""
        out, weights = np.zeros(len(units)), tuple(np.ascontiguousarray(w.T.astype(np.float32)) for w in self.weights)
        for i in range(0, len(units), CHUNK):
            for bit, hashes, seen in planes(units[i : i + CHUNK]):
                x, often = [], []
                for k, h in enumerate(hashes):
                    zeros, ones = self.table.counts(h, k)
                    x.append(_LOG[ones] - _LOG[zeros])
                    often.append(steps(zeros + ones))
                p = self.refined(mixed(weights, x, gates(often), seen), seen)
                out[i : i + CHUNK] += np.log(np.where(bit, p, 1 - p))
        return out


def memo_place(units: np.ndarray) -> np.ndarray:
    return (units * np.uint64(_ODD) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)


class Memo:
    """Scores of units, in a table of fixed size that begins with the commonest ones and keeps the last."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.held, self.found = np.zeros(1 << MEMO_BITS, np.uint64), np.zeros(1 << MEMO_BITS, np.float32)
        self.held[0] = 1  # no unit's place is 0 but that of unit 0
        self.put(*model.common)
        model.common = model.common[0][:0], model.common[1][:0]

    def put(self, units: np.ndarray, found: np.ndarray) -> None:
        place, first = np.unique(memo_place(units), return_index=True)
        self.held[place], self.found[place] = units[first], found[first]

    def coded(self, units: np.ndarray) -> np.ndarray:
        at = memo_place(units)
        out, new = self.found[at], np.flatnonzero(self.held[at] != units)
        if len(new):
            each, back = np.unique(units[new], return_inverse=True)
            found = self.model.coded(each).astype(np.float32)
            out[new] = found[back]
            self.put(each, found)
        return out


_MEMO: list[Memo] = []


def memo(model: Model) -> Memo:
    """The table of this worker process; it lives as long as the model stays the same."""
    if not _MEMO or _MEMO[0].model.name != model.name:
        _MEMO[:] = [Memo(model)]
    return _MEMO[0]


def fresh() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Even weights by gate and by the bits so far, and a refinement that changes nothing."""
    grid = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, BINS)))
    return np.full((GATES, CONTEXTS), 0.3), np.zeros((256, CONTEXTS)), np.tile(grid, (256, 1))


class Learner:
    """Weights and refinement counts that one task learns online."""

    def __init__(self, table: Table) -> None:
        self.table, self.weights = table, fresh()[:2]
        self.sums, self.used = [np.zeros_like(w) for w in self.weights], [np.zeros(len(w)) for w in self.weights]
        self.hits, self.tries = np.zeros(256 * BINS), np.zeros(256 * BINS)

    def learn(self, units: np.ndarray, times: np.ndarray) -> None:
        """Predict a batch with one occurrence of each unit taken out of the counts, then correct the weights."""
        for i in range(0, len(units), BATCH):
            n = times[i : i + BATCH].astype(np.float64)
            for bit, hashes, seen in planes(units[i : i + BATCH]):
                x, often = [], []
                for k, h in enumerate(hashes):
                    zeros, ones = self.table.counts(h, k)
                    zeros, ones = np.maximum(zeros - 1 + bit, 0), np.maximum(ones - bit, 0)
                    x.append(_LOG[ones] - _LOG[zeros])
                    often.append(steps(zeros + ones))
                gate = gates(often)
                z = mixed(tuple(w.T.astype(np.float32) for w in self.weights), x, gate, seen)
                error = (bit - 1 / (1 + np.exp(-z))) * n
                step = [error * row for row in x]
                for w, total, used, at in zip(self.weights, self.sums, self.used, (gate, seen), strict=True):
                    size = np.bincount(at, n, len(w))
                    w += RATE * np.stack([np.bincount(at, e, len(w)) for e in step], 1) / (size + 200)[:, None]
                    total += w * size[:, None]
                    used += size
                cell = seen * BINS + np.rint((z + LIMIT) * ((BINS - 1) / (2 * LIMIT))).astype(np.int64)
                self.hits += np.bincount(cell, bit * n, 256 * BINS)
                self.tries += np.bincount(cell, n, 256 * BINS)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums and occurrences of the weights, then of the refinement."""
        seen = [np.repeat(n, CONTEXTS) for n in self.used]
        return np.concatenate([*(s.ravel() for s in self.sums), self.hits]), np.concatenate([*seen, self.tries])


def averaged(place: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Weights and refinement from the sums of all tasks."""
    *weights, refine = fresh()
    flat = np.concatenate([w.ravel() for w in weights])
    w = place < len(flat)
    flat[place[w]] = total[w] / n[w]
    r = place[~w] - len(flat)
    refine.ravel()[r] = (total[~w] + 20 * refine.ravel()[r]) / (n[~w] + 20)
    cut = weights[0].size
    return (flat[:cut].reshape(-1, CONTEXTS), flat[cut:].reshape(-1, CONTEXTS)), refine


def suffix(units, length: int):
    """The last ``length`` bytes before each unit's byte, as a number."""
    return units >> np.uint64(8) & np.uint64((1 << 8 * length) - 1)


def levels(units: np.ndarray, crowded: dict[int, np.ndarray]) -> np.ndarray:
    """How many bytes before its own a unit is dealt by: as few as are not crowded, two at least."""
    out = np.full(len(units), NEAREST, np.int8)
    for length in sorted(crowded):
        here = out == length
        out[here] += np.isin(suffix(units[here], length), crowded[length])
    return out


def word_length(units: np.ndarray) -> np.ndarray:
    """Bytes of the word so far, ``REACH`` at most."""
    inside, length = np.ones(len(units), bool), np.zeros(len(units), np.int8)
    for k in range(1, REACH + 1):
        b = units >> np.uint64(8 * k) & np.uint64(255)
        inside &= (b != _SPACE) & (b != _END)
        length += inside
    return length


def best_slots(mine: np.ndarray, byte: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Slot, rank and counts of the most frequent context in every slot, among whole contexts of one kind.

    A slot's contexts are ranked by how often they occur, then by tag and ones, so whichever tasks they come
    from the same one stays.
    """
    order = np.argsort(mine << np.uint64(8) | byte, kind="stable")
    code, b, n = mine[order], byte[order], times[order]
    del order
    # how many bits of the byte a unit shares with the one before it in the same context
    shared = np.where(code[1:] == code[:-1], _SHARED[b[1:] ^ b[:-1]], -1).astype(np.int8)
    shared = np.concatenate([np.full(min(1, len(code)), -1, np.int8), shared])
    best, counts = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int32)
    for i in range(8 if len(code) else 0):
        first = np.flatnonzero(shared < i)
        one, total = np.add.reduceat(n * (b >> (7 - i) & 1), first), np.add.reduceat(n, first)
        seen = (1 << i | b[first].astype(np.int32) >> (8 - i)).astype(np.uint64)
        h = (code[first] + seen * np.uint64(0xD1B54A32D192ED03)) * np.uint64(_ODD)
        at = slot(h, 0)
        rank = np.minimum(total, 1 << 40) << 22 | tag(h).astype(np.int64) << 10 | np.minimum(one, MOST)
        np.maximum.at(best, at, rank)
        won = best[at] == rank
        at, one, total = at[won], one[won], total[won]
        most = np.maximum(np.maximum(one, total - one), MOST)
        counts[at] = -(-(total - one) * MOST // most) << 10 | -(-one * MOST // most)
    at = np.flatnonzero(best >= 0)
    return (at + (k << SLOT_BITS)).astype(np.int32), best[at], counts[at]


def gather(classes):
    """Training texts -> unit, n: how often each unit occurs; partial."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _MEMO.clear()  # of a model before this one
        found = Tally()

        def out(units: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(units.view(np.int64)), pa.array(times)], ["unit", "n"])

        for b in slices(batches):
            for piece in pieces_of(b.column(0).to_pylist(), classes.value):
                found.add(piece.units)
                if rare := found.spill(UNITS):
                    yield out(*rare)
        yield out(*found.take())

    return run


def _slots(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in found], names=["slot", "rank", "counts"])


def _shares(batches: Iterator[pa.RecordBatch], crowded: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of context of all units of a task: code, byte, occurrences, and is the context whole here."""
    held = [(b.column("unit").to_numpy().view(np.uint64), b.column("n").to_numpy()) for b in batches]
    if held:
        units, times = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        byte, level, length = (units & np.uint64(255)).astype(np.uint8), levels(units, crowded), word_length(units)
        for k, code in enumerate(contexts(units)):
            yield k, code, byte, times, (ORDERS[k] if k < len(ORDERS) else length) >= level


def slot_counts(crowded):
    """Units and their occurrences, dealt by the bytes before -> winners of slots among the task's whole contexts."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, code, byte, times, whole in _shares(batches, crowded.value):
            yield from _slots(best_slots(code[whole], byte[whole], times[whole], k))

    return run


def short_counts(crowded):
    """The same units -> ``kind, code, byte, n`` of contexts shorter than what the unit was dealt by; partial."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, code, byte, times, whole in _shares(batches, crowded.value):
            code, b, n = code[~whole], byte[~whole], times[~whole]
            order = np.lexsort((b, code))
            code, b, n = code[order], b[order], n[order]
            first = np.flatnonzero(np.concatenate([np.full(min(1, len(code)), True), (code[1:] != code[:-1]) | (b[1:] != b[:-1])]))
            if rows := len(first):
                cols = [pa.array(np.full(rows, k, np.int32)), pa.array(code[first].view(np.int64)), pa.array(b[first].astype(np.int32)), pa.array(np.add.reduceat(n, first))]
                yield pa.RecordBatch.from_arrays(cols, names=["kind", "code", "byte", "n"])

    return run


@trimmed
def summed_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole contexts as ``kind, code, byte, n`` -> winners of slots."""
    held = [[b.column(c).to_numpy() for c in ("kind", "code", "byte", "n")] for b in batches]
    if held:
        kind, code, byte, n = (np.concatenate(c) for c in zip(*held, strict=True))
        for k in np.unique(kind).tolist():
            at = kind == k
            yield from _slots(best_slots(code[at].view(np.uint64), byte[at].astype(np.uint8), n[at], k))


def learn_online(shared):
    """Units and their occurrences -> place, total, n: what a task learned."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(shared.value)
        for b in batches:
            units = b.column(0).to_numpy().view(np.uint64)
            order = np.argsort(units * np.uint64(_ODD))  # an order without pattern
            learner.learn(units[order], b.column(1).to_numpy()[order])
        total, n = learner.result()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(n[some])], ["place", "total", "n"])

    return run


def score_units(shared, table):
    """Units and their occurrences -> the same with the place in the scorers' tables and the score."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = replace(shared.value, table=table.value)
        for b in batches:
            units = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(memo_place(units).astype(np.int32)), *b.columns, pa.array(model.coded(units))], ["place", "unit", "n", "lp"])

    return run


def crowds(units: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Per length the endings that more than ``most`` distinct units share, to be dealt by one byte more; no more than units / most a length."""
    out: dict[int, np.ndarray] = {}
    for length in range(NEAREST, REACH):
        cut = F.expr(f"shiftright(unit, 8) & {(1 << 8 * length) - 1}L").alias("ending")
        shorter = F.expr(f"shiftright(unit, 8) & {(1 << 8 * (length - 1)) - 1}L")
        rows = units.where(shorter.isin(out[length - 1].tolist())) if length > NEAREST else units
        found = rows.groupBy(cut).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).toArrow()
        out[length] = np.sort(found.column("ending").to_numpy().astype(np.uint64))
        if not len(out[length]):
            break
    return out


def deal_key(crowded: dict[int, np.ndarray]):
    """The ending that a unit is dealt by, with its length."""
    key = F.expr(f"shiftright(unit, 8) & {(1 << 8 * REACH) - 1}L")
    for length in sorted(crowded, reverse=True):
        ending = F.expr(f"shiftright(unit, 8) & {(1 << 8 * length) - 1}L")
        key = F.when(ending.isin(crowded[length].tolist()), key).otherwise(ending + F.lit(length << 56))
    return key


def by_bucket(df: DataFrame, key: list, tasks: int) -> DataFrame:
    """Rows with equal keys in one task, in so many tasks as memory needs: the more contexts a task has, the fewer winners it sends."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(tasks)).cast("int").alias("bucket")
    return df.select("*", bucket).repartitionByRange(tasks, "bucket").drop("bucket")


def train(texts: DataFrame, classes: np.ndarray) -> tuple[Model, Broadcast]:
    """The model of all texts (one column), and its table where all tasks have it: that is sent only once."""
    context = texts.sparkSession.sparkContext
    units = texts.mapInArrow(gather(context.broadcast(classes)), "unit long, n long")
    # every task's rows are combined already, so nothing is gained by grouping them before the shuffle
    units = units.repartition("unit").groupBy("unit").agg(F.sum("n").alias("n"))
    units = materialize(units, "units")
    n = units.count()
    tasks = lambda most: max(1, -(-n // most))
    crowded = crowds(units, SHARD // 4)
    dealt = by_bucket(units, [deal_key(crowded)], tasks(SHARD))
    sent, row = context.broadcast(crowded), "slot int, rank long, counts int"
    short = dealt.mapInArrow(short_counts(sent), "kind int, code long, byte int, n long")
    short = by_bucket(short.groupBy("kind", "code", "byte").agg(F.sum("n").alias("n")), [F.col("kind"), F.col("code")], tasks(SHARD))
    found = dealt.mapInArrow(slot_counts(sent), row).unionByName(short.mapInArrow(summed_slots, row))
    got = found.groupBy("slot").agg(F.max("rank").alias("rank"), F.max_by("counts", "rank").alias("counts"))
    # the tag and the counts; at most CONTEXTS * 2**SLOT_BITS rows of 12 bytes
    got = got.select("slot", (F.shiftleft(F.shiftright("rank", 10).bitwiseAND(4095), 20) + F.col("counts").cast("long")).alias("c")).toArrow()
    table = Table()
    for b in got.to_batches():
        table.packed[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    del got
    units = units.repartition(tasks(LESSON), "unit")
    sent = context.broadcast(table)
    learned = units.mapInArrow(learn_online(sent), "place long, total double, n double").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    model = Model(table, *averaged(*(learned.column(c).to_numpy() for c in ("place", "total", "n"))), classes)
    shared = context.broadcast(replace(model, table=None))
    scored = units.mapInArrow(score_units(shared, sent), "place int, unit long, n long, lp double")
    often = n // (1 << MEMO_BITS - 3)  # rarer units are scored when they are met
    common = scored.where(F.col("n") > often).groupBy("place").agg(F.max_by("unit", "n").alias("unit"), F.max_by("lp", "n").alias("lp")).select("unit", F.col("lp").cast("float").alias("lp")).toArrow()
    shared.destroy()
    model.common = common.column("unit").to_numpy().view(np.uint64), common.column("lp").to_numpy()
    return model, sent


# ---- token counts and the result ---------------------------------------------------------------


@trimmed
def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, train -> h (64-bit hash of the word), n_all, c (occurrences in training texts); partial."""
    _MEMO.clear()  # of a model before this one
    tallies = [Tally(), Tally()]

    def out(train: bool, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(n if train else np.zeros_like(n))], ["h", "n_all", "c"])

    for b in slices(batches):
        train = np.array(b.column(1).to_pylist(), bool)
        for segments in cut_texts(b.column(0).to_pylist(), PIECE):
            w = Words([raw for _, raw, _, _ in segments], lower=True)
            count, lead = np.diff(w.first), np.array([n for _, _, n, _ in segments])
            own = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count) >= np.repeat(lead, count)
            teaches = np.repeat(train[[k for k, *_ in segments]], count)
            for t in (False, True):
                tallies[t].add(w.hash[own & (teaches == t)])
                if rare := tallies[t].spill(TYPES):
                    yield out(t, *rare)
    for t in (False, True):
        yield out(t, *tallies[t].take())


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_on=None) -> DataFrame:
    """id, ``held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every text.

    ``train_on``: a boolean column; by default nine tenths by the id's checksum.
    """
    spark = df.sparkSession
    train_on = F.coalesce(crc_mod(id_col, 10) != 0 if train_on is None else train_on, F.lit(False))
    keys = [k.alias(c) for k, c in zip(row_key(id_col, text_col), ("k1", "k2"), strict=True)]
    docs = df.select(F.col(id_col).alias("id"), *keys, train_on.alias("train"), F.col(text_col).alias("text"))
    figures = docs.select("text", "train").mapInArrow(count_tokens, "h long, n_all long, c long").repartition("h").groupBy("h").agg(F.sum("n_all").alias("n_all"), F.sum("c").alias("c"))
    figures = materialize(figures, "tokens")
    texts = docs.where("train").count()
    every, n, v = figures.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = n + texts, v + (texts > 0)
    common = figures.where("c > 0").orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    # small partitions are joined, so that a task meets the same units more often
    texts_of_task = docs.where("train").select("text").coalesce(max(FEW, every // TASK))
    model, sent = train(texts_of_task, np.sort(common.column("h").to_numpy().view(np.uint64)))
    top = figures.where(F.col("n_all") * HEAVY >= every).select("h", "c").toArrow()  # at most HEAVY rows
    hs, cs = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(hs)
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    shared = spark.sparkContext.broadcast((replace(model, table=None), hs[order], cs[order] > 0, base(cs[order]), texts > 0, float(base(texts))))
    kind = docs.schema["id"].dataType.simpleString()

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text with its score and the sums over its frequent words, and one per rare word of a text."""
        model, hs, knows, bases, end_known, end_base = shared.value
        model.table = sent.value
        table = memo(model)
        for b in slices(batches):
            texts, k1, k2 = b.column("text").to_pylist(), b.column("k1").to_numpy(), b.column("k2").to_numpy()
            m = len(texts)
            tokens, known, summed, score = np.ones(m, np.int64), np.full(m, int(end_known), np.int64), np.full(m, end_base), np.zeros(m)
            for piece in pieces_of(texts, model.classes):
                total = np.concatenate([[0.0], np.cumsum(table.coded(piece.units), dtype=np.float64)])[np.concatenate([[0], piece.ends])]
                np.add.at(score, piece.texts, np.diff(total) / log(10))
                h, doc = piece.words.hash.view(np.int64)[piece.own], piece.word_text[piece.own]
                tokens += np.bincount(doc, minlength=m)
                at = np.minimum(np.searchsorted(hs, h), max(0, len(hs) - 1))
                hit = hs[at] == h if len(hs) else np.zeros(len(h), bool)
                known += np.bincount(doc[hit], knows[at[hit]], m).astype(np.int64)
                summed += np.bincount(doc[hit], bases[at[hit]], m)
                doc, h = doc[~hit], h[~hit]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
                blank, none = pa.nulls, len(first)
                cols = [pa.array(k1[doc[first]]), pa.array(k2[doc[first]]), pa.array(h[first]), pa.array(np.diff(np.concatenate([first, [len(h)]])))]
                kinds = [b.column("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*cols, *(blank(none, t) for t in kinds)], names)
            n_bytes = np.fromiter((len((t or "").encode()) for t in texts), np.int64, m)
            own = [b.column("k1"), b.column("k2"), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), b.column("id"), b.column("train")]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (n_bytes, tokens, known, summed, score))], names)

    names = ["k1", "k2", "word", "tf", "id", "train", "n_bytes", "n_tokens", "known", "base", "score"]
    parts = docs.mapInArrow(split, f"k1 long, k2 long, word long, tf long, id {kind}, train boolean, n_bytes long, n_tokens long, known long, base double, score double")
    # a text's own row takes its key for a word, so these rows spread over all tasks
    rare = parts.withColumn("own", F.col("word").isNull()).withColumn("word", F.coalesce("word", "k1"))
    rare_figures = figures.where(F.col("n_all") * HEAVY < every).select(F.col("h").alias("word"), F.col("c").alias("word_c"))
    joined = rare.join(rare_figures.hint("merge"), "word", "left").select(
        "k1", "k2", "own", "id", "train", "n_bytes", "n_tokens", "score",
        F.when(F.col("own"), F.col("known")).otherwise(F.when(F.col("word_c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.when(F.col("own"), F.col("base")).otherwise(F.col("tf") * F.log10((F.col("word_c") + 0.1) / float(n + 0.1 * (v + 1)))).alias("base"),
    )
    own = [F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in ("id", "train", "n_bytes", "n_tokens", "score")]
    sums = joined.groupBy("k1", "k2").agg(F.count_if("own").alias("copies"), *own, F.sum("known").alias("known"), F.sum("base").alias("base"))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), "score",
        (-F.col("score") * (log(10) / log(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
