"""Shared helpers: row keys and vectorised word tokenising."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's identity (null-safe; equal rows get equal keys)."""
    return [F.xxhash64(F.lit(seed), *cols).alias(f"__k{seed}") for seed in (1, 2)]


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of a schema with more fields."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that little of them is held as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def trim() -> None:
    """Give the memory that this worker has freed back to the system; the JVM beside it may need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function on batches that trims its worker's memory at its end."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


# ---- words of a batch of texts, as numpy arrays -------------------------------------------------

_MIX = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
_SPACES = bytes([*range(9, 14), 32])
_IS_SPACE = bytes(b in _SPACES for b in range(256))
_LOWER = bytes(range(256)).lower()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (published splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: 64-bit hash, byte span and owner of each."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = False) -> None:
        raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        self.buffer = b"\n".join(raw) + b"\n"
        space = np.ones(len(self.buffer) + 2, np.uint8)
        space[1:-1] = np.frombuffer(self.buffer.translate(_IS_SPACE), np.uint8)
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        #: words of text i are first[i]:first[i+1]
        self.first = np.searchsorted(self.start, self.offset)
        data = np.frombuffer(self.buffer.translate(_LOWER) if lower else self.buffer, np.uint8)
        n = len(data)
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[:n], out=total[1:])
        spans = (self.end - self.start).astype(np.uint64)
        self.hash = mix64((total[self.end] - total[self.start]) * q[self.start] + spans)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]


def rolling(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(base)
        out += hashes[i : i + n]
    return mix64(out)
