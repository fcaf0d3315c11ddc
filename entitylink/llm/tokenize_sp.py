"""SentencePiece BPE encoding and decoding through a merge-type prefix table.

For byte-pair merges the encoding of every prefix of a text is fixed, and two tokens stand next to each
other in an encoding exactly if encoding their joined text gives those two tokens again. So for each
prefix its last token is unique. An automaton reports all pieces that end at a position; the last token
of that prefix is the one whose start is 0 or whose start's own last token is compatible with it.
Stored per prefix, the ids are then recovered from the end backwards. Characters outside the vocabulary
never merge and become byte pieces.

No piece of the vocabulary holds the space mark after another character (checked when the model is
loaded), so no merge crosses a word's start: texts are cut there, and each distinct word of a task is
encoded once. What a worker keeps of words and pairs is bounded in bytes.

Defined results: a null text counts as empty, which has no ids and decodes to the empty text. Very long
texts are encoded whole: beyond ``WHOLE`` characters their digests are taken in parts of ``PART`` words, and
words longer than ``LONG`` characters are not kept. Other columns are kept; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entitylink.llm.common import extended, slices, trimmed

SPACE = "▁"
CACHE = 96_000_000  # bytes of encoded words
WHOLE = 500_000
PAIRS = 200_000  # tested pairs
LONG = 64
PART = 50_000
ENTRY = 190  # bytes of a kept word beside its characters and ids


class PrefixTable:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.score = {}
        self.id = {}
        self.byte_id, self.byte_of = {}, {}
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)], self.byte_of[i] = i, int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece] = i, sp.get_score(i)
        probe = sp.encode(" a  b ", out_type=str)
        if "".join(probe) != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}" or len(self.byte_id) != 256:
            raise ValueError("the model must keep all spaces, add a leading one and have byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.id if p):
            raise ValueError("a piece holds the space mark after another character")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.chars = {p for p in self.id if len(p) == 1}
        known = "".join(map(re.escape, sorted(self.chars)))
        self.runs = re.compile(f"(?P<k>[{known}]+)|[^{known}]+", re.S)
        # line ends outside the vocabulary never merge, so texts are cut there too
        line = "" if "\n" in self.chars else "\n"
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else ""))
        # merge order: pieces of better score merge first; single characters are given
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        often = Counter(self.score[p] for p in self.id if len(p) > 1)
        self.rank = {i: order[self.score[p]] if len(p) > 1 else -1 for p, i in self.id.items()}
        self.tied = {i for p, i in self.id.items() if len(p) > 1 and often[self.score[p]] > 1}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, str | tuple[str, str]] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """Pieces by the merge rule itself (best score first, then leftmost); for short texts in the tests of pairs."""
        return self._merge(list(text), 1)

    def _merge(self, parts: list[str], down_to: int) -> list[str]:
        while len(parts) > down_to:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def last_merge(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i; None for characters and pieces that no merge makes."""
        if i not in self.split:
            parts = self._merge(list(self.pieces[i]), 2)
            self.split[i] = tuple(self.id[p] for p in parts) if len(parts) == 2 else None
        return self.split[i]

    def compatible(self, left: int, right: int) -> bool:
        """Do two pieces stay as they are next to each other? left -1: is the piece its own encoding?

        Undo the merges at the common edge, latest first. The pair breaks if, in any such state, the two
        edge pieces would have merged with each other before the merge undone last.
        """
        key = (left + 1) << 20 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        if left < 0 or left in self.tied or right in self.tied:
            want = [self.pieces[i] for i in (left, right) if i >= 0]
            return self.merged("".join(want)) == want
        a, b, limit = left, right, 1 << 30
        while True:
            joined = self.id.get(self.pieces[a] + self.pieces[b])
            if joined is not None and self.rank[joined] < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.last_merge(a)[1]
            elif self.rank[b] >= 0:  # of equal merges the left one comes first
                limit, b = self.rank[b] + 1, self.last_merge(b)[0]
            else:
                return True

    def known_run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text) + 1
        last, begin = [-2] * n, [0] * n
        last[0] = -1
        fits = self.fits
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] == -2 and (before := last[end - size]) != -2:
                if (good := fits.get((before + 1) << 20 | i)) is None:
                    good = self.compatible(before, i)
                if good:
                    last[end], begin[end] = i, end - size
        ids, at = [], n - 1
        while at:
            if (i := last[at]) < 0:
                raise RuntimeError("a prefix without a last token")
            ids.append(i)
            at = begin[at]
        ids.reverse()
        return ids

    def word_ids(self, unit: str) -> list[int]:
        if self.chars.issuperset(unit):
            return self.known_run(unit)
        ids: list[int] = []
        for m in self.runs.finditer(unit):
            ids += self.known_run(m[0]) if m.lastgroup else [self.byte_id[b] for b in m[0].encode()]
        return ids

    def word(self, unit: str) -> str | tuple[str, str]:
        """A word's ids as text; with the word decoded again, where that is not the word with spaces."""
        ids = self.word_ids(unit)
        text, plain = ",".join(map(str, ids)), self.plain(ids)
        found = text if plain == unit.replace(SPACE, " ") else (text, plain)
        if len(unit) <= LONG:
            if self.held >= CACHE:
                self.cache.clear()
                self.held = 0
            self.cache[unit] = found
            self.held += ENTRY + 2 * len(unit) + len(text)
        return found

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall(SPACE + text.replace(" ", SPACE))

    def parts(self, text: str | None) -> Iterator[tuple[str, str]]:
        """The ids as text and what they decode to; of a long text ``PART`` words at a time."""
        if text and len(text) <= WHOLE:
            yield self.encoded(text)
            return
        units = self.cut.finditer(SPACE + text.replace(" ", SPACE)) if text else iter(())
        first = True
        while some := [m[0] for m in islice(units, PART)]:
            ids, plain = self.joined(some)
            yield ids, plain[1:] if first else plain
            first = False

    def encoded(self, text: str | None) -> tuple[str, str]:
        """The ids as text, and the text decoded from them."""
        ids, plain = self.joined(self.units(text or ""))
        return ids, plain[1:]

    def joined(self, units: list[str]) -> tuple[str, str]:
        get = self.cache.get
        words = [get(u) or self.word(u) for u in units]
        if tuple in set(map(type, words)):
            plain = "".join(u.replace(SPACE, " ") if isinstance(w, str) else w[1] for u, w in zip(units, words, strict=True))
            words = [w if isinstance(w, str) else w[0] for w in words]
        else:
            plain = "".join(units).replace(SPACE, " ")
        return ",".join(words), plain

    def encode(self, text: str | None) -> list[int]:
        ids = self.encoded(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def plain(self, ids: list[int]) -> str:
        """Text of ids with every space, the leading one too; broken bytes become U+FFFD, one each."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            while held:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[:size].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    size = 1
                    out.append("�")
                del held[:size]
            if i >= 0 and i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.control), None)
        text = self.plain(ids)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


_LOADED: dict[str, PrefixTable] = {}


def table(model_file: str) -> PrefixTable:
    """One table per worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixTable(model_file)
    return _LOADED[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(df: DataFrame, model_file: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """The other columns with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``."""
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    others = [c for c in df.columns if c != text_col and c not in added]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model_file)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        for b in slices(batches):
            rows, kept, ends = [], [], [0]
            for text in b.column(text_col).to_pylist():
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for ids, plain in t.parts(text):
                    of_ids.update(b"," * (n > 0) + ids.encode())
                    of_text.update(plain.encode())
                    n += ids.count(",") + 1
                    if keep_ids:
                        kept.append(np.array(ids.split(","), np.int32))
                rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
                ends.append(ends[-1] + n)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(3)]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *kept]))))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], [*others, *added])

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    schema = extended(df.select(*[f"`{c}`" for c in others]).schema, ddl)
    return df.select(*[f"`{c}`" for c in [*others, text_col]]).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, default_model(), keep_ids=False)
