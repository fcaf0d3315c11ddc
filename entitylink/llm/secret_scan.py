"""Secret scan by corpus-wide ownership frequency.

A first pass over the texts finds base spans by fixed patterns (named assignments, access keys, runs of
hexadecimal digits) and, outside of them, key-like tokens that no pattern names. Every base value and
token is a candidate, handed on as a digest, never as text. The candidates are then counted over the
whole corpus: how many distinct repositories and how many distinct owners hold the same value. A value
that several owners or many repositories hold is a widely copied example; one that few repositories of
one owner hold looks live. A live token becomes a span of kind ``owned`` if it is strong by itself
(``STRONG`` characters of three kinds, high entropy) or if the same value is a base value anywhere in the
corpus, so a password that is assigned in one document is found bare in another. Base spans always stay.

Only digests travel: one row per candidate value and document. Repositories are made distinct before they
are counted, in two steps, so a value that a third of all documents hold is combined before each
shuffle; the join back to the documents meets live values only, which few rows hold.

Defined results: a null text counts as empty; a null owner or repository as the empty string; the same
repository name below two owners is two repositories. Rows that share an id are scanned each by itself. An
empty table gives no rows. Other columns take no part, whatever their names. Start and end are places of
code points. Texts are scanned whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.functions.storage import materialize
from entitylink.llm.common import slices, trimmed

#: Fixed by the contract: the kinds in order, their patterns, and the least length of the value.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}")
STRONG = 20  # characters of a token that is strong by itself
ENTROPY = 3.5  # bits a character, at least
MAX_OWNERS = 1
MAX_REPOSITORIES = 10
OWNED = len(KINDS)  # place of the added kind after the base ones
ROW = "id long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, candidates array<struct<value: string, start: long, end: long, kind: int>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of every base match, by start and kind."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def strong(value: str) -> bool:
    """Looks like a generated key by itself: long, of three kinds of characters, and without pattern."""
    kinds = (any("a" <= c <= "z" for c in value), any("A" <= c <= "Z" for c in value), any(c.isdigit() for c in value))
    return len(value) >= STRONG and all(kinds) and entropy(value) >= ENTROPY


def tokens(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Key-like tokens, of letters and digits, that overlap no base span (given in order of start)."""
    at, reach = 0, 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        value = m[0]
        if m.start() >= reach and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            yield m.start(), m.end(), value


def digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: counts and text of its base spans, and all its candidates."""
    kind = pa.struct([("value", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
    for b in slices(batches, 500):
        counts, bases, found = [], [], []
        for text in b.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            n = Counter(k for _, k, _, _ in base)
            counts.append([n[i] for i in range(len(KINDS))])
            bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base))
            own = [{"value": digest(v), "start": s, "end": e, "kind": k} for s, k, e, v in base]
            found.append(own + [{"value": digest(v), "start": s, "end": e, "kind": OWNED + (not strong(v))} for s, e, v in tokens(text, [(s, e) for s, _, e, _ in base])])
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("owner"), b.column("repo"), *columns, pa.array(bases, pa.string()), pa.array(found, pa.list_(kind))], names=["id", "owner", "repo", "n_assign", "n_access", "n_hex", "base", "candidates"])


def ownership(candidates: DataFrame) -> DataFrame:
    """``value, owners, repositories, base, strong`` of the columns ``value, owner, repo, kind``, over all rows."""
    each = candidates.groupBy("value", "owner", "repo").agg(F.min("kind").alias("kind"))
    owner = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    return owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), (F.min("kind") < OWNED).alias("base"), (F.min("kind") <= OWNED).alias("strong"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: ``id, n_assign, n_access, n_hex, base, spans, n_owned, n_live, n_example``.

    ``spans`` is a sorted list of ``start, kind, end, live`` of the base spans and of the added ones;
    ``n_live`` and ``n_example`` count all spans by whether their value looks live or is a copied example.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), name(owner_col).alias("owner"), name(repo_col).alias("repo"), F.col(f"`{text_col}`").alias("text"))
    # written once, so that the number of a row is the same in every later job
    scanned = materialize(given.mapInArrow(trimmed(scan), ROW).withColumn("nth", F.monotonically_increasing_id()), "secrets")
    some = scanned.where(F.size("candidates") > 0)
    each = some.select("nth", "owner", "repo", F.explode("candidates").alias("c")).select("nth", "owner", "repo", "c.*")
    live = ownership(each).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories) & (F.col("base") | F.col("strong"))).select("value")
    marked = each.select("nth", "value").distinct().join(live, "value", "left_semi").groupBy("nth").agg(F.collect_set("value").alias("live"))
    spans = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), F.least(c["kind"], F.lit(OWNED)).alias("kind"), c["end"].alias("end"), F.array_contains("live", c["value"]).alias("live")))
    spans = F.array_sort(F.filter(spans, lambda s: (s["kind"] < OWNED) | s["live"]))
    counts = ["id", "n_assign", "n_access", "n_hex", "base"]
    held = some.join(marked, "nth", "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>"))).select(*counts, spans.alias("spans"))
    none = scanned.where(F.size("candidates") == 0).select(*counts, F.array().cast(held.schema["spans"].dataType).alias("spans"))
    number = lambda test: F.size(F.filter("spans", test)).cast("long")
    return held.unionByName(none).select("*", number(lambda s: s["kind"] == OWNED).alias("n_owned"), number(lambda s: s["live"]).alias("n_live"), number(lambda s: ~s["live"]).alias("n_example"))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's digests; a document is a repository, its source the owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "owned")])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_secrets(docs).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), text.alias("spans"), "n_owned", "n_live", "n_example")
