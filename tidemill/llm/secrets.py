"""Operator 9: secret scans with corpus-wide ownership frequency.

A scan of every whole text finds the spans of the base kinds (assign, access, hex) and, apart from them, long mixed tokens that
may be a known credential standing alone (bare). The hash of each candidate's value is aggregated over the corpus: by how
many distinct repositories and owners it occurs in, and in how many documents. A value of more than ``owners`` owners or
``repositories`` repositories is a widely copied example; the others look like live credentials of their owner. A bare token
becomes a span when its value is a live-looking credential that a base kind found elsewhere in the corpus. Base spans are never
taken away. Values leave the scan as hashes only. A bare token is a run of 16 or more of [A-Za-z0-9+/_-] with a letter and a
digit; a credential that is shorter, holds other characters or is all letters or all digits gets its base spans alone (words of
six letters cannot be told from prose), and only there counts for its owners.

Edge cases: null text counts as empty and has no spans; null owner or repository counts as one of its own, other than the empty
text; rows that repeat a
doc_id are rows of their own; spans that meet or overlap are all kept; an empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, trimmed
from .encoding import texts_of

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer characters is no match
KINDS = ("assign", "access", "hex", "bare")
HINTS = ("passw", "secret", "token", "api")
LONG_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
CANDIDATES = "array<struct<kind int, start long, end long, value long>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    found, low = [], None
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in HINTS):
            found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def bare_tokens(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters and digits that touch no base span. taken is sorted by start: one walk over both."""
    out, reach, k = [], 0, 0  # the farthest end of the spans that begin before the token's end
    for m in LONG_TOKEN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] < b:
            reach = max(reach, taken[k][2])
            k += 1
        v = m[0]
        if reach <= a and DIGIT.search(v) and LETTER.search(v):
            out.append((3, a, b, v))
    return out


def scan(docs: DataFrame, owner_col: str, repository_col: str) -> DataFrame:
    """row, doc_id, owner, repository, counts and digest of base spans, and all candidates with hashed values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = TaskContext.get().partitionId() << 40, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
        for b in batches:
            rows, counts, digests, candidates = [], ([], [], []), [], []
            for text in texts_of(b.column(3)):
                rows.append(number)
                number += 1
                spans = base_spans(text or "")
                for k in range(3):
                    counts[k].append(sum(s[0] == k for s in spans))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans).encode()).hexdigest())
                both = spans + bare_tokens(text or "", spans)
                candidates.append([{"kind": k, "start": s, "end": e, "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for k, s, e, v in both])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(candidates, kind)], ["row", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"])

    bounded_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("bigint"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col).cast("string").alias("repository"), "text")
    return read.mapInArrow(trimmed(run), f"row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates {CANDIDATES}")


def ownership(found: DataFrame, owners: int, repositories: int) -> DataFrame:
    """value, n_docs, n_owners, n_repositories, based (a base kind found it), live. found: row, owner, repository, kind, value."""
    # Distinct owners and repositories before the values meet: a value of a third of all rows costs a row for each owner.
    by_owner = found.groupBy("value", "owner").agg(F.count("*").alias("n"), F.max((F.col("kind") < 3).cast("int")).alias("based"))
    by_owner = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_found"), F.max("based").alias("based"))
    by_repository = found.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("n_repositories"))
    out = by_owner.join(by_repository, "value")
    return out.withColumn("live", (F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories))


def scan_secrets(docs: DataFrame, owner_col: str = "source", repository_col: str = "source", owners: int = 1, repositories: int = 1) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans of live-looking values), n_copied (of widely copied ones), n_added."""
    rows = stored(scan(docs, owner_col, repository_col), "candidates")
    found = rows.where(F.size("candidates") > 0).select("row", "owner", "repository", F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.kind", "c.start", "c.end", "c.value")
    known = stored(ownership(found, owners, repositories).where("based = 1").select("value", "live"), "ownership")
    met = found.select("row", "kind", "start", "end", "value").join(known, "value").where("kind < 3 or live")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", kind, "start", "end").alias("s"))
    per = met.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"), F.sum(F.col("live").cast("int")).alias("n_live"), F.sum((~F.col("live")).cast("int")).alias("n_copied"), F.sum((F.col("kind") == 3).cast("int")).alias("n_added"))
    out = rows.drop("candidates").join(per, "row", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join(F.transform("all", lambda x: x["s"]), ","), F.lit("")).alias("spans"), none("n_live"), none("n_copied"), none("n_added"))
