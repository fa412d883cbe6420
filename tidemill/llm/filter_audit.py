"""Operator 13: audit of how text filters interact.

Five filters are judged on every whole text, whatever the others say; the audit then replays every order in which they can be
applied and reports what each step keeps, removes, and would have removed.

* A scan reads the texts where they lie in Arrow's buffers. Classes of bytes (white space, capitals, symbols, first bytes of
  characters) and their sums at the ends of documents count words, capitals, symbols and code points. Words are hashed by
  differences of one running polynomial sum, whatever their length; hashes are sorted within documents, and neighbours of
  equal hash are compared byte by byte, so distinct words are exact: a document in which two words share a hash but not their
  bytes is counted by a set.
* Repeats of a text are found by digest. Rows of one text share everything but their id, so they shrink to a row for each
  (part, label) before they meet: a text of a third of all rows costs a few rows a task.
* What is left are counts by (part, mask of failed filters, labels), at most 128 a part; the orders are replayed over these.

A part is a value of the part column, null as the empty text. A document is good (toxic) when one of its label rows says so.

Edge cases: null text counts as empty: no words (fails A, passes B and D) and no capitals; a document equal to one with the
same id is no repeat of it (rows that repeat an id are rows of their own); a row without an id repeats nothing and makes no
other a repeat; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, trimmed

FILTERS = "ABCDE"
#: Bytes of text scanned at once; a longer text is scanned in stretches of so many.
STRETCH = 1 << 19
SPACE, CAPITAL, SYMBOL, FIRST = 1, 2, 4, 8
#: Odd, so that it has an inverse modulo 2^64.
RADIX = 0x9E3779B97F4A7C15
CLASS = np.zeros(256, np.uint8)
CLASS[[32, *range(9, 14)]] |= SPACE
CLASS[65:91] |= CAPITAL
CLASS[list(b"#$%&*|")] |= SYMBOL
CLASS[[*range(0x80), *range(0xC0, 0x100)]] |= FIRST


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.array([1, *[base] * (n - 1)], np.uint64), dtype=np.uint64) if n else np.zeros(0, np.uint64)


class Scanner:
    """Counts of documents that stand one after another in a buffer."""

    def __init__(self, stretch: int = STRETCH, radix: int = RADIX) -> None:
        self.stretch, self.inverse = stretch, pow(radix, -1, 1 << 64)
        self.up, self.down = powers(radix, stretch + 1), powers(self.inverse, stretch + 1)
        self.radix = radix

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """words, distinct words, capitals, symbols, code points of the documents that end at ``ends`` (the first begins at 0)."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        totals = {bit: np.zeros(len(ends), np.int64) for bit in (CAPITAL, SYMBOL, FIRST)}
        inside, starts, stops, hashes = np.zeros(len(data) + 2, bool), [], [], []
        for at in range(0, len(data), self.stretch):
            kind = CLASS[data[at : at + self.stretch]]
            inside[at + 1 : at + 1 + len(kind)] = kind & SPACE == 0
            a, b = np.clip(begins - at, 0, len(kind)), np.clip(ends - at, 0, len(kind))
            for bit, total in totals.items():
                sums = np.concatenate([[0], np.cumsum(kind & bit > 0, dtype=np.int32)])
                total += sums[b] - sums[a]
        # Words begin behind white space or where a document begins, and end likewise.
        border = np.zeros(len(data) + 1, bool)
        border[begins], border[ends] = True, True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
        stops = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
        first, last = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
        words = last - first
        return words, self.distinct(data, starts, stops, words), totals[CAPITAL], totals[SYMBOL], totals[FIRST]

    def hashed(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the words, from the running sum of byte times power of the place."""
        at_start, at_stop, scale = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        carry, up, down = np.uint64(0), 1, 1
        for at in range(0, len(data), self.stretch):
            own = data[at : at + self.stretch]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * self.up[: len(own)], dtype=np.uint64)])
            sums = carry + sums * np.uint64(up)
            a, b = np.searchsorted(starts, [at, at + len(own)])
            at_start[a:b] = sums[starts[a:b] - at]
            scale[a:b] = self.down[starts[a:b] - at] * np.uint64(down)
            a, b = np.searchsorted(stops, [at + 1, at + len(own) + 1])
            at_stop[a:b] = sums[stops[a:b] - at]
            carry = sums[-1]
            up, down = up * pow(self.radix, len(own), 1 << 64) % (1 << 64), down * pow(self.inverse, len(own), 1 << 64) % (1 << 64)
        return (at_stop - at_start) * scale

    def distinct(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(len(words), np.int64)
        of, h = np.repeat(np.arange(len(words)), words), self.hashed(data, starts, stops)
        order = np.lexsort((h, of))
        h, doc, a, size = h[order], of[order], starts[order], (stops - starts)[order]
        same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        out = words - np.bincount(doc[same], minlength=len(words))
        # Neighbours of one hash must be one word.
        wrong = size[same] != size[same + 1]
        for some in np.array_split(same[~wrong], max(1, int(size[same].sum()) // self.stretch)):
            n = size[some]
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            off = data[np.repeat(a[some], n) + shift] != data[np.repeat(a[some + 1], n) + shift]
            if off.any():
                wrong[np.isin(same, some[np.unique(np.repeat(np.arange(len(some)), n)[off])])] = True
        for d in np.unique(doc[same[wrong]]).tolist():
            own = np.flatnonzero(of == d)
            out[d] = len({data[x:y].tobytes() for x, y in zip(starts[own], stops[own])})
        return out


def failures(words: np.ndarray, distinct: np.ndarray, capitals: np.ndarray, symbols: np.ndarray, points: np.ndarray, least_words: int, distinct_share: int, capital_share: int) -> np.ndarray:
    """Bit i: filter i fails (A to D)."""
    tests = (words < least_words, 100 * distinct < distinct_share * words, 100 * capitals > capital_share * points, symbols > 0)
    return sum(t.astype(np.int32) << i for i, t in enumerate(tests))


def scan_filters(docs: DataFrame, part: str = "lang", least_words: int = 200, distinct_share: int = 50, capital_share: int = 3) -> DataFrame:
    """doc_id, part, digest, mask, words, distinct_words, capitals, symbols, code_points: one row a document."""
    names = ("words", "distinct_words", "capitals", "symbols", "code_points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            text = b.column(3)
            _, offsets, raw = text.buffers()
            ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            found, at = [], 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1)
                found.append(scanner.counts(data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]))
                at = to
            counts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
            mask = failures(*counts, least_words, distinct_share, capital_share)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mask, pa.int32()), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "part", "digest", "mask", *names])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    return read.mapInArrow(trimmed(run), "doc_id long, part string, digest binary, mask int, " + ", ".join(f"{n} long" for n in names))


def mask_counts(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of all five), good, toxic, n: how many documents."""
    rows = scanned.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("c"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id have no label and do not meet in one task.
    none = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    said = rows.where("doc_id is not null").join(said, "doc_id", "left").withColumns({x: F.coalesce(F.col(x), F.lit(False)) for x in ("good", "toxic")}).unionByName(none)
    # Rows of one text: how many, the smallest id, and how many have it. Rows are one for an id, so an id's count stands in its row.
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))
    per = said.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), F.min(known).alias("head"))
    whole = Window.partitionBy("digest")  # at most four rows for each part
    first = per.withColumn("smallest", F.min("head.doc_id").over(whole))
    # One id can stand in several parts.
    heads = F.when(F.col("head.doc_id") == F.col("smallest"), F.col("head.c")).otherwise(0)
    split = first.select("part", "mask", "good", "toxic", "n", (F.col("nameless") + F.coalesce(heads, F.lit(0))).alias("passing"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("m")).groupBy("part", "good", "toxic", "m.mask").agg(F.sum("m.n").alias("n"))


def replay(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order."""
    steps = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(1 << filters.index(f)).alias("own")))
            before |= 1 << filters.index(f)
    # First by what was there before and the filter: 80 pairs instead of 600 steps.
    pairs = [(before, 1 << i) for before in range(1 << len(filters)) for i in range(len(filters)) if not before >> i & 1]
    pair = F.explode(F.array(*(F.struct(F.lit(p).alias("before"), F.lit(o).alias("own")) for p, o in pairs)))
    met = counts.select("*", pair.alias("p")).select("part", "mask", "good", "toxic", "n", "p.before", "p.own")
    here, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    some = lambda name, when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint").alias(name)
    found = met.groupBy("part", "before", "own").agg(
        some("kept", ~here & ~earlier), some("removed", here & ~earlier), some("redundant", here & earlier), some("unique_fails", F.col("mask") == F.col("own")),
        some("good_lost", here & ~earlier & F.col("good")), some("toxic_lost", here & ~earlier & F.col("toxic")),
    )
    parts = counts.select("part").distinct().select("part", F.explode(F.array(*steps)).alias("s")).select("part", "s.*")
    out = parts.join(found, ["part", "before", "own"])
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("before", "own")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replay(stored(mask_counts(scan_filters(docs, part), labels), "mask-counts"))
