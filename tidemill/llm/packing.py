"""Operator 6: best-fit packing by minimum bin slack.

Pieces are known to the packer by their lengths alone, so it works on a histogram of at most ``capacity`` counts, whatever the
number of documents: the longest length left opens a bin, a bitset subset-sum over the lengths left finds the fullest feasible
combination that completes it, and that combination is removed as many times as the counts allow. Every such removal uses up a
length or leaves fewer of it than the combination takes, so the number of patterns is bounded by the capacity, not by the data.
Pieces then find their bins by rank among the pieces of their length; ranks come from counts by (length, part), so a length
that a third of all pieces share is spread over all parts.

Edge cases: a null text is an empty document (its end id alone); an empty table packs into nothing; repeated doc_ids are
packed as often as they occur; other columns are not read. Equal lengths are interchangeable, ties go by part and row.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, trimmed, vocabulary
from .encoding import CACHE_ENTRIES, encoder, texts_of

PIECES = "part long, no long, doc_id long, piece long, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole capacities, the first piece takes what is over."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, cache_entries: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = encoder(path, kind, cache_entries), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = np.append(enc.encode(text).astype("<u4"), np.uint32(end_id)).astype("<u4")
                raw = ids.tobytes()
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((part, no, key, i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    no += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["part", "no", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(run), PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, as often as they are left, whose sum comes nearest to room from below: a bitset subset-sum.

    Longer lengths are tried first and a state is credited to the first length that reaches it, so the combination found has
    few, long pieces.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        left, times = min(counts[x], room // x), 1
        while left:
            take = min(times, left)
            new = (reach | reach << x * take) & mask
            if new != reach:
                steps.append((x, take, reach))
                reach = new
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for x, take, before in reversed(steps):
        if not before >> at & 1:
            out += [x] * take
            at -= x * take
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) in the order they were removed."""
    counts = {x: n for x, n in histogram.items() if n}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        x = lengths[0]
        counts[x] -= 1
        rest = fullest(lengths, counts, capacity - x)
        counts[x] += 1
        bin_ = [x, *rest]
        need = {y: bin_.count(y) for y in bin_}
        times = min(counts[y] // n for y, n in need.items())
        for y, n in need.items():
            counts[y] -= n * times
        lengths = [y for y in lengths if counts[y]]
        out.append((bin_, times))
    return out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 0, capacity: int = 2048, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document at its place."""
    cuts = stored(pieces(docs, tokenizer, kind, end_id, capacity, cache_entries), "pieces")
    by_part = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    length, low, sequence, offset, base = [], [], [], [], 0
    seen: dict[int, int] = {}
    for bin_, times in patterns(histogram, capacity):
        at = 0
        for x in bin_:
            rank = seen.get(x, 0)
            length.append(x), low.append(rank), sequence.append(base - rank), offset.append(at)
            seen[x] = rank + times
            at += x
        base += times
    order = np.lexsort((low, length)) if length else []
    # A slot stands for ranks [low, next low) of its length; its bins are sequence + rank.
    slot_key = np.array([(x << 44) + r for x, r in zip(length, low)], np.int64)[order] if length else np.zeros(0, np.int64)
    slot_sequence, slot_offset = (np.array(x, np.int64)[order] if length else np.zeros(0, np.int64) for x in (sequence, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, x = (b.column(n).to_numpy() for n in ("rank", "length"))
            i = np.searchsorted(slot_key, (x << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(slot_sequence[i] + rank), pa.array(slot_offset[i])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    own = Window.partitionBy("length", "part").orderBy("no")
    ranked = cuts.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "part"]).withColumn("rank", (F.col("base") + F.col("own")).cast("bigint"))
    out = ranked.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
