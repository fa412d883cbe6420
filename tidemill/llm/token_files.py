"""Operator 3: token ids as binary shards, with a minimal perfect hash from document keys to offsets.

Documents are dealt out by ranges of doc_id and sorted, so shard after shard holds the ids in ascending doc_id order; how many
shards there are follows from the size of the input, at about ``SHARD_BYTES`` of it each. A shard is written as a stream, ids
first and a footer after them: an index over its keys in the form of a multi-level perfect hash (each level a bit array of keys
that met no other key there; the rank of a key's bit is its slot), and for each slot a stored 32-bit fingerprint of the key,
its first record and their number, then the offset of every record. A task holds the keys and counts of its shard, never its
ids. A lookup reads a constant expected number of bits, one slot and one stretch of ids, and answers None for keys that are not
there (a wrong answer needs a 32-bit fingerprint match on top of a full slot).

Edge cases: a null text is the empty document (its end id alone); a null doc_id is stored first and reached by its own slot
outside the hash; rows that repeat a doc_id stand side by side by their text and share a slot that counts them; very many of
them, or of null ids, are cut into several shards by the beginning of their text, and a lookup asks each of these. An empty
table makes no shard. Other columns are not read.
"""
from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import running
from .common import bounded_batches, fanout, in_worker, new_path, stored, trimmed, vocabulary
from .encoding import encoder, texts_of

MAGIC = b"TMTOK02\n"
_TRAILER = struct.Struct("<qqqqqqq8s")  # where the footer begins, bytes an id, ids, records, keys, records of a null key, levels, magic
#: Bytes of text a shard is made for; characters of a text by which rows of one id may be cut into shards.
SHARD_BYTES, CUT_CHARS = 256 << 20, 64
GAMMA = 2  # bits a key at each level
BOUNDS_BLOCK = 4096  # shards whose ids are added up in one task
MAX_LEVELS = 64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of signed 64-bit keys."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """slots(keys): different numbers below n for the n distinct keys it was built from."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]) for bits in levels]
        self.bases = np.concatenate([[0], np.cumsum([int(r[-1]) for r in self.ranks])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, GAMMA * len(left))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where no level has a bit for the key."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.bases[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shard_index(keys: np.ndarray, counts: np.ndarray, null_rows: int, width: int, at: int) -> Iterator[bytes]:
    """The footer and trailer of a shard whose ids end at byte ``at``. keys: ascending, without the null ones. counts: ids of each record, null keys first. A key's slot holds its first record."""
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    runs = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    distinct = keys[runs]
    record = runs + null_rows
    repeats = np.diff(np.concatenate([runs, [len(keys)]]))
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    prints, records, times = np.zeros(len(slot), "<u4"), np.zeros(len(slot), "<i8"), np.zeros(len(slot), "<i8")
    prints[slot], records[slot], times[slot] = fingerprint(distinct), record, repeats
    yield struct.pack(f"<{len(table.levels)}q", *map(len, table.levels))
    for x in table.levels:
        yield np.packbits(x).tobytes()
    yield from (prints.tobytes(), records.tobytes(), times.tobytes(), first.astype("<i8").tobytes())
    yield _TRAILER.pack(at, width, int(first[-1]), len(counts), len(slot), null_rows, len(table.levels), MAGIC)


class ShardWriter:
    """A shard under a name of its own attempt, moved into place at the end: a task that runs twice leaves the same file."""

    def __init__(self, uri: str, width: int) -> None:
        self.system, self.path = _file_system(uri)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.width, self.at, self.null_rows = self.system.open_output_stream(self.part), width, 0, 0
        self.keys, self.counts = [], array("q")

    def add(self, keys: pa.Array, records: list[bytes]) -> None:
        self.null_rows += keys.null_count
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        self.counts.extend(len(r) // self.width for r in records)
        raw = b"".join(records)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> np.ndarray:
        """The keys of the shard, ascending."""
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        for x in shard_index(keys, np.frombuffer(self.counts, np.int64), self.null_rows, self.width, self.at):
            self.out.write(x)
        self.out.close()
        self.system.move(self.part, self.path)
        return keys


class Shard:
    """Keyed access to one file: its index in memory, its ids read by offset."""

    def __init__(self, uri: str) -> None:
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - _TRAILER.size)
        at, self.width, self.n_ids, self.n_records, self.n_keys, self.null_rows, n_levels, magic = _TRAILER.unpack(self.file.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.file.seek(at)
        sizes = struct.unpack(f"<{n_levels}q", self.file.read(8 * n_levels))
        self.table = PerfectHash([np.unpackbits(np.frombuffer(self.file.read((s + 7) // 8), np.uint8), count=s).astype(bool) for s in sizes])
        self.prints = np.frombuffer(self.file.read(4 * self.n_keys), "<u4")
        self.records = np.frombuffer(self.file.read(8 * self.n_keys), "<i8")
        self.times = np.frombuffer(self.file.read(8 * self.n_keys), "<i8")
        self.first = np.frombuffer(self.file.read(8 * (self.n_records + 1)), "<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 for keys that are not in the shard."""
        slot = self.table.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        record, times = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        record[ok], times[ok] = self.records[slot[ok]], self.times[slot[ok]]
        return record, times

    def ids(self, record: int) -> np.ndarray:
        self.file.seek(int(self.first[record]) * self.width)
        return np.frombuffer(self.file.read(int(self.first[record + 1] - self.first[record]) * self.width), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def shards_for(rows: DataFrame) -> int:
    """By the planner's estimate of the input's size (files hold texts compressed, to a third or so), or by a count where it has none."""
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 3 * estimate if estimate < 1 << 55 else rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(fanout(rows.sparkSession), -(-size // SHARD_BYTES))


MANIFEST = "part int, uri string, low long, high long, ids long, records long, null_rows long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1) -> DataFrame:
    """Encode every whole text, append end_id, write the shards; returns the manifest, a stored table: a small row for each shard
    that holds a document, numbered in ascending order (``part``)."""
    bounded_batches(docs.sparkSession)
    path = vocabulary(tokenizer)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, low, high = encoder(path, kind), None, None, None
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            if batch.num_rows:
                part = TaskContext.get().partitionId()
                uri = f"{folder}/shard-{part:06d}.tok"
                out = out or ShardWriter(uri, enc.dtype.itemsize)
                out.add(batch.column(0), [enc.encode(text).tobytes() + end for text in texts_of(batch.column(1))])
        if out:
            keys = out.close()
            low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
            found = ((part, pa.int32()), (uri, pa.string()), (low, pa.int64()), (high, pa.int64()), (out.at // out.width, pa.int64()), (len(out.counts), pa.int64()), (out.null_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in found], ["part", "uri", "low", "high", "ids", "records", "null_rows"])

    key, text = F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("k"), F.col("text").alias("t"))
    dealt = rows.repartitionByRange(shards_for(rows), key, F.substring("t", 1, CUT_CHARS).asc_nulls_first()).sortWithinPartitions(key, text)
    return stored(dealt.mapInArrow(trimmed(shard), MANIFEST), "manifest")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1) -> list[dict]:
    """write_shards, its manifest as a list: for callers that look at single shards of a corpus that has few."""
    return [r.asDict() for r in write_shards(docs, folder, tokenizer, kind, end_id).orderBy("part").collect()]


class Bounds:
    """The manifest as arrays, read by a task from the stored table: some 100 bytes for 256 MB of input."""

    def __init__(self, path: str) -> None:
        from pyarrow import dataset

        system, inner = _file_system(path)
        rows = dataset.dataset(inner, filesystem=system, format="parquet").to_table().sort_by("part")
        keyed, null = rows.filter(pa.compute.is_valid(rows["low"])), rows.filter(pa.compute.greater(rows["null_rows"], 0))
        self.low, self.high = (keyed[c].to_numpy() for c in ("low", "high"))
        self.keyed, self.null = (t.select(["part", "uri", "base"]).combine_chunks() for t in (keyed, null))


def read_by_key(keys: DataFrame, manifest: DataFrame | list[dict]) -> DataFrame:
    """For each distinct key of keys (doc_id) the rows stored under it, found through the index.

    A key's shards are found by bisecting the shards' bounds, which tasks read from a stored table; keys meet their shard in one
    shuffle of the bare keys, a task a shard. Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    if isinstance(manifest, list):
        manifest = keys.sparkSession.createDataFrame([tuple(m[c] for c in ("part", "uri", "low", "high", "ids", "records", "null_rows")) for m in manifest], MANIFEST)
    before = running(manifest, {"upto": ("sum", F.col("ids"))}, [], "part", BOUNDS_BLOCK)
    bounds = stored(before.withColumn("base", F.col("upto") - F.col("ids")), "shards")
    last, path = bounds.agg(F.max("part")).first()[0], bounds._tidemill_path

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = held or in_worker(("shards", path), lambda: Bounds(path))
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first, last = np.searchsorted(held.high, x, side="left"), np.searchsorted(held.low, x, side="right")
            times = np.maximum(last - first, 0)
            row = np.repeat(np.arange(len(x)), times)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            found = [(pa.array(x[row]), held.keyed.take(pa.array(at)))]
            if b.column(0).null_count:
                found.append((pa.nulls(len(held.null), pa.int64()), held.null))
            for own, shards in found:
                yield from pa.Table.from_arrays([own, *shards.columns], ["doc_id", "part", "uri", "base"]).combine_chunks().to_batches()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        for b in batches:
            for uri in dict.fromkeys(b.column(1).to_pylist()):
                if uri not in open_:
                    for s in open_.values():  # rows come sorted by shard: one is open at a time
                        s.close()
                    open_ = {uri: Shard(uri)}
                s, own = open_[uri], b.filter(pa.compute.equal(b.column(1), uri))
                k, base = own.column(0), own.column(2)[0].as_py()
                found, times = s.find(k.drop_null().to_numpy(zero_copy_only=False))
                wanted = [(None, r) for r in range(s.null_rows)] if k.null_count else []
                wanted += [(key, r + j) for key, r, n in zip(k.drop_null().to_pylist(), found.tolist(), times.tolist()) if r >= 0 for j in range(n)]
                wanted.sort(key=lambda x: x[1])
                for at in range(0, len(wanted), 10_000):
                    some = wanted[at : at + 10_000]
                    crc = [zlib.crc32(s.ids(r).tobytes()) for _, r in some]
                    first = [base + int(s.first[r]) for _, r in some]
                    count = [int(s.first[r + 1] - s.first[r]) for _, r in some]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), *(pa.array(x, pa.int64()) for x in (first, count, crc))], ["doc_id", "start", "n_tokens", "ids_crc32"])
        for s in open_.values():
            s.close()

    placed = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().mapInArrow(place, "doc_id long, part int, uri string, base long")
    dealt = placed.repartitionById((last or 0) + 1, "part").sortWithinPartitions("doc_id").select("doc_id", "uri", "base")
    return dealt.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 1) -> DataFrame:
    """Write the shards, then read every document of docs back by its key."""
    return read_by_key(docs, write_shards(docs, folder or new_path(spark, "tokens"), tokenizer, kind, end_id))
