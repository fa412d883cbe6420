"""Shared helpers of the training-data operators: durable intermediate tables, row identity and size-checked joins."""
from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every contract of this package defines it.
ASCII_WS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = getattr(spark, "_tidemill_shared", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark._tidemill_shared = found
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


#: A writer looks at the size of a page after every so many rows at least (Parquet's default is 100, and rows can be packed ones of
#: megabytes: a page and its compressor's buffers outside the heap would be a hundred times that), and holds a row group in memory.
WRITER = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def stored(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; it outlives any executor. Its rows, and measures over all of them, are counted as it is written."""
    spark, path, seen = df.sparkSession, new_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())).write.options(**WRITER).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path, out._tidemill_seen = path, {} if seen._jo.getOrEmpty().isEmpty() else seen.get
    return out


def rows_of(table: DataFrame, measure: str = "rows"):
    """What was counted when the table was stored; its rows are counted now if that is not known (a task that ran twice may have counted twice, which only makes a table look larger)."""
    seen = getattr(table, "_tidemill_seen", {})
    return seen[measure] if measure in seen else table.count()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t._tidemill_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small(df: DataFrame, rows: int, of: DataFrame | None = None) -> bool:
    """True if df, or the stored table of which it is a projection, has at most so many rows; reads no more than needed to tell."""
    known = of if of is not None else df
    if hasattr(known, "_tidemill_seen"):
        return rows_of(known) <= rows
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int, of: DataFrame | None = None) -> DataFrame:
    """Marked for broadcast only when its row count was checked against the bound; otherwise left to the shuffle join."""
    return F.broadcast(df) if small(df, rows, of) else df


#: Rows of an Arrow batch, and of one of the Parquet reader: texts can be long, and a batch stands in memory whole. An Arrow batch
#: ends at so many bytes as well, as rows can be packed ones; below READ_ROWS the reader's own work on a batch would count.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1000, 8 << 20, 32
ARROW_ROWS, ARROW_BYTES, READER_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def batch_settings(rows: int) -> dict[str, str]:
    return {ARROW_ROWS: str(rows), ARROW_BYTES: str(BATCH_BYTES), READER_ROWS: str(min(max(rows, READ_ROWS), 4096))}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batches to BATCH_ROWS rows, for operators that hand whole texts or packed rows to Python."""
    if not 0 < int(spark.conf.get(ARROW_ROWS, "10000")) <= BATCH_ROWS:
        for key, value in batch_settings(BATCH_ROWS).items():
            spark.conf.set(key, value)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows in an Arrow batch of what is executed inside, and about as many at most in one of the Parquet reader; the session's own settings come back."""
    now = batch_settings(rows)
    before = {key: spark.conf.get(key, None) for key in now}
    for key, value in now.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_held: dict = {}


def give_back() -> None:
    """Return memory that Arrow and the C library hold free to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library: memory goes back when it does
        pass


def trimmed(run: Callable) -> Callable:
    """A batch function whose task leaves no free memory behind in its worker."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return whole


def in_worker(owner: tuple, make: Callable):
    """What an operator keeps in a worker process between tasks. Workers are used again by other operators: a new owner frees what the last one held."""
    if _held.get("owner") != owner:
        _held.clear()
        gc.collect()
        give_back()
        _held.update(owner=owner, value=make())
    return _held["value"]


def normal_space(c: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), ASCII_WS, " ")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
