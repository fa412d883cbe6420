"""Running a stream over what is there now, as tests and queries do."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: the state of a stream lives there")
    base = base or "file://" + tempfile.mkdtemp(prefix="tidemill-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@contextmanager
def sorts_allowed(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside may sort within the partitions of a trigger; Spark looks at that when they start."""
    key = "spark.sql.streaming.unsupportedOperationCheck"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def available_now(df: DataFrame, mode: str = "append", sorts: bool = False) -> DataFrame:
    """Process everything the source has, into Parquet, and read it back. sorts: the stream sorts within its triggers."""
    base = folder(df.sparkSession)
    writer = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    with sorts_allowed(df.sparkSession) if sorts else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
