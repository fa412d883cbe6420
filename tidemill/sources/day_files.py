"""Bars kept as a folder of Parquet files a day, as a Spark data source for batches and streams.

``spark.read.format("day_bars").schema(...).option("path", ...)`` lists folders ``day=YYYY-MM-DD``; each is a partition. Bounds that a
query puts on the time column are pushed into the source, which then lists and reads the days within them alone (Spark still
applies the bounds to the rows). As a stream its offset is the last day taken: a day is read once, when its folder is there, so a
day must be published whole (written elsewhere and renamed).

Paths go through Arrow's file systems (``file``, ``hdfs``, ``s3``, ``gs``). A session must have ``spark.sql.python.filterPushdown.enabled``
set for bounds to reach the source; without it every day is read.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT, FOLDER, TIME = "day_bars", "day=", "timestamp"


class Day(InputPartition):
    def __init__(self, day: str) -> None:
        self.day = day


class Days:
    """Listing and reading, the same for batches and streams."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"].rstrip("/")

    def _files(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def listed(self) -> list[str]:
        fs, root = self._files()
        found = fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name.removeprefix(FOLDER) for f in found if f.type == pa.fs.FileType.Directory and f.base_name.startswith(FOLDER))

    def rows(self, day: str) -> Iterator[pa.RecordBatch]:
        fs, root = self._files()
        wanted = to_arrow_schema(self.schema)
        for f in sorted(fs.get_file_info(pa.fs.FileSelector(f"{root}/{FOLDER}{day}")), key=lambda f: f.path):
            if f.type == pa.fs.FileType.File and f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as raw:
                    for batch in pq.ParquetFile(raw).iter_batches(columns=wanted.names):
                        yield from pa.Table.from_batches([batch]).select(wanted.names).cast(wanted).to_batches()


class DayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.days, self.low, self.high = Days(schema, options), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the time narrow the days. Every filter is given back: a day holds rows on both sides of a bound."""
        for f in filters:
            if getattr(f, "attribute", None) == (TIME,) and isinstance(getattr(f, "value", None), datetime):
                # Folders are named by the day in New York or UTC: a day on either side covers both.
                day = (f.value.astimezone(UTC) if f.value.tzinfo else f.value).date()
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(filter(None, (self.low, day - timedelta(days=1))))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(filter(None, (self.high, day + timedelta(days=1))))
            yield f

    def partitions(self) -> list[Day]:
        inside = lambda d: (self.low is None or d >= self.low) and (self.high is None or d <= self.high)
        return [Day(d) for d in self.days.listed() if inside(date.fromisoformat(d))]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark gives one empty partition where none is listed
            yield from self.days.rows(partition.day)


class DayStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.days = Days(schema, options)

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        return {"day": max(self.days.listed(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [Day(d) for d in self.days.listed() if start["day"] < d <= end["day"]]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        yield from self.days.rows(partition.day)


class DayBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        raise ValueError("give the schema of the bars: .schema(...)")

    def reader(self, schema: StructType) -> DayReader:
        return DayReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DayStream:
        return DayStream(schema, dict(self.options))


def write_days(df: DataFrame, path: str, ts: str = TIME, zone: str = "America/New_York") -> None:
    """A folder for each day of the zone; days that are there are replaced."""
    day = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(ts, F.current_timezone()).cast("timestamp_ntz")), "yyyy-MM-dd")
    df.withColumn("day", day).repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_days(spark: SparkSession, path: str, schema: StructType | str, stream: bool = False) -> DataFrame:
    """The bars of all days, or of those that the time bounds of the query leave."""
    spark.dataSource.register(DayBars)
    if stream:
        return spark.readStream.format(FORMAT).schema(schema).option("path", path).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(schema).option("path", path).load()
