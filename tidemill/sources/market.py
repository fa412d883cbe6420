"""The market data seam: half-open windows in New York time, every result held to its contract."""
from __future__ import annotations

from abc import ABC, abstractmethod
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import as_of, resample_bars
from .contracts import ZONE, validate_bars, validate_events, validate_option_chain, validate_quotes

FREQUENCIES = ("1min", "5min", "15min")


def in_new_york(value: datetime, name: str = "timestamp") -> datetime:
    """The value itself; naive values and other zones raise."""
    zone = "no time zone" if value.tzinfo is None else str(value.tzinfo)
    if zone != ZONE:
        raise ValueError(f"{name} must be told in {ZONE}, it has {zone}")
    return value


def check_window(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    start, end = in_new_york(start, "start"), in_new_york(end, "end")
    if not start < end:
        raise ValueError(f"start must be before end, got {start} and {end}")
    return start, end


def check_frequency(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}, got {freq!r}")
    return freq


def instant(value: datetime):
    return F.timestamp_seconds(F.lit(value.timestamp()))


class MarketDataSource(ABC):
    """What research code may see of a market. Bounds are pushed down to the scan as plain comparisons."""

    @abstractmethod
    def bars(self, start: datetime, end: datetime, freq: str = "1min") -> DataFrame: ...

    @abstractmethod
    def depth(self, start: datetime, end: datetime) -> DataFrame: ...

    @abstractmethod
    def option_chain(self, as_of: datetime) -> DataFrame: ...

    @abstractmethod
    def events(self, start: datetime, end: datetime) -> DataFrame: ...


class TableSource(MarketDataSource):
    """Over four tables: bars (timestamp, open, high, low, close, volume, bid_volume, ask_volume), quotes, chains, events.

    Tables are DataFrames, so a folder of Parquet, a catalog table or a synthetic frame serve alike. A table has no order but
    that of a column: where it has one of the name ``arrival`` (a number that rises with arrival), rows must have come in the
    order of their times; where it has none, time is the order. Checks work day by day or stretch by stretch, never on the whole
    table in one task.
    """

    def __init__(self, bars: DataFrame, quotes: DataFrame, chains: DataFrame, events: DataFrame, arrival: str = "arrival") -> None:
        self._bars, self._quotes, self._chains, self._events, self._arrival = bars, quotes, chains, events, arrival

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str) -> TableSource:
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("bars", "quotes", "chains", "events")))

    def _window(self, df: DataFrame, start: datetime, end: datetime) -> DataFrame:
        start, end = check_window(start, end)
        return df.where((F.col("timestamp") >= instant(start)) & (F.col("timestamp") < instant(end)))

    def _order(self, df: DataFrame) -> str:
        return self._arrival if self._arrival in df.columns else "timestamp"

    def bars(self, start: datetime, end: datetime, freq: str = "1min") -> DataFrame:
        check_frequency(freq)
        found = self._window(self._bars, start, end)
        if freq != "1min":
            if self._arrival in found.columns:  # bins have no arrival of their own: their bars are checked before
                validate_bars(found, self._arrival)
            sums = [c for c in ("volume", "bid_volume", "ask_volume") if c in found.columns]
            found = resample_bars(found, f"{freq[:-3]} minutes", "timestamp", sums, ())
        validate_bars(found, self._order(found))
        return found

    def depth(self, start: datetime, end: datetime) -> DataFrame:
        found = self._window(self._quotes, start, end)
        validate_quotes(found, self._order(found))
        return found

    def option_chain(self, as_of: datetime) -> DataFrame:
        at = instant(in_new_york(as_of, "as_of"))
        last = self._chains.where(F.col("as_of") <= at).agg(F.max("as_of").alias("as_of"))
        if last.first()["as_of"] is None:
            raise ValueError(f"no option chain at or before {as_of}")
        found = self._chains.join(F.broadcast(last), "as_of")
        validate_option_chain(found.withColumn("row", F.concat_ws(" ", "expiry", "strike")))
        return found

    def events(self, start: datetime, end: datetime) -> DataFrame:
        found = self._window(self._events, start, end)
        validate_events(found, self._order(found))
        return found


def spot_as_of(requests: DataFrame, bars: DataFrame, keys: list[str], request_ts: str, bar_ts: str) -> DataFrame:
    """Each request with the close of the last bar at or before it."""
    return as_of(requests, bars, keys, request_ts, bar_ts, ["close"])
