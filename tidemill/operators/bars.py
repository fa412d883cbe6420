"""Bars and returns: resampling, paths, segments, session calendars."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, ordered
from ..functions.prefix import running


def log_returns(df: DataFrame, price: str = "close", keys: Sequence[str] = KEYS, out: str = "log_return") -> DataFrame:
    """Null on the first bar of a series and where a price is not positive."""
    p = F.log(F.when(F.col(price) > 0, F.col(price)))
    return df.withColumn(out, p - F.lag(p).over(ordered(keys)))


def price_path(df: DataFrame, start: float, returns: str = "log_return", keys: Sequence[str] = KEYS, out: str = "price") -> DataFrame:
    total = running(df, {"__total": ("sum", F.coalesce(F.col(returns), F.lit(0.0)))}, keys, ORDER)
    return total.withColumn(out, start * F.exp("__total")).drop("__total")


def next_return(returns: str = "log_return", keys: Sequence[str] = KEYS) -> Column:
    return F.lead(returns).over(ordered(keys))


def resample_ticks(df: DataFrame, width: str, ts: str = "ts", value: str = "value", tie: str = "event_id", keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars of left-closed, left-labelled bins: open, high, low, close, volume (sum), n. Ticks of one time go by tie."""
    at = F.struct(ts, tie)
    return (
        df.groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume", "n")
    )


def resample_bars(df: DataFrame, width: str, ts: str = "ts", sums: Sequence[str] = ("volume",), keys: Sequence[str] = KEYS) -> DataFrame:
    """Wider bars from bars; bins without bars do not appear."""
    return (
        df.groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), *(F.sum(c).alias(c) for c in sums))
        .select(*keys, F.col("w.start").alias(ts), "open", "high", "low", "close", *sums)
    )


def segments(df: DataFrame, label: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of one label: segment (from 0), label, first and last bar, bars."""
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(ordered(keys))) & F.lag(ORDER).over(ordered(keys)).isNotNull(), 0).otherwise(1)
    marked = running(df.select(*keys, ORDER, label, changed.alias("new")), {"__met": ("sum", F.col("new"))}, keys, ORDER).withColumn("segment", F.col("__met") - 1)
    return marked.groupBy(*keys, "segment").agg(F.first(label).alias(label), F.min(ORDER).alias("first_bar"), F.max(ORDER).alias("last_bar"), F.count("*").alias("bars"))


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], stretch: str = "day", span: int = 1 << 16) -> DataFrame:
    """Each left row with the values of the last right row at or before its time, null if there is none.

    One shuffle by the keys and stretches of time and one sorted pass (union, last non-null value); no range join. What a
    stretch (a unit of time, or a span of times that are numbers) starts with is carried over from the stretches before, of which
    there is a row a key and stretch, so a key that holds most rows is still spread over tasks. Right rows of one time: the largest values as a struct.
    """
    payload = F.struct(*(F.col(v) for v in values))
    r = right.groupBy(*on, F.col(right_ts).alias("__ts")).agg(F.max(payload).alias("__v"))
    columns = left.columns
    both = left.withColumns({"__ts": F.col(left_ts), "__v": F.lit(None).cast(r.schema["__v"].dataType), "__side": F.lit(1)}).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    timed = both.schema["__ts"].dataType.typeName().startswith(("timestamp", "date"))
    both = both.withColumn("__stretch", F.date_trunc(stretch, F.col("__ts")) if timed else F.floor(F.col("__ts") / span))
    seen = Window.partitionBy(*on, "__stretch").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*on).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*on, "__stretch").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__ts"))).alias("__end"))
    ends = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    told = ends.withColumnsRenamed({k: f"__end_{k}" for k in (*on, "__stretch")})
    same = F.lit(True)
    for k in (*on, "__stretch"):
        same = same & F.col(k).eqNullSafe(F.col(f"__end_{k}"))
    filled = both.withColumn("__v", F.last("__v", ignorenulls=True).over(seen)).where("__side = 1").join(told, same, "left").withColumn("__v", F.coalesce("__v", "__carried"))
    return filled.select(*columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def business_days(spark, first: str, n: int) -> DataFrame:
    """day, weekday from Monday 0, first_of_month: the first n days from Monday to Friday."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.date_add(F.to_date(F.lit(first)), n * 2 + 7))).alias("day"))
    return days.where(F.weekday("day") < 5).orderBy("day").limit(n).withColumn("first_of_month", F.dayofmonth("day") <= F.when(F.weekday("day") == 0, 3).otherwise(1))


def next_fridays(day: Column, n: int) -> Column:
    """The next n Fridays strictly after a day."""
    first = F.next_day(day, "FRI")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.date_add(first, k.cast("int") * 7))


#: Bumps at the open and the close of volatility and of volume, and the minutes in which they fade.
VOLATILITY_BUMPS, VOLUME_BUMPS, FADE = (1.0, 0.5), (0.8, 0.4), 40.0


def intraday_profile(spark, minutes: int = 390) -> DataFrame:
    """minute, volatility (mean square 1), volume (mean 1): high at both ends of a session."""
    m = F.col("minute")
    raw = lambda bumps: 1 + bumps[0] * F.exp(-m / F.lit(FADE)) + bumps[1] * F.exp(-(minutes - m) / F.lit(FADE))
    table = spark.range(minutes).select(F.col("id").alias("minute")).select("minute", raw(VOLATILITY_BUMPS).alias("a"), raw(VOLUME_BUMPS).alias("b"))
    mean = table.agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rms"), F.avg("b").alias("mean"))
    return table.crossJoin(F.broadcast(mean)).select("minute", (F.col("a") / F.col("rms")).alias("volatility"), (F.col("b") / F.col("mean")).alias("volume"))
