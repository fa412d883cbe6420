"""Macro surprises: an interval join of bars with the events that still act on them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER
from ..functions.scalars import CUTOFF_HALF_LIVES, age_days, event_param, surprise_score

#: Events up to which their table is broadcast; beyond that both sides meet by day.
BROADCAST_EVENTS = 100_000


def surprise_context(bars: DataFrame, events: DataFrame, ts: str = "ts", label: str = "regime", cutoff: float = CUTOFF_HALF_LIVES, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each bar's active (any event of age 0 to cutoff half-lives), wss (their sum) and events (by date, type, surprise).

    events: event_ts, event_type, surprise; rows without a surprise are not released yet and skipped; an unknown type raises
    whether or not a bar meets it. The score decays to nothing at the standard cutoff whatever the cutoff here.
    """
    e = events.where(F.col("surprise").isNotNull() & ~F.isnan("surprise")).select("event_ts", "event_type", "surprise")
    e = e.withColumn("__reach", event_param(F.col("event_type"), 2) * cutoff)
    age = age_days(F.col(ts), F.col("event_ts"))
    rows = bars.select(*keys, ORDER, ts, label)
    if e.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS:
        met = rows.join(F.broadcast(e), (age >= 0) & (age <= F.col("__reach")))
    else:
        days = e.withColumn("__day", F.explode(F.sequence(F.to_date("event_ts"), F.date_add(F.to_date("event_ts"), F.ceil("__reach").cast("int") + 1))))
        met = rows.withColumn("__day", F.to_date(ts)).join(days, "__day").where((age >= 0) & (age <= F.col("__reach")))
    met = met.withColumn("age_days", age).withColumn("one", surprise_score(F.col("surprise"), F.col("event_type"), F.col("age_days"), F.col(label)))
    event = F.struct(F.col("event_ts"), "event_type", "surprise", "age_days", F.col("one").alias("wss"))
    sums = met.groupBy(*keys, ORDER).agg(F.array_sort(F.collect_list(event)).alias("events")).withColumn("wss", F.aggregate("events", F.lit(0.0), lambda a, x: a + x["wss"]))
    out = bars.join(sums, [*keys, ORDER], "left")
    return out.withColumn("active", F.col("events").isNotNull()).withColumn("wss", F.coalesce("wss", F.lit(0.0)))
