"""Queries on streams, run over the events that are there."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import operators as ops
from ..streaming.run import available_now, table_stream
from . import views as V
from .models import bocpd_sql, gate_sql
from .registry import Queries, query, rounded

QUERIES: Queries = {}


def ticks(spark, d) -> DataFrame:
    return table_stream(spark, d, "events").select(F.col("event_type").alias("series_id"), "event_id", "ts", "value")


@query(QUERIES, f"WITH {V.HOURLY} SELECT series_id, bar_ts, open, high, low, close, round(volume, 6) + 0 AS volume, n FROM hourly WHERE bar_ts + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)")
def stream_bars(spark, d) -> DataFrame:
    """Append mode keeps back the bars that the watermark has not passed."""
    out = available_now(ops.stream_bars(ticks(spark, d), "1 hour"))
    return rounded(out.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")), 6, ["volume"])


BY = "PARTITION BY event_type ORDER BY event_id"


@query(QUERIES, bocpd_sql(f"x AS MATERIALIZED (SELECT event_type AS series_id, event_id AS bar_idx, ln(1 + value) AS x, row_number() OVER ({BY}) AS t FROM events)", False))
def stream_bocpd(spark, d) -> DataFrame:
    rows = ticks(spark, d).withColumn("bar_idx", F.col("event_id").cast("bigint")).withColumn("z", F.log1p("value"))
    return rounded(available_now(ops.stream_changepoints(rows, "z", spark_sorts=True), sorts=True), 6)


@query(QUERIES, gate_sql(f"""g AS (SELECT event_type AS series_id, event_id AS bar_idx, sin(event_id::DOUBLE) AS s, sin(event_id::DOUBLE) + ln(1 + value) / 10 AS r, row_number() OVER ({BY}) AS t FROM events),
sc AS (SELECT DISTINCT event_type AS series_id, 1.0::DOUBLE AS scale FROM events)"""))
def stream_gate(spark, d) -> DataFrame:
    rows = ticks(spark, d).withColumn("bar_idx", F.col("event_id").cast("bigint")).withColumn("score", F.sin(F.col("event_id").cast("double"))).withColumn("realised", F.sin(F.col("event_id").cast("double")) + F.log1p("value") / 10)
    out = available_now(ops.stream_gate(rows, "score", "realised", 1.0, spark_sorts=True), sorts=True)
    infinite = F.abs("lower") == float("inf")
    return rounded(out.withColumns({c: F.when(~infinite, F.col(c)) for c in ("upper", "lower")}), 8)
