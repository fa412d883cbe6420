"""Market-style views of the star-schema tables, as DataFrames and as the same SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import with_bar_index
from ..operators import bars, flow

MACRO = {"signup": "NFP", "error": "CPI", "purchase": "FOMC", "click": "GDP"}
STATUS = {"O": "bull", "F": "bear", "P": "sideways"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(c: str, names: dict[str, str]):
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in names.items():
        out = out.when(F.col(c) == k, v)
    return out


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "event_id", "ts", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, bar_ts, open, high, low, close, volume, n, bar_idx."""
    return with_bar_index(bars.resample_ticks(ticks(spark, sf_dir), "1 hour"), "bar_ts")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of events with a regime: the sign of close less open."""
    df = with_bar_index(bars.resample_ticks(ticks(spark, sf_dir), "1 day"), "bar_ts")
    return df.withColumn("regime", F.when(F.col("close") > F.col("open"), "bull").when(F.col("close") < F.col("open"), "bear").otherwise("sideways"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_ts, event_type, surprise: a day's mean value of a type in deviations of the type's values."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*MACRO))
    scale = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    day = e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_ts")).agg(F.avg("value").alias("v"))
    z = F.round((F.col("v") - F.col("m")) / F.col("sd"), 6)
    return day.join(scale, "event_type").select("event_ts", mapped("event_type", MACRO).alias("event_type"), z.alias("surprise"))


def series(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """series_id, ts, close, volume, regime, bar_idx, log_return: orders by priority and date; one series of all if whole."""
    key = F.lit("ALL") if whole else F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").groupBy(key.alias("series_id"), F.col("o_orderdate").alias("ts"), "o_orderstatus")
    o = o.agg(F.round(F.sum("o_totalprice"), 2).alias("t"), F.count("*").alias("n"))
    day = o.groupBy("series_id", "ts").agg(F.round(F.sum("t"), 2).alias("close"), F.sum("n").alias("volume"), F.max(F.struct("t", "o_orderstatus"))["o_orderstatus"].alias("status"))
    day = day.withColumn("regime", mapped("status", STATUS)).drop("status")
    return bars.log_returns(with_bar_index(day, "ts"))


def flow_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, buy, sell, bid_depth, ask_depth, bar_idx of lineitem by ship date."""
    li = table(spark, sf_dir, "lineitem")
    part = lambda c, v: F.coalesce(F.sum(F.when(F.col(c) == v, F.col("l_quantity"))), F.lit(0.0))
    day = li.groupBy(F.lit("ALL").alias("series_id"), F.col("l_shipdate").alias("ts")).agg(part("l_returnflag", "A").alias("buy"), part("l_returnflag", "R").alias("sell"), part("l_linestatus", "O").alias("bid_depth"), part("l_linestatus", "F").alias("ask_depth"))
    return with_bar_index(day, "ts")


def flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.features(flow_days(spark, sf_dir))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (brand), part, spot, strike, iv, call_oi, put_oi, years."""
    li = table(spark, sf_dir, "lineitem")
    oi = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("call_oi"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("put_oi"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"), F.col("p_retailprice").alias("strike"), (0.1 + F.col("p_size") / 200).alias("iv"))
    spot = p.groupBy("series_id").agg(F.round(F.avg("strike"), 2).alias("spot"))
    return p.join(spot, "series_id").join(oi, "p_partkey", "left").na.fill(0.0, ["call_oi", "put_oi"]).withColumn("years", F.lit(30 / 365.0))


#: The same views for DuckDB, each as common table expressions that may follow one another.
HOURLY = """
hourly0 AS (SELECT event_type AS series_id, time_bucket(INTERVAL '1 hour', ts) AS bar_ts, min({'ts': ts, 'e': event_id, 'v': value}).v AS open, max(value) AS high, min(value) AS low,
  max({'ts': ts, 'e': event_id, 'v': value}).v AS close, sum(value) AS volume, count(*) AS n FROM events GROUP BY ALL),
hourly AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bar_ts) - 1 AS bar_idx FROM hourly0)"""
DAILY = """
daily0 AS (SELECT event_type AS series_id, time_bucket(INTERVAL '1 day', ts) AS bar_ts, min({'ts': ts, 'e': event_id, 'v': value}).v AS open, max(value) AS high, min(value) AS low,
  max({'ts': ts, 'e': event_id, 'v': value}).v AS close, sum(value) AS volume, count(*) AS n FROM events GROUP BY ALL),
daily AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bar_ts) - 1 AS bar_idx, CASE WHEN close > open THEN 'bull' WHEN close < open THEN 'bear' ELSE 'sideways' END AS regime FROM daily0)"""
MACRO_SQL = """
macro AS (SELECT d.event_ts, CASE d.event_type WHEN 'signup' THEN 'NFP' WHEN 'error' THEN 'CPI' WHEN 'purchase' THEN 'FOMC' WHEN 'click' THEN 'GDP' END AS event_type, round((d.v - s.m) / s.sd, 6) AS surprise
  FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS event_ts, avg(value) AS v FROM events GROUP BY ALL) d
  JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL) s USING (event_type) WHERE event_type IN ('signup', 'error', 'purchase', 'click'))"""
SERIES_OF = """
series0 AS (SELECT {key} AS series_id, o_orderdate AS ts, o_orderstatus, round(sum(o_totalprice), 2) AS t, count(*) AS n FROM orders GROUP BY ALL),
series1 AS (SELECT series_id, ts, round(sum(t), 2) AS close, sum(n)::BIGINT AS volume, max({{'t': t, 's': o_orderstatus}}).s AS status FROM series0 GROUP BY series_id, ts),
series AS (SELECT series_id, ts, close, volume, CASE status WHEN 'O' THEN 'bull' WHEN 'F' THEN 'bear' WHEN 'P' THEN 'sideways' END AS regime,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx, ln(close) - lag(ln(close)) OVER (PARTITION BY series_id ORDER BY ts) AS log_return FROM series1)"""
SERIES = SERIES_OF.format(key="o_orderpriority")
SERIES_ALL = SERIES_OF.format(key="'ALL'")
FLOW = """
flow0 AS (SELECT 'ALL' AS series_id, l_shipdate AS ts, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS buy, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS sell,
  coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS bid_depth, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS ask_depth FROM lineitem GROUP BY ALL),
flow AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx, buy - sell AS volume_delta, CASE WHEN bid_depth + ask_depth = 0 THEN NULL ELSE (bid_depth - ask_depth) / (bid_depth + ask_depth) END AS obi FROM flow0),
features AS (SELECT *, avg(volume_delta) OVER w3 AS volume_delta_ma3, avg(obi) OVER w3 AS obi_ma3, avg(volume_delta) OVER w5 AS volume_delta_ma5, avg(obi) OVER w5 AS obi_ma5,
  avg(volume_delta) OVER w10 AS volume_delta_ma10, avg(obi) OVER w10 AS obi_ma10 FROM flow
  WINDOW w3 AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w10 AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
CHAIN = """
oi AS (SELECT l_partkey AS p_partkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS call_oi, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS put_oi FROM lineitem GROUP BY ALL),
chain AS (SELECT p.p_partkey, p_brand AS series_id, spot, p_retailprice AS strike, 0.1::DOUBLE + p_size / 200.0::DOUBLE AS iv, coalesce(call_oi, 0) AS call_oi, coalesce(put_oi, 0) AS put_oi, 30 / 365.0::DOUBLE AS years
  FROM part p JOIN (SELECT p_brand, round(avg(p_retailprice), 2) AS spot FROM part GROUP BY ALL) s USING (p_brand) LEFT JOIN oi USING (p_partkey))"""
