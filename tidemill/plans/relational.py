"""Queries on bars, flow, returns and their statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, bars, flow, stats
from ..sources import contracts
from . import views as V
from .registry import Queries, query, rounded

QUERIES: Queries = {}
BY = "PARTITION BY series_id ORDER BY bar_idx"


@query(QUERIES, f"WITH {V.HOURLY} SELECT series_id, bar_ts, open, high, low, close, round(volume, 6) + 0 AS volume, n FROM hourly")
def bars_resample(spark, d) -> DataFrame:
    return rounded(bars.resample_ticks(V.ticks(spark, d), "1 hour"), 6, ["volume"])


RULES = contracts.BAR_SAYS
GLOBEX = "((isodow(timestamp) <= 4 AND NOT (m >= 1020 AND m < 1080)) OR (isodow(timestamp) = 5 AND m < 1020) OR (isodow(timestamp) = 7 AND m >= 1080))"
BAD = [
    "timestamp IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL", "timestamp < before", "again", f"NOT {GLOBEX}",
    *(f"abs({c} / 0.25::DOUBLE - round_even({c} / 0.25::DOUBLE, 0)) > 1e-6" for c in contracts.PRICES), "high < low", "high < greatest(open, close)", "low > least(open, close)", "volume < 0",
]


@query(QUERIES, f"WITH {V.HOURLY}, b AS (SELECT series_id, bar_idx, bar_ts AS timestamp, open, high, low, close, n AS volume, hour(bar_ts) * 60 + minute(bar_ts) AS m, lag(bar_ts) OVER ({BY}) AS before, row_number() OVER (PARTITION BY series_id, bar_ts ORDER BY bar_idx) > 1 AS again FROM hourly) "
       + " UNION ALL ".join(f"SELECT {i} AS rule, '{s}' AS says, count(*) FILTER ({b}) AS violations, min(bar_idx) FILTER ({b}) AS first_row FROM b" for i, (s, b) in enumerate(zip(RULES, BAD))))
def bars_contract_report(spark, d) -> DataFrame:
    df = V.hourly(spark, d).select("series_id", "bar_idx", F.col("bar_ts").alias("timestamp"), "open", "high", "low", "close", F.col("n").alias("volume"))
    return contracts.report(contracts.prepared_bars(df, "bar_idx", ["series_id"]), contracts.bar_rules(df, naive=True), "bar_idx")


@query(QUERIES, f"""WITH e AS (SELECT event_type, ts AS timestamp, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT event_type, count(*) FILTER ({GLOBEX}) AS globex, count(*) FILTER (isodow(timestamp) <= 5 AND m >= 570 AND m < 960) AS cash, count(*) AS n FROM e GROUP BY event_type""")
def session_filter(spark, d) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_if(S.globex_open(F.col("ts"))).alias("globex"), F.count_if(S.cash_session(F.col("ts"))).alias("cash"), F.count("*").alias("n"))


@query(QUERIES, f"WITH {V.FLOW} SELECT ts, volume_delta, round(obi, 8) + 0 AS obi FROM features")
def flow_delta_obi(spark, d) -> DataFrame:
    return rounded(V.flow_features(spark, d).select("ts", "volume_delta", "obi"), 8, ["obi"])


@query(QUERIES, f"WITH {V.FLOW} SELECT ts, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in flow.FEATURES) + " FROM features")
def flow_features(spark, d) -> DataFrame:
    return rounded(V.flow_features(spark, d).select("ts", *flow.FEATURES), 6)


@query(QUERIES, f"""WITH {V.FLOW}, z AS (SELECT *, (volume_delta_ma5 - avg(volume_delta_ma5) OVER ()) / CASE WHEN stddev_pop(volume_delta_ma5) OVER () > 0 THEN stddev_pop(volume_delta_ma5) OVER () ELSE 1 END AS z0 FROM features),
v AS (SELECT *, round(tanh(z0 / 2), 6) + 0 AS vote FROM z)
SELECT ts AS trade_date, """ + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in flow.FEATURES) + ", round(z0, 6) + 0 AS z, vote, CASE WHEN vote > 0.15 THEN 'bullish' WHEN vote < -0.15 THEN 'bearish' ELSE 'neutral' END AS label FROM v")
def vote_label_m0(spark, d) -> DataFrame:
    """The flagship: daily flow, its features, the standardised vote and its label."""
    df = flow.standardised(V.flow_features(spark, d), "volume_delta_ma5", "z").withColumn("vote", F.round(S.tanh_vote(F.col("z")), 6) + 0.0)
    return rounded(df.select(F.col("ts").alias("trade_date"), *flow.FEATURES, "z", "vote", S.band_label(F.col("vote")).alias("label")), 6)


@query(QUERIES, f"WITH {V.SERIES} SELECT series_id, ts, bar_idx, close, round(log_return, 8) + 0 AS log_return FROM series")
def log_returns(spark, d) -> DataFrame:
    return rounded(V.series(spark, d).select("series_id", "ts", "bar_idx", "close", "log_return"), 8, ["log_return"])


@query(QUERIES, f"WITH {V.SERIES} SELECT series_id, bar_idx, round(100 * exp(sum(coalesce(log_return, 0)) OVER ({BY} ROWS UNBOUNDED PRECEDING)), 6) + 0 AS price FROM series")
def price_path(spark, d) -> DataFrame:
    return rounded(bars.price_path(V.series(spark, d), 100.0).select("series_id", "bar_idx", "price"), 6)


@query(QUERIES, f"""WITH {V.SERIES}, x AS (SELECT *, count(log_return) OVER w AS k, avg(abs(log_return)) OVER w AS ma, avg(log_return) OVER w AS m, avg(log_return * log_return) OVER w AS m2 FROM series WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING))
SELECT series_id, bar_idx, round(CASE WHEN k >= 20 THEN ma ELSE 0.008::DOUBLE END, 8) + 0 AS typical_abs, round(CASE WHEN k >= 20 THEN sqrt(greatest(m2 - m * m, 0)) ELSE 0.01::DOUBLE END, 8) + 0 AS scale FROM x""")
def expanding_scales(spark, d) -> DataFrame:
    return rounded(stats.expanding_scales(V.series(spark, d)).select("series_id", "bar_idx", "typical_abs", "scale"), 8)


DRAWDOWN = f"dd AS (SELECT *, (max(close) OVER ({BY} ROWS UNBOUNDED PRECEDING) - close) / max(close) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS drawdown FROM series)"


@query(QUERIES, f"WITH {V.SERIES}, {DRAWDOWN} SELECT series_id, bar_idx, round(drawdown, 8) + 0 AS drawdown FROM dd")
def drawdown(spark, d) -> DataFrame:
    return rounded(stats.drawdown(V.series(spark, d), "close").select("series_id", "bar_idx", "drawdown"), 8)


@query(QUERIES, f"""WITH {V.SERIES}, {DRAWDOWN}, l AS (SELECT series_id, bar_idx, list_reverse_sort(list(drawdown) OVER ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS v FROM dd)
SELECT series_id, bar_idx, round(list_avg(v[1:greatest(1, ceil(round(0.05::DOUBLE * len(v), 9))::INT)]), 8) + 0 AS cdar FROM l""")
def trailing_cdar(spark, d) -> DataFrame:
    return rounded(stats.trailing_cdar(V.series(spark, d), 0.05, 60, "close").select("series_id", "bar_idx", "cdar"), 8)


CENTRAL = """count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / pow(var_pop(x), 1.5) AS skew,
 (avg(x ** 4) - 4 * avg(x) * avg(x ** 3) + 6 * avg(x) ** 2 * avg(x * x) - 3 * avg(x) ** 4) / pow(var_pop(x), 2) - 3 AS kurtosis_excess"""


@query(QUERIES, f"""WITH {V.SERIES}, m AS (SELECT series_id, regime, {CENTRAL} FROM (SELECT *, log_return AS x FROM series) WHERE x IS NOT NULL GROUP BY series_id, regime HAVING count(x) > 3)
SELECT series_id, regime, n, round(mean, 6) + 0 AS mean, round(std, 6) + 0 AS std, round(skew, 5) + 0 AS skew, round(kurtosis_excess, 5) + 0 AS kurtosis_excess FROM m""")
def summary_stats(spark, d) -> DataFrame:
    df = stats.moments(V.series(spark, d).where("log_return is not null"), ["series_id", "regime"], "log_return").where("n > 3")
    df = rounded(df.select("series_id", "regime", "n", "mean", "std", "skew", "kurtosis_excess"), 6, ["mean", "std"])
    return rounded(df, 5, ["skew", "kurtosis_excess"])


@query(QUERIES, f"""WITH {V.SERIES}, m AS (SELECT series_id, {CENTRAL} FROM (SELECT *, log_return AS x FROM series) WHERE x IS NOT NULL GROUP BY series_id)
SELECT series_id, n, round(n / 6.0 * (skew * skew + kurtosis_excess * kurtosis_excess / 4), 4) + 0 AS jb, round(exp(-(n / 6.0 * (skew * skew + kurtosis_excess * kurtosis_excess / 4)) / 2), 8) + 0 AS jb_p FROM m""")
def jarque_bera(spark, d) -> DataFrame:
    df = stats.moments(V.series(spark, d).where("log_return is not null"), ["series_id"], "log_return").select("series_id", "n", "jb", "jb_p")
    return rounded(rounded(df, 4, ["jb"]), 8, ["jb_p"])


SEGMENTS = f"""g AS (SELECT series_id, bar_idx, regime, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER ({BY}) AND bar_idx > 0 THEN 0 ELSE 1 END AS new FROM series),
seg AS (SELECT series_id, segment, any_value(regime) AS regime, min(bar_idx) AS first_bar, max(bar_idx) AS last_bar, count(*) AS bars FROM (SELECT *, sum(new) OVER ({BY} ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS segment FROM g) GROUP BY series_id, segment)"""


@query(QUERIES, f"WITH {V.SERIES}, {SEGMENTS} SELECT * FROM seg")
def regime_segments(spark, d) -> DataFrame:
    return bars.segments(V.series(spark, d), "regime")


@query(QUERIES, f"WITH {V.SERIES}, {SEGMENTS} SELECT series_id, regime, count(*) AS segments, round(avg(bars), 6) + 0 AS mean_bars, min(bars) AS least_bars, max(bars) AS most_bars FROM seg GROUP BY ALL")
def segment_stats(spark, d) -> DataFrame:
    seg = bars.segments(V.series(spark, d), "regime")
    return rounded(seg.groupBy("series_id", "regime").agg(F.count("*").alias("segments"), F.avg("bars").alias("mean_bars"), F.min("bars").alias("least_bars"), F.max("bars").alias("most_bars")), 6)


@query(QUERIES, """SELECT event_id, round_even(value / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS nearest, ceil(value / 0.25::DOUBLE - 1e-9) * 0.25::DOUBLE AS up, floor(value / 0.25::DOUBLE + 1e-9) * 0.25::DOUBLE AS down FROM events""")
def tick_rounding(spark, d) -> DataFrame:
    v = F.col("value")
    return V.table(spark, d, "events").select("event_id", S.tick_round(v).alias("nearest"), S.tick_up(v).alias("up"), S.tick_down(v).alias("down"))


@query(QUERIES, """WITH v AS (SELECT minute, 1 + 1.0::DOUBLE * exp(-minute / 40.0::DOUBLE) + 0.5::DOUBLE * exp(-(390 - minute) / 40.0::DOUBLE) AS a, 1 + 0.8::DOUBLE * exp(-minute / 40.0::DOUBLE) + 0.4::DOUBLE * exp(-(390 - minute) / 40.0::DOUBLE) AS b FROM range(390) t(minute))
SELECT minute, round(a / (SELECT sqrt(avg(a * a)) FROM v), 8) + 0 AS volatility, round(b / (SELECT avg(b) FROM v), 8) + 0 AS volume FROM v""")
def intraday_profile(spark, d) -> DataFrame:
    return rounded(bars.intraday_profile(spark), 8)


@query(QUERIES, """WITH d AS (SELECT day::DATE AS day FROM range(DATE '2024-01-02', DATE '2024-06-30', INTERVAL 1 DAY) t(day) WHERE isodow(day) <= 5 ORDER BY day LIMIT 60)
SELECT day, list_transform(range(4), lambda k: (day + ((4 - (isodow(day) - 1) + 7 - 1) % 7 + 1)::INT + (7 * k)::INT)::DATE)::VARCHAR AS fridays FROM d""")
def session_calendar(spark, d) -> DataFrame:
    days = bars.business_days(spark, "2024-01-02", 60)
    text = F.concat(F.lit("["), F.array_join(F.transform(bars.next_fridays(F.col("day"), 4), lambda x: x.cast("string")), ", "), F.lit("]"))
    return days.select("day", text.alias("fridays"))


@query(QUERIES, f"""WITH {V.HOURLY}
SELECT r.event_id, r.ts, h.close AS spot FROM events r ASOF LEFT JOIN hourly h ON r.event_type = h.series_id AND r.ts >= h.bar_ts""")
def asof_spot(spark, d) -> DataFrame:
    """Each event with the last bar of its own type."""
    requests = V.table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("series_id"))
    found = bars.as_of(requests, V.hourly(spark, d).select("series_id", "bar_ts", "close"), ["series_id"], "ts", "bar_ts", ["close"])
    return found.select("event_id", "ts", F.col("close").alias("spot"))


@query(QUERIES, f"""WITH {V.SERIES}, p AS (SELECT *, CASE WHEN log_return IS NULL THEN 0 ELSE tanh(-log_return / 2) END AS position, lead(log_return) OVER ({BY}) AS next_return FROM series),
t AS (SELECT *, abs(position - coalesce(lag(position) OVER ({BY}), 0)) AS turnover, sign(position) <> sign(coalesce(lag(position) OVER ({BY}), 0)) AS is_trade FROM p WHERE next_return IS NOT NULL)
SELECT series_id, bar_idx, round(position, 8) + 0 AS position, round(turnover, 8) + 0 AS turnover, is_trade, round(position * next_return - 0.0002::DOUBLE * turnover, 8) + 0 AS net_return FROM t""")
def turnover_costs(spark, d) -> DataFrame:
    return rounded(fixed_positions(spark, d).select("series_id", "bar_idx", "position", "turnover", "is_trade", "net_return"), 8)


def fixed_positions(spark, d) -> DataFrame:
    df = V.series(spark, d).withColumn("position", F.coalesce(F.tanh(-F.col("log_return") / 2), F.lit(0.0))).withColumn("next_return", bars.next_return()).where("next_return is not null")
    return backtest.fixed_backtest(df, "position", "next_return")


@query(QUERIES, f"""WITH {V.SERIES}, p AS (SELECT *, CASE WHEN log_return IS NULL THEN 0 ELSE tanh(-log_return / 2) END AS position, lead(log_return) OVER ({BY}) AS next_return FROM series),
t AS (SELECT *, position * next_return - 0.0002::DOUBLE * abs(position - coalesce(lag(position) OVER ({BY}), 0)) AS net, sign(position) <> sign(coalesce(lag(position) OVER ({BY}), 0)) AS is_trade FROM p WHERE next_return IS NOT NULL)
SELECT series_id, count(*) AS bars, count(*) FILTER (is_trade) AS trades, round(count(*) FILTER (is_trade) / count(*) * 5, 8) + 0 AS trades_per_week, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0 AS sharpe FROM t GROUP BY series_id""")
def backtest_summary(spark, d) -> DataFrame:
    return rounded(rounded(stats.summary(fixed_positions(spark, d), ["series_id"]), 8, ["trades_per_week"]), 6, ["sharpe"])


def trials(spark, d) -> tuple[DataFrame, DataFrame]:
    n = V.table(spark, d, "nation")
    sweep = n.where("n_regionkey < 3").select(F.concat(F.lit("sweep_"), F.col("n_nationkey").cast("string")).alias("trial_id"), F.lit("sweep").alias("group"), (F.col("n_nationkey") / 50).alias("base_band"))
    walk = n.where("n_regionkey >= 3").select(F.concat(F.lit("wf_"), F.col("n_nationkey").cast("string")).alias("trial_id"), F.lit("walk").alias("group"), (F.col("n_nationkey") % 7).cast("bigint").alias("recal_window"))
    return sweep, walk


@query(QUERIES, """SELECT 'sweep_' || n_nationkey AS trial_id, 'sweep' AS "group", n_nationkey / 50.0::DOUBLE AS base_band, NULL::BIGINT AS recal_window FROM nation WHERE n_regionkey < 3
UNION ALL SELECT 'wf_' || n_nationkey, 'walk', NULL, n_nationkey % 7 FROM nation WHERE n_regionkey >= 3""")
def trial_log_union(spark, d) -> DataFrame:
    sweep, walk = trials(spark, d)
    return sweep.unionByName(walk, allowMissingColumns=True)


@query(QUERIES, """SELECT o_orderstatus, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS known, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS unknown FROM orders GROUP BY ALL""")
def trial_semi_anti(spark, d) -> DataFrame:
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    semi = o.join(c, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("known"))
    anti = o.join(c, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("unknown"))
    return semi.join(anti, "o_orderstatus", "full").na.fill(0)


@query(QUERIES, f"WITH {V.SERIES}, q AS (SELECT series_id, unnest(range(1, 20)) AS i, quantile_cont(log_return, list_transform(range(1, 20), lambda i: i / 20.0::DOUBLE)) AS v FROM series GROUP BY series_id) SELECT series_id, i / 20.0::DOUBLE AS p, round(v[i], 8) + 0 AS value FROM q")
def quantile_pairs(spark, d) -> DataFrame:
    return rounded(stats.quantile_pairs(V.series(spark, d), "log_return").select("series_id", "p", "value"), 8, ["value"])


@query(QUERIES, f"WITH {V.SERIES}, p AS (SELECT series_id, log_return AS a, lag(log_return) OVER ({BY}) AS b FROM series) SELECT series_id, round(corr(a, b), 8) + 0 AS autocorrelation FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY series_id")
def lag_autocorrelation(spark, d) -> DataFrame:
    return rounded(stats.lag_one_autocorrelation(V.series(spark, d), "log_return"), 8)


@query(QUERIES, f"WITH {V.SERIES}, p AS (SELECT *, CASE WHEN log_return > 0 THEN 'bull' ELSE 'bear' END AS guess FROM series WHERE log_return IS NOT NULL) SELECT series_id, round(avg(CASE WHEN guess = regime THEN 1.0 ELSE 0.0 END), 8) + 0 AS accuracy, count(*) AS n FROM p GROUP BY series_id")
def regime_accuracy(spark, d) -> DataFrame:
    df = V.series(spark, d).where("log_return is not null").withColumn("guess", F.when(F.col("log_return") > 0, "bull").otherwise("bear"))
    return rounded(df.groupBy("series_id").agg(F.avg(F.when(F.col("guess") == F.col("regime"), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n")), 8)


@query(QUERIES, f"""WITH {V.HOURLY} SELECT series_id, time_bucket(INTERVAL '6 hours', bar_ts) AS bar_ts, arg_min(open, bar_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_ts) AS close, sum(n)::BIGINT AS n FROM hourly GROUP BY series_id, time_bucket(INTERVAL '6 hours', bar_ts)""")
def bars_from_bars(spark, d) -> DataFrame:
    return bars.resample_bars(V.hourly(spark, d), "6 hours", "bar_ts", ["n"])
