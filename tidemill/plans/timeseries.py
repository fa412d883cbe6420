"""Queries on mean reversion, surprises, consensus, Hurst exponents, kernels, folds and the overfitting gate."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, bars, consensus, flow, hurst, kernel, online, regimes, reversion, stats, surprise
from . import views as V
from .registry import Queries, query, rounded

QUERIES: Queries = {}
BY = "PARTITION BY series_id ORDER BY bar_idx"
BIAS = "CASE regime WHEN 'bull' THEN 1.0 WHEN 'bear' THEN -1.0 ELSE 0.0 END"


def level(spark, d) -> DataFrame:
    return V.series(spark, d).withColumn("level", F.log("close"))


OU = f"""l AS (SELECT *, ln(close) AS level FROM series), x AS (SELECT *, lag(level) OVER ({BY}) AS x, level - lag(level) OVER ({BY}) AS dx FROM l),
ou0 AS (SELECT *, count(dx) OVER w AS k, regr_slope(dx, x) OVER w AS b, regr_intercept(dx, x) OVER w AS a, regr_syy(dx, x) OVER w AS syy, regr_sxx(dx, x) OVER w AS sxx, regr_sxy(dx, x) OVER w AS sxy FROM x WINDOW w AS ({BY} ROWS BETWEEN 98 PRECEDING AND CURRENT ROW)),
ou AS (SELECT *, CASE WHEN k >= 19 THEN -b END AS theta, CASE WHEN k >= 19 AND b < 0 THEN -a / b END AS mu, CASE WHEN k >= 19 AND b < 0 THEN ln(2) / -b END AS half_life, CASE WHEN k >= 19 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / k) END AS resid_std FROM ou0)"""


@query(QUERIES, f"WITH {V.SERIES}, {OU} SELECT series_id, bar_idx, round(theta, 6) + 0 AS theta, round(mu, 5) + 0 AS mu, round(half_life, 5) + 0 AS half_life, round(resid_std, 6) + 0 AS resid_std FROM ou")
def ou_half_life(spark, d) -> DataFrame:
    df = reversion.ou_fit(level(spark, d), "level", least=20).select("series_id", "bar_idx", "theta", "mu", "half_life", "resid_std")
    return rounded(rounded(df, 6, ["theta", "resid_std"]), 5, ["mu", "half_life"])


@query(QUERIES, f"WITH {V.SERIES}, {OU} SELECT series_id, bar_idx, round(CASE WHEN regime <> 'sideways' THEN NULL WHEN half_life IS NULL OR resid_std = 0 THEN 0 ELSE tanh((mu - level) / (resid_std / sqrt(2 * theta)) / 2) END, 5) + 0 AS signal FROM ou")
def ax_reversion(spark, d) -> DataFrame:
    df = reversion.ou_fit(level(spark, d), "level", least=20)
    return rounded(df.select("series_id", "bar_idx", F.when(F.col("regime") == "sideways", reversion.reversion_signal(F.col("level"))).alias("signal")), 5)


PARAMS = "params(event_type, w, half_life) AS (VALUES ('NFP', 1.0::DOUBLE, 3.0::DOUBLE), ('CPI', -1.0, 4.0), ('FOMC', -1.2, 7.0), ('GDP', 0.8, 3.0))"
WSS = f"surprise * w * (1 + 0.3::DOUBLE * sign(surprise * w) * {BIAS}) * CASE WHEN age < 0 OR age > half_life * 5 THEN 0 ELSE pow(0.5::DOUBLE, age / half_life) END"


@query(QUERIES, f"WITH {V.MACRO_SQL}, {PARAMS}, e AS (SELECT *, 1.5::DOUBLE AS age FROM macro JOIN params USING (event_type), (VALUES ('bull'), ('bear'), ('sideways')) r(regime)) SELECT event_ts, event_type, regime, round({WSS}, 8) + 0 AS wss FROM e")
def wss_event(spark, d) -> DataFrame:
    labels = spark.createDataFrame([("bull",), ("bear",), ("sideways",)], "regime string")
    e = V.macro(spark, d).crossJoin(F.broadcast(labels))
    return rounded(e.select("event_ts", "event_type", "regime", S.surprise_score(F.col("surprise"), F.col("event_type"), F.lit(1.5), F.col("regime")).alias("wss")), 8)


CONTEXT = f"""acting AS (SELECT b.series_id, b.bar_idx, b.regime, m.*, p.w, p.half_life, epoch(b.bar_ts - m.event_ts) / 86400.0::DOUBLE AS age FROM daily b, macro m JOIN params p USING (event_type) WHERE b.bar_ts >= m.event_ts AND epoch(b.bar_ts - m.event_ts) / 86400.0::DOUBLE <= 5 * p.half_life),
context AS (SELECT b.series_id, b.bar_idx, b.regime, count(a.event_ts) > 0 AS active, count(a.event_ts) AS n_events, coalesce(sum({WSS.replace("regime", "a.regime")}), 0) AS wss FROM daily b LEFT JOIN acting a ON a.series_id = b.series_id AND a.bar_idx = b.bar_idx GROUP BY ALL)"""


def context(spark, d) -> DataFrame:
    return surprise.surprise_context(V.daily(spark, d), V.macro(spark, d), "bar_ts")


@query(QUERIES, f"WITH {V.DAILY}, {V.MACRO_SQL}, {PARAMS}, {CONTEXT} SELECT series_id, bar_idx, active, n_events, round(wss, 6) + 0 AS wss FROM context")
def surprise_context(spark, d) -> DataFrame:
    df = context(spark, d).select("series_id", "bar_idx", "active", F.coalesce(F.size("events"), F.lit(0)).cast("bigint").alias("n_events"), "wss")
    return rounded(df.withColumn("n_events", F.when(F.col("active"), F.col("n_events")).otherwise(0)), 6)


KERNEL = f"""ks AS (SELECT *, list(close) OVER ({BY} ROWS BETWEEN 45 PRECEDING AND CURRENT ROW) AS ys FROM series),
ke AS (SELECT *, list_sum(list_transform(range(1, len(ys) + 1), lambda i: ys[i] * exp(-0.5::DOUBLE * pow((len(ys) - i) / 5.0::DOUBLE, 2)))) / list_sum(list_transform(range(1, len(ys) + 1), lambda i: exp(-0.5::DOUBLE * pow((len(ys) - i) / 5.0::DOUBLE, 2)))) AS estimate FROM ks),
kd AS (SELECT *, CASE WHEN count(*) OVER w >= 20 AND stddev_samp(close - estimate) OVER w > 0 THEN (close - estimate) / stddev_samp(close - estimate) OVER w END AS deviation FROM ke WINDOW w AS ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
SIGNALS = f"""{KERNEL}, sg AS (SELECT series_id, bar_idx, regime, log_return, round((log_return - avg(log_return) OVER w) / stddev_samp(log_return) OVER w, 6) AS order_flow, round(deviation, 6) AS kernel_dev FROM kd WINDOW w AS ({BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, {BIAS} AS v_regime, tanh(order_flow / 2) AS v_flow, -tanh(kernel_dev / 2) AS v_kernel FROM sg WHERE order_flow IS NOT NULL AND kernel_dev IS NOT NULL)"""


def signals(spark, d) -> DataFrame:
    """series_id, bar_idx, regime, log_return, order_flow, kernel_dev: rounded, so that both engines decide alike."""
    from ..functions.frames import trailing

    df = kernel.causal_deviation(V.series(spark, d), 5, window=60)
    w = trailing(20)
    sd = F.stddev_samp("log_return").over(w)
    df = df.withColumn("order_flow", F.round((F.col("log_return") - F.avg("log_return").over(w)) / F.when(sd > 0, sd), 6)).withColumn("kernel_dev", F.round("deviation", 6))
    return df.where("order_flow is not null and kernel_dev is not null").select("series_id", "bar_idx", "regime", "log_return", "order_flow", "kernel_dev")


def voted(spark, d, wss=None) -> tuple[DataFrame, dict]:
    return signals(spark, d), consensus.votes_of(F.col("regime"), F.col("order_flow"), F.col("kernel_dev"), wss=wss)


@query(QUERIES, f"WITH {V.SERIES}, {SIGNALS}, s AS (SELECT *, round((v_regime + v_flow + v_kernel) / 3, 6) + 0 AS score FROM v) SELECT series_id, bar_idx, score, CASE WHEN score > 0.15 THEN 'bullish' WHEN score < -0.15 THEN 'bearish' ELSE 'neutral' END AS label, CASE WHEN log_return >= 0 THEN 'dampening' ELSE 'amplifying' END AS volatility_regime FROM s")
def consensus_equal(spark, d) -> DataFrame:
    df, votes = voted(spark, d)
    df = rounded(consensus.consensus(df, votes, gex=F.col("log_return")), 6, ["score"])
    return df.select("series_id", "bar_idx", "score", S.band_label(F.col("score")).alias("label"), "volatility_regime")


@query(QUERIES, f"WITH {V.SERIES}, {SIGNALS}, s AS (SELECT *, round((2 * v_regime + v_flow + 0.5::DOUBLE * v_kernel + 1.5::DOUBLE * tanh(log_return * 10 / 2)) / 5, 6) + 0 AS score FROM v) SELECT series_id, bar_idx, score, CASE WHEN score > 0.15 THEN 'bullish' WHEN score < -0.15 THEN 'bearish' ELSE 'neutral' END AS label FROM s")
def consensus_surprise(spark, d) -> DataFrame:
    df, votes = voted(spark, d, F.col("log_return") * 10)
    df = rounded(consensus.consensus(df, votes, {"regime": 2.0, "order_flow": 1.0, "kernel": 0.5}, surprise_weight=1.5), 6, ["score"])
    return df.select("series_id", "bar_idx", "score", S.band_label(F.col("score")).alias("label"))


DFA = """pr AS (SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY {o}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n, sum(r - m) OVER (PARTITION BY {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT *, avg(r) OVER (PARTITION BY {k}) AS m FROM rr)),
bx AS (SELECT DISTINCT {k}, n, round_even(pow(10, 1 + (log10(n // 4) - 1) * q / 14.0::DOUBLE), 0)::INT AS box FROM pr, range(15) t(q)),
sg0 AS (SELECT {kp}, b.box, w, p.n // b.box AS ns, p.i - CASE w WHEN 0 THEN 0 ELSE p.n - (p.n // b.box) * b.box END AS pos, p.y FROM pr p JOIN bx b USING ({k}), range(2) t(w) WHERE b.box >= 4 AND p.n // b.box >= 2),
ms AS (SELECT {k}, box, w, pos // box AS seg, (regr_syy(y, (pos % box)::DOUBLE) - regr_sxy(y, (pos % box)::DOUBLE) ** 2 / regr_sxx(y, (pos % box)::DOUBLE)) / count(*) AS mse FROM sg0 WHERE pos >= 0 AND pos < ns * box GROUP BY ALL),
fl AS (SELECT {k}, box, sqrt(avg(mse)) AS f FROM ms GROUP BY ALL),
hu AS (SELECT {k}, regr_slope(log10(f), log10(box)) AS hurst, regr_intercept(log10(f), log10(box)) AS intercept, count(*) AS boxes FROM fl WHERE f > 0 GROUP BY {k})"""


def dfa_sql(keys: str, order: str) -> str:
    return DFA.format(k=keys, o=order, kp=", ".join(f"p.{c.strip()}" for c in keys.split(",")))


RETURNS = "rr AS (SELECT series_id, bar_idx, log_return AS r FROM series WHERE log_return IS NOT NULL)"


@query(QUERIES, f"WITH {V.SERIES}, {RETURNS}, {dfa_sql('series_id', 'bar_idx')} SELECT series_id, round(hurst, 7) + 0 AS hurst, round(intercept, 6) + 0 AS intercept, boxes FROM hu")
def hurst_dfa(spark, d) -> DataFrame:
    df = hurst.dfa(V.series(spark, d))
    return rounded(rounded(df, 7, ["hurst"]), 6, ["intercept"])


@query(QUERIES, f"""WITH {V.SERIES}, r0 AS (SELECT series_id, bar_idx, log_return AS r, max(bar_idx) OVER (PARTITION BY series_id) AS last, min(bar_idx) OVER (PARTITION BY series_id) AS first FROM series WHERE log_return IS NOT NULL),
rr AS (SELECT r0.series_id, e.end_bar, r0.bar_idx, r FROM r0 JOIN (SELECT series_id, unnest(range(first + 251, last + 1)) AS end_bar FROM (SELECT DISTINCT series_id, first, last FROM r0)) e ON e.series_id = r0.series_id AND r0.bar_idx BETWEEN e.end_bar - 251 AND e.end_bar),
{dfa_sql('series_id, end_bar', 'bar_idx')} SELECT series_id, end_bar, round(hurst, 6) + 0 AS hurst FROM hu""")
def hurst_rolling(spark, d) -> DataFrame:
    return rounded(hurst.rolling_exponent(V.series(spark, d)), 6)


#: iv: the exponent of each whole series (resample -1 of hu) and the percentiles of its resamples.
INTERVAL = f"""r0 AS (SELECT series_id, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, log_return AS r FROM series WHERE log_return IS NOT NULL),
bl AS (SELECT DISTINCT series_id, n, least(n, greatest(10, round(2 * pow(n, 1 / 3.0::DOUBLE))::BIGINT)) AS block FROM r0),
bk AS (SELECT *, unnest(range((n + block - 1) // block)) AS k FROM bl),
st AS (SELECT *, unnest(range(block)) AS j FROM (SELECT bk.*, rs AS resample, ('0x' || substr(md5(rs || ':' || k), 1, 8))::BIGINT % (n - block + 1) AS start FROM bk, range({hurst.RESAMPLES}) a(rs))),
rr AS (SELECT st.series_id, resample, k * block + j AS pos, r FROM st JOIN r0 ON r0.series_id = st.series_id AND r0.i = st.start + st.j WHERE k * block + j < st.n UNION ALL SELECT series_id, -1, i, r FROM r0),
{dfa_sql('series_id, resample', 'pos')},
iv AS (SELECT series_id, max(hurst) FILTER (resample < 0) AS hurst, quantile_cont(hurst, 0.025) FILTER (resample >= 0) AS ci_low, quantile_cont(hurst, 0.975) FILTER (resample >= 0) AS ci_high, count(*) FILTER (resample >= 0) AS resamples FROM hu GROUP BY series_id)"""


@query(QUERIES, f"WITH {V.SERIES}, {INTERVAL} SELECT series_id, round(hurst, 6) + 0 AS hurst, round(ci_low, 6) + 0 AS ci_low, round(ci_high, 6) + 0 AS ci_high, resamples FROM iv")
def hurst_block_bootstrap(spark, d) -> DataFrame:
    return rounded(hurst.series_interval(V.series(spark, d)), 6)


@query(QUERIES, f"""WITH {V.SERIES}, {SIGNALS}, {INTERVAL}, b AS (SELECT series_id, round(0.15::DOUBLE * CASE WHEN ci_low <= 0.5 AND ci_high >= 0.5 THEN 2 ELSE 2 - least(abs(hurst - 0.5) / 0.5, 1) * 1.5 END, 6) + 0 AS band FROM iv),
s AS (SELECT v.series_id, bar_idx, band, round((v_regime + v_flow + v_kernel) / 3, 6) + 0 AS score FROM v JOIN b USING (series_id))
SELECT series_id, bar_idx, score, band, CASE WHEN score > band THEN 'bullish' WHEN score < -band THEN 'bearish' ELSE 'neutral' END AS label FROM s""")
def consensus_hurst_band(spark, d) -> DataFrame:
    multiplier = F.when(F.col("hurst").isNull(), 2.0).otherwise(S.hurst_multiplier(F.col("hurst"), F.col("ci_low"), F.col("ci_high")))
    h = hurst.series_interval(V.series(spark, d)).select("series_id", F.round(S.NEUTRAL_BAND * multiplier, 6).alias("band"))
    df, votes = voted(spark, d)
    df = rounded(consensus.consensus(df.join(h, "series_id"), votes, band=F.col("band")), 6, ["score"])
    return df.select("series_id", "bar_idx", "score", "band", S.band_label(F.col("score"), F.col("band")).alias("label"))


DYNAMIC = ", ".join(f"CASE WHEN count(*) OVER w > 0 THEN greatest(avg(CASE WHEN sign({v}) <> 0 AND sign({v}) = sign(nxt) THEN 1.0 ELSE 0.0 END) OVER w - 0.5::DOUBLE, 0) + 0.01::DOUBLE END AS weight_{n}" for v, n in (("v_regime", "regime"), ("v_flow", "order_flow"), ("v_kernel", "kernel")))


def resolved(spark, d) -> DataFrame:
    df, votes = voted(spark, d)
    return df.withColumns(votes).withColumn("outcome", bars.next_return())


@query(QUERIES, f"WITH {V.SERIES}, {SIGNALS}, n AS (SELECT *, lead(log_return) OVER ({BY}) AS nxt FROM v), w AS (SELECT series_id, bar_idx, {DYNAMIC} FROM n WHERE nxt IS NOT NULL WINDOW w AS ({BY} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT series_id, bar_idx, round(weight_regime, 8) AS weight_regime, round(weight_order_flow, 8) AS weight_order_flow, round(weight_kernel, 8) AS weight_kernel FROM w")
def dynamic_weights(spark, d) -> DataFrame:
    df = consensus.dynamic_weights(resolved(spark, d).where("outcome is not null").withColumn("regime_label", F.col("regime")), consensus.VOTES, "outcome")
    return rounded(df.select("series_id", "bar_idx", *(f"weight_{v}" for v in consensus.VOTES)), 8)


@query(QUERIES, f"""WITH {V.SERIES}, {SIGNALS}, s AS (SELECT *, round((v_regime + v_flow + v_kernel) / 3, 6) + 0 AS score FROM v),
a AS (SELECT *, ((sign(v_regime) = sign(score))::INT + (sign(v_flow) = sign(score))::INT + (sign(v_kernel) = sign(score))::INT) / 3.0::DOUBLE AS agreement FROM s)
SELECT series_id, bar_idx, round(CASE WHEN abs(score) <= 0.1 THEN 0 ELSE sign(score) * (abs(score) - 0.1::DOUBLE) / 0.9::DOUBLE * agreement * 0.75::DOUBLE END, 7) + 0 AS position FROM a""")
def position_size(spark, d) -> DataFrame:
    df, votes = voted(spark, d)
    df = rounded(df.withColumn("score", consensus.score_of(votes, consensus.weights_of(None, list(votes)))), 6, ["score"])
    return rounded(df.select("series_id", "bar_idx", S.position_size(F.col("score"), list(votes.values()), F.lit(0.05), 0.2, 0.1).alias("position")), 7)


@query(QUERIES, f"WITH {V.SERIES}, n AS (SELECT series_id, count(*) AS n, count(*) // 9 AS block FROM series GROUP BY ALL) SELECT series_id, fold::INT AS fold, block * fold AS train_end, CASE WHEN fold = 8 THEN n ELSE block * (fold + 1) END AS test_end FROM n, range(1, 9) f(fold)")
def walk_forward_folds(spark, d) -> DataFrame:
    return regimes.folds(V.series(spark, d), 8, 20)


@query(QUERIES, f"WITH {V.SERIES}, {KERNEL} SELECT series_id, bar_idx, round(estimate, 4) + 0 AS estimate FROM ke")
def kernel_causal(spark, d) -> DataFrame:
    return rounded(kernel.causal_estimate(V.series(spark, d), 5).select("series_id", "bar_idx", "estimate"), 4)


@query(QUERIES, f"WITH {V.SERIES}, {KERNEL} SELECT series_id, bar_idx, round(deviation, 6) + 0 AS deviation FROM kd")
def kernel_deviation(spark, d) -> DataFrame:
    return rounded(kernel.causal_deviation(V.series(spark, d), 5, window=60).select("series_id", "bar_idx", "deviation"), 6)


@query(QUERIES, f"""WITH {V.SERIES}, e AS (SELECT a.series_id, a.bar_idx, any_value(a.close) AS close, sum(b.close * exp(-0.5::DOUBLE * pow((a.bar_idx - b.bar_idx) / 8.0::DOUBLE, 2))) / sum(exp(-0.5::DOUBLE * pow((a.bar_idx - b.bar_idx) / 8.0::DOUBLE, 2))) AS estimate
FROM series a JOIN series b ON a.series_id = b.series_id AND b.bar_idx BETWEEN a.bar_idx - 72 AND a.bar_idx + 72 GROUP BY a.series_id, a.bar_idx)
SELECT series_id, bar_idx, round(estimate, 4) + 0 AS estimate, round((close - estimate) / stddev_pop(close - estimate) OVER (PARTITION BY series_id), 6) + 0 AS signal FROM e""")
def kernel_two_sided(spark, d) -> DataFrame:
    df = kernel.two_sided_deviation(kernel.two_sided_estimate(V.series(spark, d), 8))
    return rounded(rounded(df.select("series_id", "bar_idx", "estimate", "signal"), 4, ["estimate"]), 6, ["signal"])


@query(QUERIES, f"""WITH {V.SERIES}, h AS (SELECT unnest([{", ".join(f"{h}.0::DOUBLE" for h in kernel.BANDWIDTHS)}]) AS h),
e AS (SELECT a.series_id, a.bar_idx, h.h, any_value(a.close) AS close, sum(b.close * exp(-0.5::DOUBLE * pow((a.bar_idx - b.bar_idx) / h.h, 2))) / sum(exp(-0.5::DOUBLE * pow((a.bar_idx - b.bar_idx) / h.h, 2))) AS estimate
FROM series a, h JOIN series b ON a.series_id = b.series_id AND b.bar_idx BETWEEN a.bar_idx - (9 * h.h)::INT AND a.bar_idx + (9 * h.h)::INT AND a.bar_idx <> b.bar_idx GROUP BY a.series_id, a.bar_idx, h.h)
SELECT series_id, h AS bandwidth, round(avg((close - estimate) ** 2) / 1e6, 3) + 0 AS mse FROM e GROUP BY series_id, h""")
def kernel_loocv(spark, d) -> DataFrame:
    df = kernel.loocv(V.series(spark, d))
    return rounded(df.withColumn("mse", F.col("mse") / 1e6), 3, ["mse"])


@query(QUERIES, f"WITH {V.SERIES}, {SIGNALS}, n AS (SELECT *, (v_regime + v_flow + v_kernel) / 3 AS score, lead(log_return) OVER ({BY}) AS nxt FROM v) SELECT series_id, round(coalesce(sum(score * nxt) / nullif(sum(score * score), 0), 0), 7) + 0 AS scale FROM n WHERE nxt IS NOT NULL GROUP BY series_id")
def conformal_scale(spark, d) -> DataFrame:
    df = scored(spark, d)
    return rounded(df.groupBy("series_id").agg(online.slope_through_origin("score", "next_return").alias("scale")), 7)


def scored(spark, d) -> DataFrame:
    """signals with score, agreement and next_return; the last bar of a series has none and goes."""
    df, votes = voted(spark, d)
    df = df.withColumn("score", consensus.score_of(votes, consensus.weights_of(None, list(votes))))
    return df.withColumn("agreement", backtest.agreement_of(F.col("score"), list(votes.values()))).withColumn("next_return", bars.next_return()).where("next_return is not null")


def sql_phi(x: str) -> str:
    """Hart's approximation as SQL, from the fixed values of the scalar functions."""

    def horner(c: tuple[float, ...]) -> str:
        out = f"{c[0]!r}::DOUBLE"
        for v in c[1:]:
            out = f"({out} * abs({x}) + {v!r}::DOUBLE)"
        return out

    tail = f"(abs({x}) + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        tail = f"(abs({x}) + {k} / {tail})"
    c = f"CASE WHEN abs({x}) > 37 THEN 0 WHEN abs({x}) < {S.HART_SPLIT!r} THEN exp(-({x}) * ({x}) / 2) * {horner(S.HART_N)} / {horner(S.HART_D)} ELSE exp(-({x}) * ({x}) / 2) / {tail} / {S.HART_ROOT!r}::DOUBLE END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({c}) ELSE ({c}) END)"


@query(QUERIES, f"""WITH {V.SERIES}, m AS (SELECT series_id, avg(x) / stddev_samp(x) AS sr, count(x) AS n, (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / pow(var_pop(x), 1.5) AS sk, (avg(x ** 4) - 4 * avg(x) * avg(x ** 3) + 6 * avg(x) ** 2 * avg(x * x) - 3 * avg(x) ** 4) / pow(var_pop(x), 2) AS ku
FROM (SELECT series_id, log_return AS x FROM series WHERE log_return IS NOT NULL) GROUP BY series_id), t AS (SELECT (SELECT count(*) FROM nation)::DOUBLE AS k),
b AS (SELECT *, sqrt(2 * ln(k)) - (ln(ln(k)) + ln(4 * pi())) / (2 * sqrt(2 * ln(k))) AS best, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS v FROM m, t),
z AS (SELECT *, (sr - best * sqrt(1.0::DOUBLE / (n - 1))) / sqrt(v / (n - 1)) AS dsr FROM b)
SELECT series_id, n AS num_obs, round(sr, 8) + 0 AS sr, round(dsr, 6) + 0 AS dsr, round(1 - {sql_phi('dsr')}, 7) + 0 AS p_value FROM z""")
def dsr_gate(spark, d) -> DataFrame:
    r = F.col("log_return")
    k = V.table(spark, d, "nation").agg(F.count("*").cast("double").alias("k"))
    m = V.series(spark, d).where("log_return is not null").groupBy("series_id").agg(stats.sharpe(r).alias("sr"), F.count(r).alias("num_obs"), F.skewness(r).alias("sk"), (F.kurtosis(r) + 3).alias("ku")).crossJoin(F.broadcast(k))
    out = stats.deflated_sharpe(F.col("sr"), F.col("k"), F.col("num_obs"), F.col("sk"), F.col("ku"))
    df = m.select("series_id", "num_obs", "sr", out["dsr"].alias("dsr"), out["p_value"].alias("p_value"))
    return rounded(rounded(rounded(df, 8, ["sr"]), 6, ["dsr"]), 7, ["p_value"])


@query(QUERIES, f"""WITH {V.FLOW}, c AS (SELECT ts, bar_idx, corr(volume_delta, volume_delta_ma3) OVER w AS a, corr(volume_delta, obi) OVER w AS b, corr(obi, obi_ma10) OVER w AS e FROM features WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING))
SELECT ts, CASE WHEN bar_idx >= 59 THEN round(a, 6) + 0 END AS delta_ma3, CASE WHEN bar_idx >= 59 THEN round(b, 6) + 0 END AS delta_obi, CASE WHEN bar_idx >= 59 THEN round(e, 6) + 0 END AS obi_ma10 FROM c""")
def mp_corr_moments(spark, d) -> DataFrame:
    cols = ["volume_delta", "obi", "volume_delta_ma3", "obi_ma10"]
    df = flow.expanding_moments(V.flow_features(spark, d), cols)
    r = lambda i, j: F.when(F.col("n") >= flow.LEAST_ROWS, F.try_divide(F.col(f"cov_{i}_{j}"), F.sqrt(F.col(f"cov_{i}_{i}") * F.col(f"cov_{j}_{j}"))))
    return rounded(df.select("ts", r(0, 2).alias("delta_ma3"), r(0, 1).alias("delta_obi"), r(1, 3).alias("obi_ma10")), 6)
