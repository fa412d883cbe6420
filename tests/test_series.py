import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests import sequential
from tests.causality import same_before
from tidemill.functions.frames import trailing, with_bar_index
from tidemill.operators import backtest, bars, consensus, flow, hurst, kernel, online, options, regimes, reversion, stats, surprise
from tidemill.sources import synthetic


def frame(spark, values, name="close", sid="A"):
    return spark.createDataFrame([(sid, i, float(v)) for i, v in enumerate(values)], f"series_id string, bar_idx bigint, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("bar_idx").collect()]


@pytest.fixture(scope="module")
def walk():
    return 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 260)))


@pytest.fixture(scope="module")
def spiked(walk):
    out = walk.copy()
    out[180] *= 50
    return out


CAUSAL = {
    "returns": (lambda df: bars.log_returns(df), ["log_return"]),
    "ou": (lambda df: reversion.ou_fit(df, window=50), ["theta", "mu", "resid_std"]),
    "trend": (lambda df: reversion.with_trend_slope(df, window=60), ["trend_slope"]),
    "kernel": (lambda df: kernel.causal_estimate(df, 5), ["estimate"]),
    "deviation": (lambda df: kernel.causal_deviation(df, 5, window=60), ["deviation"]),
    "scales": (lambda df: stats.expanding_scales(bars.log_returns(df)), ["typical_abs", "scale"]),
    "cdar": (lambda df: stats.trailing_cdar(df, 0.1, 40, "close"), ["cdar"]),
    "weights": (lambda df: consensus.dynamic_weights(bars.log_returns(df).withColumn("v", F.sin("bar_idx")), ["v"], "log_return", 30), ["weight_v"]),
    "changepoints": (lambda df: online.changepoints(bars.log_returns(df), "log_return"), ["change_prob", "expected_run", "map_run"]),
}


@pytest.mark.parametrize("name", CAUSAL)
def test_causal(spark, walk, spiked, name):
    operator, columns = CAUSAL[name]
    same_before(operator, frame(spark, walk), frame(spark, spiked), 180, columns)


def test_causal_composite_and_its_retrospective_form(spark):
    rng = np.random.default_rng(1)
    factor = rng.normal(size=200)
    x = np.stack([factor * rng.uniform(0.5, 1.5) + 2 * rng.normal(size=200) for _ in range(3)], axis=1)
    rows = lambda m: spark.createDataFrame([("A", i, *map(float, r)) for i, r in enumerate(m)], "series_id string, bar_idx bigint, a double, b double, c double")
    y = x.copy()
    y[150:] += 40
    same_before(lambda df: flow.causal_composite(df, ["a", "b", "c"], least=30), rows(x), rows(y), 150, ["composite"])
    got = column(flow.causal_composite(rows(x), ["a", "b", "c"], least=30), "composite")
    assert got[:29] == [None] * 29
    for t in (29, 80, 199):
        z = (x[: t + 1] - x[: t + 1].mean(axis=0)) / x[: t + 1].std(axis=0)
        v = np.linalg.eigh(np.corrcoef(z, rowvar=False))[1][:, -1]
        assert got[t] == pytest.approx(float(z[-1] @ (v if v.sum() >= 0 else -v)), rel=1e-8)
    whole = flow.whole_composite(rows(x), ["a", "b", "c"])
    assert column(whole, "composite")[-1] == pytest.approx(got[-1], rel=1e-8)
    assert whole.first()["mp_upper"] == pytest.approx((1 + math.sqrt(3 / 200)) ** 2)


def test_constant_feature_column(spark):
    df = spark.createDataFrame([("A", i, float(i % 7), 5.0, float(i % 3)) for i in range(40)], "series_id string, bar_idx bigint, a double, b double, c double")
    assert all(v is not None and math.isfinite(v) for v in column(flow.causal_composite(df, ["a", "b", "c"], least=10), "composite")[9:])


def test_drawdown_by_hand(spark):
    got = column(stats.drawdown(frame(spark, (100, 120, 90, 110, 130), "equity")), "drawdown")
    assert got == pytest.approx([0, 0, 0.25, 1 / 12, 0])


def test_tail_mean_counts_as_a_rounded_ceiling(spark):
    values = F.array(*(F.lit(float(v)) for v in range(20)))
    got = spark.range(1).select(stats.tail_mean(values, 0.05).alias("a"), stats.tail_mean(values, 0.1).alias("b"), stats.tail_mean(values, 0.11).alias("c"), stats.tail_mean(F.array().cast("array<double>"), 0.5).alias("d")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (19.0, 18.5, 18.0, 0.0)
    with pytest.raises(ValueError):
        stats.tail_mean(values, 0.0)


def test_published_deflated_sharpe(spark):
    def gate(trials):
        sr, skew, kurt = 0.55 / math.sqrt(252), 0.0, 3.0
        out = stats.deflated_sharpe(F.lit(sr), F.lit(float(trials)), F.lit(448.0), F.lit(skew), F.lit(kurt))
        return spark.range(1).select(*(c.alias(k) for k, c in out.items())).first()

    many, few, single = gate(189), gate(7), gate(1)
    assert many["dsr"] == pytest.approx(-1.86, abs=0.03) and few["dsr"] == pytest.approx(-0.43, abs=0.03)
    assert many["p_value"] == pytest.approx(0.97, abs=0.005) and single["dsr"] > 0 and many["min_length"] > few["min_length"]


def test_gate_of_a_logged_trial(spark):
    trials = spark.createDataFrame([("reported",), *[(f"other_{i}",) for i in range(6)]], "trial_id string")
    r = np.random.default_rng(2).normal(0.001, 0.01, 300)
    df = spark.createDataFrame([(float(x),) for x in r], "net_return double")
    got = stats.overfitting_gate(trials, "reported", df).first()
    assert got["num_trials"] == 7 and got["num_obs"] == 300 and got["observed_sr_per_period"] == pytest.approx(r.mean() / r.std(ddof=1))
    with pytest.raises(ValueError):
        stats.overfitting_gate(trials, "nobody", df)


def test_summary_of_one_row_and_moments(spark):
    one = spark.createDataFrame([("A", 0.01, True)], "series_id string, net_return double, is_trade boolean")
    got = stats.summary(one, ["series_id"]).first()
    assert (got["bars"], got["trades"], got["trades_per_week"], got["sharpe"]) == (1, 1, 5.0, 0.0)
    x = np.random.default_rng(4).gamma(2, 1, 500)
    m = stats.moments(frame(spark, x, "x"), ["series_id"], "x").first()
    z = (x - x.mean()) / x.std()
    assert m["skew"] == pytest.approx((z**3).mean()) and m["kurtosis_excess"] == pytest.approx((z**4).mean() - 3)
    assert m["jb_p"] == pytest.approx(math.exp(-m["jb"] / 2))


def test_segments_of_labels_with_nulls(spark):
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(["a", "a", None, None, "b", "a"])], "series_id string, bar_idx bigint, l string")
    got = sorted((r["segment"], r["l"], r["first_bar"], r["last_bar"]) for r in bars.segments(df, "l").collect())
    assert got == [(0, "a", 0, 1), (1, None, 2, 3), (2, "b", 4, 4), (3, "a", 5, 5)]


def test_as_of_carries_values_over_days(spark):
    from datetime import datetime, timedelta

    rng, start = np.random.default_rng(3), datetime(2024, 1, 1)
    at = lambda n: [start + timedelta(hours=float(h)) for h in np.sort(rng.uniform(0, 24 * 12, n)).round(2)]
    left = [(k, t) for k in "ab" for t in at(60)] + [(None, start + timedelta(days=3))]
    right = [(k, t, float(i)) for k in "ab" for i, t in enumerate(at(7))]
    got = sorted(bars.as_of(spark.createDataFrame(left, "k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v double"), ["k"], "t", "u", ["v"]).collect(), key=str)
    want = sorted(((k, t, max(((u, v) for j, u, v in right if j == k and u <= t), default=(None, None))[1]) for k, t in left), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_as_of_takes_equal_times_and_nothing_before(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("j", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 5, 50.0), ("k", 7, 70.0)], "k string, u long, v double")
    got = {(r["k"], r["t"]): r["v"] for r in bars.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("k", 1): None, ("k", 5): 50.0, ("k", 9): 70.0, ("j", 5): None}


def test_kernel_against_dense_matrices(spark, walk, monkeypatch):
    n = len(walk)
    lag = np.arange(n)[:, None] - np.arange(n)
    w = np.exp(-0.5 * (lag / 5) ** 2)
    one = np.tril(w)
    assert np.allclose(column(kernel.causal_estimate(frame(spark, walk), 5), "estimate"), one @ walk / one.sum(axis=1), rtol=1e-12)
    assert np.allclose(column(kernel.two_sided_estimate(frame(spark, walk), 5), "estimate"), w @ walk / w.sum(axis=1), rtol=1e-12)
    scores = {r["bandwidth"]: r["mse"] for r in kernel.loocv(frame(spark, walk), (2, 5, 12)).collect()}
    for h, mse in scores.items():
        k = np.exp(-0.5 * (lag / h) ** 2)
        np.fill_diagonal(k, 0)
        assert mse == pytest.approx(((walk - k @ walk / k.sum(axis=1)) ** 2).mean(), rel=1e-9)
    assert kernel.best_bandwidth(kernel.loocv(frame(spark, walk), (2, 5, 12))).first()["bandwidth"] == min(scores, key=scores.get)
    monkeypatch.setattr(kernel, "STRETCH", 32)  # a series in many stretches, each shorter than the reach
    cut = {r["bandwidth"]: r["mse"] for r in kernel.loocv(frame(spark, walk), (2, 5, 12)).collect()}
    assert cut == pytest.approx(scores, rel=1e-12)
    assert kernel.loocv(frame(spark, walk).limit(0), (2,)).count() == 0 and kernel.loocv(frame(spark, walk).limit(1), (2,)).first()["mse"] is None


def test_ou_recovery_and_errors(spark):
    level = synthetic.ou_path(2000, 0.15, 100.0, seed=3)
    got = reversion.ou_fit(frame(spark, level), window=2000).orderBy(F.desc("bar_idx")).first()
    x, d = level[:-1], np.diff(level)
    slope, intercept = np.polyfit(x, d, 1)
    assert got["theta"] == pytest.approx(-slope, rel=1e-8) and got["mu"] == pytest.approx(-intercept / slope, rel=1e-8)
    assert got["resid_std"] == pytest.approx((d - slope * x - intercept).std(), rel=1e-8) and got["half_life"] == pytest.approx(math.log(2) / -slope)
    assert 0.11 < got["theta"] < 0.2
    trend = reversion.ou_fit(frame(spark, np.exp(np.arange(60) / 10)), window=60).orderBy(F.desc("bar_idx")).first()
    assert trend["theta"] < 0 and trend["mu"] is None and trend["half_life"] is None
    with pytest.raises(ValueError):
        reversion.ou_fit(frame(spark, level[:5]), window=2)


def test_subsignal(spark):
    df = spark.createDataFrame([("bull", 2.0, None, None, None), ("sideways", 2.0, 1.0, 0.5, 10.0), ("sideways", 2.0, None, 0.5, None)], "regime string, trend_slope double, half_life double, resid_std double, mu double").withColumn("theta", F.lit(0.1)).withColumn("close", F.lit(9.0))
    got = [r["s"] for r in df.select(reversion.subsignal(F.col("regime"), F.col("close")).alias("s")).collect()]
    assert got == pytest.approx([math.tanh(1.0), math.tanh(1 / (0.5 / math.sqrt(0.2)) / 2), 0.0])
    with pytest.raises(PySparkException):
        df.select(reversion.subsignal(F.lit("crab"), F.col("close"))).collect()


def test_trend_slope_of_windows(spark, walk):
    got = column(reversion.with_trend_slope(frame(spark, walk), window=60), "trend_slope")
    for t in (1, 5, 59, 120, 259):
        assert got[t] == pytest.approx(reversion.trend_slope(walk[max(0, t - 59) : t + 1]), rel=1e-7)


def dfa_loop(r, least=10, boxes=15):
    y, n = np.cumsum(r - r.mean()), len(r)
    sizes = np.unique(np.round(np.logspace(np.log10(least), np.log10(n // 4), boxes)).astype(int))
    f = []
    for b in sizes:
        k, parts = n // b, []
        for start in (0, n - (n // b) * b):
            for s in range(k):
                seg = y[start + s * b : start + (s + 1) * b]
                parts.append(((seg - np.polyval(np.polyfit(np.arange(b), seg, 1), np.arange(b))) ** 2).mean())
        f.append(math.sqrt(np.mean(parts)))
    return np.polyfit(np.log10(sizes), np.log10(f), 1)[0]


def test_dfa_against_a_loop(spark):
    r = np.random.default_rng(0).normal(size=600)
    want = dfa_loop(r)
    assert hurst.dfa(frame(spark, r, "log_return")).first()["hurst"] == pytest.approx(want, rel=1e-9)
    assert hurst.dfa_many(np.stack([r, r * 2]))[1] == pytest.approx(want, rel=1e-9)
    rolled = {x["end_bar"]: x["hurst"] for x in hurst.rolling_dfa(frame(spark, r, "log_return"), window=252, step=120).collect()}
    assert sorted(rolled) == [251, 371, 491]
    assert rolled[371] == pytest.approx(dfa_loop(r[120:372]), rel=1e-8)


def test_hurst_tells_persistence(spark):
    rng = np.random.default_rng(5)
    white, back = rng.normal(size=3000), np.diff(synthetic.ou_path(2501, 0.15, seed=2))
    assert abs(hurst.dfa_many(white[None])[0] - 0.5) < 0.07 and hurst.dfa_many(back[None])[0] < 0.35


def test_bootstrap_matches_numpy(spark):
    r = np.random.default_rng(6).normal(size=200)
    found = [dfa_loop(hurst.pieced_series(r, k)) for k in range(8)]
    got = hurst.series_interval(frame(spark, r, "log_return"), resamples=8).first()
    assert got["hurst"] == pytest.approx(dfa_loop(r), rel=1e-8) and got["resamples"] == 8
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.percentile(found, [2.5, 97.5])), rel=1e-8)
    short = hurst.series_interval(frame(spark, r[:30], "log_return")).first()
    assert (short["hurst"], short["ci_low"], short["resamples"]) == (None, None, 0)
    df = frame(spark, r, "log_return").withColumn("w", F.collect_list("log_return").over(trailing(200))).where("bar_idx in (20, 199)")
    both = hurst.with_interval(df, "w").orderBy("bar_idx").collect()
    assert both[0]["hurst"] is None and both[1]["hurst"] == pytest.approx(dfa_loop(r), rel=1e-8) and both[1]["ci_low"] < both[1]["ci_high"]


def test_surprise_context_both_joins(spark, monkeypatch):
    days = spark.createDataFrame([("A", i, f"2024-01-{i + 1:02d}", "bull") for i in range(28)], "series_id string, bar_idx bigint, d string, regime string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    e = spark.createDataFrame([("2024-01-05", "NFP", 1.8), ("2024-01-11", "CPI", 0.9), ("2024-01-11", "GDP", None)], "d string, event_type string, surprise double").withColumn("event_ts", F.col("d").cast("timestamp_ntz"))
    rows = surprise.surprise_context(days, e).orderBy("bar_idx").collect()
    assert not rows[3]["active"] and rows[3]["wss"] == 0.0 and rows[4]["wss"] == pytest.approx(1.8 * 1.3)
    at = rows[11]  # the 12th: seven days after one, one day after the other
    assert at["wss"] == pytest.approx(1.8 * 1.3 * 0.5 ** (7 / 3) - 0.9 * 0.7 * 0.5 ** (1 / 4)) and [x["event_type"] for x in at["events"]] == ["NFP", "CPI"]
    monkeypatch.setattr(surprise, "BROADCAST_EVENTS", 0)
    again = surprise.surprise_context(days, e).orderBy("bar_idx").collect()
    assert [r["wss"] for r in again] == [r["wss"] for r in rows]
    bad = spark.createDataFrame([("1990-01-01", "ISM_MFG", 1.0)], "d string, event_type string, surprise double").withColumn("event_ts", F.col("d").cast("timestamp_ntz"))
    with pytest.raises(PySparkException):
        surprise.surprise_context(days, bad).collect()


def test_consensus(spark):
    df = spark.createDataFrame([("bull", 1.0, -0.5, 0.0)], "regime string, flow double, dev double, wss double")
    votes = consensus.votes_of(F.col("regime"), F.col("flow"), F.col("dev"), wss=F.col("wss"))
    got = consensus.consensus(df, votes, {"regime": 1.0, "order_flow": 2.0, "kernel": 1.0}, F.lit(-1.0), surprise_weight=4.0).first()
    a, b = math.tanh(0.5), math.tanh(0.25)
    assert got["score"] == pytest.approx((1 + 2 * a + b) / 8) and got["volatility_regime"] == "amplifying"  # an idle event dilutes
    assert dict(got["weights"]) == {"regime": 1.0, "order_flow": 2.0, "kernel": 1.0, "surprise": 4.0} and set(got["votes"]) == set(votes)
    with pytest.raises(ValueError):
        consensus.weights_of({"regime": 1.0}, list(votes))
    with pytest.raises(ValueError):
        consensus.weights_of({"regime": 0.0, "order_flow": 0.0, "kernel": 0.0}, consensus.VOTES)
    with pytest.raises(ValueError):
        consensus.votes_of(F.col("regime"), F.col("flow"), F.col("dev"), "subsignal")


def test_dynamic_weights_by_hand(spark):
    v, o = [1, -1, 0, 1, 1, -1], [0.1, -0.2, 0.3, -0.4, 0.5, 0.6]
    df = spark.createDataFrame([("A", i, float(a), b) for i, (a, b) in enumerate(zip(v, o))], "series_id string, bar_idx bigint, v double, o double")
    got = column(consensus.dynamic_weights(df, ["v"], "o", 3), "weight_v")
    hits = [1, 1, 0, 0, 1, 0]
    assert got[0] is None and got[1:] == pytest.approx([max(np.mean(hits[max(0, i - 3) : i]) - 0.5, 0) + 0.01 for i in range(1, 6)])
    steps = consensus.held(df.withColumn("w", F.col("bar_idx").cast("double")), ["w"], every=2, least=2)
    assert column(steps, "w") == [1.0, 1.0, 2.0, 2.0, 4.0, 4.0]


def loop_backtest(scores, votes, returns, band, limit, alpha, window, cost):
    equity, pos, net, trade, before = [1.0], [], [], [], 0.0
    for s, v, r in zip(scores, votes, returns):
        e = np.array(equity)
        dd = ((np.maximum.accumulate(e) - e) / np.maximum.accumulate(e))[-window:]
        k = max(1, math.ceil(round(alpha * len(dd), 9)))
        cdar = np.sort(dd)[-k:].mean()
        p = 0.0 if abs(s) <= band else np.sign(s) * (abs(s) - band) / (1 - band) * np.mean([np.sign(x) == np.sign(s) for x in v]) * min(1, max(0, 1 - cdar / limit))
        net.append(p * r - cost * abs(p - before))
        trade.append(np.sign(p) != np.sign(before))
        equity.append(equity[-1] * (1 + net[-1]))
        pos.append(p)
        before = p
    return pos, net, trade, equity[1:]


def test_sized_backtest_against_a_loop(spark):
    rng = np.random.default_rng(8)
    votes = np.tanh(rng.normal(size=(300, 3)))
    scores, returns = votes.mean(axis=1), rng.normal(0, 0.05, 300)
    df = spark.createDataFrame([("A", i, float(s), float(r), *map(float, v)) for i, (s, r, v) in enumerate(zip(scores, returns, votes))], "series_id string, bar_idx bigint, score double, next_return double, a double, b double, c double")
    df = df.withColumn("agreement", backtest.agreement_of(F.col("score"), [F.col(x) for x in "abc"]))
    settings = backtest.settings_table(spark, (0.0, 0.1), (0.1, 1.0), window=40)
    got = backtest.sized_backtest(df, settings).toPandas()
    for s in settings.collect():
        own = got[got.setting == s["setting"]].sort_values("bar_idx")
        pos, net, trade, equity = loop_backtest(scores, votes, returns, s["band"], s["cdar_limit"], 0.05, 40, 0.0002)
        assert np.allclose(own.position, pos) and np.allclose(own.net_return, net) and np.allclose(own.equity, equity) and own.is_trade.tolist() == trade
    m = backtest.metrics(backtest.sized_backtest(df, settings), ["series_id", "setting"]).where("setting = 0").first()
    own = got[got.setting == 0].sort_values("bar_idx")
    held = own.net_return.to_numpy()[180:]
    assert (m["n_decisions"], m["split_index"]) == (300, 180) and m["heldout_sharpe_pp"] == pytest.approx(held.mean() / held.std(ddof=1))
    assert m["heldout_total_return"] == pytest.approx(np.prod(1 + held) - 1) and m["heldout_trades_per_week"] == pytest.approx(own.is_trade.to_numpy()[180:].sum() / 120 * 5)
    path = np.concatenate([[1.0], own.equity])
    assert m["max_drawdown"] == pytest.approx(((np.maximum.accumulate(path) - path) / np.maximum.accumulate(path)).max())


def test_setting_selection(spark):
    rows = spark.createDataFrame([("A", 0, 0.5, 9.0), ("A", 1, 1.0, 2.0), ("A", 2, 1.0, 3.0), ("A", 3, 2.0, 0.5)], "series_id string, setting int, train_sharpe_ann double, train_trades_per_week double")
    assert backtest.select_setting(rows).first()["setting"] == 1
    with pytest.raises(PySparkException):
        backtest.select_setting(rows.where("setting in (0, 3)")).collect()
    for bad in (lambda: backtest.sized_path(np.ones(2), np.ones(2), np.ones(2), np.zeros(2), 0.0), lambda: backtest.sized_path(np.array([np.nan]), np.ones(1), np.ones(1), np.zeros(1), 1.0), lambda: backtest.split_at(F.lit(3), 1.0), lambda: backtest.Tail(0.0, 3), lambda: backtest.Tail(0.5, 0)):
        with pytest.raises(ValueError):
            bad()


def test_trades_of_fixed_positions(spark):
    df = spark.createDataFrame([("A", i, p, 0.01) for i, p in enumerate([0.5, 0.6, -0.5, -0.6, 0.0])], "series_id string, bar_idx bigint, p double, r double")
    out = backtest.fixed_backtest(df, "p", "r", 0.001)
    assert column(out, "is_trade") == [True, False, True, False, True] and column(out, "turnover") == pytest.approx([0.5, 0.1, 1.1, 0.1, 0.6])
    net = column(out, "net_return")
    assert net[2] == pytest.approx(-0.005 - 0.0011) and column(out, "equity")[-1] == pytest.approx(np.prod(1 + np.array(net)))


def test_options(spark):
    noise = options.chain_noise(spark)
    spots = spark.createDataFrame([(1, 16152.5), (2, 900.0)], "k long, spot double")
    chain = options.synthetic_chain(spots, noise)
    assert chain.where("k = 1").count() == 81 and chain.where("k = 2").count() == 58 and chain.where("strike <= 0 or iv < 0.03 or call_oi < 0").count() == 0
    total = options.dashboard(spots.where("k = 1"), noise, ["k"]).first()
    assert total["total_gex"] == pytest.approx(46_746_024, rel=1e-6) and total["total_vex"] == pytest.approx(842_609_566_771, rel=1e-6)  # published


def test_bar_index_breaks_ties(spark):
    df = spark.createDataFrame([("A", 5, 2), ("A", 5, 1), ("A", 3, 9)], "series_id string, t long, e long")
    assert [(r["t"], r["e"]) for r in with_bar_index(df, "t", tie="e").orderBy("bar_idx").collect()] == [(3, 9), (5, 1), (5, 2)]


# Models --------------------------------------------------------------------------------------------------------------

def paths(pi, a, logb):
    """Log probability of every path, by enumeration."""
    from itertools import product

    out = {}
    for p in product(range(len(pi)), repeat=len(logb)):
        out[p] = math.log(pi[p[0]]) + logb[0, p[0]] + sum(math.log(a[p[t - 1], p[t]]) + logb[t, p[t]] for t in range(1, len(logb)))
    return out


def test_recursions_against_enumeration():
    x, pi, a = np.array([0.2, 4.8, 5.3, -0.5, 2.5]), np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]])
    logb = regimes.log_emissions(x, np.array([0.0, 5.0]), np.array([1.0, 1.5]) ** 2, np.array([np.inf, np.inf]))
    every = paths(pi, a, logb)
    alpha, scale, ll = sequential.forward(pi, a, logb)
    assert ll == pytest.approx(math.log(sum(map(math.exp, every.values()))))
    assert tuple(sequential.viterbi(pi, a, logb)) == max(every, key=every.get)
    beta = sequential.backward(a, logb, scale)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    for t in range(5):
        assert gamma[t, 1] == pytest.approx(sum(math.exp(v - ll) for p, v in every.items() if p[t] == 1))
    t = regimes.log_emissions(x, np.array([0.0, 1.0]), np.array([1.0, 2.0]), np.array([4.0, 30.0]))
    want = math.lgamma(2.5) - math.lgamma(2) - 0.5 * math.log(4 * math.pi) - 2.5 * math.log1p(0.2**2 / 4)
    assert t[0, 0] == pytest.approx(want)


def test_digamma_and_nu():
    assert regimes.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-12)
    v = regimes.solve_nu(-0.2)
    assert 1 + math.log(v / 2) - float(regimes.digamma(np.array([v / 2]))[0]) - 0.2 == pytest.approx(0, abs=1e-9) or v in (regimes.NU_LEAST, regimes.NU_MOST)


def test_likelihood_never_falls():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, s, 150) for m, s in ((0.02, 0.01), (-0.02, 0.015), (0.0, 0.008))])
    trace = []
    regimes.fit_once(x, 5, trace=trace)
    assert len(trace) > 3 and (np.diff(trace) > -1e-6 * np.abs(trace[:-1])).all()


@pytest.mark.parametrize("student", [True, False])
def test_regimes_are_found(spark, student):
    r, labels = synthetic.separated_path(3, 100)
    df = frame(spark, r, "log_return")
    models = regimes.fit(df, starts=regimes.seeds_of(4), student=student, rounds=60)
    for how in ("viterbi", "filter"):
        got = column(regimes.decode(df, models, how), "regime")
        assert np.mean([a == b for a, b in zip(got, labels)]) > 0.85
    with pytest.raises(ValueError):
        regimes.decode(df, models, "smooth")


def test_state_labels():
    assert regimes.state_labels(np.array([0.0, 0.01, -0.001]), np.array([1e-4, 1e-4, 4e-4]), np.full(3, 8.0)) == ["sideways", "bull", "bear"]
    with pytest.raises(ValueError):
        regimes.state_labels(np.zeros(2), np.ones(2), np.ones(2) * 5)


def test_walk_forward_labels_are_causal(spark):
    r, _ = synthetic.separated_path(2, 60)
    later = r.copy()
    later[300:] = 0.3
    run = lambda df: regimes.walk_forward_regimes(df, 3, starts=regimes.seeds_of(2))
    a, b = (column(run(frame(spark, x, "log_return")), "regime") for x in (r, later))
    assert len(a) == 270 and a[:210] == b[:210]


def test_folds(spark):
    table = regimes.folds(frame(spark, range(103)), 4).orderBy("fold").collect()
    assert [(r["train_end"], r["test_end"]) for r in table] == [(20, 40), (40, 60), (60, 80), (80, 103)]
    with pytest.raises(PySparkException):
        regimes.folds(frame(spark, range(30)), 4, 20).collect()


def full_posterior(xs, hazard=0.01):
    """Run-length posterior by the plain recursion over sufficient statistics, in ordinary probabilities."""
    runs = {0: (1.0, 0.0, 1.0, 1.0, 1.0)}
    out = []
    for x in xs:
        new, change = {}, 0.0
        for r, (p, mu, k, a, b) in runs.items():
            s2 = b * (k + 1) / (a * k)
            pred = math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * a * math.pi * s2) * (1 + (x - mu) ** 2 / (2 * a * s2)) ** -(a + 0.5)
            new[r + 1] = (p * pred * (1 - hazard), (k * mu + x) / (k + 1), k + 1, a + 0.5, b + k * (x - mu) ** 2 / (2 * (k + 1)))
            change += p * pred * hazard
        new[0] = (change, 0.0, 1.0, 1.0, 1.0)
        total = sum(v[0] for v in new.values())
        runs = {r: (v[0] / total, *v[1:]) for r, v in new.items()}
        out.append({r: v[0] for r, v in runs.items()})
    return out


def test_changepoints_against_the_plain_recursion():
    xs = np.random.default_rng(1).normal(0, 1, 40).tolist() + np.random.default_rng(2).normal(4, 1, 20).tolist()
    model, want = online.Changepoints(), full_posterior(xs)
    for x, post in zip(xs, want):
        prob, run, best = model.update(x)
        assert prob == pytest.approx(sum(p for r, p in post.items() if r <= 5)) and run == pytest.approx(sum(r * p for r, p in post.items()))
        assert post[best] == pytest.approx(max(post.values()))
    half = online.Changepoints()
    for x in xs[:30]:
        half.update(x)
    rest = online.Changepoints().restore(half.state())
    for x in xs[30:]:
        last = rest.update(x)
    assert last == pytest.approx(tuple(map(float, (prob, run, best))))
    cut = online.Changepoints(most=10)
    for x in xs:
        cut.update(x)
    assert len(cut.logp) == 10 and np.exp(cut.logp).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        online.Changepoints(1.0)


def test_gate_coverage_and_errors(spark):
    rng = np.random.default_rng(0)
    n = 4000
    score = rng.normal(size=n)
    ret = np.where(np.arange(n) < n // 2, 0.01, 0.02) * rng.standard_t(4, n) / math.sqrt(2) + 0.005 * score
    df = spark.createDataFrame([("A", i, float(s), float(r)) for i, (s, r) in enumerate(zip(score, ret))], "series_id string, bar_idx bigint, s double, r double")
    got = online.conformal_gate(df, "s", "r").toPandas().sort_values("bar_idx")
    assert abs(got.covered[60:].mean() - 0.9) < 0.03 and (got.action[:60] == "abstain").all()
    with pytest.raises(PySparkException):
        online.conformal_gate(df.where("bar_idx < 50"), "s", "r").collect()
    for bad in ({"alpha": 0.0}, {"power": 0.5}):
        with pytest.raises(ValueError):
            online.Gate(**bad)
    flat = df.withColumn("s", F.lit(0.0)).groupBy().agg(online.slope_through_origin("s", "r").alias("x"))
    assert flat.first()["x"] == 0.0
