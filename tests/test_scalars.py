import math
from statistics import NormalDist

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemill.functions import scalars as S

PHI = NormalDist().cdf
CASES = [(100.0, 100.0, 0.5, 0.05, 0.2, 0.0), (120.0, 100.0, 1.5, 0.03, 0.35, 0.02), (90.0, 100.0, 0.4, 0.01, 0.25, 0.0)]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def price(kind, s, k, t, r, v, q):
    d1 = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    if kind == "call":
        return s * math.exp(-q * t) * PHI(d1) - k * math.exp(-r * t) * PHI(d2)
    return k * math.exp(-r * t) * PHI(-d2) - s * math.exp(-q * t) * PHI(-d1)


def test_normal_cdf(spark):
    xs = [i / 37 for i in range(-450, 451)] + [0.0, 40.0, -40.0, 7.07106781186547]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 3e-16 for r in rows)


@pytest.mark.parametrize("case", CASES)
def test_black_scholes(spark, case):
    m = S.BlackScholes(*(F.lit(x) for x in case))
    got = one(spark, **{f"{k}_{g}": getattr(m, g)(k) for g in ("price", "delta", "theta", "rho") for k in ("call", "put")}, gamma=m.gamma(), vega=m.vega(), vanna=m.vanna())
    s, k, t, r, v, q = case
    e = 1e-4

    def slope(kind, i, h):
        up, down = list(case), list(case)
        up[i] += h
        down[i] -= h
        return (price(kind, *up) - price(kind, *down)) / (2 * h)

    for kind in ("call", "put"):
        assert got[f"{kind}_price"] == pytest.approx(price(kind, *case), rel=1e-12)
        assert got[f"{kind}_delta"] == pytest.approx(slope(kind, 0, e * s), rel=1e-4)
        assert got[f"{kind}_theta"] == pytest.approx(-slope(kind, 2, e * t), rel=1e-4)
        assert got[f"{kind}_rho"] == pytest.approx(slope(kind, 3, 1e-6), rel=1e-4, abs=1e-7)
    assert got["call_price"] - got["put_price"] == pytest.approx(s * math.exp(-q * t) - k * math.exp(-r * t), abs=1e-10)
    assert got["vega"] == pytest.approx(slope("call", 4, e), rel=1e-4)
    h = 1e-3 * s
    bump = (price("call", s + h, *case[1:]) - 2 * price("call", *case) + price("call", s - h, *case[1:])) / h**2
    assert got["gamma"] == pytest.approx(bump, rel=1e-4)
    d = lambda vol: (price("call", s + h, k, t, r, vol, q) - price("call", s - h, k, t, r, vol, q)) / (2 * h)
    assert got["vanna"] == pytest.approx((d(v + e) - d(v - e)) / (2 * e), rel=1e-3, abs=1e-6)
    with pytest.raises(ValueError):
        m.price("straddle")


def test_votes_and_labels(spark):
    got = one(spark, bull=S.regime_vote(F.lit("bull")), bear=S.regime_vote(F.lit("bear")), side=S.regime_vote(F.lit("sideways")), clip=S.subsignal_vote(F.lit(1.7)), flow=S.tanh_vote(F.lit(1.0)), rev=S.kernel_vote(F.lit(1.0)), mom=S.kernel_vote(F.lit(1.0), "momentum"), at=S.band_label(F.lit(0.15)), over=S.band_label(F.lit(0.1500001)), under=S.band_label(F.lit(-0.2)), damp=S.gex_regime(F.lit(0.0)), amp=S.gex_regime(F.lit(-1e-9)))
    assert (got["bull"], got["bear"], got["side"], got["clip"]) == (1.0, -1.0, 0.0, 1.0)
    assert got["flow"] == pytest.approx(math.tanh(0.5)) and got["rev"] == -got["mom"] and got["mom"] == got["flow"]
    assert (got["at"], got["over"], got["under"], got["damp"], got["amp"]) == ("neutral", "bullish", "bearish", "dampening", "amplifying")
    with pytest.raises(PySparkException):
        one(spark, x=S.regime_vote(F.lit("crab")))
    with pytest.raises(ValueError):
        S.kernel_vote(F.lit(1.0), "sideways")


def test_surprise(spark):
    got = one(spark, half=S.time_decay(F.lit(3.0), F.lit(3.0)), early=S.time_decay(F.lit(-0.1), F.lit(3.0)), edge=S.time_decay(F.lit(15.0), F.lit(3.0)), late=S.time_decay(F.lit(15.001), F.lit(3.0)), wss=S.surprise_score(F.lit(-2.0), F.lit("FOMC"), F.lit(7.0), F.lit("bull")))
    assert (got["half"], got["early"], got["late"]) == (0.5, 0.0, 0.0) and got["edge"] == pytest.approx(1 / 32)
    assert got["wss"] == pytest.approx(2.4 * 1.3 * 0.5)
    with pytest.raises(PySparkException):
        one(spark, x=S.surprise_score(F.lit(1.0), F.lit("ISM_MFG"), F.lit(1.0), F.lit("bull")))


def test_position_size(spark):
    size = lambda score, votes, cdar=0.0, limit=0.2, band=0.2: S.position_size(F.lit(score), [F.lit(v) for v in votes], F.lit(cdar), limit, band)
    got = one(spark, full=size(1.0, [1.0, 1.0, 1.0]), half=size(-0.6, [-1.0, 1.0, -1.0, 0.0]), band=size(0.2, [1.0]), stop=size(0.9, [1.0], 0.3), some=size(1.0, [1.0], 0.05))
    assert got["full"] == 1.0 and got["half"] == pytest.approx(-0.5 * 0.5) and got["band"] == got["stop"] == 0.0 and got["some"] == pytest.approx(0.75)
    for bad in (size(1.0, [1.0], limit=0.0), size(1.0, [1.0], band=1.0), size(float("nan"), [1.0])):
        with pytest.raises(PySparkException):
            one(spark, x=bad)


def test_ticks_and_sessions(spark):
    got = one(spark, even=S.tick_round(F.lit(100.125)), odd=S.tick_round(F.lit(100.375)), up=S.tick_up(F.lit(100.01)), on=S.tick_up(F.lit(100.25)), down=S.tick_down(F.lit(100.24)), off=S.off_grid(F.lit(100.1)), grid=S.off_grid(F.lit(100.75)))
    assert (got["even"], got["odd"], got["up"], got["on"], got["down"], got["off"], got["grid"]) == (100.0, 100.5, 100.25, 100.25, 100.0, True, False)
    times = {"2024-01-05 16:59:00": (True, False), "2024-01-05 17:00:00": (False, False), "2024-01-06 12:00:00": (False, False), "2024-01-07 17:59:00": (False, False), "2024-01-07 18:00:00": (True, False), "2024-01-08 17:30:00": (False, False), "2024-01-08 09:30:00": (True, True), "2024-01-08 16:00:00": (True, False), "2024-01-08 09:29:00": (True, False)}
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", S.globex_open(F.col("t").cast("timestamp_ntz")).alias("g"), S.cash_session(F.col("t").cast("timestamp_ntz")).alias("c")).collect()
    assert {r["t"]: (r["g"], r["c"]) for r in rows} == times


def test_multipliers_and_bounds(spark):
    got = one(spark, unsure=S.hurst_multiplier(F.lit(0.6), F.lit(0.4), F.lit(0.7)), sure=S.hurst_multiplier(F.lit(0.75), F.lit(0.6), F.lit(0.9)), far=S.hurst_multiplier(F.lit(1.2), F.lit(1.1), F.lit(1.3)), young=S.run_confidence(F.lit(15)), old=S.run_confidence(F.lit(90)), up=S.mp_bound(F.lit(2000.0), 8), down=S.mp_bound(F.lit(2000.0), 8, -1), empty=S.imbalance(F.lit(0.0), F.lit(0.0)))
    assert (got["unsure"], got["sure"], got["far"], got["young"], got["old"]) == (2.0, 1.25, 0.5, 0.5, 1.0)
    assert got["up"] == pytest.approx(1.131, abs=1e-3) and got["down"] == pytest.approx(0.878, abs=1e-3) and got["empty"] is None
