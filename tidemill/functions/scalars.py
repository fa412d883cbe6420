"""Scalar functions as Catalyst expressions: votes, surprise weights, sizing, session predicates, ticks, Black-Scholes."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Votes of regime labels; event parameters; alignment bonus and cutoff; tick grid; neutral band.
REGIME_VOTES = {"bull": 1.0, "bear": -1.0, "sideways": 0.0}
EVENT_PARAMS = {"NFP": (1.0, 1.0, 3.0), "CPI": (-1.0, 1.0, 4.0), "FOMC": (-1.0, 1.2, 7.0), "GDP": (1.0, 0.8, 3.0)}  # direction, importance, half-life in days
ALIGNMENT_BONUS, CUTOFF_HALF_LIVES, VOTE_SCALE = 0.3, 5.0, 2.0
TICK, TICK_TOLERANCE, NEUTRAL_BAND = 0.25, 1e-6, 0.15
#: Hart's rational approximation of the normal integral, highest power first.
HART_N = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_D = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT, HART_TAIL, HART_ROOT = 7.07106781186547, 37.0, 2.506628274631


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """Hart's approximation; absolute error below 3e-16."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    c = F.when(a > HART_TAIL, F.lit(0.0)).when(a < HART_SPLIT, e * _horner(a, HART_N) / _horner(a, HART_D)).otherwise(e / tail / HART_ROOT)
    return F.when(x > 0, 1 - c).otherwise(c)


def sign(c: Column) -> Column:
    return F.signum(c)


def lookup(key: Column, table: dict, what: str) -> Column:
    """The table's value; a key that it lacks raises, null stays null."""
    out = F.when(key.isNull(), F.lit(None).cast("double"))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), key)).cast("double"))


def regime_vote(label: Column) -> Column:
    return lookup(label, REGIME_VOTES, "regime label")


def subsignal_vote(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def tanh_vote(x: Column, scale: float = VOTE_SCALE) -> Column:
    return F.tanh(x / scale)


def kernel_vote(deviation: Column, reading: str = "mean_reversion") -> Column:
    if reading not in ("mean_reversion", "momentum"):
        raise ValueError(f"unknown kernel reading {reading!r}")
    return tanh_vote(deviation if reading == "momentum" else -deviation)


def gex_regime(total: Column) -> Column:
    return F.when(total >= 0, "dampening").otherwise("amplifying")


def band_label(score: Column, band: Column | float = NEUTRAL_BAND) -> Column:
    band = band if isinstance(band, Column) else F.lit(band)
    return F.when(score.isNull(), None).when(score > band, "bullish").when(score < -band, "bearish").otherwise("neutral")


def time_decay(age: Column, half_life: Column, cutoff: float = CUTOFF_HALF_LIVES) -> Column:
    return F.when((age < 0) | (age > half_life * cutoff), 0.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def regime_modulator(direction: Column, label: Column) -> Column:
    return 1 + ALIGNMENT_BONUS * direction * regime_vote(label)


def event_param(event_type: Column, which: int) -> Column:
    return lookup(event_type, {k: v[which] for k, v in EVENT_PARAMS.items()}, "event type")


def surprise_score(surprise: Column, event_type: Column, age: Column, label: Column) -> Column:
    w = event_param(event_type, 0) * event_param(event_type, 1)
    return surprise * w * regime_modulator(sign(surprise * w), label) * time_decay(age, event_param(event_type, 2))


def age_days(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86400e6)


def throttle(cdar: Column, limit: Column | float) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.when(limit <= 0, F.raise_error(F.lit("the CDaR limit must be positive")).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cdar / limit)))


def position_size(score: Column, votes: list[Column], cdar: Column, limit: Column | float, band: Column | float = NEUTRAL_BAND, largest: float = 1.0) -> Column:
    band = band if isinstance(band, Column) else F.lit(float(band))
    agreeing = sum((F.when(sign(v) == sign(score), 1).otherwise(0) for v in votes), F.lit(0)) / len(votes)
    size = sign(score) * largest * (F.abs(score) - band) / (1 - band) * agreeing * throttle(cdar, limit)
    bad = F.raise_error(F.lit("the neutral band must be in [0, 1)")).cast("double")
    return F.when((band < 0) | (band >= 1), bad).when(score.isNull() | F.isnan(score), F.raise_error(F.lit("the score must be finite")).cast("double")).when(F.abs(score) <= band, 0.0).otherwise(size)


def hurst_multiplier(hurst: Column, low: Column, high: Column, most: float = 2.0, least: float = 0.5) -> Column:
    far = F.least(F.abs(hurst - 0.5) / 0.5, F.lit(1.0))
    return F.when((low <= 0.5) & (high >= 0.5), most).otherwise(most - far * (most - least))


def run_confidence(run: Column, saturation: int = 30) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), run / F.lit(float(saturation))))


def imbalance(bid: Column, ask: Column) -> Column:
    """Null where both sides are empty."""
    return F.try_divide(bid - ask, bid + ask)


def mp_bound(n_rows: Column, n_features: int, side: int = 1, variance: float = 1.0) -> Column:
    """Edge of the eigenvalue band of pure noise: upper for side 1, lower for side -1."""
    return variance * F.pow(1 + side * F.sqrt(F.lit(float(n_features)) / n_rows), 2)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def globex_open(ts: Column) -> Column:
    """Sunday 18:00 to Friday 17:00 without the halt from 17:00 to 18:00, in the zone that ts is told in."""
    day, m = F.weekday(ts), minute_of_day(ts)
    return ((day <= 3) & ~((m >= 1020) & (m < 1080))) | ((day == 4) & (m < 1020)) | ((day == 6) & (m >= 1080))


def cash_session(ts: Column) -> Column:
    m = minute_of_day(ts)
    return (F.weekday(ts) <= 4) & (m >= 570) & (m < 960)


def tick_round(x: Column, tick: float = TICK) -> Column:
    """Half to even, as IEEE rounding has it."""
    return F.rint(x / tick) * tick


def tick_up(x: Column, tick: float = TICK) -> Column:
    return F.ceil(x / tick - 1e-9) * tick


def tick_down(x: Column, tick: float = TICK) -> Column:
    return F.floor(x / tick + 1e-9) * tick


def off_grid(x: Column, tick: float = TICK) -> Column:
    return F.abs(x / tick - F.rint(x / tick)) > TICK_TOLERANCE


def gaussian_weight(u: Column) -> Column:
    return normal_pdf(u)


class BlackScholes:
    """European options with a dividend yield: s spot, k strike, t years, r rate, v volatility, q yield."""

    def __init__(self, s: Column, k: Column, t: Column, r: Column, v: Column, q: Column | float = 0.0) -> None:
        self.s, self.k, self.t, self.r, self.v = s, k, t, r, v
        self.q = q if isinstance(q, Column) else F.lit(float(q))
        self.d1 = (F.log(s / k) + (r - self.q + v * v / 2) * t) / (v * F.sqrt(t))
        self.d2 = self.d1 - v * F.sqrt(t)
        self.grown, self.discounted = F.exp(-self.q * t), F.exp(-r * t)

    @staticmethod
    def _side(kind: str) -> int:
        if kind not in ("call", "put"):
            raise ValueError(f"an option is a call or a put, not {kind!r}")
        return 1 if kind == "call" else -1

    def price(self, kind: str = "call") -> Column:
        w = self._side(kind)
        return w * (self.s * self.grown * normal_cdf(w * self.d1) - self.k * self.discounted * normal_cdf(w * self.d2))

    def delta(self, kind: str = "call") -> Column:
        w = self._side(kind)
        return w * self.grown * normal_cdf(w * self.d1)

    def gamma(self) -> Column:
        return self.grown * normal_pdf(self.d1) / (self.s * self.v * F.sqrt(self.t))

    def vega(self) -> Column:
        return self.s * self.grown * normal_pdf(self.d1) * F.sqrt(self.t)

    def theta(self, kind: str = "call") -> Column:
        w = self._side(kind)
        decay = -self.s * self.grown * normal_pdf(self.d1) * self.v / (2 * F.sqrt(self.t))
        return decay - w * self.r * self.k * self.discounted * normal_cdf(w * self.d2) + w * self.q * self.s * self.grown * normal_cdf(w * self.d1)

    def rho(self, kind: str = "call") -> Column:
        w = self._side(kind)
        return w * self.k * self.t * self.discounted * normal_cdf(w * self.d2)

    def vanna(self) -> Column:
        return -self.grown * normal_pdf(self.d1) * self.d2 / self.v
