"""Synthetic markets. The driver draws the random numbers, in a fixed order, so results do not depend on partitions and a
longer horizon starts with the shorter one's rows; everything derived from the draws is a Catalyst expression."""
from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import tick_down, tick_round, tick_up
from ..operators.bars import intraday_profile, next_fridays
from .contracts import validate_option_chain
from .market import TableSource, in_new_york, instant

DAYS_A_YEAR = 252
#: Annual drift and volatility, mean days and gamma shape of a stay; where a stay leads; the separated regimes' mean and deviation.
REGIMES = {"bull": (0.20, 0.15, 90, 3.0), "bear": (-0.30, 0.30, 45, 2.5), "sideways": (0.0, 0.13, 60, 3.0)}
MOVES = {"bull": {"sideways": 0.65, "bear": 0.35}, "bear": {"sideways": 0.65, "bull": 0.35}, "sideways": {"bull": 0.5, "bear": 0.5}}
SEPARATED = {"bull": (0.020, 0.010), "bear": (-0.020, 0.015), "sideways": (0.0, 0.008)}
LEAST_STAY, TAIL_DF = 5, 5
#: Fixed values of the intraday market.
MINUTES, START_PRICE, DAILY_VOLUME, SHOCK_VOLUME, OVERDISPERSION, AGGRESSOR, RANGE, PERSISTENCE = 390, 18_000.0, 200_000, 0.3, 0.3, 0.20, 0.5, 0.95
MONTHLY, MONTHLY_MINUTE, MEETING, MEETING_EVERY, MEETING_FIRST, MEETING_MINUTE = "ISM_MFG", 30, "FOMC", 31, 20, 270
HALF_SPREAD, DEPTH, DEPTH_SIGMA, DEPTH_LINK = 0.25, 150.0, 0.4, 0.5
CHAIN_VOL, CHAIN_SLOPE, CHAIN_CURVATURE, CHAIN_STEP, CHAIN_SIDE, CHAIN_EXPIRIES, CHAIN_OI, CHAIN_WIDTH, CHAIN_TILT, CHAIN_LEAST, CHAIN_MOST = 0.18, -0.10, 0.20, 100.0, 10, 4, 20_000, 0.02, 1.2, 0.03, 5.0


def heavy(rng: np.random.Generator, n: int) -> np.ndarray:
    """Student-t draws of unit variance."""
    return rng.standard_t(TAIL_DF, size=n) * np.sqrt((TAIL_DF - 2) / TAIL_DF)


def stays(n: int, rng: np.random.Generator, start: str = "sideways") -> list[str]:
    labels, now = [], start
    while len(labels) < n:
        _, _, mean, shape = REGIMES[now]
        labels += [now] * max(int(round(rng.gamma(shape, mean / shape))), LEAST_STAY)
        now = str(rng.choice(list(MOVES[now]), p=list(MOVES[now].values())))
    return labels[:n]


def regime_path(n: int = 1260, seed: int = 18, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list[str]]:
    """Log returns and labels: stays of gamma length, heavy-tailed shocks of the regime's volatility, drawn regime by regime."""
    rng = np.random.default_rng(seed) if rng is None else rng
    labels = stays(n, rng)
    kind, out = np.array(labels), np.empty(n)
    for name, (drift, vol, _, _) in REGIMES.items():
        at = np.flatnonzero(kind == name)
        if len(at):
            out[at] = drift / DAYS_A_YEAR + vol / np.sqrt(DAYS_A_YEAR) * heavy(rng, len(at))
    return out, labels


def separated_path(cycles: int = 5, stay: int = 100, seed: int = 1) -> tuple[np.ndarray, list[str]]:
    rng, parts = np.random.default_rng(seed), list(SEPARATED) * cycles
    return np.concatenate([rng.normal(*SEPARATED[p], size=stay) for p in parts]), [p for p in parts for _ in range(stay)]


def ou_path(n: int, theta: float = 0.15, mu: float = 0.0, sigma: float = 1.0, seed: int | None = None, start: float | None = None) -> np.ndarray:
    """Levels by Euler steps of one."""
    z, out = np.random.default_rng(seed).normal(size=n - 1), np.empty(n)
    out[0] = mu if start is None else start
    for t, e in enumerate(z, 1):
        out[t] = out[t - 1] + theta * (mu - out[t - 1]) + sigma * e
    return out


def business_dates(first: date, n: int) -> list[date]:
    out, d = [], first
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def daily_bars(spark: SparkSession, n: int = 1260, seed: int = 18, start_price: float = 15_000.0, first: date = date(2020, 1, 2), series: str = "SYN") -> DataFrame:
    """series_id, bar_idx, date, open, high, low, close, log_return, regime; prices on the quarter-point grid."""
    r, labels = regime_path(n, seed)
    z = np.random.default_rng(seed + 1).normal(size=(3, n))
    rows = [(series, i, d, float(r[i]), labels[i], *map(float, z[:, i])) for i, d in enumerate(business_dates(first, n))]
    df = spark.createDataFrame(rows, "series_id string, bar_idx bigint, date date, log_return double, regime string, z_gap double, z_up double, z_down double")
    vol = F.lit(0.0)
    for k, (_, v, _, _) in REGIMES.items():
        vol = F.when(F.col("regime") == k, v / np.sqrt(DAYS_A_YEAR)).otherwise(vol)
    w = Window.partitionBy("series_id").orderBy("bar_idx")
    df = df.withColumn("close", tick_round(start_price * F.exp(F.sum("log_return").over(w.rowsBetween(Window.unboundedPreceding, 0)))))
    df = df.withColumn("open", tick_round(F.coalesce(F.lag("close").over(w), F.lit(start_price)) * (1 + 0.3 * vol * F.col("z_gap"))))
    df = df.withColumn("high", tick_up(F.greatest("open", "close") * (1 + 0.8 * vol * F.abs("z_up")))).withColumn("low", tick_down(F.least("open", "close") * (1 - 0.8 * vol * F.abs("z_down"))))
    return df.select("series_id", "bar_idx", "date", "open", "high", "low", "close", "log_return", "regime")


def flow_noise(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """bar_idx and the four standard normal draws that the synthetic flow takes, column after column."""
    rng = np.random.default_rng(seed)
    z = [rng.normal(size=n) for _ in range(4)]
    return spark.createDataFrame([(i, *(float(x[i]) for x in z)) for i in range(n)], "bar_idx bigint, z_volume double, z_buy double, z_depth double, z_tilt double")


class SyntheticIntradaySource(TableSource):
    """Minutes of n sessions: U-shaped volatility and volume, heavy-tailed steps, jumps at events, a hidden pressure that may
    lead the next step by ``planted_edge``, volume split by the step, tick-rounded bars and quotes.

    Draws come session by session from one stream, so earlier sessions do not change with the horizon. The pressure stays out
    of every public table; only ``hidden_state_for_validation`` shows it.
    """

    DRAWS = ("eps", "push", "z_volume", "z_split", "z_high", "z_low", "z_bid", "z_ask")

    def __init__(self, spark: SparkSession, n_sessions: int = 60, start: date = date(2024, 1, 2), seed: int = 18, planted_edge: float = 0.0) -> None:
        if n_sessions < 1:
            raise ValueError("a market needs at least one session")
        of_regimes, of_minutes = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(2))
        days = business_dates(start, n_sessions)
        _, labels = regime_path(n_sessions, rng=of_regimes)
        rows, told, pressure = [], [], None
        for s, day in enumerate(days):
            z = {name: heavy(of_minutes, MINUTES) if name == "eps" else of_minutes.standard_normal(MINUTES) for name in self.DRAWS}
            monthly, meeting = float(of_minutes.standard_normal()), float(of_minutes.standard_normal())
            events = {}
            if s == 0 or day.month != days[s - 1].month:
                events[MONTHLY_MINUTE] = (MONTHLY, monthly)
            if s >= MEETING_FIRST and (s - MEETING_FIRST) % MEETING_EVERY == 0:
                events[MEETING_MINUTE] = (MEETING, meeting)
            told += [(day.isoformat(), m, kind, surprise) for m, (kind, surprise) in events.items()]
            for m in range(MINUTES):
                before, pressure = (0.0, z["push"][m]) if pressure is None else (pressure, PERSISTENCE * pressure + np.sqrt(1 - PERSISTENCE**2) * z["push"][m])
                rows.append((s, day.isoformat(), labels[s], m, events.get(m, (None, 0.0))[1], float(before), float(pressure), *(float(z[n][m]) for n in self.DRAWS if n != "push")))
        names = [n for n in self.DRAWS if n != "push"]
        raw = spark.createDataFrame(rows, "session int, day string, regime string, minute bigint, surprise double, pushed double, pressure double, " + ", ".join(f"{n} double" for n in names))
        ts = F.to_timestamp(F.concat("day", F.lit(" 09:30:00 America/New_York"))) + F.make_dt_interval(mins=F.col("minute"))
        per_minute = np.sqrt(DAYS_A_YEAR * MINUTES)
        base, drift = F.lit(0.0), F.lit(0.0)
        for k, (d, v, _, _) in REGIMES.items():
            base, drift = F.when(F.col("regime") == k, v / per_minute).otherwise(base), F.when(F.col("regime") == k, d / DAYS_A_YEAR / MINUTES).otherwise(drift)
        df = raw.join(F.broadcast(intraday_profile(spark, MINUTES)), "minute").withColumn("timestamp", ts).withColumn("base", base)
        df = df.withColumn("sigma", F.col("base") * F.col("volatility") * (1 + F.abs("surprise"))).withColumn("residual", F.col("eps") + planted_edge * F.col("pushed"))
        df = df.withColumn("jump", F.col("surprise") * F.col("sigma")).withColumn("step", drift + F.col("sigma") * F.col("residual") + F.col("jump"))
        w = Window.orderBy("session", "minute")  # one market of a bounded horizon: its path is one recursion
        df = df.withColumn("close", tick_round(START_PRICE * F.exp(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))))
        df = df.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(START_PRICE)))
        reach = RANGE * F.col("sigma") * F.col("open")
        df = df.withColumn("high", tick_up(F.greatest("open", "close") + reach * F.abs("z_high"))).withColumn("low", tick_down(F.least("open", "close") - reach * F.abs("z_low")))
        busy = DAILY_VOLUME / MINUTES * F.col("volume") * F.col("sigma") / F.col("base") * (1 + SHOCK_VOLUME * F.abs("residual"))
        df = df.withColumn("total", F.rint(busy * F.exp(OVERDISPERSION * F.col("z_volume") - OVERDISPERSION**2 / 2)).cast("bigint"))
        share = 0.5 + AGGRESSOR * F.tanh(F.col("step") / F.col("sigma"))
        bought = F.col("total") * share + F.sqrt(F.col("total") * share * (1 - share)) * F.col("z_split")
        df = df.withColumn("ask_volume", F.greatest(F.lit(0), F.least(F.col("total"), F.rint(bought).cast("bigint")))).withColumn("bid_volume", F.col("total") - F.col("ask_volume"))
        self._hidden = df.select("timestamp", "pressure", F.col("residual").alias("normalized_residual"), "sigma", drift.alias("drift"), "jump")
        bars = df.select("timestamp", "open", "high", "low", "close", F.col("total").alias("volume"), "bid_volume", "ask_volume")
        thin = F.pow(F.col("base") / F.col("sigma"), F.lit(DEPTH_LINK))
        size = lambda z: F.rint(DEPTH * thin * F.exp(DEPTH_SIGMA * F.col(z) - DEPTH_SIGMA**2 / 2)).cast("bigint")
        quotes = df.select("timestamp", (F.col("close") - HALF_SPREAD).alias("bid"), (F.col("close") + HALF_SPREAD).alias("ask"), size("z_bid").alias("bid_size"), size("z_ask").alias("ask_size"))
        calendar = spark.createDataFrame(told, "day string, minute bigint, event_type string, surprise double").select(ts.alias("timestamp"), "event_type", "surprise")
        super().__init__(bars, quotes, bars.limit(0), calendar)

    def option_chain(self, as_of: datetime) -> DataFrame:
        """The chain around the close of the last bar at or before a time."""
        at = instant(in_new_york(as_of, "as_of"))
        last = self._bars.where(F.col("timestamp") <= at).agg(F.max_by(F.struct("timestamp", "close"), "timestamp").alias("b")).select("b.*")
        if last.first()["close"] is None:
            raise ValueError(f"as_of {as_of} is before the first bar")
        chain = chain_of(last)
        validate_option_chain(chain.withColumn("row", F.row_number().over(Window.orderBy("expiry", "strike"))))
        return chain

    def hidden_state_for_validation(self) -> DataFrame:
        return self._hidden


def chain_of(bars: DataFrame) -> DataFrame:
    """The contract-form chain at every bar's time: the next Fridays, strikes around the close, quadratic skew."""
    centre = F.rint(F.col("close") / CHAIN_STEP) * CHAIN_STEP
    day = F.to_date(F.convert_timezone(F.current_timezone(), F.lit("America/New_York"), F.col("timestamp").cast("timestamp_ntz")))
    df = bars.select(F.col("timestamp").alias("as_of"), "close", centre.alias("centre"), day.alias("day"))
    df = df.withColumn("expiry", F.explode(next_fridays(F.col("day"), CHAIN_EXPIRIES))).withColumn("k", F.explode(F.sequence(F.lit(-CHAIN_SIDE), F.lit(CHAIN_SIDE))))
    df = df.withColumn("strike", F.col("centre") + F.col("k") * CHAIN_STEP).where("strike > 0")
    m = F.log(F.col("strike") / F.col("close"))
    shape = CHAIN_OI * F.exp(-0.5 * F.pow(m / CHAIN_WIDTH, F.lit(2.0)))
    vol = F.greatest(F.lit(CHAIN_LEAST), F.least(F.lit(CHAIN_MOST), CHAIN_VOL + CHAIN_SLOPE * m + CHAIN_CURVATURE * m * m))
    return df.select("as_of", "expiry", "strike", F.rint(shape).cast("bigint").alias("call_open_interest"), F.rint(shape * CHAIN_TILT).cast("bigint").alias("put_open_interest"), vol.alias("implied_vol"))
