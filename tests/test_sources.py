from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources import contracts, files, market, synthetic

NY = ZoneInfo("America/New_York")
BARS = "bar_idx long, t string, open double, high double, low double, close double, volume long, bid_volume long, ask_volume long"
GOOD = (0, "2024-01-02 09:30:00", 18000.0, 18000.5, 17999.75, 18000.25, 100, 40, 60)


def bars(spark, *rows, schema=BARS):
    return spark.createDataFrame(list(rows), schema).withColumn("timestamp", F.to_timestamp(F.concat("t", F.lit(" America/New_York")))).drop("t")


def changed(**what):
    names = [x.split()[0] for x in BARS.split(", ")]
    return tuple(what.get(n, v) for n, v in zip(names, (1, "2024-01-02 09:31:00", *GOOD[2:])))


BAD_BARS = [
    ({"close": None}, "absent"), ({"t": "2024-01-02 09:29:00"}, "earlier than"), ({"t": GOOD[1]}, "same time"), ({"t": "2024-01-06 12:00:00"}, "without trading"), ({"open": 18000.1}, "open lies between"), ({"high": 17999.5}, "high is under the low"),
    ({"high": 18000.0, "open": 17999.75, "close": 18000.25}, "high is under the open"), ({"low": 18000.25, "high": 18000.5}, "low is over"), ({"volume": -1}, "volume is below zero"), ({"bid_volume": -1}, "bid_volume is below zero"), ({"bid_volume": 41}, "add up"),
]


def test_good_bars(spark):
    df = bars(spark, GOOD, changed())
    assert contracts.validate_bars(df, require_aggressor=True) is df
    assert contracts.validate_bars(df.limit(0)) is not None


@pytest.mark.parametrize(("what", "says"), BAD_BARS)
def test_bad_bars(spark, what, says):
    with pytest.raises(contracts.ContractError, match=says) as e:
        contracts.validate_bars(bars(spark, GOOD, changed(**what)))
    assert "(in row 1)" in str(e.value)


def test_many_offenders_are_shortened(spark):
    rows = [GOOD, *((i, f"2024-01-02 09:{30 + i}:00", *GOOD[2:6], -1, 0, 0) for i in range(1, 9))]
    with pytest.raises(contracts.ContractError, match=r"volume is below zero \(in row 1, 2, 3, 4, 5 and 3 others\)"):
        contracts.validate_bars(bars(spark, *rows))


def test_schema_rules(spark):
    df = bars(spark, GOOD)
    with pytest.raises(contracts.ContractError, match="without"):
        contracts.validate_bars(df.drop("close"))
    with pytest.raises(contracts.ContractError, match="no time zone"):
        contracts.validate_bars(df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))
    with pytest.raises(contracts.ContractError, match="floating-point"):
        contracts.validate_bars(df.withColumn("open", F.col("open").cast("long")))
    with pytest.raises(contracts.ContractError, match="whole numbers"):
        contracts.validate_bars(df.withColumn("volume", F.col("volume").cast("double")))
    with pytest.raises(contracts.ContractError, match="without"):
        contracts.validate_bars(df.drop("ask_volume"), require_aggressor=True)


def told(spark, rows, schema, **casts):
    df = spark.createDataFrame(rows, schema)
    for c, kind in casts.items():
        df = df.withColumn(c, F.to_timestamp(F.concat(c, F.lit(" America/New_York"))) if kind == "ny" else F.col(c).cast(kind))
    return df


QUOTE, QUOTES = (0, "2024-01-02 10:00:00", 100.0, 100.25, 5, 6), "row long, timestamp string, bid double, ask double, bid_size long, ask_size long"


@pytest.mark.parametrize(("row", "says"), [((1, "2024-01-02 09:59:00", *QUOTE[2:]), "earlier than"), ((1, "2024-01-06 10:00:00", *QUOTE[2:]), "without trading"), ((1, QUOTE[1], 100.1, 100.25, 5, 6), "bid lies between"), ((1, QUOTE[1], 100.5, 100.25, 5, 6), "bid is over"), ((1, QUOTE[1], 100.0, 100.25, 5, -6), "ask_size is below zero"), ((1, QUOTE[1], None, 100.25, 5, 6), "absent")])
def test_quotes(spark, row, says):
    contracts.validate_quotes(told(spark, [QUOTE, (1, QUOTE[1], 100.25, 100.25, 1, 1)], QUOTES, timestamp="ny"))  # locked and equal times are fine
    with pytest.raises(contracts.ContractError, match=says):
        contracts.validate_quotes(told(spark, [QUOTE, row], QUOTES, timestamp="ny"))


CHAIN, CHAINS = (0, "2024-01-02 10:00:00", "2024-01-05", 100.0, 5, 6, 0.2), "row long, as_of string, expiry string, strike double, call_open_interest long, put_open_interest long, implied_vol double"


@pytest.mark.parametrize(("change", "says"), [({3: -1.0}, "above zero"), ({3: float("inf")}, "above zero"), ({4: -1}, "call_open_interest is below"), ({6: 5.1}, "implied_vol"), ({6: float("nan")}, "implied_vol"), ({}, "stands twice"), ({2: "2024-01-01"}, "over before"), ({2: None}, "absent")])
def test_chains(spark, change, says):
    contracts.validate_option_chain(told(spark, [CHAIN, (1, *CHAIN[1:3], 101.0, *CHAIN[4:])], CHAINS, as_of="ny", expiry="date"))
    row = tuple(change.get(i, v) for i, v in enumerate((1, *CHAIN[1:])))
    with pytest.raises(contracts.ContractError, match=says):
        contracts.validate_option_chain(told(spark, [CHAIN, row], CHAINS, as_of="ny", expiry="date"))


EVENT, EVENTS = (0, "2024-01-02 10:00:00", "CPI", 0.5), "row long, timestamp string, event_type string, surprise double"


@pytest.mark.parametrize(("row", "says"), [((1, None, "CPI", 0.1), "no time"), ((1, "2024-01-02 11:00:00", "  ", 0.1), "no type"), ((1, "2024-01-02 09:00:00", "CPI", 0.1), "earlier than"), ((1, *EVENT[1:3], 0.1), "stands twice")])
def test_events(spark, row, says):
    contracts.validate_events(told(spark, [EVENT, (1, EVENT[1], "NFP", float("nan"))], EVENTS, timestamp="ny"))
    with pytest.raises(contracts.ContractError, match=says):
        contracts.validate_events(told(spark, [EVENT, row], EVENTS, timestamp="ny"))


def test_windows_and_frequencies():
    a, b = datetime(2024, 1, 2, 9, 30, tzinfo=NY), datetime(2024, 1, 2, 16, tzinfo=NY)
    assert market.check_window(a, b) == (a, b)
    for bad in ((b, a), (a, a), (a.replace(tzinfo=None), b), (a.replace(tzinfo=ZoneInfo("UTC")), b)):
        with pytest.raises(ValueError):
            market.check_window(*bad)
    with pytest.raises(ValueError):
        market.check_frequency("2min")


@pytest.fixture(scope="module")
def source(spark):
    return synthetic.SyntheticIntradaySource(spark, 4)


def test_market(source):
    day = lambda h, m=0, d=2: datetime(2024, 1, d, h, m, tzinfo=NY)
    assert source.bars(day(9, 30), day(16)).count() == 390
    wide = source.bars(day(9, 30), day(16), "15min").toPandas()
    assert len(wide) == 26 and (wide.volume == wide.bid_volume + wide.ask_volume).all()
    one = source.bars(day(9, 30), day(9, 45)).toPandas().sort_values("timestamp")
    first = wide.sort_values("timestamp").iloc[0]
    assert (first.open, first.high, first.low, first.close, first.volume) == (one.open.iloc[0], one.high.max(), one.low.min(), one.close.iloc[-1], one.volume.sum())
    assert source.depth(day(9, 30), day(9, 40)).count() == 10 and source.events(day(0, 0), day(23, 0)).count() == 1
    chain = source.option_chain(day(12, 0)).toPandas()
    assert len(chain) == 84 and [str(x) for x in sorted(chain.expiry.unique())] == ["2024-01-05", "2024-01-12", "2024-01-19", "2024-01-26"]
    with pytest.raises(ValueError):
        source.option_chain(datetime(2023, 12, 1, 12, tzinfo=NY))


def test_order_of_arrival(spark, source):
    """Rows with a column of arrival are held to it, also where one stretch meets the next; without it time is the order."""
    day = lambda h, m=0: datetime(2024, 1, 2, h, m, tzinfo=NY)
    bars, stretch = source._bars, contracts.STRETCH
    seconds = F.unix_timestamp("timestamp") - F.lit(int(day(9, 30).timestamp()))
    for arrival, fine in ((seconds, True), (-seconds, False), (F.when(seconds >= 3600, seconds + stretch).otherwise(seconds), True), (F.when(seconds >= 3600, seconds).otherwise(seconds + 10 * stretch), False)):
        own = market.TableSource(bars.withColumn("arrival", arrival.cast("bigint")), source._quotes, source._chains, source._events)
        if fine:
            assert own.bars(day(9, 30), day(16)).count() == 390
            assert own.bars(day(9, 30), day(16), "5min").count() == 78
        else:
            for freq in ("1min", "5min"):
                with pytest.raises(contracts.ContractError, match="earlier than"):
                    own.bars(day(9, 30), day(16), freq)
    shuffled = market.TableSource(bars.orderBy(F.xxhash64("timestamp")), source._quotes, source._chains, source._events)
    assert shuffled.bars(day(9, 30), day(16)).count() == 390
    plan = contracts._ordered(bars, "timestamp", "timestamp", ())._jdf.queryExecution().optimizedPlan().toString()
    assert "__stretch" in plan


def test_longer_horizons_start_the_same(spark, source):
    longer = synthetic.SyntheticIntradaySource(spark, 6)
    a, b = (s._bars.orderBy("timestamp").limit(4 * 390).collect() for s in (source, longer))
    assert a == b


def test_hidden_state_stays_hidden(source):
    public = set(source._bars.columns) | set(source._quotes.columns) | set(source._events.columns)
    assert not {"pressure", "sigma", "jump", "normalized_residual"} & public and "pressure" in source.hidden_state_for_validation().columns


def test_no_operator_uses_the_hidden_state():
    import ast
    import pathlib

    root = pathlib.Path(synthetic.__file__).parents[1]
    for f in [*root.glob("operators/*.py"), *root.glob("plans/*.py"), *root.glob("streaming/*.py"), *root.glob("functions/*.py")]:
        names = {n.attr for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.Attribute)}
        assert "hidden_state_for_validation" not in names, f


def test_volume_profile_has_a_u_shape(source):
    v = source._bars.toPandas().sort_values("timestamp").volume.to_numpy().reshape(4, 390).mean(axis=0)
    assert v[:30].mean() > 1.2 * v[150:240].mean()


def test_daily_bars(spark):
    df = synthetic.daily_bars(spark, 300).toPandas()
    assert (df.high >= df[["open", "close"]].max(axis=1)).all() and (df.low <= df[["open", "close"]].min(axis=1)).all()
    assert np.allclose(df[["open", "high", "low", "close"]].to_numpy() % 0.25, 0) and set(df.regime) <= {"bull", "bear", "sideways"}


def test_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        files.read_daily_bars(spark, f"{base}/none.csv")
    (tmp_path / "d.csv").write_text("date,open,high,low,close,log_return,regime\n2020-01-02,1,2,0.5,1.5,,bull\n")
    assert files.read_daily_bars(spark, f"{base}/d.csv").first()["close"] == 1.5
    (tmp_path / "r.txt").write_text("title\n\n band  limit\n  0.10   1.00\n  0.20   0.50\n\n")
    got = files.read_report(spark, f"{base}/r.txt", ["band", "limit"]).orderBy("row").collect()
    assert [(r["row"], r["band"], r["limit"]) for r in got] == [(0, 0.1, 1.0), (1, 0.2, 0.5)]
    log = f"{base}/log"
    assert files.read_trial_log(spark, log).count() == 0
    rows = spark.createDataFrame([("t1", "g1", 5)], "trial_id string, group string, n_decisions long")
    assert files.append_trials(spark, log, rows).first()["recal_window"] is None
    with pytest.raises(RuntimeError):
        files.append_trials(spark, log, rows)
    assert files.append_trials(spark, log, rows.withColumn("group", F.lit("g2"))).count() == 2
    assert files.append_trials(spark, log, rows.withColumn("group", F.explode(F.array(F.lit("g3/x"), F.lit(None))))).count() == 4
    lines = files.report_lines(spark.createDataFrame([(1, 0.0625), (2, None)], "k int, v double"), ["k", "v"], ["k"], 3, 8).collect()
    assert [x["value"] for x in lines] == ["       1   0.062", "       2        "]
    files.write_report(spark.createDataFrame([("x",)], "value string"), f"{base}/out")
    assert spark.read.text(f"{base}/out").first()["value"] == "x"


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    """Both find the group free, both write their rows; only one group is published, whole."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    log, meet, real = f"file://{tmp_path}/log", Barrier(2, timeout=60), files.publish
    monkeypatch.setattr(files, "publish", lambda *a: (meet.wait(), real(*a))[1])

    def write(k):
        rows = spark.createDataFrame([(f"t{k}{i}", "g", k) for i in range(3)], "trial_id string, group string, n_decisions long")
        try:
            files.append_trials(spark, log, rows)
            return k
        except RuntimeError:
            return None

    with ThreadPoolExecutor(2) as pool:
        won = [k for k in pool.map(write, (1, 2)) if k is not None]
    assert len(won) == 1
    got = files.read_trial_log(spark, log).collect()
    assert sorted(r["trial_id"] for r in got) == [f"t{won[0]}{i}" for i in range(3)]
