import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemill.operators import hurst, online
from tidemill.plans import catalogue, views
from tidemill.plans import walk_forward as wf
from tidemill.streaming import operators as ops
from tidemill.streaming.run import available_now

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    return "null" if x is None else repr(x + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(cell(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "label" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["mp_composite", "mp_composite_causal", "ax_subsignal", "sized_backtest", "conformal_gate", "bocpd", "conformal_experiment", "dashboard_synthetic", "stream_bocpd", "stream_gate", "synthetic_intraday"])
def test_queries_without_sql_run(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def returns_of(spark, data):
    rows = views.series(spark, data).where("log_return is not null").orderBy("bar_idx").toPandas()
    return {k: part.log_return.to_numpy() for k, part in rows.groupby("series_id")}


def brute_interval(r):
    """200 resamples of blocks from the whole length, one after another."""
    block, n, found, last = max(10, round(2 * len(r) ** (1 / 3))), len(r), [], 0
    for resample in range(200):
        rows = []
        while len(rows) < n:
            start = int(hashlib.md5(f"{resample}:{len(rows) // block}".encode()).hexdigest()[:8], 16) % (n - block + 1)
            rows += r[start : start + block].tolist()
            last = max(last, start + block)
        found.append(hurst.dfa_many(np.array(rows[:n])[None])[0])
    assert last > 0.95 * n
    return np.percentile(found, [2.5, 97.5])


def test_whole_bootstrap(spark, data):
    got = {r["series_id"]: r for r in catalogue.queries()["hurst_block_bootstrap"](spark, data).collect()}
    own = returns_of(spark, data)
    assert set(got) == set(own)
    for k, r in own.items():
        assert got[k]["resamples"] == 200 and (got[k]["ci_low"], got[k]["ci_high"]) == pytest.approx(tuple(brute_interval(r)), abs=1e-6)


def test_every_window_has_an_exponent(spark, data):
    got = {(r["series_id"], r["end_bar"]): r["hurst"] for r in catalogue.queries()["hurst_rolling"](spark, data).collect()}
    last = {r["series_id"]: r["n"] - 1 for r in views.series(spark, data).groupBy("series_id").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {(k, e) for k, n in last.items() for e in range(252, n + 1)}
    want = hurst.rolling_dfa(views.series(spark, data).where("bar_idx < 262")).collect()
    assert len(want) >= 40 and all(got[r["series_id"], r["end_bar"]] == pytest.approx(r["hurst"], abs=1e-6) for r in want)


def test_band_follows_the_bootstrapped_interval(spark, data):
    got = catalogue.queries()["consensus_hurst_band"](spark, data).collect()
    assert {r["series_id"] for r in got} == set(returns_of(spark, data))
    bands = {}
    for k, r in returns_of(spark, data).items():
        low, high = brute_interval(r)
        h = hurst.dfa_many(r[None])[0]
        bands[k] = 0.15 * (2 if low <= 0.5 <= high else 2 - min(abs(h - 0.5) / 0.5, 1) * 1.5)
    for r in got:
        assert r["band"] == pytest.approx(bands[r["series_id"]], abs=1e-6)
        assert r["label"] == ("bullish" if r["score"] > r["band"] else "bearish" if r["score"] < -r["band"] else "neutral")


def test_model_queries_run_whole(spark, data):
    """All orders, default splits, starts, bandwidths, permutations and sessions; nothing is replaced."""
    n = views.series(spark, data, whole=True).count()
    edge = catalogue.queries()["regime_edge_permutation"](spark, data).collect()
    assert [r["series_id"] for r in edge] == ["ALL"]
    assert all(abs(edge[0][p] * 501 - round(edge[0][p] * 501)) < 1e-3 for p in ("trend_p", "reversion_p") if edge[0][p] is not None)
    rows = catalogue.queries()["run_config_metrics"](spark, data).collect()
    assert [r["name"] for r in sorted(rows, key=lambda r: r["trial_id"])] == list(wf.TRIALS) and {r["n_decisions"] for r in rows} == {n - n // 9 - 1}
    best = max((r for r in rows if r["name"] != "baseline_pre5a"), key=lambda r: r["train_sharpe_pp"])
    assert [r["train_sharpe_pp"] for r in rows if r["reported"]] == [best["train_sharpe_pp"]]
    assert catalogue.queries()["synthetic_intraday"](spark, data).count() == 60 * 26


def test_every_bandwidth_is_scored(spark, data):
    got = {(r["series_id"], r["bandwidth"]): r["mse"] for r in catalogue.queries()["kernel_loocv"](spark, data).collect()}
    rows = views.series(spark, data).orderBy("bar_idx").toPandas()
    assert len(got) == 5 * 11
    for k, part in rows.groupby("series_id"):
        y, i = part.close.to_numpy(), part.bar_idx.to_numpy()
        for h in (2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135):
            w = np.exp(-0.5 * ((i[:, None] - i) / h) ** 2) * (1 - np.eye(len(i)))
            assert got[k, h] == pytest.approx(np.mean((y - w @ y / w.sum(axis=1)) ** 2) / 1e6, abs=2e-3)


def test_config_checks():
    assert [c.name for c in wf.default_configs()][0] == "baseline_pre5a" and len(wf.default_configs()) == 7
    for bad in ({"weights": "x"}, {"base_band": 1.0}, {"recal_every": 0}, {"wss_mode": "on"}):
        with pytest.raises(ValueError):
            wf.Config("c", **bad)


def market_signals(spark, n, splits):
    """A synthetic market with two starts and three bandwidths."""
    from tidemill.operators import options, regimes
    from tidemill.sources import synthetic

    df = synthetic.daily_bars(spark, n).withColumn("ts", F.col("date").cast("timestamp_ntz"))
    events = spark.createDataFrame([("2020-10-02", "NFP", 1.8), ("2020-11-12", "CPI", 0.9), ("2021-01-27", "FOMC", -0.6), ("2021-02-25", "GDP", 1.2)], "day string, event_type string, surprise double")
    events = events.select(F.col("day").cast("timestamp_ntz").alias("event_ts"), "event_type", "surprise")
    return wf.build_signals(df, events, wf.flow_panel(df, synthetic.flow_noise(spark, n)), options.chain_noise(spark), splits, regimes.seeds_of(2), (3, 8, 18))


@pytest.fixture(scope="module")
def signals(spark):
    return market_signals(spark, 240, 3).persist()


def test_all_trials_in_one_pass_score_as_each_alone(signals):
    configs = [
        wf.Config("a", wss_mode="off", hurst=False), wf.Config("b", base_band=0.1), wf.Config("c", weights="dynamic", recal_window=30, recal_every=7), wf.Config("d", weights="dynamic", wss_mode="vote"),
        wf.Config("e", regime_mode="subsignal", kernel_reading="momentum", wss_mode="vote"),
    ]
    got = wf.scored_trials(signals, configs).toPandas()
    assert len(got) == 5 * 179
    for i, c in enumerate(configs):
        alone = wf.scored(signals, c).orderBy("bar_idx").toPandas()
        mine = got[got.setting == i].sort_values("bar_idx")
        assert np.allclose(mine[["score", "agreement", "band"]], alone[["score", "agreement", "band"]])
    # By hand: the votes of trial c under the hit rates of the last 30 bars, taken up every seventh bar.
    s = signals.orderBy("bar_idx").toPandas()
    weight = np.ones(3)
    mine = got[got.setting == 2].sort_values("bar_idx")
    own = wf.consensus.votes_of(F.col("regime"), F.col("order_flow"), F.col("kernel_dev"))
    v = signals.orderBy("bar_idx").select(*(x.alias(k) for k, x in own.items())).toPandas().to_numpy()
    for t in range(len(v)):
        if t >= 20 and t % 7 == 0:
            past = slice(max(0, t - 30), t)
            hits = (np.sign(v[past]) != 0) & (np.sign(v[past]) == np.sign(s.next_return.to_numpy()[past])[:, None])
            weight = np.maximum(hits.mean(axis=0) - 0.5, 0) + 0.01
        assert mine.score.iloc[t] == pytest.approx((weight * v[t]).sum() / weight.sum(), abs=1e-9)


def test_only_chosen_bandwidths_run_over_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([("A", i, float(100 + 10 * np.sin(i / 5) + i % 3)) for i in range(200)], "series_id string, bar_idx long, close double")
    run, real = [], wf.kernel.causal_deviation
    monkeypatch.setattr(wf.kernel, "causal_deviation", lambda d, h, *a: run.append(h) or real(d, h, *a))
    table = wf.regimes.folds(df, 3)
    got = wf.fold_kernel(df, table, (2, 3, 40)).toPandas()
    assert sorted(run) == sorted(set(got.bandwidth)) and 40 not in run and len(got) == 150


def test_signals(signals):
    rows = signals.orderBy("bar_idx").toPandas()
    assert rows.bar_idx.tolist() == list(range(60, 239)) and rows.isna().sum().sum() == 0
    assert set(rows.hurst_multiplier.between(0.5, 2.0)) == {True} and rows.ax_subsignal.abs().max() <= 1


def test_run_configs(signals):
    configs = [wf.Config("baseline_pre5a", wss_mode="off", hurst=False), wf.Config("b"), wf.Config("dynamic", weights="dynamic"), wf.Config("vote", wss_mode="vote"), wf.Config("sub", regime_mode="subsignal", kernel_reading="momentum")]
    paths = wf.run_configs(signals, configs)
    rows = {r["name"]: r for r in wf.trial_rows(paths, configs, "g").collect()}
    assert len(rows) == 5 and all(r["n_decisions"] == 179 and r["split_index"] == 107 for r in rows.values())
    assert rows["baseline_pre5a"]["train_sharpe_pp"] == pytest.approx(rows["b"]["train_sharpe_pp"])  # a context without a vote and a band of 0 change nothing
    assert sum(r["reported"] for r in rows.values()) == 1 and not rows["baseline_pre5a"]["reported"]
    assert rows["dynamic"]["recal_window"] == 120 and rows["b"]["recal_window"] is None


def test_signals_are_causal(spark, signals):
    """A market that jumps at a late bar gives the same signals before it."""
    from tidemill.operators import options, regimes
    from tidemill.sources import synthetic

    df = synthetic.daily_bars(spark, 240).withColumn("ts", F.col("date").cast("timestamp_ntz"))
    jump = F.when(F.col("bar_idx") == 200, 50.0).otherwise(1.0)
    move = F.when(F.col("bar_idx") == 200, float(np.log(50))).when(F.col("bar_idx") == 201, -float(np.log(50))).otherwise(0.0)
    spiked = df.withColumn("close", F.col("close") * jump).withColumn("log_return", F.col("log_return") + move)
    events = spark.createDataFrame([("2020-10-02", "NFP", 1.8)], "day string, event_type string, surprise double").select(F.col("day").cast("timestamp_ntz").alias("event_ts"), "event_type", "surprise")
    run = lambda d: wf.build_signals(d, events, wf.flow_panel(d, synthetic.flow_noise(spark, 240)), options.chain_noise(spark), 3, regimes.seeds_of(1), (3, 8)).orderBy("bar_idx").toPandas()
    a, b = run(df), run(spiked)
    columns = ["order_flow", "kernel_dev", "gex", "hurst_multiplier", "ax_subsignal", "wss"]
    early = a.bar_idx < 180  # the last test block's own training stops there
    assert np.allclose(a[early][columns], b[early][columns]) and (a[early].regime == b[early].regime).all()
    late = (a.bar_idx >= 180) & (a.bar_idx < 200)
    assert np.allclose(a[late][columns], b[late][columns])
    assert not np.allclose(a[~early][["gex"]], b[~early][["gex"]])


def test_regime_edge(spark):
    from tidemill.operators import regimes
    from tidemill.sources import synthetic

    got = wf.regime_edge(synthetic.daily_bars(spark, 300), 2, 50, regimes.seeds_of(1)).first()
    assert got["n_trend"] + got["n_reversion"] <= 199 and (got["trend_p"] is None or 0 < got["trend_p"] <= 1)


def test_streams_cut_into_triggers_equal_batches(spark, tmp_path, data):
    """Three files, one trigger each, against the batch operators."""
    rng = np.random.default_rng(7)
    rows = [("A", i, float(s), float(r)) for i, (s, r) in enumerate(zip(rng.normal(size=180), np.concatenate([rng.normal(0, 1, 90), rng.normal(4, 1, 90)])))]
    schema = "series_id string, bar_idx long, s double, r double"
    for k in range(3):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"file://{tmp_path}/in")
    whole = spark.createDataFrame(rows, schema)
    a = available_now(ops.stream_changepoints(stream(), "r")).orderBy("bar_idx").toPandas()
    b = online.changepoints(whole, "r").orderBy("bar_idx").toPandas()
    assert np.allclose(a[["change_prob", "expected_run", "map_run"]], b[["change_prob", "expected_run", "map_run"]])
    gate = online.Gate(0.1, 0.5)
    want = []
    for _, _, s, r in rows:
        want.append(gate.decide(s))
        gate.update(s, r)
    c = available_now(ops.stream_gate(stream(), "s", "r", 0.5)).orderBy("bar_idx").collect()
    assert all(x["action"] == w[0] and x["lower"] == pytest.approx(w[1]) and x["upper"] == pytest.approx(w[2]) for x, w in zip(c, want))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "series_id string, event_id long, ts timestamp_ntz, value double"
    first = spark.createDataFrame([("A", 1, "2024-01-01 10:10:00", 1.0), ("A", 2, "2024-01-01 14:00:00", 2.0)], "series_id string, event_id long, t string, value double")
    late = spark.createDataFrame([("A", 3, "2024-01-01 10:20:00", 9.0), ("A", 4, "2024-01-01 18:30:00", 3.0)], "series_id string, event_id long, t string, value double")
    later = first.limit(0).union(spark.createDataFrame([("A", 5, "2024-01-01 18:00:00", 1.0)], first.schema))
    for k, df in enumerate((first, later, late)):
        df.select("series_id", "event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    got = {str(r["bar_ts"]): r["n"] for r in available_now(ops.stream_bars(s, "1 hour")).collect()}
    assert got["2024-01-01 10:00:00"] == 1 and got["2024-01-01 14:00:00"] == 1


def test_library_does_not_import_the_training_data_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(views.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" in f.parts:
            continue
        for n in ast.walk(ast.parse(f.read_text())):
            if isinstance(n, ast.Import | ast.ImportFrom):
                assert "llm" not in " ".join([getattr(n, "module", "") or "", *(a.name for a in n.names)]), f


def test_experiment_appends_and_gates(spark, signals, tmp_path):
    from tidemill.sources import files

    (tmp_path / "r.txt").write_text("sweep\n\nneutral_band cdar_limit train_sharpe train_trades_per_week heldout_sharpe heldout_trades_per_week\n0.00 1.00 0.34 4.1 -0.45 4.0\n0.02 0.10 0.30 3.9 -0.40 3.8\n")
    report = files.read_report(spark, f"file://{tmp_path}/r.txt", ["neutral_band", "cdar_limit", "train_sharpe", "train_trades_per_week", "heldout_sharpe", "heldout_trades_per_week"])
    configs, log = [wf.Config("baseline_pre5a", wss_mode="off", hurst=False), wf.Config("a"), wf.Config("b", kernel_reading="momentum")], f"file://{tmp_path}/log"
    rows, gate = wf.experiment(signals, log, configs, report=report)
    g, whole = gate.first(), files.read_trial_log(spark, log)
    assert whole.count() == 5 and g["num_trials"] == 5 and g["num_obs"] == 72 and g["trial_id"] == rows.where("reported").first()["trial_id"]
    assert {r["trial_id"] for r in whole.where("group = 'calibration_sweep_v1'").collect()} == {"sweep_000", "sweep_001"}
    with pytest.raises(RuntimeError):
        wf.experiment(signals, log, configs)
    costs = wf.cost_sensitivity(wf.scored(signals, configs[1]).drop("band"), 0.0, 1.0).orderBy("cost_bps").collect()
    assert [c["cost_bps"] for c in costs] == [0.0, 5.0, 10.0] and costs[0]["train_sharpe_pp"] > costs[2]["train_sharpe_pp"]


def test_late_rows_are_dropped_as_behind_a_watermark(spark, tmp_path):
    import time

    rows = [("a", i, float(i % 7)) for i in range(40)]
    for k, part in enumerate((rows[:20], rows[30:], rows[20:30])):
        spark.createDataFrame(part, "series_id string, bar_idx long, r double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        time.sleep(1.1)
    s = spark.readStream.schema("series_id string, bar_idx long, r double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    assert sorted(r["bar_idx"] for r in available_now(ops.stream_changepoints(s, "r")).collect()) == [*range(20), *range(30, 40)]
