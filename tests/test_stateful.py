"""Streams with typed state: the gate that fits its scale, and bars held to their contract."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import online
from tidemill.sources.contracts import BAR_SAYS
from tidemill.streaming import operators as ops
from tidemill.streaming.run import available_now

SCHEMA = "series_id string, bar_idx long, s double, r double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    ops.rocksdb(spark)
    yield
    spark.conf.set(key, before)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{path}/in")


def written(spark, path, rows, cuts, schema):
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"file://{path}/in/{k}")


def told(df):
    rows = df.orderBy("series_id", "bar_idx").collect()
    return [(r["series_id"], r["bar_idx"], r["action"], r["covered"], *(v if math.isinf(v) else pytest.approx(v, abs=1e-12) for v in (r["lower"], r["upper"], r["scale"]))) for r in rows]


@pytest.mark.parametrize("cuts", [[37], [10, 60, 61, 130]])
def test_fitted_gate_cut_anywhere_equals_the_batch(spark, tmp_path, rocks, cuts):
    rng = np.random.default_rng(7)
    rows = [(k, i, float(s), float(0.3 * s + e)) for i in range(90) for k, s, e in (("A", rng.normal(), rng.normal()), ("B", rng.normal(), 0.1))]
    written(spark, tmp_path, rows, cuts, SCHEMA)
    got = available_now(ops.stream_fitted_gate(stream(spark, tmp_path, SCHEMA), "s", "r", warmup=30))
    want = online.conformal_gate(spark.createDataFrame(rows, SCHEMA), "s", "r", warmup=30)
    a, b = told(got), told(want)
    assert len(a) == 180 and a == b


def test_a_series_that_is_too_short_comes_out_when_it_has_grown(spark, tmp_path, rocks):
    rows = [("A", i, 1.0 + i % 3, 0.5 * i) for i in range(12)]
    written(spark, tmp_path, rows, [4, 8], SCHEMA)
    source = stream(spark, tmp_path, SCHEMA)
    assert available_now(ops.stream_fitted_gate(source.where("bar_idx < 10"), "s", "r", warmup=10)).count() == 0
    assert available_now(ops.stream_fitted_gate(source, "s", "r", warmup=10)).count() == 12


BARS = "series_id string, arrival long, t string, open double, high double, low double, close double, volume long"


def test_bad_bars_land_in_quarantine_once(spark, tmp_path, rocks):
    fine = (18000.0, 18000.5, 17999.75, 18000.25, 10)
    rows = [("A", k, f"2024-01-02 10:{k:02d}:00", *fine) for k in range(6)]
    rows[2] = (*rows[2][:3], 18000.1, *fine[1:])  # off the grid
    rows[4] = ("A", 4, "2024-01-02 10:01:30", *fine)  # earlier than the one before
    rows.insert(5, ("A", 4, "2024-01-02 10:03:00", *fine))  # a repeat: dropped
    rows.append(("B", 9, "2024-01-02 17:30:00", 18000.0, 17000.0, 17999.75, 18000.25, -1))  # three rules and the hours
    written(spark, tmp_path, rows, [3, 5], BARS)

    def run(only=None):
        source = stream(spark, tmp_path, BARS)
        source = source if only is None else source.where(only)
        typed = source.withColumn("timestamp", F.to_timestamp(F.concat("t", F.lit(" America/New_York")))).drop("t")
        ops.quarantine(ops.checked_bars(typed), f"file://{tmp_path}/good", f"file://{tmp_path}/bad", f"file://{tmp_path}/state").awaitTermination()

    run()
    good = spark.read.parquet(f"file://{tmp_path}/good").select("series_id", "arrival").collect()
    bad = sorted((r["series_id"], r["arrival"], r["rule"]) for r in spark.read.parquet(f"file://{tmp_path}/bad").collect())
    assert sorted(map(tuple, good)) == [("A", 0), ("A", 1), ("A", 3), ("A", 5)]
    want = [("A", 2, "open lies between two ticks"), ("A", 4, BAR_SAYS[1])] + sorted(("B", 9, s) for s in (BAR_SAYS[3], "the high is under the low", "the high is under the open or the close", "volume is below zero"))
    assert bad == sorted(want)
    # A restart over one more file takes that alone, and still knows what came before.
    spark.createDataFrame([("A", 10, "2024-01-02 10:02:00", *fine), ("A", 11, "2024-01-02 10:30:00", *fine)], BARS).coalesce(1).write.parquet(f"file://{tmp_path}/in/9")
    run()
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 5
    assert [r["rule"] for r in spark.read.parquet(f"file://{tmp_path}/bad").where("arrival >= 10").collect()] in ([], [BAR_SAYS[1]])
