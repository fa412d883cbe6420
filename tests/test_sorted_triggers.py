"""Streams whose triggers Spark sorts: a worker takes one Arrow batch of a series after the other."""
import numpy as np
import pandas as pd
import pytest

from tidemill.operators import online
from tidemill.streaming import operators as ops
from tidemill.streaming.run import available_now

SCHEMA = "series_id string, bar_idx long, s double, r double"
CHECK = "spark.sql.streaming.unsupportedOperationCheck"


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Two series in two triggers, shuffled within each; the second trigger has two late rows."""
    at, rng = tmp_path_factory.mktemp("cut"), np.random.default_rng(3)
    rows = [(k, i, float(s), float(r)) for k in "AB" for i, (s, r) in enumerate(rng.normal(size=(700, 2)))]
    late = [("A", 5, 1.0, 9.0), ("B", 350, 1.0, 9.0)]
    for k, part in enumerate(([r for r in rows if r[1] < 400], [r for r in rows if r[1] >= 400] + late)):
        rng.shuffle(part := [*part])
        spark.createDataFrame([(str(a), int(b), float(c), float(d)) for a, b, c, d in part], SCHEMA).coalesce(1).write.parquet(f"file://{at}/in/{k}")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{at}/in")
    return rows, stream


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "37")
    yield
    spark.conf.set(key, before)


def test_gate_over_sorted_triggers(spark, cut, small_batches):
    rows, stream = cut
    got = available_now(ops.stream_gate(stream(), "s", "r", 0.5, spark_sorts=True), sorts=True).orderBy("series_id", "bar_idx").collect()
    assert spark.conf.get(CHECK) == "true"
    want = []
    for k in "AB":
        gate = online.Gate(0.1, 0.5)
        for _, i, s, r in (x for x in rows if x[0] == k):
            action, low, high = gate.decide(s)
            want.append((k, i, action, low, high, low <= r <= high))
            gate.update(s, r)
    assert [tuple(r) for r in got] == want


def test_changepoints_over_sorted_triggers(spark, cut, small_batches):
    rows, stream = cut
    got = available_now(ops.stream_changepoints(stream(), "r", spark_sorts=True), sorts=True).orderBy("series_id", "bar_idx").collect()
    want = []
    for k in "AB":
        model = online.Changepoints()
        want += [(k, i, *model.update(r)) for a, i, _, r in rows if a == k]
    assert [tuple(r) for r in got] == want


def test_a_worker_takes_one_part_at_a_time():
    """And says so when parts are not in order."""
    taken = []

    def parts(*starts):
        for s in starts:
            taken.append(s)
            yield pd.DataFrame({"series_id": "A", "bar_idx": np.arange(s, s + 10), "s": 0.0})

    steps = ops.in_steps(parts(0, 10, 20), "bar_idx", ["s"], 4, True)
    assert next(steps)["bar_idx"].tolist() == list(range(5, 10)) and taken == [0]
    assert len(next(steps)) == 10 and taken == [0, 10]
    with pytest.raises(RuntimeError, match="not in order"):
        list(ops.in_steps(parts(10, 0), "bar_idx", ["s"], None, True))
    assert [x for p in ops.in_steps(parts(10, 0), "bar_idx", ["s"], 3, False) for x in p["bar_idx"]] == list(range(4, 20))
