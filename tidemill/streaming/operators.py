"""Streaming forms: watermarked bars, changepoints and the conformal gate. Rows of a trigger are put in event order before the
state sees them, so a stream that is cut into triggers at any point gives what the batch operators give. The state keeps the last
row's place: a row that arrives after one that follows it was taken is late and dropped, as behind a watermark.

Spark orders a trigger's rows where ``spark_sorts`` is set: the worker then holds one Arrow batch of a series, however large the
trigger. Spark refuses sorts in streams by default (it cannot order a stream as a whole; within a trigger's partitions it can), so
such a stream is started by ``available_now(..., sorts=True)`` or with spark.sql.streaming.unsupportedOperationCheck off. Without it
a trigger's rows of one series stand in a worker at once, as numbers, and the source's own limits (files or offsets a trigger) bound them."""
from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.online import Changepoints, Gate
from ..sources.contracts import bar_rules

KEYS = ("series_id",)


def in_order(parts: Iterator[pd.DataFrame], order: str, last: int | None) -> pd.DataFrame:
    """The rows of a trigger by their place, without late ones."""
    rows = pd.concat([p if last is None else p[p[order] > last] for p in parts])
    return rows.sort_values(order, kind="stable")


#: Rows that a model takes at once from a trigger that was sorted in the worker.
ROWS_AT_ONCE = 10_000


def in_steps(parts: Iterator[pd.DataFrame], order: str, columns: Sequence[str], last: int | None, spark_sorts: bool) -> Iterator[pd.DataFrame]:
    """The rows of in_order, some thousand at a time, without their key; parts that Spark has sorted pass one by one."""
    parts = (p[[order, *columns]] for p in parts)
    if not spark_sorts:
        rows = in_order(parts, order, last)
        yield from (rows.iloc[i : i + ROWS_AT_ONCE] for i in range(0, len(rows), ROWS_AT_ONCE))
        return
    before = None
    for p in parts:
        p = p if last is None else p[p[order] > last]
        if p.empty:
            continue
        at = p[order].to_numpy()
        if pd.isna(at).any():
            raise ValueError("a row has no place in its series")
        if (at[1:] < at[:-1]).any() or (before is not None and at[0] < before):
            raise RuntimeError("a trigger's rows are not in order: has the number of shuffle partitions changed since the stream's first start?")
        before = at[-1]
        yield p


def by_series(rows: DataFrame, key: str, order: str, spark_sorts: bool):
    """Groups of rows by key; the stateful operator needs the same partitions, so Spark's sort by key and place reaches it as it is."""
    return (rows.repartition(key).sortWithinPartitions(key, order) if spark_sorts else rows).groupBy(key)


def event_time(df: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Watermarks need a timestamp with a zone; rows later than that are dropped and counted by the engine."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def stream_bars(df: DataFrame, width: str, ts: str = "ts", value: str = "value", tie: str = "event_id", late: str = "1 hour", keys: Sequence[str] = KEYS) -> DataFrame:
    """The bars of resample_ticks over a stream; in append mode a bar comes out once the watermark has passed its end."""
    at = F.struct(ts, tie)
    bars = event_time(df, ts, late).groupBy(*keys, F.window(ts, width).alias("w"))
    made = bars.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n"))
    return made.select(*keys, F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume", "n")


def stream_changepoints(df: DataFrame, value: str, order: str = "bar_idx", hazard: float = 0.01, k: int = 5, most: int = 500, key: str = "series_id", spark_sorts: bool = False) -> DataFrame:
    """key, bar_idx, change_prob, expected_run, map_run; the state of a series is its posterior, at most ``most`` runs."""
    Changepoints(hazard, most)

    def step(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = Changepoints(hazard, most)
        if state.exists:
            model.restore(bytes(state.get[0]))
        for rows in in_steps(parts, order, [value], state.get[1] if state.exists else None, spark_sorts):
            out = [model.update(float(x), k) for x in rows[value]]
            state.update((model.state(), int(rows[order].iloc[-1])))
            yield pd.DataFrame({key: own[0], "bar_idx": rows[order].to_numpy(), "change_prob": [o[0] for o in out], "expected_run": [o[1] for o in out], "map_run": [o[2] for o in out]})

    rows = df.where(F.col(value).isNotNull()).select(key, order, F.col(value).cast("double").alias(value))
    return by_series(rows, key, order, spark_sorts).applyInPandasWithState(step, f"{key} string, bar_idx long, change_prob double, expected_run double, map_run int", "posterior binary, last long", "append", GroupStateTimeout.NoTimeout)


def stream_gate(df: DataFrame, score: str, realised: str, scale: float, order: str = "bar_idx", alpha: float = 0.1, warmup: int = 60, key: str = "series_id", spark_sorts: bool = False) -> DataFrame:
    """key, bar_idx, action, lower, upper, covered under a scale fitted before; the state is the width and the last errors."""
    Gate(alpha, scale, warmup=warmup)

    def step(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, last = Gate(alpha, scale, warmup=warmup), None
        if state.exists:
            gate.t, gate.width, errors, last = state.get
            gate.errors = json.loads(errors)
        for rows in in_steps(parts, order, [score, realised], last, spark_sorts):
            out = []
            for a, b in zip(rows[score].tolist(), rows[realised].tolist()):
                action, low, high = gate.decide(a)
                out.append((action, low, high, low <= b <= high))
                gate.update(a, b)
            state.update((gate.t, gate.width, json.dumps(gate.errors), int(rows[order].iloc[-1])))
            yield pd.DataFrame({key: own[0], "bar_idx": rows[order].to_numpy(), **pd.DataFrame(out, columns=["action", "lower", "upper", "covered"])})

    rows = df.where(F.col(score).isNotNull() & F.col(realised).isNotNull()).select(key, order, F.col(score).cast("double").alias(score), F.col(realised).cast("double").alias(realised))
    return by_series(rows, key, order, spark_sorts).applyInPandasWithState(step, f"{key} string, bar_idx long, action string, lower double, upper double, covered boolean", "t long, width double, errors string, last long", "append", GroupStateTimeout.NoTimeout)


GATED = "bar_idx long, action string, lower double, upper double, covered boolean, scale double"


class FittedGate(StatefulProcessor):
    """The gate of one series on a stream that brings its own scale: a warm-up whose rows are kept as a list, then the scale fitted on
    them, frozen, and every row, those of the warm-up first, through the gate.

    State: ``warm``, the rows of the warm-up (emptied when it ends); ``gate``, its width, scale and count; ``errors``, the last
    ones; ``last``, the place of the last row taken. There are no timers: with them (time mode processingTime) a pandas
    processor of this Spark version waits for ever.
    """

    def __init__(self, key: str, score: str, realised: str, order: str, alpha: float, warmup: int) -> None:
        self.key, self.score, self.realised, self.order, self.alpha, self.warmup = key, score, realised, order, alpha, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.warm = handle.getListState("warm", "place long, score double, realised double")
        self.gate = handle.getValueState("gate", "t long, width double, scale double")
        self.errors = handle.getListState("errors", "error double")
        self.last = handle.getValueState("last", "place long")

    def _told(self, key: tuple, places: list, out: list, scale: float) -> pd.DataFrame:
        return pd.DataFrame({self.key: key[0], "bar_idx": places, **pd.DataFrame(out, columns=["action", "lower", "upper", "covered"]), "scale": scale})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = in_order(rows, self.order, self.last.get()[0] if self.last.exists() else None)
        if part.empty:
            return
        fresh = list(zip(part[self.order].tolist(), part[self.score].tolist(), part[self.realised].tolist()))
        self.last.update((int(fresh[-1][0]),))
        gate = Gate(self.alpha, warmup=self.warmup)
        if self.gate.exists():
            gate.t, gate.width, gate.scale = self.gate.get()
            gate.errors = [e[0] for e in self.errors.get()]
        else:
            held = [tuple(r) for r in self.warm.get()] if self.warm.exists() else []
            if len(held) + len(fresh) <= self.warmup:
                self.warm.appendList([(int(a), float(b), float(c)) for a, b, c in fresh])
                return
            fresh = held + fresh
            s, r = (np.array([x[i] for x in fresh[: self.warmup]]) for i in (1, 2))
            square = float(s @ s)
            gate.scale = float(s @ r) / square if square else 0.0
            self.warm.clear()
        out = []
        for _, a, b in fresh:
            action, low, high = gate.decide(a)
            out.append((action, low, high, low <= b <= high))
            gate.update(a, b)
        self.gate.update((int(gate.t), float(gate.width), float(gate.scale)))
        self.errors.put([(float(e),) for e in gate.errors])
        yield self._told(key, [x[0] for x in fresh], out, gate.scale)

    def close(self) -> None:
        pass


def stream_fitted_gate(df: DataFrame, score: str, realised: str, order: str = "bar_idx", alpha: float = 0.1, warmup: int = 60, key: str = "series_id") -> DataFrame:
    """key, bar_idx, action, lower, upper, covered, scale: conformal_gate over a stream, wherever it is cut. A series comes out from
    its first row on once it has more rows than the warm-up. Needs the RocksDB state store (``rocksdb``)."""
    Gate(alpha, warmup=warmup)
    rows = df.where(F.col(score).isNotNull() & F.col(realised).isNotNull()).select(key, F.col(order).cast("bigint").alias(order), F.col(score).cast("double").alias(score), F.col(realised).cast("double").alias(realised))
    processor = FittedGate(key, score, realised, order, alpha, warmup)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} string, {GATED}", "append", "none")


def rocksdb(spark: SparkSession) -> None:
    """The state store that typed state needs, for the streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ArrivalOrder(StatefulProcessor):
    """Marks rows that are earlier than one that arrived before them: the state of a key is the latest time it has seen."""

    def __init__(self, key: str, ts: str, order: str) -> None:
        self.key, self.ts, self.order = key, ts, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "micros long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        seen = self.latest.get()[0] if self.latest.exists() else np.iinfo(np.int64).min
        at = part["at_micros"].to_numpy(np.int64)
        before = np.maximum.accumulate(np.concatenate([[seen], at]))
        self.latest.update((int(before[-1]),))
        yield part.assign(is_early=at < before[:-1])

    def close(self) -> None:
        pass


def checked_bars(df: DataFrame, key: str = "series_id", ts: str = "timestamp", arrival: str = "arrival", late: str = "1 day") -> DataFrame:
    """The rows of a stream of bars with ``broken``, the names of the contract's rules that each breaks (empty: a good row).

    Repeats of (key, time) within the watermark are dropped by the engine before; order of arrival is held in keyed state. df:
    key, ts (timestamp), open, high, low, close, volume, arrival (a number that grows as rows arrive).
    """
    whole = df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, ts])
    whole = whole.withColumn("at_micros", F.coalesce(F.unix_micros(ts), F.lit(-(1 << 62))))
    schema = StructType([*whole.schema.fields, StructField("is_early", BooleanType())])
    marked = whole.groupBy(key).transformWithStateInPandas(ArrivalOrder(key, ts, arrival), schema, "append", "none")
    rules = bar_rules(marked.withColumnRenamed(ts, "timestamp"), early=F.col("is_early"), again=F.lit(False))
    named = F.array_compact(F.array(*(F.when(F.coalesce(r.bad, F.lit(False)), F.lit(r.says)) for r in rules)))
    return marked.withColumnRenamed(ts, "timestamp").withColumn("broken", named).withColumnRenamed("timestamp", ts).drop("at_micros", "is_early")


def quarantine(checked: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Write good rows to one table and, a row for each rule it breaks, bad ones to another. A trigger's folders bear its number and
    replace what an earlier try of the same trigger wrote: every row lands once, over restarts too."""
    shown = [c for c in checked.columns if c != "broken"]

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.where(F.size("broken") == 0).select(*shown).write.mode("overwrite").parquet(f"{good}/trigger={number}")
            batch.where(F.size("broken") > 0).select(*shown, F.explode("broken").alias("rule")).write.mode("overwrite").parquet(f"{bad}/trigger={number}")
        finally:
            batch.unpersist()

    return checked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
