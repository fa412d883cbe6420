"""File sources and sinks: daily bars, whitespace-delimited reports, the append-only trial log, text reports."""
from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DAILY = "date date, open double, high double, low double, close double, log_return double, regime string"
#: The trial log; whole numbers stay whole where a trial leaves them out.
LOG = (
    "trial_id string, group string, name string, regime_mode string, kernel_reading string, weights string, recal_window bigint, recal_every bigint, wss_mode string, hurst boolean, base_band double, "
    "cdar_limit double, cdar_alpha double, cdar_window bigint, cost_bps double, n_decisions bigint, split_index bigint, train_sharpe_pp double, train_sharpe_ann double, train_trades_per_week double, "
    "heldout_sharpe_pp double, heldout_sharpe_ann double, heldout_trades_per_week double, heldout_skew double, heldout_kurt_raw double, heldout_total_return double, max_drawdown double, reported boolean"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a declared schema, so nothing is scanned to infer one."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: write the daily bars there first")
    return spark.read.schema(DAILY).option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, columns: Sequence[str], skip: int = 2) -> DataFrame:
    """A table of doubles split at white space, after ``skip`` lines and its heading; row counts from 0. Reports are small files: a whole file is a line list of one row."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("line", "value"))
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.col("line") > skip) & (F.trim("value") != ""))
    return rows.select((F.col("line") - skip - 1).alias("row"), *(cells[i].cast("double").alias(c) for i, c in enumerate(columns)))


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, or an empty one of the same schema. Attempts that were not published (folders that begin with _) are no part of it."""
    if not exists(spark, path):
        return spark.createDataFrame([], LOG)
    try:
        return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def publish(spark: SparkSession, attempt: str, place: str) -> bool:
    """Rename a folder to a place where nothing is; False if something is there. One step of the file system: of two that try, one succeeds."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(attempt), jvm.org.apache.hadoop.fs.Path(place)
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # whose own rename would copy into a folder that exists
        try:
            os.rename(a.toUri().getPath(), b.toUri().getPath())
            return True
        except OSError:
            if os.path.isdir(b.toUri().getPath()):
                return False
            raise
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, how)
        return True
    except Py4JJavaError:
        if fs.exists(b):
            return False
        raise


def append_trials(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Append whole groups, each as a folder that is published in one step; a group that the log has already raises. Returns the log with the new rows.

    Of several new groups the earlier ones stay when a later one turns out to be taken.
    """
    empty = spark.createDataFrame([], LOG)
    whole = empty.unionByName(rows, allowMissingColumns=True).select(empty.columns).persist()
    try:
        groups = sorted((r["group"] for r in whole.select("group").distinct().collect()), key=str)  # names of trials' groups: a few
        wanted = reduce(or_, (F.col("group").eqNullSafe(g) for g in groups), F.lit(False))
        known = read_trial_log(spark, path).where(wanted).select("group").distinct().limit(5).collect()
        if known:
            raise RuntimeError(f"{path} has trials of {', '.join(str(r['group']) for r in known)} from before")
        for g in groups:
            attempt = f"{path}/_attempt-{uuid.uuid4().hex}"
            whole.where(F.col("group").eqNullSafe(g)).write.parquet(attempt)
            if not publish(spark, attempt, f"{path}/trials-{hashlib.sha256(repr(g).encode()).hexdigest()[:32]}"):
                delete(spark, attempt)
                raise RuntimeError(f"another writer brought {g} to {path} at the same time")
    finally:
        whole.unpersist()
    return read_trial_log(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def report_lines(df: DataFrame, columns: Sequence[str], order: Sequence[str], digits: int = 3, width: int = 14) -> DataFrame:
    """One text line a row, numbers half to even."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.bround(F.col(c), digits))) if kinds[c] == "double" else F.col(c).cast("string")
        return F.lpad(F.coalesce(text, F.lit("")), width, " ")

    return df.orderBy(*order).select(F.concat(*(cell(c) for c in columns)).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path)
