"""The registered queries of the library and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import models, options, relational, streams, timeseries

MODULES = (relational, timeseries, options, models, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.vote_label_m0(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
