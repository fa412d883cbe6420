"""Order flow: features, expanding correlation moments, and the eigenvalue filter against pure noise."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, ORDER, trailing, whole
from ..functions.prefix import running
from ..functions.scalars import imbalance

WINDOWS = (3, 5, 10)
FEATURES = ("volume_delta", "obi", *(f"{n}_ma{w}" for w in WINDOWS for n in ("volume_delta", "obi")))
#: Fixed values of the synthetic flow.
BASE_VOLUME, BASE_DEPTH, VOLUME_SENSITIVITY, DEPTH_SENSITIVITY, FLOW_SENSITIVITY, IMBALANCE_SENSITIVITY = 200_000.0, 500.0, 0.8, 0.6, 0.08, 3.0
LEAST_ROWS = 60


def features(df: DataFrame, keys: Sequence[str] = KEYS, fill: float | None = None) -> DataFrame:
    """volume_delta and obi of buy, sell, bid_depth, ask_depth, and their trailing means; fill: the obi of bars without any depth."""
    obi = imbalance(F.col("bid_depth"), F.col("ask_depth"))
    out = df.withColumn("volume_delta", F.col("buy") - F.col("sell")).withColumn("obi", obi if fill is None else F.coalesce(obi, F.lit(fill)))
    return out.withColumns({f"{n}_ma{w}": F.avg(n).over(trailing(w, keys)) for w in WINDOWS for n in ("volume_delta", "obi")})


def standardised(df: DataFrame, column: str, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Over the whole series, population deviation; a constant series gives zeros."""
    sd = F.stddev_pop(column).over(whole(keys))
    return df.withColumn(out, (F.col(column) - F.avg(column).over(whole(keys))) / F.when(sd > 0, sd).otherwise(1.0))


def synthetic_flow(df: DataFrame, causal: bool = False, keys: Sequence[str] = KEYS, returns: str = "log_return") -> DataFrame:
    """buy, sell, total, bid_depth, ask_depth from log returns and four noise columns: z_volume, z_buy, z_depth, z_tilt (standard normal)."""
    from .stats import expanding_scales

    r = F.col(returns)
    if causal:
        df = expanding_scales(df, returns, keys)
    else:
        df = df.withColumn("typical_abs", F.avg(F.abs(r)).over(whole(keys))).withColumn("scale", F.stddev_pop(r).over(whole(keys)))
    ratio = F.abs(r) / F.col("typical_abs")
    total = F.greatest(F.lit(1000.0), BASE_VOLUME * F.greatest(F.lit(0.3), 1 + VOLUME_SENSITIVITY * (ratio - 1)) * F.exp(0.25 * F.col("z_volume")))
    share = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + 0.4 * F.tanh(FLOW_SENSITIVITY * r / F.col("scale")) + 0.1 * F.col("z_buy")))
    depth = BASE_DEPTH * F.greatest(F.lit(0.15), 1 - DEPTH_SENSITIVITY * (ratio - 1)) * F.exp(0.2 * F.col("z_depth"))
    tilt = F.greatest(F.lit(-0.6), F.least(F.lit(0.6), 0.05 * F.tanh(IMBALANCE_SENSITIVITY * r / F.col("scale")) + 0.08 * F.col("z_tilt")))
    out = df.withColumn("total", total).withColumn("buy", F.col("total") * share).withColumn("sell", F.col("total") - F.col("buy"))
    return out.withColumn("bid_depth", F.greatest(F.lit(10.0), depth * (1 + tilt))).withColumn("ask_depth", F.greatest(F.lit(10.0), depth * (1 - tilt)))


def expanding_moments(df: DataFrame, columns: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS) -> DataFrame:
    """n, mean_<i>, cov_<i>_<j> of all rows so far, from running sums over blocks: each column less its first value against cancellation."""
    df = running(df, {f"__first{i}": ("first", F.col(c)) for i, c in enumerate(columns)}, keys, ORDER)
    x = {i: F.col(f"__x{i}") for i in range(len(columns))}
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    df = df.withColumns({f"__x{i}": F.col(c) - F.col(f"__first{i}") for i, c in enumerate(columns)}).drop(*(f"__first{i}" for i in x))
    sums = {"n": ("sum", F.lit(1).cast("bigint"))} | {f"__s{i}": ("sum", x[i]) for i in x}
    sums |= {f"__s{i}_{j}": ("sum", x[i] * x[j]) for i, j in pairs} | {f"__n{i}_{j}": ("sum", (x[i] * x[j]).isNotNull().cast("bigint")) for i, j in pairs}
    out = running(df, sums, keys, ORDER)
    some = lambda n: F.when(F.col(n) > 0, F.col(n))
    out = out.withColumns({f"mean_{i}": F.col(f"__s{i}") / some(f"__n{i}_{i}") for i in x})
    out = out.withColumns({f"cov_{i}_{j}": F.col(f"__s{i}_{j}") / some(f"__n{i}_{j}") - F.col(f"mean_{i}") * F.col(f"mean_{j}") for i, j in pairs})
    return out.drop(*(c for c in sums if c != "n"))


def top_vectors(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descending eigenvalues and the leading eigenvector, turned so that its entries do not sum below zero."""
    values, vectors = np.linalg.eigh(corr)
    top = vectors[..., -1]
    return values[..., ::-1], np.where(top.sum(axis=-1, keepdims=True) < 0, -top, top)


def causal_composite(df: DataFrame, columns: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS, least: int = LEAST_ROWS) -> DataFrame:
    """Each row standardised by, and projected on the leading eigenvector of, all rows up to it; null before enough rows.

    The running moments are window sums in the JVM; only the small matrices go to numpy, a batch at a time.
    """
    k = len(columns)
    pairs = list(combinations_with_replacement(range(k), 2))
    moments, kept = expanding_moments(df, columns, keys), list(df.columns)
    schema = moments.select(*df.columns).schema.add("composite", "double").add("top_eigenvalue", "double").add("n_signal", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cov = np.zeros((len(b), k, k))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = b[f"cov_{i}_{j}"]
            sd = np.sqrt(np.maximum(np.einsum("tii->ti", cov), 0))
            flat = sd <= 1e-12 * np.maximum(1, np.abs(b[[f"__x{i}" for i in range(k)]].to_numpy()))
            sd = np.where(flat, 1.0, sd)
            corr = cov / sd[:, :, None] / sd[:, None, :]
            corr[:, range(k), range(k)] = 1.0  # a constant column is uncorrelated with all others
            z = (b[[f"__x{i}" for i in range(k)]].to_numpy() - b[[f"mean_{i}" for i in range(k)]].to_numpy()) / sd
            ready = (b["n"].to_numpy() >= least) & np.isfinite(z).all(axis=1) & np.isfinite(corr).all(axis=(1, 2))
            out = b[kept].copy()
            composite, top, signal = np.full(len(b), np.nan), np.full(len(b), np.nan), np.zeros(len(b), int)
            if ready.any():
                values, vectors = top_vectors(corr[ready])
                composite[ready], top[ready] = (z[ready] * vectors).sum(axis=1), values[:, 0]
                n = b["n"].to_numpy()[ready]
                signal[ready] = np.maximum((values > ((1 + np.sqrt(k / n)) ** 2)[:, None]).sum(axis=1), 1)
            out["composite"], out["top_eigenvalue"] = composite, top
            out["n_signal"] = pd.array(np.where(ready, signal, 0), "Int32")
            yield out

    got = moments.mapInPandas(run, schema)
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("composite", "top_eigenvalue")})


def whole_composite(df: DataFrame, columns: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS) -> DataFrame:
    """The retrospective form: one correlation matrix of the whole series. Adds composite, eigenvalues, mp_upper, n_signal."""
    k, pairs = len(columns), list(combinations_with_replacement(range(len(columns)), 2))
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs))

    @F.pandas_udf("struct<values array<double>, vector array<double>, sd array<double>>")
    def solved(cov: pd.Series) -> pd.DataFrame:
        out = []
        for flat in cov:
            c = np.zeros((k, k))
            for (i, j), v in zip(pairs, flat):
                c[i, j] = c[j, i] = v
            sd = np.sqrt(np.maximum(np.diag(c), 0))
            sd = np.where(sd > 0, sd, 1.0)
            corr = c / sd[:, None] / sd
            np.fill_diagonal(corr, 1.0)
            values, vector = top_vectors(corr)
            out.append((values.tolist(), vector.tolist(), sd.tolist()))
        return pd.DataFrame(out, columns=["values", "vector", "sd"])

    model = sums.select(*keys, "n", F.array(*(F.col(f"m{i}") for i in range(k))).alias("mean"), solved(F.array(*(F.col(f"c{i}_{j}") for i, j in pairs))).alias("e"))
    bound = F.pow(1 + F.sqrt(F.lit(float(k)) / F.col("n")), 2)
    model = model.withColumn("mp_upper", bound).withColumn("n_signal", F.greatest(F.lit(1), F.size(F.filter("e.values", lambda v: v > F.col("mp_upper")))))
    z = sum(((F.col(c) - F.col("mean")[i]) / F.col("e.sd")[i] * F.col("e.vector")[i] for i, c in enumerate(columns)), F.lit(0.0))
    return df.join(model, list(keys)).withColumn("composite", z).withColumn("eigenvalues", F.col("e.values")).drop("e", "mean", "n")
