"""Option chains: synthetic chains around a spot, exposures by strike and in total."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import BlackScholes

MULTIPLIER, RATE, DAYS = 20, 0.05, 30
#: Fixed values of the synthetic chain.
SPACING, EACH_SIDE, ATM_VOL, SLOPE, CURVATURE, LEAST_VOL, OI_WIDTH, BASE_OI = 50.0, 40, 0.15, -0.4, 0.35, 0.03, 0.05, 5000


def exposure(df: DataFrame, greek: str, spot: str = "spot", strike: str = "strike", years: str | Column = "years", vol: str = "iv", calls: str = "call_oi", puts: str = "put_oi", rate: float = RATE, multiplier: int = MULTIPLIER) -> DataFrame:
    """gex (greek 'gamma') or vex ('vanna') of every strike: the dealers' side of a one per cent move."""
    t = F.col(years) if isinstance(years, str) else years
    bs = BlackScholes(F.col(spot), F.col(strike), t, F.lit(rate), F.col(vol))
    name, value = {"gamma": ("gex", bs.gamma), "vanna": ("vex", bs.vanna)}[greek]
    return df.withColumn(name, (F.col(calls) - F.col(puts)) * value() * multiplier * F.col(spot) * F.col(spot) * 0.01)


def chain_noise(spark: SparkSession, seed: int = 42) -> DataFrame:
    """offset, z_iv, z_call, z_put: the same draws for every spot; 81 rows."""
    rng, n = np.random.default_rng(seed), 2 * EACH_SIDE + 1
    z = [rng.normal(size=n) for _ in range(3)]
    return spark.createDataFrame([(i - EACH_SIDE, *(float(x[i]) for x in z)) for i in range(n)], "offset int, z_iv double, z_call double, z_put double")


def synthetic_chain(spots: DataFrame, noise: DataFrame, spot: str = "spot") -> DataFrame:
    """The rows of spots with strike, iv, call_oi, put_oi of each positive strike around them."""
    df = spots.crossJoin(F.broadcast(noise)).withColumn("strike", F.col(spot) + F.col("offset") * SPACING).where("strike > 0")
    m = F.log(F.col("strike") / F.col(spot))
    shape = BASE_OI * F.exp(-0.5 * F.pow(m / OI_WIDTH, F.lit(2.0)))
    return df.withColumns({
        "iv": F.greatest(F.lit(LEAST_VOL), ATM_VOL + SLOPE * m + CURVATURE * m * m + 0.005 * F.col("z_iv")),
        "call_oi": F.greatest(F.lit(0.0), F.rint(shape * F.exp(0.3 * F.col("z_call")))),
        "put_oi": F.greatest(F.lit(0.0), F.rint(shape * F.exp(0.3 * F.col("z_put")))),
    }).drop("offset", "z_iv", "z_call", "z_put")


def dashboard(spots: DataFrame, noise: DataFrame, by: Sequence[str], spot: str = "spot", days: int = DAYS) -> DataFrame:
    """total_gex and total_vex of the synthetic chain around each spot."""
    chain = synthetic_chain(spots, noise, spot).withColumn("years", F.lit(days / 365.0))
    both = exposure(exposure(chain, "gamma", spot), "vanna", spot)
    return both.groupBy(*by).agg(F.sum("gex").alias("total_gex"), F.sum("vex").alias("total_vex"))


def contract_form(chain: DataFrame) -> DataFrame:
    """From the contract's names (as_of, expiry, *_open_interest, implied_vol) to the snapshot's, with years to expiry."""
    years = F.datediff("expiry", F.to_date("as_of")) / F.lit(365.0)
    return chain.select("as_of", "expiry", "strike", F.col("implied_vol").alias("iv"), F.col("call_open_interest").cast("double").alias("call_oi"), F.col("put_open_interest").cast("double").alias("put_oi"), years.alias("years"))
