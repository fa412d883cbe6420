"""Queries on option chains."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import options
from . import views as V
from .registry import Queries, query, rounded
from .timeseries import sql_phi

QUERIES: Queries = {}
D = f"""{V.CHAIN}, dd AS (SELECT *, (ln(spot / strike) + (0.05::DOUBLE + iv * iv / 2) * years) / (iv * sqrt(years)) AS d1, (ln(spot / strike) + (0.05::DOUBLE + iv * iv / 2) * years) / (iv * sqrt(years)) - iv * sqrt(years) AS d2 FROM chain),
g AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM dd)"""


def model(df_spot: str = "spot") -> S.BlackScholes:
    return S.BlackScholes(F.col(df_spot), F.col("strike"), F.col("years"), F.lit(options.RATE), F.col("iv"))


@query(QUERIES, f"WITH {D} SELECT p_partkey, round(pdf / (spot * iv * sqrt(years)), 9) + 0 AS gamma, round(spot * pdf * sqrt(years), 5) + 0 AS vega, round(-pdf * d2 / iv, 6) + 0 AS vanna FROM g")
def bs_gamma_vega_vanna(spark, d) -> DataFrame:
    m = model()
    df = V.chain(spark, d).select("p_partkey", m.gamma().alias("gamma"), m.vega().alias("vega"), m.vanna().alias("vanna"))
    return rounded(rounded(rounded(df, 9, ["gamma"]), 5, ["vega"]), 6, ["vanna"])


@query(QUERIES, f"""WITH {D}, n AS (SELECT *, {sql_phi('d1')} AS n1, {sql_phi('d2')} AS n2, {sql_phi('(-d1)')} AS m1, {sql_phi('(-d2)')} AS m2, exp(-0.05::DOUBLE * years) AS df FROM g)
SELECT p_partkey, round(spot * n1 - strike * df * n2, 5) + 0 AS call_price, round(strike * df * m2 - spot * m1, 5) + 0 AS put_price, round(n1, 7) + 0 AS call_delta, round(-m1, 7) + 0 AS put_delta,
 round(-spot * pdf * iv / (2 * sqrt(years)) - 0.05::DOUBLE * strike * df * n2, 4) + 0 AS call_theta, round(-spot * pdf * iv / (2 * sqrt(years)) + 0.05::DOUBLE * strike * df * m2, 4) + 0 AS put_theta,
 round(strike * years * df * n2, 5) + 0 AS call_rho, round(-strike * years * df * m2, 5) + 0 AS put_rho FROM n""")
def bs_price_delta_theta_rho(spark, d) -> DataFrame:
    m = model()
    out = V.chain(spark, d).select("p_partkey", *(getattr(m, g)(k).alias(f"{k}_{g}") for g in ("price", "delta", "theta", "rho") for k in ("call", "put")))
    out = rounded(out, 7, ["call_delta", "put_delta"])
    out = rounded(out, 4, ["call_theta", "put_theta"])
    return rounded(out, 5, ["call_price", "put_price", "call_rho", "put_rho"])


GEX = "(call_oi - put_oi) * pdf / (spot * iv * sqrt(years)) * 20 * spot * spot * 0.01::DOUBLE"
VEX = "(call_oi - put_oi) * (-pdf * d2 / iv) * 20 * spot * spot * 0.01::DOUBLE"


@query(QUERIES, f"WITH {D} SELECT p_partkey, round({GEX}, 4) + 0 AS gex FROM g")
def gex_by_strike(spark, d) -> DataFrame:
    return rounded(options.exposure(V.chain(spark, d), "gamma").select("p_partkey", "gex"), 4)


@query(QUERIES, f"WITH {D} SELECT series_id, round(sum({GEX}), 2) + 0 AS total_gex, CASE WHEN sum({GEX}) >= 0 THEN 'dampening' ELSE 'amplifying' END AS volatility_regime FROM g GROUP BY series_id")
def gex_total(spark, d) -> DataFrame:
    df = options.exposure(V.chain(spark, d), "gamma").groupBy("series_id").agg(F.sum("gex").alias("total_gex"))
    return rounded(df.withColumn("volatility_regime", S.gex_regime(F.col("total_gex"))), 2)


@query(QUERIES, f"WITH {D} SELECT series_id, round(sum({VEX}) / 1e3, 3) + 0 AS total_vex FROM g GROUP BY series_id")
def vex_total(spark, d) -> DataFrame:
    df = options.exposure(V.chain(spark, d), "vanna").groupBy("series_id").agg((F.sum("vex") / 1e3).alias("total_vex"))
    return rounded(df, 3)


@query(QUERIES)
def dashboard_synthetic(spark, d) -> DataFrame:
    """Total exposures of the synthetic chain around every close of the whole series."""
    spots = V.series(spark, d, whole=True).select("series_id", "bar_idx", (F.col("close") / 100).alias("spot"))
    return rounded(options.dashboard(spots, options.chain_noise(spark), ["series_id", "bar_idx"]), 2)
