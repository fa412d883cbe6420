"""Queries on iterative and recursive models; SQL has no form of these, tests hold them against brute force."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, flow, online, regimes, reversion, stats
from ..sources import synthetic
from . import views as V
from . import walk_forward as wf
from .registry import Queries, query, rounded
from .timeseries import BY, OU, SIGNALS, level
from .timeseries import scored as scored_view

QUERIES: Queries = {}


def composite_sql(moments: str, final: str) -> str:
    """moments: common table expressions up to c (id, n, mean, cov as lists); final: the select over p (id, n, mean, sd, vector, top, n_signal).

    The leading eigenvector by squaring the correlation matrix again and again, how many eigenvalues pass the bound by the signs of
    the pivots of the matrix less the bound (Sylvester's law of inertia).
    """
    k = len(flow.FEATURES)
    at = lambda m, i, j: f"{m}[({i}) * {k} + ({j}) + 1]"
    return f"""WITH RECURSIVE {moments},
d AS (SELECT *, list_transform(range({k}), lambda i: CASE WHEN {at("cov", "i", "i")} > 0 THEN sqrt({at("cov", "i", "i")}) ELSE 1 END) AS sd FROM c),
r AS MATERIALIZED (SELECT *, list_transform(range({k * k}), lambda q: CASE WHEN q // {k} = q % {k} THEN 1.0::DOUBLE ELSE cov[q + 1] / sd[q // {k} + 1] / sd[q % {k} + 1] END) AS corr, (1 + sqrt({k}.0::DOUBLE / n)) ** 2 AS bound FROM d),
sq(id, step, m) AS (
  SELECT id, 0, corr FROM r
  UNION ALL SELECT id, step + 1, list_transform(m2, lambda x: x / list_max(list_transform(m2, lambda y: abs(y)))) FROM (
    SELECT id, step, list_transform(range({k * k}), lambda q: list_sum(list_transform(range({k}), lambda l: {at("m", f"q // {k}", "l")} * {at("m", "l", f"q % {k}")}))) AS m2 FROM sq WHERE step < 24)),
v0 AS (SELECT id, list_transform(range({k}), lambda i: {at("m", "i", f"list_position(list_transform(range({k}), lambda j: {at('m', 'j', 'j')}), list_max(list_transform(range({k}), lambda j: {at('m', 'j', 'j')}))) - 1")}) AS v FROM sq WHERE step = 24),
v1 AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * CASE WHEN list_sum(v) < 0 THEN -1 ELSE 1 END) AS vector FROM v0),
el(id, step, m, passed) AS (
  SELECT id, 0, list_transform(range({k * k}), lambda q: corr[q + 1] - CASE WHEN q // {k} = q % {k} THEN bound ELSE 0 END), 0 FROM r
  UNION ALL SELECT id, step + 1, list_transform(range({k * k}), lambda q: CASE WHEN q // {k} > step AND q % {k} > step THEN m[q + 1] - {at("m", f"q // {k}", "step")} * {at("m", "step", f"q % {k}")} / {at("m", "step", "step")} ELSE m[q + 1] END),
    passed + ({at("m", "step", "step")} > 0)::INT FROM el WHERE step < {k}),
p AS (SELECT r.id, n, mean, sd, bound, vector, greatest(1, passed)::INT AS n_signal, list_sum(list_transform(range({k * k}), lambda q: vector[q // {k} + 1] * corr[q + 1] * vector[q % {k} + 1])) AS top
  FROM r JOIN v1 USING (id) JOIN (SELECT id, passed FROM el WHERE step = {k}) e USING (id))
{final}"""


def _lists(over: str) -> str:
    f = flow.FEATURES
    return f"[{', '.join(f'avg({c}){over}' for c in f)}] AS mean, [{', '.join(f'covar_pop({a}, {b}){over}' for a in f for b in f)}] AS cov"


_PROJECTED = "list_sum(list_transform(range(8), lambda i: (x[i + 1] - mean[i + 1]) / sd[i + 1] * vector[i + 1]))"
_X = f"[{', '.join(flow.FEATURES)}] AS x"
COMPOSITE = composite_sql(
    f"{V.FLOW}, c AS (SELECT series_id AS id, count(*) AS n, {_lists('')} FROM features GROUP BY series_id)",
    f"SELECT series_id, ts, round({_PROJECTED}, 6) + 0 AS composite, round(bound, 6) + 0 AS mp_upper, n_signal FROM (SELECT series_id, ts, {_X} FROM features) f JOIN p ON p.id = f.series_id",
)
CAUSAL = composite_sql(
    f"{V.FLOW}, c AS (SELECT * FROM (SELECT bar_idx AS id, bar_idx + 1 AS n, {_lists(' OVER w')} FROM features WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)) WHERE n >= 60)",
    f"SELECT series_id, ts, round({_PROJECTED}, 6) + 0 AS composite, round(top, 6) + 0 AS top_eigenvalue, coalesce(n_signal, 0) AS n_signal FROM (SELECT series_id, ts, bar_idx, {_X} FROM features) f LEFT JOIN p ON p.id = f.bar_idx",
)


@query(QUERIES, COMPOSITE)
def mp_composite(spark, d) -> DataFrame:
    df = flow.whole_composite(V.flow_features(spark, d))
    return rounded(df.select("series_id", "ts", "composite", "mp_upper", "n_signal"), 6)


@query(QUERIES, CAUSAL)
def mp_composite_causal(spark, d) -> DataFrame:
    df = flow.causal_composite(V.flow_features(spark, d).select("series_id", "ts", "bar_idx", *flow.FEATURES))
    return rounded(df.select("series_id", "ts", "composite", "top_eigenvalue", "n_signal"), 6)


#: tr: the kernel curve of each trailing window (a row a place: weights of that place times the window's levels), its last slope over the deviation of its steps.
TREND = f"""wd AS (SELECT series_id, bar_idx, list(level) OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {reversion.TREND_WINDOW - 1} PRECEDING AND CURRENT ROW) AS ys FROM ou),
kn AS (SELECT n, p, list(exp(-0.5::DOUBLE * pow((p - q) / {reversion.TREND_BANDWIDTH}.0::DOUBLE, 2)) ORDER BY q) AS ws FROM range(1, {reversion.TREND_WINDOW + 1}) a(n), range({reversion.TREND_WINDOW}) b(p), range({reversion.TREND_WINDOW}) c(q) WHERE p < n AND q < n GROUP BY n, p),
cv AS (SELECT series_id, bar_idx, n, p, list_dot_product(ys, ws) / list_sum(ws) AS curve FROM wd JOIN kn ON kn.n = len(ys)),
st AS (SELECT *, curve - lag(curve) OVER (PARTITION BY series_id, bar_idx ORDER BY p) AS step FROM cv),
tr AS (SELECT series_id, bar_idx, CASE WHEN stddev_pop(step) > 0 THEN regr_slope(curve, p) FILTER (p >= n - {reversion.TREND_LOOKBACK}) / stddev_pop(step) ELSE 0 END AS trend FROM st GROUP BY ALL)"""


@query(QUERIES, f"""WITH {V.SERIES}, {OU}, {TREND} SELECT series_id, bar_idx, regime, round(CASE WHEN regime IN ('bull', 'bear') THEN tanh(trend / 2) WHEN regime = 'sideways' THEN
CASE WHEN half_life IS NULL OR resid_std = 0 THEN 0 ELSE tanh((mu - level) / (resid_std / sqrt(2 * theta)) / 2) END END, 6) + 0 AS subsignal FROM ou JOIN tr USING (series_id, bar_idx)""")
def ax_subsignal(spark, d) -> DataFrame:
    df = reversion.with_trend_slope(reversion.ou_fit(level(spark, d), "level", least=20), "level")
    return rounded(df.select("series_id", "bar_idx", "regime", reversion.subsignal(F.col("regime"), F.col("level")).alias("subsignal")), 6)


def whole(spark, d) -> DataFrame:
    """All orders as one series."""
    return V.series(spark, d, whole=True)


@query(QUERIES)
def hmm_fit(spark, d) -> DataFrame:
    df = regimes.fit(whole(spark, d))
    return df.select("series_id", "start", F.round("score", 3).alias("score"), *(F.transform(c, lambda x: F.round(x, 4)).alias(c) for c in ("mu", "var", "nu")))


@query(QUERIES)
def hmm_gaussian(spark, d) -> DataFrame:
    df = regimes.fit(whole(spark, d), starts=regimes.seeds_of(25), student=False)
    return df.select("series_id", "start", F.round("score", 3).alias("score"), *(F.transform(c, lambda x: F.round(x, 4)).alias(c) for c in ("mu", "var")))


@query(QUERIES)
def hmm_filter(spark, d) -> DataFrame:
    s = whole(spark, d)
    return regimes.decode(s, regimes.fit(s), "filter").select("series_id", "bar_idx", "regime")


@query(QUERIES)
def hmm_viterbi(spark, d) -> DataFrame:
    s = whole(spark, d)
    return regimes.decode(s, regimes.fit(s), "viterbi").select("series_id", "bar_idx", "regime")


#: Parameters of a model that decodes the orders' series: pi, a, mu, var, nu by state.
GIVEN = {"pi": [0.3, 0.4, 0.3], "a": [0.90, 0.05, 0.05, 0.10, 0.80, 0.10, 0.05, 0.15, 0.80], "mu": [-0.5, 0.0, 0.5], "var": [0.30, 0.15, 0.20], "nu": [4.0, 12.0, 6.0]}
#: What the labels of those states are: the highest mean is bull, the more volatile of the others bear.
GIVEN_LABELS = ["bear", "sideways", "bull"]


def given_model(spark, d) -> tuple[DataFrame, DataFrame]:
    s = V.series(spark, d)
    model = spark.createDataFrame([(0, 0, *GIVEN.values(), 0.0)], f"fold int, start int, {regimes.MODEL}")
    return s, s.select("series_id").distinct().join(F.broadcast(model))


def _emission(k: int) -> str:
    mu, var, nu = (GIVEN[c][k] for c in ("mu", "var", "nu"))
    return f"lgamma({(nu + 1) / 2}::DOUBLE) - lgamma({nu / 2}::DOUBLE) - 0.5::DOUBLE * ln({var * nu}::DOUBLE * pi()) - {(nu + 1) / 2}::DOUBLE * ln(1 + (x - {mu}::DOUBLE) ** 2 / {var * nu}::DOUBLE)"


DECODED = f"""{V.SERIES}, x AS (SELECT series_id, bar_idx, log_return AS x, row_number() OVER ({BY}) AS t FROM series WHERE log_return IS NOT NULL),
e AS MATERIALIZED (SELECT series_id, bar_idx, t, {", ".join(f"{_emission(k)} AS b{k}" for k in range(3))} FROM x)"""
_LABEL = f"({GIVEN_LABELS})[state + 1]"
_STATE = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
_A = [GIVEN["a"][3 * i : 3 * i + 3] for i in range(3)]
FILTERED = f"""WITH RECURSIVE {DECODED},
f(series_id, t, p0, p1, p2) AS (
  SELECT series_id, t, {", ".join(f"q{k} / (q0 + q1 + q2)" for k in range(3))} FROM (SELECT series_id, t, {", ".join(f"{GIVEN['pi'][k]}::DOUBLE * exp(b{k} - greatest(b0, b1, b2)) AS q{k}" for k in range(3))} FROM e WHERE t = 1)
  UNION ALL SELECT series_id, t, {", ".join(f"q{k} / (q0 + q1 + q2)" for k in range(3))} FROM (SELECT e.series_id, e.t, {", ".join("(" + " + ".join(f"p{i} * {_A[i][k]}::DOUBLE" for i in range(3)) + f") * exp(b{k} - greatest(b0, b1, b2)) AS q{k}" for k in range(3))}
    FROM f JOIN e ON e.series_id = f.series_id AND e.t = f.t + 1)),
s AS (SELECT e.series_id, e.bar_idx, {_STATE} AS state FROM f JOIN e ON e.series_id = f.series_id AND e.t = f.t)
SELECT series_id, bar_idx, state::INT AS state, {_LABEL} AS regime FROM s"""


@query(QUERIES, FILTERED)
def hmm_filter_given(spark, d) -> DataFrame:
    """Causal states of every series under a given model."""
    s, models = given_model(spark, d)
    return regimes.decode(s, models, "filter").select("series_id", "bar_idx", "state", "regime")


def _from(k: int) -> str:
    """Best way into state k: its score, and the state it comes from (the first of equals)."""
    ways = [f"v{i} + ln({_A[i][k]}::DOUBLE)" for i in range(3)]
    return f"greatest({', '.join(ways)}) AS w{k}, CASE WHEN {ways[0]} >= {ways[1]} AND {ways[0]} >= {ways[2]} THEN 0 WHEN {ways[1]} >= {ways[2]} THEN 1 ELSE 2 END AS c{k}"


BEST = f"""WITH RECURSIVE {DECODED},
f(series_id, t, v0, v1, v2, c0, c1, c2) AS (
  SELECT series_id, t, {", ".join(f"ln({GIVEN['pi'][k]}::DOUBLE) + b{k}" for k in range(3))}, 0, 0, 0 FROM e WHERE t = 1
  UNION ALL SELECT series_id, t, w0 + b0, w1 + b1, w2 + b2, c0, c1, c2 FROM (SELECT e.series_id, e.t, b0, b1, b2, {", ".join(_from(k) for k in range(3))} FROM (SELECT series_id, t, v0, v1, v2 FROM f) f JOIN e ON e.series_id = f.series_id AND e.t = f.t + 1)),
m AS MATERIALIZED (SELECT *, {_STATE.replace("p0", "v0").replace("p1", "v1").replace("p2", "v2")} AS ends, max(t) OVER (PARTITION BY series_id) AS n FROM f),
z(series_id, t, state) AS (
  SELECT series_id, t, ends FROM m WHERE t = n
  UNION ALL SELECT m.series_id, m.t - 1, CASE z.state WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END FROM z JOIN m ON m.series_id = z.series_id AND m.t = z.t WHERE m.t > 1)
SELECT z.series_id, e.bar_idx, state::INT AS state, {_LABEL} AS regime FROM z JOIN e ON e.series_id = z.series_id AND e.t = z.t"""


@query(QUERIES, BEST)
def hmm_viterbi_given(spark, d) -> DataFrame:
    """The likeliest path of every series under a given model."""
    s, models = given_model(spark, d)
    return regimes.decode(s, models, "viterbi").select("series_id", "bar_idx", "state", "regime")


@query(QUERIES)
def walk_forward_regimes(spark, d) -> DataFrame:
    return regimes.walk_forward_regimes(whole(spark, d)).select("series_id", "fold", "bar_idx", "regime")


def settings(spark) -> DataFrame:
    return backtest.settings_table(spark)


def path_sql(settings: str) -> str:
    """The sized path of every series under every row of settings (setting, band, cdar_limit), step by step."""
    return f"""WITH RECURSIVE {V.SERIES}, {SIGNALS}, n AS (SELECT *, (v_regime + v_flow + v_kernel) / 3 AS score, lead(log_return) OVER ({BY}) AS r FROM v),
a AS MATERIALIZED (SELECT series_id, bar_idx, score, r, ((sign(v_regime) = sign(score))::INT + (sign(v_flow) = sign(score))::INT + (sign(v_kernel) = sign(score))::INT) / 3.0::DOUBLE AS agreement, row_number() OVER ({BY}) AS t FROM n WHERE r IS NOT NULL),
st AS ({settings}),
w(series_id, setting, band, cdar_limit, t, equity, peak, dds, position, net_return, is_trade) AS (
 SELECT DISTINCT series_id, setting, band, cdar_limit, 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, [0.0::DOUBLE], 0.0::DOUBLE, 0.0::DOUBLE, false FROM a, st
 UNION ALL SELECT series_id, setting, band, cdar_limit, t, equity * (1 + net), greatest(peak, equity * (1 + net)),
  list_append(dds[(CASE WHEN len(dds) >= 252 THEN 2 ELSE 1 END):], (greatest(peak, equity * (1 + net)) - equity * (1 + net)) / greatest(peak, equity * (1 + net))), pos, net, sign(pos) <> sign(prev)
  FROM (SELECT *, pos * r - 0.0002::DOUBLE * abs(pos - prev) AS net FROM (
   SELECT w.series_id, w.setting, w.band, w.cdar_limit, a.t, w.equity, w.peak, w.dds, w.position AS prev, a.r,
    CASE WHEN abs(a.score) <= w.band THEN 0 ELSE sign(a.score) * (abs(a.score) - w.band) / (1 - w.band) * a.agreement
     * greatest(0, least(1, 1 - list_sum(list_reverse_sort(w.dds)[1:greatest(1, ceil(round(0.05::DOUBLE * len(w.dds), 9))::INT)]) / greatest(1, ceil(round(0.05::DOUBLE * len(w.dds), 9))::INT) / w.cdar_limit)) END AS pos
   FROM w JOIN a ON a.series_id = w.series_id AND a.t = w.t + 1)))"""


SIZED = path_sql("SELECT 0 AS setting, 0.1::DOUBLE AS band, 0.25::DOUBLE AS cdar_limit") + """
SELECT w.series_id, setting, a.bar_idx, round(position, 8) + 0 AS position, round(net_return, 8) + 0 AS net_return, is_trade, round(equity, 8) + 0 AS equity FROM w JOIN a ON a.series_id = w.series_id AND a.t = w.t"""


@query(QUERIES, SIZED)
def sized_backtest(spark, d) -> DataFrame:
    one = backtest.settings_table(spark, (0.1,), (0.25,))
    return rounded(backtest.sized_backtest(scored_view(spark, d), one), 8)


GRID = "SELECT (i * 7 + j)::INT AS setting, round(0.02::DOUBLE * i, 2) AS band, ([0.1::DOUBLE, 0.15, 0.2, 0.25, 0.3, 0.4, 1.0])[j + 1] AS cdar_limit FROM range(26) a(i), range(7) b(j)"
_PART = ", ".join(
    f"CASE WHEN stddev_samp(net_return) FILTER ({w}) > 0 THEN avg(net_return) FILTER ({w}) / stddev_samp(net_return) FILTER ({w}) * sqrt(252) ELSE 0 END AS {h}_sharpe_ann, (count(*) FILTER ({w} AND is_trade))::DOUBLE / count(*) FILTER ({w}) * 5 AS {h}_trades_per_week"
    for h, w in (("train", "t <= cut"), ("heldout", "t > cut"))
)
SWEEP = path_sql(GRID) + f""", k AS (SELECT series_id, round_even(count(*) * 0.6::DOUBLE, 0) AS cut FROM a GROUP BY series_id),
m AS (SELECT w.series_id, setting, any_value(band) AS band, any_value(cdar_limit) AS cdar_limit, {_PART} FROM w JOIN k ON k.series_id = w.series_id WHERE t > 0 GROUP BY w.series_id, setting)"""
_ROUNDED = "series_id, setting, round(band, 6) + 0 AS band, round(cdar_limit, 6) + 0 AS cdar_limit, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("train_sharpe_ann", "train_trades_per_week", "heldout_sharpe_ann", "heldout_trades_per_week"))


@query(QUERIES, f"{SWEEP} SELECT {_ROUNDED} FROM m")
def sizing_sweep(spark, d) -> DataFrame:
    return rounded(backtest.sweep(scored_view(spark, d), settings(spark)), 6)


@query(QUERIES, f"{SWEEP} SELECT {_ROUNDED} FROM m WHERE train_trades_per_week BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY train_sharpe_ann DESC, setting) = 1")
def select_setting(spark, d) -> DataFrame:
    return rounded(backtest.select_setting(backtest.sweep(scored_view(spark, d), settings(spark))), 6)


def gate_sql(g: str, told: str = "", alpha: float = 0.1) -> str:
    """g: common table expressions up to g (series_id, bar_idx, s, r, t) and sc (series_id, scale)."""
    return f"""WITH RECURSIVE {g},
e0 AS (SELECT g.*, scale, abs(r - scale * s) AS err FROM g JOIN sc USING (series_id)), e AS MATERIALIZED (SELECT *, avg(err) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM e0),
w AS (SELECT series_id, t, CASE WHEN err > 0 THEN err ELSE 1e-6::DOUBLE END AS width FROM e WHERE t = 1
 UNION ALL SELECT e.series_id, e.t, greatest(w.width + 0.05::DOUBLE * greatest(e.m, 1e-12::DOUBLE) * ((e.err > w.width)::INT - {alpha}::DOUBLE), 1e-12::DOUBLE) FROM w JOIN e ON e.series_id = w.series_id AND e.t = w.t + 1),
i AS (SELECT e.*, CASE WHEN e.t > 60 THEN w.width END AS width FROM e LEFT JOIN w ON w.series_id = e.series_id AND w.t = e.t - 1)
SELECT series_id, bar_idx, CASE WHEN scale * s - width > 0 THEN 'long' WHEN scale * s + width < 0 THEN 'short' ELSE 'abstain' END AS action, round(scale * s - width, 8) + 0 AS lower, round(scale * s + width, 8) + 0 AS upper,
 width IS NULL OR (r >= scale * s - width AND r <= scale * s + width) AS covered{told} FROM i"""


GATED = f"""{V.SERIES}, {SIGNALS}, n AS (SELECT series_id, bar_idx, (v_regime + v_flow + v_kernel) / 3 AS s, lead(log_return) OVER ({BY}) AS r FROM v),
g AS (SELECT *, row_number() OVER ({BY}) AS t FROM n WHERE r IS NOT NULL), sc AS (SELECT series_id, sum(s * r) / sum(s * s) AS scale FROM g WHERE t <= 60 GROUP BY series_id)"""
GATE = gate_sql(GATED, ", round(scale, 8) + 0 AS scale")


@query(QUERIES, GATE)
def conformal_gate(spark, d) -> DataFrame:
    df = online.conformal_gate(scored_view(spark, d), "score", "next_return")
    infinite = F.abs("lower") == float("inf")
    return rounded(df.withColumns({c: F.when(~infinite, F.col(c)) for c in ("upper", "lower")}), 8)


def experiment_sql(alpha: float) -> str:
    """Positions of the gate at a level, costed, and both Sharpe ratios behind the warm-up."""
    ratio = lambda x: f"CASE WHEN coalesce(stddev_samp({x}), 0) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt(252) ELSE 0 END"
    return f"""SELECT series_id, round(avg(covered::INT), 6) + 0 AS coverage, round(avg((action = 'abstain')::INT), 6) + 0 AS abstain_rate, round({ratio("net")}, 6) + 0 AS sharpe, round({ratio("sign(s) * r")}, 6) + 0 AS sharpe_ungated, {alpha}::DOUBLE AS alpha
FROM (SELECT *, position * r - 0.0002::DOUBLE * abs(position - coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY bar_idx), 0)) AS net
  FROM (SELECT q.*, g.s, g.r, CASE action WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END AS position FROM ({gate_sql(GATED, alpha=alpha)}) q JOIN (WITH {GATED} SELECT series_id, bar_idx, s, r FROM g) g USING (series_id, bar_idx)))
WHERE lower IS NOT NULL GROUP BY series_id"""


@query(QUERIES, " UNION ALL ".join(f"SELECT * FROM ({experiment_sql(a)})" for a in (0.10, 0.25)))
def conformal_experiment(spark, d) -> DataFrame:
    """Coverage, abstention and Sharpe ratio of gated positions at two levels, next to the ungated score's sign."""
    s = scored_view(spark, d)
    out = None
    for alpha in (0.10, 0.25):
        gate = online.conformal_gate(s, "score", "next_return", alpha).join(s.select("series_id", "bar_idx", "next_return", "score"), ["series_id", "bar_idx"])
        gate = gate.withColumn("position", F.when(F.col("action") == "long", 1.0).when(F.col("action") == "short", -1.0).otherwise(0.0))
        post = backtest.fixed_backtest(gate, "position", "next_return").where("abs(lower) <> double('infinity')")
        m = post.groupBy("series_id").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg((F.col("action") == "abstain").cast("double")).alias("abstain_rate"), stats.sharpe(F.col("net_return"), 252).alias("sharpe"), stats.sharpe(S.sign(F.col("score")) * F.col("next_return"), 252).alias("sharpe_ungated"))
        m = m.withColumn("alpha", F.lit(alpha))
        out = m if out is None else out.unionByName(m)
    return rounded(out, 6)


def bocpd_sql(x: str, confidence: bool) -> str:
    """x: common table expressions up to x (series_id, bar_idx, x, t)."""
    more = ", round(greatest(0, least(1, map_run / 30.0::DOUBLE)), 6) + 0 AS confidence" if confidence else ""
    return f"""WITH RECURSIVE {x},
w(series_id, t, lp, mu, be) AS (SELECT DISTINCT series_id, 0::BIGINT, [0.0::DOUBLE], [0.0::DOUBLE], [1.0::DOUBLE] FROM x
 UNION ALL SELECT series_id, t, list_transform(lp, lambda v: v - rest), mu[1:500], be[1:500] FROM (SELECT *, CASE WHEN cut THEN top2 + ln(list_sum(list_transform(lp, lambda u: exp(u - top2)))) ELSE 0 END AS rest
 FROM (SELECT series_id, t, mu, be, lp0[1:500] AS lp, len(lp0) > 500 AS cut, list_max(lp0[1:500]) AS top2
 FROM (SELECT series_id, t, list_concat([ln(0.01::DOUBLE)], list_transform(joint, lambda j: j + ln(1 - 0.01::DOUBLE) - total)) AS lp0,
   list_concat([0.0::DOUBLE], list_transform(mu, lambda m, i: m + (x - m) / (i + 1))) AS mu, list_concat([1.0::DOUBLE], list_transform(list_zip(be, mu), lambda z, i: z[1] + i * (x - z[2]) ** 2 / (2.0 * (i + 1)))) AS be
  FROM (SELECT *, top + ln(list_sum(list_transform(joint, lambda j: exp(j - top)))) AS total FROM (SELECT *, list_max(joint) AS top
   FROM (SELECT w.series_id, x.t, x.x, w.mu, w.be, list_transform(list_zip(w.lp, w.mu, w.be), lambda z, i: z[1] + lgamma((i + 1) / 2.0::DOUBLE + 0.5) - lgamma((i + 1) / 2.0::DOUBLE)
     - 0.5 * ln((i + 1) * pi() * z[3] * (i + 1) / ((i + 1) / 2.0::DOUBLE * i)) - ((i + 1) / 2.0::DOUBLE + 0.5) * ln(1 + (x.x - z[2]) ** 2 / ((i + 1) * z[3] * (i + 1) / ((i + 1) / 2.0::DOUBLE * i)))) AS joint
    FROM w JOIN x ON x.series_id = w.series_id AND x.t = w.t + 1))))))),
o AS (SELECT series_id, t, list_sum(list_transform(lp[1:6], lambda v: exp(v))) AS change_prob, list_sum(list_transform(lp, lambda v, i: (i - 1) * exp(v))) AS expected_run, (list_position(lp, list_max(lp)) - 1)::INT AS map_run FROM w WHERE t > 0)
SELECT o.series_id, x.bar_idx, round(change_prob, 6) + 0 AS change_prob, round(expected_run, 6) + 0 AS expected_run, map_run{more} FROM o JOIN x ON x.series_id = o.series_id AND x.t = o.t"""


BOCPD = bocpd_sql(f"{V.SERIES}, x AS MATERIALIZED (SELECT series_id, bar_idx, log_return AS x, row_number() OVER ({BY}) AS t FROM series WHERE log_return IS NOT NULL)", True)


@query(QUERIES, BOCPD)
def bocpd(spark, d) -> DataFrame:
    z = F.col("log_return")
    df = online.changepoints(V.series(spark, d).withColumn("z", z), "z").withColumn("confidence", S.run_confidence(F.col("map_run")))
    return rounded(df, 6)


@query(QUERIES)
def run_config_metrics(spark, d) -> DataFrame:
    """The trial log's rows of the default configurations over all orders as one series."""
    signals = series_signals(spark, d).persist()
    configs = wf.default_configs()
    return rounded(wf.trial_rows(wf.run_configs(signals, configs), configs, "walk_forward_v1"), 6)


def series_signals(spark, d) -> DataFrame:
    """Signals of all orders as one series, with the operators' own splits, starts and bandwidths; the flow is that of lineitem by ship date."""
    from ..operators import options

    df = whole(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")).persist()
    days = V.flow_days(spark, d).select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "buy", "sell", "bid_depth", "ask_depth")
    # A day without a line has no flow and no tilt.
    met = df.select("series_id", "bar_idx", "ts").join(days, ["series_id", "ts"], "left").na.fill(0.0, ["buy", "sell", "bid_depth", "ask_depth"])
    panel = flow.features(met, fill=0.0).select("series_id", "bar_idx", *flow.FEATURES)
    return wf.build_signals(df, V.macro(spark, d), panel, options.chain_noise(spark))


@query(QUERIES)
def regime_edge_permutation(spark, d) -> DataFrame:
    return rounded(wf.regime_edge(whole(spark, d)), 6)


@query(QUERIES)
def synthetic_intraday(spark, d) -> DataFrame:
    """Fifteen-minute bars of the synthetic intraday market."""
    from ..operators.bars import resample_bars

    source = synthetic.SyntheticIntradaySource(spark)
    return resample_bars(source._bars, "15 minutes", "timestamp", ("volume", "bid_volume", "ask_volume"), ())
