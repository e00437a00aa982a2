"""Value at risk, limits, breakers and risk snapshots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions import kernels as K
from tickspark.functions.stretches import beside_few, over_rows, scan, stretches
from tickspark.functions.special import normal_pdf, normal_quantile
from tickspark.plans.catalog import nav, query, r

from .performance import _MARKED, _below_peak, _marked, curve_returns, historical_tail, nav_returns, portfolio_summary, safe

var_historical = historical_tail


def var_parametric(df: DataFrame, keys: list[str], c: float, col: str = "ret") -> DataFrame:
    """R2: normal VaR and ES as losses."""
    g = df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("sd"))
    return _normal(g, c)


def _normal(g: DataFrame, c: float) -> DataFrame:
    z = normal_quantile(F.lit(c))
    return g.withColumn("var", z * F.col("sd") - F.col("mean")).withColumn("es", F.col("sd") * normal_pdf(z) / (1 - c) - F.col("mean"))


def var_cornish_fisher(df: DataFrame, keys: list[str], c: float, col: str = "ret") -> DataFrame:
    """The quantile corrected for skew and kurtosis; under 4 returns or 1e-12 of deviation the normal one."""
    g = df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("sd"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurt"))
    g = _normal(g, c).withColumn("_z", -normal_quantile(F.lit(c)))
    z, s, k = F.col("_z"), F.col("skew"), F.col("kurt")
    zc = z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36
    return g.withColumn("var", F.when((F.col("n") >= 4) & (F.col("sd") > 1e-12), -(F.col("mean") + zc * F.col("sd"))).otherwise(F.col("var"))).drop("_z")


def var_garch(rets: DataFrame, keys: list[str], c: float) -> DataFrame:
    """Normal VaR with the deviation that a fitted GARCH forecasts for the next period."""
    from .models import garch_fit

    own = rets.join(rets.groupBy(*keys).agg(F.avg("ret").alias("mean")), keys)
    last = _garch_next(own, garch_fit(rets, keys), keys).groupBy(*keys).agg(F.max_by("_next", "ts_ns").alias("sd"), F.first("mean").alias("mean"))
    return _normal(last, c)


def _garch_next(rets: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """``_next``: the deviation that each key's GARCH forecasts after each return; null without a fit."""
    met = rets.join(fit.select(*keys, "omega", "alpha", "beta"), keys, "left")

    def step(state, p: pd.DataFrame):
        o, a, b = (p[x].iloc[0] for x in ("omega", "alpha", "beta"))
        if pd.isna(o):
            return state, {"_next": np.full(len(p), np.nan)}
        x = (p["ret"] - p["mean"]).to_numpy()
        state, s = K.garch_filter(state, x, o, a, b)
        return state, {"_next": np.sqrt(o + a * x * x + b * s)}

    return scan(met, keys, ["ts_ns"], step, "_next double").withColumn("_next", F.nanvl("_next", F.lit(None).cast("double"))).drop("omega", "alpha", "beta")


def scale_var(df: DataFrame, days: int, value: Column) -> DataFrame:
    """Over ``days``, and in money."""
    k = math.sqrt(days)
    return df.withColumn("var", F.col("var") * k).withColumn("es", F.col("es") * k).withColumn("var_money", F.col("var") * value).withColumn("es_money", F.col("es") * value)


def drawdown_track(nav: DataFrame, key: str = "curve_id", length: int | None = None) -> DataFrame:
    """Current and largest drawdown, peak, time under water and updates after each point."""
    cut = stretches(nav, key, ("ts_ns",), length)
    u = _below_peak(cut, cut.df)
    top = F.when(F.col("nav") >= F.col("peak"), F.col("ts_ns"))
    u = cut.done(cut.running(u, {"max_drawdown": ("max", F.col("drawdown")), "_top": ("last", top), "updates": ("count", F.lit(1))}))
    return u.withColumn("underwater_ns", F.col("ts_ns") - F.col("_top")).drop("_top")


#: Fixed default limits; the breaker's cooldown and the volatility ratio that trips it.
LIMITS = {"drawdown": 0.20, "daily_loss": 0.05, "leverage": 3.0, "var": 0.05, "concentration": 0.25}
COOLDOWN, VOL_SPIKE = 10_000_000_000, 5.0


def breaches(snapshots: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row per limit that a snapshot exceeds, with the value and the limit."""
    return snapshots.withColumn("_b", F.explode(_exceeded(snapshots, LIMITS | (limits or {})))).select(*snapshots.columns, "_b.*")


def _exceeded(snapshots: DataFrame, own: dict[str, float]) -> Column:
    tests = [F.when(F.col(k) > v, F.struct(F.lit(k).alias("limit"), F.col(k).cast("double").alias("current"), F.lit(float(v)).alias("allowed"))) for k, v in own.items() if k in snapshots.columns]
    return F.array_compact(F.array(*tests))


def pretrade_check(orders: DataFrame, positions: DataFrame, accounts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``problem`` of each order against its account's state; an order that only reduces risk passes.

    ``orders``: account, symbol, signed_quantity, price; ``positions``: account, symbol, position;
    ``accounts``: account, nav, gross, drawdown.
    """
    o = beside_few(orders, positions.select("account", "symbol", F.col("position").alias("_held")), ["account", "symbol"], "left")
    o = beside_few(o, accounts, ["account"], "left")
    held = F.coalesce("_held", F.lit(0.0))
    after = held + F.col("signed_quantity")
    reduces = (F.abs(after) < F.abs(held)) & (after * held >= 0)
    notional = F.abs(F.col("signed_quantity") * F.col("price"))
    problem = (
        F.when(reduces, None)
        .when(F.col("drawdown") > limits["drawdown"], "drawdown")
        .when(notional > limits["order_notional"], "order_notional")
        .when(F.abs(after * F.col("price")) > limits["concentration"] * F.col("nav"), "concentration")
        .when(F.col("gross") + notional > limits["leverage"] * F.col("nav"), "leverage")
    )
    return o.withColumn("problem", problem).drop("_held")


def circuit_states(snapshots: DataFrame, limit: float, cooldown_ns: int, key: str = "curve_id", also: Column | None = None, length: int | None = None) -> DataFrame:
    """Armed until the first trigger of an epoch, tripped for the cooldown, then recovering until a reset.

    ``reset`` (boolean) starts a new epoch. The drawdown triggers, and so does ``also``.
    """
    trigger = F.col("drawdown") > limit
    if also is not None:
        trigger = trigger | also
    cut = stretches(snapshots, key, ("ts_ns",), length)
    e = cut.running(cut.df, {"epoch": ("sum", F.when(F.col("reset"), 1).otherwise(0))})
    # An epoch trips at its first trigger: one row for each epoch that trips.
    trips = e.where(trigger & ~F.col("reset")).groupBy(F.col(key).alias("_key"), F.col("epoch").alias("_epoch")).agg(F.min("ts_ns").alias("_trip"))
    met = cut.done(e).join(trips, F.col(key).eqNullSafe(F.col("_key")) & (F.col("epoch") == F.col("_epoch")), "left")
    e = met.withColumn("tripped_at", F.when(F.col("_trip") <= F.col("ts_ns"), F.col("_trip"))).drop("_key", "_epoch", "_trip")
    return e.withColumn("circuit", F.when(F.col("tripped_at").isNull(), "armed").when(F.col("ts_ns") - F.col("tripped_at") < cooldown_ns, "tripped").otherwise("recovering"))


def correlation_status(df: DataFrame, threshold: float = 0.3, slow: int = 60, fast: int = 10, key: str = "pair", length: int | None = None) -> DataFrame:
    """sign_flip (signs differ and the fast one is above the threshold), broken, weakening or stable."""

    def step(name: str, period: int):
        def run(state, p: pd.DataFrame):
            state, mean, _ = K.ewma(state, p["corr"].to_numpy(), period)
            return state, {name: mean}

        return run

    d = df
    for name, period in (("slow", slow), ("fast", fast)):
        d = scan(d, [key], ["ts_ns"], step(name, period), f"{name} double", K.ewma_carry("corr", period), length)
    d = d.withColumn("drop", F.abs(F.col("slow") - F.col("fast")))
    flip = (F.col("slow") * F.col("fast") < 0) & (F.abs("fast") > threshold)
    return d.withColumn("status", F.when(flip, "sign_flip").when(F.col("drop") >= threshold, "broken").when(F.col("drop") >= threshold / 2, "weakening").otherwise("stable"))


SEVERITY = {"stable": 0, "weakening": 1, "broken": 2, "sign_flip": 3}


def worst_status(df: DataFrame) -> DataFrame:
    """The worst status over the pairs at each time."""
    rank = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return df.groupBy("ts_ns").agg(F.max_by("status", F.struct(rank[F.col("status")], "status")).alias("worst"))


def vol_regime(df: DataFrame, window: int = 20, base: int = 120, key: str = "curve_id", col: str = "ret", length: int | None = None) -> DataFrame:
    """Recent over baseline volatility: calm under 0.5, normal under 1.5, elevated under 3, else stressed."""

    def added(d: DataFrame, w) -> DataFrame:
        sd = lambda k: F.coalesce(F.stddev_samp(col).over(w.rowsBetween(-(k - 1), 0)), F.lit(0.0))
        return d.withColumns({"realized": sd(window), "baseline": sd(base)})

    d = over_rows(df, key, max(window, base), added, length=length)
    ratio = F.when(F.col("baseline") > 1e-12, F.try_divide("realized", "baseline")).otherwise(0.0)
    regime = F.when(F.col("baseline") <= 1e-12, "normal").when(ratio < 0.5, "calm").when(ratio < 1.5, "normal").when(ratio < 3.0, "elevated").otherwise("stressed")
    return d.withColumn("vol_ratio", ratio).withColumn("vol_regime", regime)


#: Fixed weights of the score's parts, and what a status adds.
WEIGHTS = {"var": 0.30, "drawdown": 0.25, "leverage": 0.15, "correlation": 0.15, "circuit": 0.15}
STATUS_SCORE = {"correlation": {"weakening": 0.33, "broken": 0.67, "sign_flip": 1.0}, "circuit": {"recovering": 0.5, "tripped": 1.0}}


def risk_score(df: DataFrame, limits: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted shares of the limits used and severities of the states, each between 0 and 1, and the level.

    ``df``: var, drawdown, leverage, correlation (worst status, null: stable) and circuit (null: armed).
    """
    own, parts = LIMITS | (limits or {}), weights or WEIGHTS

    def part(k: str) -> Column:
        if k in STATUS_SCORE:
            out = F.lit(0.0)
            for status, value in STATUS_SCORE[k].items():
                out = F.when(F.col(k) == status, value).otherwise(out)
            return out
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(k) / own[k])) if own[k] > 0 else F.lit(0.0)

    score = sum((F.lit(w) * part(k) for k, w in parts.items()), F.lit(0.0)) / (sum(parts.values()) or 1.0)
    return df.withColumn("score", score).withColumn("level", F.when(score < 0.25, "low").when(score < 0.5, "moderate").when(score < 0.75, "high").otherwise("critical"))


def exposures_at(curve: DataFrame, positions: DataFrame, key: str = "curve_id") -> DataFrame:
    """Gross, net, leverage, largest position and number of positions at each NAV update.

    ``positions``: key, symbol, ts_ns, value, one row per change of a holding: its signed value from then on.
    """
    from .joins import asof

    grid = curve.select(key, "ts_ns", "nav").join(positions.select(key, "symbol").distinct(), key)
    held = asof(grid, positions.select(key, "symbol", "ts_ns", "value"), [key, "symbol"], ["value"]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    size = F.abs("value")
    g = held.groupBy(key, "ts_ns").agg(F.first("nav").alias("_nav"), F.sum(size).alias("gross"), F.sum("value").alias("net"), F.max(size).alias("_largest"), F.count_if(size > 1e-12).alias("n_positions"))
    return g.withColumn("leverage", safe(F.col("gross"), F.col("_nav"))).withColumn("concentration", safe(F.col("_largest"), F.col("_nav"))).drop("_nav", "_largest")


def _garch_sd(rets: DataFrame, garch: DataFrame, key: str) -> DataFrame:
    """R4 per update: the deviation that the given GARCH (key, omega, alpha, beta) forecasts after each return."""
    return _garch_next(rets, garch, [key]).withColumn("sd", F.coalesce("_next", "sd")).drop("_next")


def risk_monitor(
    curve: DataFrame,
    positions: DataFrame,
    corrs: DataFrame,
    garch: DataFrame | None = None,
    limits: dict[str, float] | None = None,
    window: int = 250,
    c: float = 0.95,
    key: str = "curve_id",
    cooldown_ns: int = COOLDOWN,
    vol_spike: float = VOL_SPIKE,
    breakdown: float = 0.3,
    length: int | None = None,
) -> DataFrame:
    """Per NAV update VaR, drawdown, exposures, worst correlation status, breaker, breaches, score and readiness.

    ``positions`` as in ``exposures_at``; ``corrs``: pair, ts_ns, corr, the correlations told at an update (none: stable).
    VaR is the rolling normal one (R2), or with ``garch`` (key, omega, alpha, beta) that of its forecast (R4).
    The breaker trips on drawdown, daily loss, leverage or a volatility spike; a boolean ``reset`` of the curve arms it.
    """
    own = LIMITS | (limits or {})

    def rolled(d: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(-(window - 1), 0)
        return d.withColumns({"sd": F.coalesce(F.stddev_samp("ret").over(w), F.lit(0.0)), "mean": F.avg("ret").over(w), "n": F.count("*").over(w)})

    d = over_rows(vol_regime(nav_returns(curve, key=key, length=length), key=key, length=length), key, window, rolled, length=length)
    d = _normal(d if garch is None else _garch_sd(d, garch, key), c).join(drawdown_track(curve, key, length).select(key, "ts_ns", "drawdown", "max_drawdown", "underwater_ns"), [key, "ts_ns"])
    d = d.join(exposures_at(curve, positions, key), [key, "ts_ns"], "left").na.fill(0.0, ["gross", "net", "leverage", "concentration"]).na.fill(0, ["n_positions"])
    d = d.join(worst_status(correlation_status(corrs, breakdown)).withColumnRenamed("worst", "correlation"), "ts_ns", "left").withColumn("correlation", F.coalesce("correlation", F.lit("stable")))
    d = d.withColumn("daily_loss", F.greatest(-F.col("ret"), F.lit(0.0))).withColumn("ready", F.col("n") >= 30)
    if "reset" not in d.columns:
        d = d.withColumn("reset", F.lit(False))
    also = (F.col("daily_loss") > own["daily_loss"]) | (F.col("leverage") > own["leverage"]) | (F.col("vol_ratio") > vol_spike)
    d = circuit_states(d, own["drawdown"], cooldown_ns, key, also, length)
    return risk_score(d.withColumn("breaches", _exceeded(d, own)), limits)


def _rets(spark, sf):
    return curve_returns(spark, sf)


_R = "q AS (SELECT curve_id, ts_ns, nav, r AS ret FROM v_returns WHERE r IS NOT NULL)"
Z95, PDF95 = "1.6448536251337104::DOUBLE", "exp(-1.6448536251337104::DOUBLE * 1.6448536251337104::DOUBLE / 2) / sqrt(2 * pi())"


@query("r1_var_historical", f"WITH {_R}, s AS (SELECT curve_id, list_sort(list(ret)) AS v, count(*)::DOUBLE AS n FROM q GROUP BY 1) SELECT curve_id, R6(-v[(floor(n * (1 - 0.99::DOUBLE)) + 1)::INT]) AS var, R6(-list_avg(v[1:floor(n * (1 - 0.99::DOUBLE))::INT])) AS es FROM s", "v_returns")
def r1(spark, sf):
    return var_historical(_rets(spark, sf), ["curve_id"], 0.99).select("curve_id", r("var"), r("es"))


@query("r2_var_parametric", f"WITH {_R} SELECT curve_id, R6({Z95} * stddev_samp(ret) - avg(ret)) AS var, R6(stddev_samp(ret) * {PDF95} / 0.05 - avg(ret)) AS es FROM q GROUP BY 1", "v_returns")
def r2(spark, sf):
    return var_parametric(_rets(spark, sf), ["curve_id"], 0.95).select("curve_id", r("var"), r("es"))


@query(
    "r3_var_cornish_fisher",
    f"""WITH {_R}, m AS (SELECT curve_id, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM q GROUP BY 1), k AS (SELECT q.curve_id, any_value(m) AS m, any_value(sd) AS sd, avg(pow((ret - m) / sp, 3)) AS s, avg(pow((ret - m) / sp, 4)) - 3 AS k, -{Z95} AS z FROM q JOIN m ON m.curve_id = q.curve_id GROUP BY 1)
    SELECT curve_id, R6(-(m + (z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36) * sd)) AS var, R6(sd * {PDF95} / 0.05 - m) AS es FROM k""",
    "v_returns",
)
def r3(spark, sf):
    return var_cornish_fisher(_rets(spark, sf), ["curve_id"], 0.95).select("curve_id", r("var"), r("es"))


@query("r4_var_garch")
def r4(spark, sf):
    return var_garch(_rets(spark, sf), ["curve_id"], 0.95).select("curve_id", r("var"), r("es"))


@query("r5_scale_var", f"WITH {_R} SELECT curve_id, R6(sqrt(10) * ({Z95} * stddev_samp(ret) - avg(ret))) AS var, R2(1e6 * sqrt(10) * ({Z95} * stddev_samp(ret) - avg(ret))) AS var_money FROM q GROUP BY 1", "v_returns")
def r5(spark, sf):
    return scale_var(var_parametric(_rets(spark, sf), ["curve_id"], 0.95), 10, F.lit(1e6)).select("curve_id", r("var"), r("var_money", 2))


_DD = """d0 AS (SELECT *, max(nav) OVER (PARTITION BY curve_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS peak FROM v_nav), d1 AS (SELECT *, (peak - nav) / peak AS drawdown, CASE WHEN nav >= peak THEN ts_ns END AS top FROM d0),
    dt AS (SELECT *, max(drawdown) OVER w AS max_drawdown, ts_ns - last_value(top IGNORE NULLS) OVER w AS underwater_ns, count(*) OVER w AS updates FROM d1 WINDOW w AS (PARTITION BY curve_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING))"""


@query("r6_drawdown_track", f"WITH {_DD} SELECT curve_id, ts_ns, R6(drawdown) AS drawdown, R6(max_drawdown) AS max_drawdown, R2(peak) AS peak, underwater_ns, updates FROM dt", "v_nav")
def r6(spark, sf):
    return drawdown_track(nav(spark, sf)).select("curve_id", "ts_ns", r("drawdown"), r("max_drawdown"), r("peak", 2), "underwater_ns", "updates")


@query("r7_breaches", f"""WITH {_DD} SELECT curve_id, ts_ns, 'drawdown' AS "limit", R6(drawdown) AS current, 0.005::DOUBLE AS allowed FROM dt WHERE drawdown > 0.005 UNION ALL SELECT curve_id, ts_ns, 'daily_loss', R6(greatest(-r, 0)), 0.0002::DOUBLE FROM v_returns WHERE greatest(-r, 0) > 0.0002""", ("v_returns",))
def r7(spark, sf):
    d = drawdown_track(nav(spark, sf)).select("curve_id", "ts_ns", "drawdown").join(_rets(spark, sf).select("curve_id", "ts_ns", F.greatest(-F.col("ret"), F.lit(0.0)).alias("daily_loss")), ["curve_id", "ts_ns"], "left")
    return breaches(d, {"drawdown": 0.005, "daily_loss": 0.0002}).select("curve_id", "ts_ns", "limit", r("current"), "allowed")


@query(
    "r8_pretrade_check",
    f"""WITH {_MARKED}, a AS (SELECT account, 1e9 + sum(realized_pnl) + sum(unrealized_pnl) AS nav, sum(exposure) AS gross FROM m GROUP BY 1),
    o AS (SELECT f.account, f.symbol, f.signed_quantity AS q, f.price, k1, k2, k3, k4, f.ts_ns, coalesce(e.position, 0) AS held, nav, gross FROM v_fills f LEFT JOIN e ON e.account = f.account AND e.symbol = f.symbol JOIN a ON a.account = f.account)
    SELECT ts_ns, k1, k2, k3, k4, CASE WHEN abs(held + q) < abs(held) AND (held + q) * held >= 0 THEN NULL WHEN abs(q * price) > 90000 THEN 'order_notional' WHEN abs((held + q) * price) > 0.002::DOUBLE * nav THEN 'concentration' WHEN gross + abs(q * price) > 3 * nav THEN 'leverage' END AS problem FROM o""",
    "v_fills",
)
def r8(spark, sf):
    from tickspark.plans.catalog import FILL_ORDER, fills

    m = _marked(spark, sf)
    acc = portfolio_summary(m, 1e9).select("account", "nav", "gross", F.lit(0.0).alias("drawdown"))
    limits = {"drawdown": 0.2, "order_notional": 90000.0, "concentration": 0.002, "leverage": 3.0}
    return pretrade_check(fills(spark, sf), m.select("account", "symbol", "position"), acc, limits).select(*FILL_ORDER, "problem")


_CIRC = f"""{_DD}, s AS (SELECT curve_id, ts_ns, drawdown, updates % 400 = 0 AS reset FROM dt), e AS (SELECT *, sum(reset::INT) OVER (PARTITION BY curve_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS epoch FROM s),
    t AS (SELECT *, min(CASE WHEN drawdown > 0.005 AND NOT reset THEN ts_ns END) OVER (PARTITION BY curve_id, epoch ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS tr FROM e)"""


@query("r9_circuit_states", f"WITH {_CIRC} SELECT curve_id, ts_ns, CASE WHEN tr IS NULL THEN 'armed' WHEN ts_ns - tr < {30 * 86_400_000_000_000} THEN 'tripped' ELSE 'recovering' END AS circuit FROM t", "v_nav")
def r9(spark, sf):
    s = drawdown_track(nav(spark, sf)).withColumn("reset", F.col("updates") % 400 == 0)
    return circuit_states(s, 0.005, 30 * 86_400_000_000_000).select("curve_id", "ts_ns", "circuit")


def _corrs(spark, sf):
    from .pairs import _pairs
    from .windows import over_last, with_corr

    return over_last(_pairs(spark, sf), 20, lambda d, w: with_corr(d, "y", "x", w), "pair", ("ts_ns",)).select("pair", "ts_ns", "corr")


def _status_sql() -> str:
    from .pairs import _PAIRS

    return f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT *, coalesce(covar_samp(y, x) OVER w, 0) AS cov, sqrt(coalesce(var_samp(y) OVER w, 0) * coalesce(var_samp(x) OVER w, 0)) AS den FROM p WINDOW w AS (PARTITION BY pair ORDER BY ts_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
      c AS (SELECT pair, ts_ns, CASE WHEN den < 1e-12 THEN 0 ELSE greatest(-1, least(1, cov / den)) END AS corr, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM w),
      e(pair, ts_ns, i, s, f) AS (SELECT DISTINCT pair, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM c UNION ALL SELECT c.pair, c.ts_ns, c.i, 59.0::DOUBLE / 61 * e.s + 2.0::DOUBLE / 61 * corr, 9.0::DOUBLE / 11 * e.f + 2.0::DOUBLE / 11 * corr FROM e JOIN c ON c.pair = e.pair AND c.i = e.i + 1),
      m AS (SELECT pair, ts_ns, s / (1 - pow(59.0::DOUBLE / 61, i)) AS slow, f / (1 - pow(9.0::DOUBLE / 11, i)) AS fast FROM e WHERE i > 0)
      SELECT pair, ts_ns, R6(slow) AS slow, R6(fast) AS fast, CASE WHEN slow * fast < 0 AND abs(fast) > 0.2 THEN 'sign_flip' WHEN abs(slow - fast) >= 0.2 THEN 'broken' WHEN abs(slow - fast) >= 0.1 THEN 'weakening' ELSE 'stable' END AS status FROM m"""


@query("r10_correlation_status", _status_sql(), "v_series")
def r10(spark, sf):
    return correlation_status(_corrs(spark, sf), 0.2).select("pair", "ts_ns", r("slow"), r("fast"), "status")


@query("r11_worst_status", """WITH c AS (SELECT ts_ns, CASE WHEN volume > 5 THEN 'sign_flip' WHEN volume > 3 THEN 'broken' WHEN volume > 1 THEN 'weakening' ELSE 'stable' END AS status FROM v_series)
    SELECT ts_ns, arg_max(status, CASE status WHEN 'sign_flip' THEN 3 WHEN 'broken' THEN 2 WHEN 'weakening' THEN 1 ELSE 0 END) AS worst FROM c GROUP BY 1""", "v_series")
def r11(spark, sf):
    from tickspark.plans.catalog import series

    v = F.col("volume")
    return worst_status(series(spark, sf).withColumn("status", F.when(v > 5, "sign_flip").when(v > 3, "broken").when(v > 1, "weakening").otherwise("stable")))


_VR = f"""{_R}, v0 AS (SELECT *, coalesce(stddev_samp(ret) OVER (PARTITION BY curve_id ORDER BY ts_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS realized, coalesce(stddev_samp(ret) OVER (PARTITION BY curve_id ORDER BY ts_ns ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), 0) AS baseline FROM q),
    vr AS (SELECT *, CASE WHEN baseline <= 1e-12 THEN 0 ELSE realized / baseline END AS ratio FROM v0)"""


@query("r12_vol_regime", f"WITH {_VR} SELECT curve_id, ts_ns, R6(ratio) AS vol_ratio, CASE WHEN baseline <= 1e-12 THEN 'normal' WHEN ratio < 0.5 THEN 'calm' WHEN ratio < 1.5 THEN 'normal' WHEN ratio < 3 THEN 'elevated' ELSE 'stressed' END AS vol_regime FROM vr", "v_returns")
def r12(spark, sf):
    return vol_regime(_rets(spark, sf)).select("curve_id", "ts_ns", r("vol_ratio"), "vol_regime")


@query(
    "r13_risk_score",
    f"""WITH {_VR}, {_DD}, j AS (SELECT vr.curve_id, vr.ts_ns, ratio, drawdown FROM vr JOIN dt ON dt.curve_id = vr.curve_id AND dt.ts_ns = vr.ts_ns), s AS (SELECT *, 0.3 * 0.5 + 0.25 * least(1, greatest(0, drawdown / 0.02)) + 0.15 * (1 / 3.0::DOUBLE) + CASE WHEN ratio > 1.2 THEN 0.15 * 0.67 WHEN ratio > 1 THEN 0.15 * 0.33 ELSE 0 END + CASE WHEN drawdown > 0.01 THEN 0.15 WHEN drawdown > 0.005 THEN 0.075 ELSE 0 END AS score FROM j)
    SELECT curve_id, ts_ns, R6(score) AS score, CASE WHEN score < 0.25 THEN 'low' WHEN score < 0.5 THEN 'moderate' WHEN score < 0.75 THEN 'high' ELSE 'critical' END AS level FROM s""",
    ("v_returns",),
)
def r13(spark, sf):
    d = vol_regime(_rets(spark, sf)).join(drawdown_track(nav(spark, sf)).select("curve_id", "ts_ns", "drawdown"), ["curve_id", "ts_ns"])
    dd, ratio = F.col("drawdown"), F.col("vol_ratio")
    d = d.withColumns({"var": F.lit(0.025), "leverage": F.lit(1.0), "correlation": F.when(ratio > 1.2, "broken").when(ratio > 1, "weakening").otherwise("stable"), "circuit": F.when(dd > 0.01, "tripped").when(dd > 0.005, "recovering").otherwise("armed")})
    return risk_score(d, {"drawdown": 0.02}).select("curve_id", "ts_ns", r("score"), "level")


def _positions(spark, sf):
    """Each curve's holding of each symbol after each day with fills, at the day's mean price; in thousands, as the NAV."""
    from tickspark.plans.catalog import fills, table

    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k1"), F.col("o_orderpriority").alias("curve_id"))
    days = fills(spark, sf).join(owner, "k1").groupBy("curve_id", "symbol", "ts_ns").agg(F.sum("signed_quantity").alias("q"), F.avg("price").alias("price"))
    held = F.sum("q").over(Window.partitionBy("curve_id", "symbol").orderBy("ts_ns"))
    return days.select("curve_id", "symbol", "ts_ns", (held * F.col("price") / 1000).alias("value"))


@query("r14_risk_monitor")
def r14(spark, sf):
    m = risk_monitor(nav(spark, sf), _positions(spark, sf), _corrs(spark, sf))
    exceeded = F.array_join(F.transform("breaches", lambda b: b["limit"]), ",").alias("breaches")
    state = ["n_positions", "vol_regime", "correlation", "circuit"]
    return m.select("curve_id", "ts_ns", r("var"), r("es"), r("drawdown"), r("max_drawdown"), r("gross", 2), r("net", 2), r("leverage"), r("concentration"), *state, exceeded, r("score"), "level", "ready")
