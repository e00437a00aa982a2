"""Rolling, expanding and recursive windows."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickspark.functions import kernels as K
from tickspark.functions.filtering import level_carry
from tickspark.functions.ranks import cold_rows, hot_keys, values_at
from tickspark.functions.stretches import NEVER, scan, stretches
from tickspark.plans.catalog import HOUR, query, r, series, ticks

from .quality import sliding_median

ORDER = ("ts_ns", "seq")


def rows(k: int | None = None, key: str = "symbol", order: tuple[str, ...] = ("ts_ns", "seq")) -> WindowSpec:
    """The last ``k`` rows of a key, the current one included; all so far without ``k``."""
    return Window.partitionBy(key).orderBy(*order).rowsBetween(-(k - 1) if k else Window.unboundedPreceding, 0)


def rolling_mean(col: str, w: WindowSpec) -> Column:
    return F.avg(col).over(w)


def rolling_var(col: str | Column, w: WindowSpec) -> Column:
    """Sample variance, 0 for less than two values."""
    return F.coalesce(F.greatest(F.var_samp(col).over(w), F.lit(0.0)), F.lit(0.0))


def rolling_std(col: str | Column, w: WindowSpec) -> Column:
    return F.sqrt(rolling_var(col, w))


def rolling_cov(a: str, b: str, w: WindowSpec) -> Column:
    return F.coalesce(F.covar_samp(a, b).over(w), F.lit(0.0))


def over_last(df: DataFrame, k: int, f: Callable[[DataFrame, WindowSpec], DataFrame], key: str = "symbol", order: tuple[str, ...] = ORDER, length: int | None = None) -> DataFrame:
    """``f(rows, window)`` with the window of the ``k`` last rows of a key; keys of any length (see ``stretches``)."""
    cut = stretches(df, key, order, length, least=k)
    return cut.done(cut.bounded(cut.df, k, lambda d, keys: f(d, Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0))))


def with_corr(df: DataFrame, a: str, b: str, w: WindowSpec, name: str = "corr") -> DataFrame:
    """From covariance and variances, each taken once; a denominator under 1e-12 gives 0."""
    parts = df.withColumns({"_cab": rolling_cov(a, b, w), "_va": rolling_var(a, w), "_vb": rolling_var(b, w)})
    den = F.sqrt(F.col("_va") * F.col("_vb"))
    corr = F.when(den < 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("_cab", den))))
    return parts.withColumn(name, corr).drop("_cab", "_va", "_vb")


def rolling_median_mad(df: DataFrame, col: str, k: int, key: str = "symbol", order: tuple[str, ...] = ORDER, length: int | None = None) -> DataFrame:
    """Median and the median distance from it (0 for less than two values)."""
    return sliding_median(df, col, k, key, order, length)


def log_return(col: str, w: WindowSpec) -> Column:
    """Log return against the row before; null next to a price that is not positive."""
    before = F.lag(col).over(w)
    return F.when((F.col(col) > 0) & (before > 0), F.ln(F.col(col) / before))


def realized_vol(df: DataFrame, k: int, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Rolling deviation of log returns."""
    cut = stretches(df, key, ORDER, length, least=k + 1)

    def made(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ORDER)
        return d.withColumn("ret", log_return("price", w)).withColumn("realized_vol", rolling_std("ret", w.rowsBetween(-(k - 1), 0)))

    return cut.done(cut.bounded(cut.df, k + 1, made))


def running_drawdown(df: DataFrame, col: str, key: str = "symbol", order: tuple[str, ...] = ORDER, length: int | None = None) -> DataFrame:
    """``drawdown``, the share lost from the highest value so far."""
    cut = stretches(df, key, order, length)
    top = F.col("_top")
    down = F.when(top > 0, F.greatest(F.lit(0.0), (top - F.col(col)) / top)).otherwise(0.0)
    return cut.done(cut.running(cut.df, {"_top": ("max", F.col(col))}).withColumn("drawdown", down).drop("_top"))


def return_runs(df: DataFrame, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Sign of the return and the length of its run; flat returns (1e-9) end a run and have length 0."""
    cut = stretches(df, key, ORDER, length, least=3)

    def signed(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ORDER)
        sign = F.when(F.col("ret") > 1e-9, 1).when(F.col("ret") < -1e-9, -1).otherwise(0)
        d = d.withColumn("ret", F.coalesce(log_return("price", w), F.lit(0.0))).withColumn("run_sign", sign)
        return d.withColumn("_new", F.coalesce(F.lag("run_sign").over(w) != F.col("run_sign"), F.lit(True)))

    numbered = cut.running(cut.bounded(cut.df, 3, signed), {"_i": ("count", F.lit(1))})
    begun = cut.running(numbered, {"_at": ("last", F.when(F.col("_new"), F.col("_i")))})
    return cut.done(begun.withColumn("run_length", F.when(F.col("run_sign") == 0, 0).otherwise(F.col("_i") - F.col("_at") + 1).cast("int")).drop("_new", "_i", "_at"))


def market_view(df: DataFrame, k: int = 64, least: int = 8, length: int | None = None) -> DataFrame:
    """Last quote, sigma of the last log returns, running VWAP and average daily volume (null under an hour)."""
    cut = stretches(df, "symbol", ORDER, length, least=k + 1)

    def sigma(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ORDER)
        last = w.rowsBetween(-(k - 1), 0)
        d = d.withColumn("ret", log_return("price", w))
        return d.withColumn("sigma", F.when(F.count("ret").over(last) >= least, F.stddev_samp("ret").over(last)))

    specs = {"last_bid": ("last", F.col("bid")), "last_ask": ("last", F.col("ask")), "_pv": ("sum", F.col("price") * F.col("size")), "_v": ("sum", F.col("size")), "_t0": ("min", F.col("ts_ns"))}
    out = cut.running(cut.bounded(cut.df, k + 1, sigma), specs)
    span = F.col("ts_ns") - F.col("_t0")
    out = out.withColumn("vwap", F.try_divide("_pv", "_v")).withColumn("adv", F.when(span >= HOUR, F.col("_v") / (span / (24 * HOUR))))
    return cut.done(out.drop("_pv", "_v", "_t0"))


def streaming_stats(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Count, mean, variance, minimum and maximum."""
    return df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.coalesce(F.var_samp(col), F.lit(0.0)).alias("var"), F.min(col).alias("min"), F.max(col).alias("max"))


def tracked_percentile(df: DataFrame, col: str, p: float, keys: list[str], length: int | None = None) -> DataFrame:
    """The value at index floor(p * (n - 1)) of the sorted values, from counts per value; of keys with more than
    ``length`` values by histograms."""
    hot = hot_keys(df, keys, col, length)
    if hot is not None:
        long = values_at(df, keys, col, hot, {"percentile": F.floor(F.lit(p) * (F.col("_n") - 1))}).drop("_n")
        return tracked_percentile(cold_rows(df, keys, hot), col, p, keys, NEVER).unionByName(long)
    counts = df.groupBy(*keys, col).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(col)
    ranked = counts.withColumn("_up", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = F.floor(F.lit(p) * (F.col("_n") - 1))
    return ranked.where(F.col("_up") > at).groupBy(*keys).agg(F.min(col).alias("percentile"))


def classify_regime(df: DataFrame, drawdown: float = 0.05, band: float = 1.8, run: int = 50) -> DataFrame:
    """Crisis, volatile, trending or calm, from vol, median_vol, drawdown and the return run."""
    regime = F.when(F.col("drawdown") >= drawdown, "crisis").when((F.col("median_vol") > 0) & (F.col("vol") / F.col("median_vol") > band), "volatile").when(F.col("run_length") >= run, "trending").otherwise("calm")
    return df.withColumn("regime", regime).withColumn("direction", F.when(F.col("regime") == "trending", F.col("run_sign"))).withColumn("strength", F.when(F.col("regime") == "trending", F.col("run_length") / 100))


def regime_states(df: DataFrame, key: str = "symbol") -> DataFrame:
    """``state`` after hysteresis over the observed ``regime``; the machine counts time, so a key is one task."""
    code = {n: i for i, n in enumerate(K.REGIMES)}

    def step(state, p: pd.DataFrame):
        state, out = K.regime_states(state, p["regime"].map(code).to_numpy(), p["ts_ns"].to_numpy())
        return state, {"state": np.array(K.REGIMES, object)[out]}

    return scan(df, [key], list(ORDER), step, "state string")


def ewma(df: DataFrame, col: str, period: int, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Ewma and whether its weight has reached 0.95."""

    def step(state, p: pd.DataFrame):
        state, mean, weight = K.ewma(state, p[col].to_numpy(), period)
        return state, {"ewma": mean, "ready": weight >= 0.95}

    return scan(df, [key], list(ORDER), step, "ewma double, ready boolean", K.ewma_carry(col, period), length)


def ewma_var(df: DataFrame, col: str, period: int, key: str = "symbol", seed: str = "zero", length: int | None = None) -> DataFrame:
    """``ewma_var``, and ``ewma_before``, the mean before each value.

    Two recurrences that compose: the means, then the squared distances from the mean before.
    """
    first = lambda x: 0.0 if seed == "zero" else float(x[0])

    def means(state, p: pd.DataFrame):
        x = p[col].to_numpy()
        s, n = state or (0.0, 0)
        before = s / (1 - (1 - 2 / (period + 1)) ** n) if n else first(x)
        state, mean, _ = K.ewma(state, x, period)
        return state, {"ewma_before": np.concatenate(([before], mean[:-1]))}

    def squares(state, p: pd.DataFrame):
        state, var, _ = K.ewma(state, p["_sq"].to_numpy(), period)
        return state, {"ewma_var": var}

    one = scan(df, [key], list(ORDER), means, "ewma_before double", K.ewma_carry(col, period), length)
    two = one.withColumn("_sq", F.pow(F.col(col) - F.col("ewma_before"), F.lit(2.0)))
    return scan(two, [key], list(ORDER), squares, "ewma_var double", K.ewma_carry("_sq", period), length).drop("_sq")


def ema(df: DataFrame, col: str, period: int, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Plain EMA seeded with the first value."""

    def step(state, p: pd.DataFrame):
        state, out = K.ema(state, p[col].to_numpy(), period)
        return state, {"ema": out}

    return scan(df, [key], list(ORDER), step, "ema double", K.ema_carry(col, period), length)


def kalman_smoothed(df: DataFrame, col: str, name: str, keys: list[str], order: tuple[str, ...], snr: float, warmup: int, length: int | None = None) -> DataFrame:
    """The local-level filter over a column; long keys compose by stretches, which number their values first."""

    def step(state, p: pd.DataFrame):
        state, out = K.kalman_level(state, p[col].to_numpy(), snr, warmup)
        return state, {name: out}

    cut = stretches(df, keys, order, length)
    if cut.hot is None:
        return scan(df, keys, list(order), step, f"{name} double")
    finite = F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) < float("inf"))
    rows = cut.done(cut.running(cut.df, {"_nth": ("count", F.when(finite, 1))}))
    return scan(rows, keys, list(order), step, f"{name} double", level_carry(col, "_nth", snr, warmup), length).drop("_nth")


def kalman_level(df: DataFrame, col: str, snr: float = 0.01, warmup: int = 1024, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Local-level denoiser."""
    return kalman_smoothed(df, col, "level", [key], ORDER, snr, warmup, length)


def ewma_vol(df: DataFrame, period: int = 120, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Square root of the exponentially weighted variance of log returns."""
    cut = stretches(df, key, ORDER, length, least=2)
    held = cut.bounded(cut.df, 2, lambda d, keys: d.withColumn("ret", log_return("price", Window.partitionBy(*keys).orderBy(*ORDER))))
    return ewma_var(cut.done(held).where("ret is not null"), "ret", period, key, length=length).withColumn("ewma_vol", F.sqrt("ewma_var")).drop("ewma_before")


def zscore_outliers(df: DataFrame, threshold: float = 5.0, warmup: int = 30, period: int = 60, key: str = "symbol", seed: str = "zero", length: int | None = None) -> DataFrame:
    """Q9: distance from the mean and deviation before the value, both exponentially weighted; rejects still count."""
    spread = ewma_var(df, "price", period, key, seed, length)
    cut = stretches(spread, key, ORDER, length, least=2)
    known = cut.bounded(cut.df, 2, lambda d, keys: d.withColumn("_sd", F.sqrt(F.coalesce(F.lag("ewma_var").over(Window.partitionBy(*keys).orderBy(*ORDER)), F.lit(0.0)))))
    numbered = cut.running(known, {"_i": ("count", F.lit(1))})
    z = F.when(F.col("_sd") > 1e-12, F.abs(F.col("price") - F.col("ewma_before")) / F.when(F.col("_sd") > 1e-12, F.col("_sd"))).otherwise(0.0)
    out = numbered.withColumn("z", z).withColumn("outlier", (F.col("_i") > warmup) & (F.col("z") > threshold))
    return cut.done(out.drop("_sd", "_i", "ewma_before", "ewma_var"))


def outlier_pipeline(df: DataFrame, filters: list) -> DataFrame:
    """Q11: ``filters`` in order, each (name, f) with f adding ``outlier``; a rejected row is not seen by the next."""
    left, rejected = df, None
    for name, f in filters:
        judged = f(left)
        lost = judged.where("outlier").select(*df.columns, F.lit(name).alias("rejected_by"))
        rejected = lost if rejected is None else rejected.unionByName(lost)
        left = judged.where("not outlier").select(*df.columns)
    return left.withColumn("rejected_by", F.lit(None).cast("string")).unionByName(rejected) if rejected is not None else left


SNAPSHOT = """n_ticks int, last_price double, denoised_price double, realized_vol double, ewma_vol double, rolling_mean double, rolling_std double, drawdown double, state string, rejected int, ready boolean, publish boolean"""
#: State of one symbol between batches: what each filter keeps, and the values of the last window.
SNAPSHOT_STATE = """newest long, rejected long, zs double, zn long, zmean double, zvs double, kn long, level double, kp double, kr double, klast double, km long, kmean double, ksq double, peak double,
    vs double, vn long, vmean double, vvs double, vol double, run long, run_sign long, regime long, other long, other_n long, other_since long, published long, n long, last double, prices array<double>, rets array<double>, marks array<double>"""


def _rolling(tail: np.ndarray, x: np.ndarray, window: int, least: int) -> pd.core.window.rolling.Rolling:
    return pd.Series(np.concatenate((tail, x))).rolling(window, min_periods=least)


def snapshot_step(state: tuple | None, p: pd.DataFrame, window: int = 256, publish_ns: int = 10_000_000) -> tuple[tuple, dict[str, np.ndarray]]:
    """The state of one symbol after each of its rows, in arrival order; rows not taken repeat the state before.

    ``state`` follows SNAPSHOT_STATE. Ticks that go back in time, are not sane or lie outside the z filter are rejected.
    """
    n = len(p)
    st = list(state) if state else [-(2**63), 0, 0.0, 0, 0.0, 0.0, 0, 0.0, 1.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, -(2**63), 0, np.nan, [], [], []]
    (newest, rejected), peak, vol0, (run, run_sign), published, m0, last0 = st[:2], st[14], st[19], st[20:22], st[26], int(st[27]), st[28]
    tails = [np.array([v for v in t if v is not None], float) for t in st[29:32]]
    ts, price, size = p["ts_ns"].to_numpy(), p["price"].to_numpy(dtype=float), p["size"].to_numpy(dtype=float)
    on_time = ts >= np.maximum(np.maximum.accumulate(ts), newest) if n else np.zeros(0, bool)
    fresh = on_time & np.isfinite(price) & np.isfinite(size) & (price > 0) & (size > 0)
    x, at = price[fresh], np.flatnonzero(fresh)
    seen = int(st[3])
    z_state, _, before, var_before = K.ewma_var(tuple(st[2:6]) if seen else None, x, 60)
    sd = np.sqrt(var_before)
    z = np.divide(np.abs(x - before), sd, out=np.zeros(len(x)), where=sd > 1e-12)
    good = ~((seen + np.arange(len(x)) >= 30) & (z > 5.0))
    at, x = at[good], x[good]
    m = len(x)
    level0 = st[7]
    k_state, level = K.kalman_level(tuple(st[6:14]) if st[6] else None, x)
    back = np.concatenate(([last0], x[:-1])) if m else x
    ret = np.log(x / np.where(np.isfinite(back), back, x))
    known = np.isfinite(back)
    v_state, var, _, _ = K.ewma_var(tuple(st[15:19]) if st[16] else None, ret[known], 120)
    vol = np.concatenate((np.full(m - int(known.sum()), vol0), np.sqrt(var)))
    real = _rolling(tails[1], np.where(known, ret, np.nan), window, 2).std().fillna(0.0).to_numpy()[len(tails[1]) :]
    held = _rolling(tails[0], x, window, 1)
    mean, std = held.mean().to_numpy()[len(tails[0]) :], held.std().fillna(0.0).to_numpy()[len(tails[0]) :]
    count = m0 + np.arange(1, m + 1)
    # The lower median of the volatility at every 128th tick; its samples are all kept, one for each 128 ticks.
    fits, marks = np.flatnonzero(count % 128 == 0), tails[2].tolist()
    medians = [marks[(len(marks) - 1) // 2] if marks else 0.0]
    for i in fits:
        insort(marks, float(vol[i]))
        medians.append(marks[(len(marks) - 1) // 2])
    median = np.array(medians)[np.searchsorted(fits, np.arange(m), "right")]
    tops = np.maximum.accumulate(np.concatenate(([peak], level)))[1:]
    down = np.where(tops > 0, np.maximum(0.0, (tops - level) / np.where(tops > 0, tops, 1.0)), 0.0)
    previous = np.concatenate(([level0], level[:-1])) if m else level
    log_ret = np.where(previous > 0, np.log(x / np.where(previous > 0, previous, 1.0)), 0.0)
    sign = np.where(log_ret > 1e-9, 1, np.where(log_ret < -1e-9, -1, 0))
    start = np.flatnonzero(np.diff(sign, prepend=run_sign) != 0)
    since = np.zeros(m, np.int64)
    since[start] = start
    since = np.maximum.accumulate(since)
    length = np.arange(m) - since + 1
    if m:
        length[: start[0] if len(start) else m] += int(run)
    length = np.where(sign == 0, 0, length)
    observed = np.where(down >= 0.05, K.CRISIS, np.where((median > 0) & (vol > 1.8 * median), K.VOLATILE, np.where(length >= 50, K.TRENDING, K.CALM)))
    r_state, regime = K.regime_states(tuple(int(v) for v in st[22:26]), observed, ts[at])
    publish = np.zeros(m, bool)
    for i in range(m):
        if published == -(2**63) or ts[at[i]] - published >= publish_ns:
            publish[i], published = True, int(ts[at[i]])
    taken = np.zeros(n, bool)
    taken[at] = True
    where = np.searchsorted(at, np.arange(n), "right") - 1
    old = lambda v, none: none if m0 == 0 else v
    take = lambda v, none: np.where(where >= 0, np.asarray(v)[np.maximum(where, 0)], none) if m else np.full(n, none)
    lost = int(rejected) + np.cumsum(~taken)
    tail = lambda t, v: np.concatenate((t, v))[-(window - 1) :]
    prices, rets = tail(tails[0], x), tail(tails[1], ret[known])
    new = (int(max(newest, ts[on_time].max())) if on_time.any() else int(newest), int(lost[-1]) if n else int(rejected), *(z_state if len(price[fresh]) else st[2:6]))
    new += (*(k_state if m else st[6:14]), float(tops[-1]) if m else peak, *(v_state if known.any() else st[15:19]), float(vol[-1]) if m else vol0)
    new += (int(length[-1]) if m else int(run), int(sign[-1]) if m else int(run_sign), *r_state, int(published), m0 + m, float(x[-1]) if m else last0, prices.tolist(), rets.tolist(), marks)
    return new, {
        "n_ticks": take(np.minimum(count, window), min(m0, window)).astype(np.int32),
        "last_price": take(x, old(last0, np.nan)),
        "denoised_price": take(level, old(level0, np.nan)),
        "realized_vol": take(real, float(pd.Series(tails[1][-window:]).std()) if len(tails[1]) > 1 else 0.0),
        "ewma_vol": take(vol, vol0),
        "rolling_mean": take(mean, tails[0].mean() if len(tails[0]) else np.nan),
        "rolling_std": take(std, tails[0].std(ddof=1) if len(tails[0]) > 1 else 0.0),
        "drawdown": take(down, max(0.0, (peak - level0) / peak) if peak > 0 else 0.0),
        "state": np.array(K.REGIMES, object)[take(regime, int(st[22])).astype(int)],
        "rejected": lost.astype(np.int32),
        "ready": take(count >= 1024, m0 >= 1024).astype(bool),
        "publish": taken & take(publish, False).astype(bool),
    }


def symbol_snapshots(df: DataFrame, window: int = 256, publish_ns: int = 10_000_000) -> DataFrame:
    """Late and outlying ticks dropped, all filters and the regime updated, published at most every 10 ms."""
    made = scan(df.select("symbol", "ts_ns", "seq", "price", "size"), ["symbol"], ["seq"], lambda state, p: snapshot_step(state, p, window, publish_ns), SNAPSHOT)
    return made.where("publish").drop("publish")


def vwap(df: DataFrame, keys: list[str]) -> DataFrame:
    """Volume-weighted average price per group."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"))


_W = "PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


@query("w1_rolling_mean", f"SELECT seq, R6(avg(price) OVER ({_W.format(63)})) AS mean FROM v_ticks", "v_ticks")
def w1(spark, sf):
    return over_last(ticks(spark, sf), 64, lambda d, w: d.withColumn("mean", rolling_mean("price", w))).select("seq", r("mean"))


@query("w2_rolling_std", f"SELECT seq, R4(coalesce(var_samp(price) OVER w, 0)) AS var, R4(coalesce(stddev_samp(price) OVER w, 0)) AS std FROM v_ticks WINDOW w AS ({_W.format(63)})", "v_ticks")
def w2(spark, sf):
    var = over_last(ticks(spark, sf), 64, lambda d, w: d.withColumn("var", rolling_var("price", w)))
    return var.select("seq", r("var", 4), r(F.sqrt("var"), 4).alias("std"))


@query("w3_rolling_cov", f"SELECT seq, R4(coalesce(covar_samp(price, size) OVER ({_W.format(63)}), 0)) AS cov FROM v_ticks", "v_ticks")
def w3(spark, sf):
    return over_last(ticks(spark, sf), 64, lambda d, w: d.withColumn("cov", rolling_cov("price", "size", w))).select("seq", r("cov", 4))


@query(
    "w4_rolling_corr",
    f"""WITH m AS (SELECT seq, coalesce(covar_samp(price, size) OVER w, 0) AS c, sqrt(coalesce(var_samp(price) OVER w, 0) * coalesce(var_samp(size) OVER w, 0)) AS d FROM v_ticks WINDOW w AS ({_W.format(63)}))
    SELECT seq, R6(CASE WHEN d < 1e-12 THEN 0 ELSE greatest(-1, least(1, c / d)) END) AS corr FROM m""",
    "v_ticks",
)
def w4(spark, sf):
    return over_last(ticks(spark, sf), 64, lambda d, w: with_corr(d, "price", "size", w)).select("seq", r("corr"))


_EW = """s AS (SELECT symbol, ts_ns, price, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS i FROM v_series),
    e AS (SELECT a.symbol, a.ts_ns, a.i, a.price, sum(pow(1 - {a}, a.i - b.i) * b.price) / sum(pow(1 - {a}, a.i - b.i)) AS m FROM s a JOIN s b ON a.symbol = b.symbol AND b.i <= a.i AND b.i > a.i - 900 GROUP BY ALL)"""


def _daily(spark, sf):
    return series(spark, sf).withColumn("seq", F.lit(0).cast("long"))


@query("w5_ewma", f"WITH {_EW.format(a='2.0::DOUBLE/21')} SELECT symbol, ts_ns, R4(m) AS ewma, 1 - pow(1 - 2.0::DOUBLE / 21, i) >= 0.95 AS ready FROM e", "v_series")
def w5(spark, sf):
    return ewma(_daily(spark, sf), "price", 20).select("symbol", "ts_ns", r("ewma", 4), "ready")


@query(
    "w6_ewma_var",
    f"""WITH {_EW.format(a='2.0::DOUBLE/21')}, p AS (SELECT *, pow(price - coalesce(lag(m) OVER (PARTITION BY symbol ORDER BY i), 0), 2) AS d FROM e)
    SELECT a.symbol, a.ts_ns, R0(sum(pow(1 - 2.0::DOUBLE / 21, a.i - b.i) * b.d) / sum(pow(1 - 2.0::DOUBLE / 21, a.i - b.i))) AS ewma_var FROM p a JOIN p b ON a.symbol = b.symbol AND b.i <= a.i AND b.i > a.i - 900 GROUP BY a.symbol, a.ts_ns, a.i""",
    "v_series",
)
def w6(spark, sf):
    return ewma_var(_daily(spark, sf), "price", 20).select("symbol", "ts_ns", r("ewma_var", 0))


@query(
    "w7_ema",
    """WITH RECURSIVE s AS (SELECT symbol, ts_ns, price, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS i FROM v_series),
    e AS (SELECT symbol, ts_ns, i, price AS ema FROM s WHERE i = 1 UNION ALL SELECT s.symbol, s.ts_ns, s.i, e.ema + 2.0::DOUBLE / 21 * (s.price - e.ema) FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)
    SELECT symbol, ts_ns, R4(ema) AS ema FROM e""",
    "v_series",
)
def w7(spark, sf):
    return ema(_daily(spark, sf), "price", 20).select("symbol", "ts_ns", r("ema", 4))


@query(
    "w8_rolling_median",
    f"""WITH l AS (SELECT seq, list(price) OVER ({_W.format(31)}) AS v FROM v_ticks), m AS (SELECT *, list_aggregate(v, 'median') AS med FROM l)
    SELECT seq, R4(med) AS median, R4(CASE WHEN len(v) < 2 THEN 0 ELSE list_aggregate(list_transform(v, lambda x: abs(x - med)), 'median') END) AS mad FROM m""",
    "v_ticks",
)
def w8(spark, sf):
    return rolling_median_mad(ticks(spark, sf), "price", 32).select("seq", r("median", 4), r("mad", 4))


@query(
    "w9_kalman_level",
    f"""WITH RECURSIVE s AS (SELECT symbol, ts_ns, price, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS i FROM v_series), d AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY i)) AS ret FROM s),
    n AS (SELECT symbol, greatest(var_samp(ret), 1e-12) AS noise FROM d WHERE i <= 64 GROUP BY symbol),
    k(symbol, ts_ns, i, level, p) AS (SELECT symbol, ts_ns, i, price, 1.0::DOUBLE FROM s WHERE i = 1 UNION ALL
      SELECT s.symbol, s.ts_ns, s.i, CASE WHEN s.i < 64 THEN 0.5 * k.level + 0.5 * s.price ELSE k.level + (k.p + noise * 0.01) / (k.p + noise * 0.01 + noise) * (s.price - k.level) END,
        CASE WHEN s.i < 64 THEN k.p ELSE (1 - (k.p + noise * 0.01) / (k.p + noise * 0.01 + noise)) * (k.p + noise * 0.01) END
      FROM k JOIN s ON s.symbol = k.symbol AND s.i = k.i + 1 JOIN n ON n.symbol = k.symbol)
    SELECT symbol, ts_ns, R4(level) AS level FROM k""",
    "v_series",
)
def w9(spark, sf):
    return kalman_level(_daily(spark, sf), "price", warmup=64).select("symbol", "ts_ns", r("level", 4))


_RET = "r AS (SELECT *, CASE WHEN price > 0 AND lag(price) OVER o > 0 THEN ln(price / lag(price) OVER o) END AS ret FROM v_ticks WINDOW o AS (PARTITION BY symbol ORDER BY ts_ns, seq))"


@query("w10_realized_vol", f"WITH {_RET} SELECT seq, R6(coalesce(stddev_samp(ret) OVER ({_W.format(63)}), 0)) AS realized_vol FROM r", "v_ticks")
def w10(spark, sf):
    return realized_vol(ticks(spark, sf), 64).select("seq", r("realized_vol"))


@query(
    "w11_ewma_vol",
    """WITH q AS (SELECT symbol, ts_ns, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts_ns)) AS price FROM v_series), s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS i FROM q WHERE price IS NOT NULL),
    e AS (SELECT a.symbol, a.ts_ns, a.i, a.price, sum(pow(119.0::DOUBLE / 121, a.i - b.i) * b.price) / sum(pow(119.0::DOUBLE / 121, a.i - b.i)) AS m FROM s a JOIN s b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY ALL),
    p AS (SELECT *, pow(price - coalesce(lag(m) OVER (PARTITION BY symbol ORDER BY i), 0), 2) AS d FROM e)
    SELECT a.symbol, a.ts_ns, R6(sqrt(sum(pow(119.0::DOUBLE / 121, a.i - b.i) * b.d) / sum(pow(119.0::DOUBLE / 121, a.i - b.i)))) AS ewma_vol FROM p a JOIN p b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY a.symbol, a.ts_ns, a.i""",
    "v_series",
)
def w11(spark, sf):
    return ewma_vol(_daily(spark, sf)).select("symbol", "ts_ns", r("ewma_vol"))


@query("w12_running_drawdown", "SELECT seq, R6(CASE WHEN m > 0 THEN greatest(0, (m - price) / m) ELSE 0 END) AS drawdown FROM (SELECT *, max(price) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS m FROM v_ticks)", "v_ticks")
def w12(spark, sf):
    return running_drawdown(ticks(spark, sf), "price").select("seq", r("drawdown"))


_RUNS = f"""{_RET}, g AS (SELECT *, CASE WHEN ret > 1e-9 THEN 1 WHEN ret < -1e-9 THEN -1 ELSE 0 END AS run_sign FROM r),
    n AS (SELECT *, CASE WHEN lag(run_sign) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) = run_sign THEN 0 ELSE 1 END AS fresh FROM g), i AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM n),
    u AS (SELECT *, (CASE WHEN run_sign = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, run ORDER BY ts_ns, seq) END)::INT AS run_length FROM i)"""


@query("w13_return_runs", f"WITH {_RUNS} SELECT seq, run_sign, run_length FROM u", "v_ticks")
def w13(spark, sf):
    return return_runs(ticks(spark, sf)).select("seq", "run_sign", "run_length")


@query(
    "w14_market_view",
    f"""WITH {_RET} SELECT seq, R6(CASE WHEN count(ret) OVER k >= 8 THEN stddev_samp(ret) OVER k END) AS sigma, R4(sum(price * size) OVER a / nullif(sum(size) OVER a, 0)) AS vwap,
    R4(CASE WHEN ts_ns - min(ts_ns) OVER a >= {HOUR} THEN sum(size) OVER a / ((ts_ns - min(ts_ns) OVER a) / {24 * HOUR}::DOUBLE) END) AS adv, R4(bid) AS last_bid FROM r
    WINDOW k AS ({_W.format(63)}), a AS (PARTITION BY symbol ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)""",
    "v_ticks",
)
def w14(spark, sf):
    return market_view(ticks(spark, sf)).select("seq", r("sigma"), r("vwap", 4), r("adv", 4), r("last_bid", 4))


@query("w15_streaming_stats", "SELECT symbol, count(price) AS n, R6(avg(price)) AS mean, R4(var_samp(price)) AS var, min(price) AS min, max(price) AS max FROM v_ticks GROUP BY symbol", "v_ticks")
def w15(spark, sf):
    return streaming_stats(ticks(spark, sf), "price", ["symbol"]).select("symbol", "n", r("mean"), r("var", 4), "min", "max")


@query("w16_tracked_percentile", "SELECT symbol, list_sort(list(price))[(floor(0.95::DOUBLE * (count(*) - 1)) + 1)::INT] AS percentile FROM v_ticks GROUP BY symbol", "v_ticks")
def w16(spark, sf):
    return tracked_percentile(ticks(spark, sf), "price", 0.95, ["symbol"])


_REG = f"""{_RUNS}, o AS (SELECT symbol, ts_ns, seq, run_length, run_sign, coalesce(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 0) AS vol,
      coalesce(stddev_samp(ret) OVER ({_W.format(255)}), 0) AS median_vol FROM u),
    c AS (SELECT *, CASE WHEN median_vol > 0 AND vol / median_vol > 1.2::DOUBLE THEN 'volatile' WHEN run_length >= 3 THEN 'trending' ELSE 'calm' END AS regime FROM o)"""


def _regimes(spark, sf):
    moved = F.when(F.col("ret") != 0, F.col("ret"))
    run = over_last(return_runs(ticks(spark, sf)), 256, lambda d, w: d.withColumn("vol", rolling_std(moved, w.rowsBetween(-15, 0))).withColumn("median_vol", rolling_std(moved, w)))
    return classify_regime(run.withColumn("drawdown", F.lit(0.0)), band=1.2, run=3)


@query(
    "w17_classify_regime",
    f"WITH {_REG.replace('stddev_samp(ret)', 'stddev_samp(CASE WHEN ret <> 0 THEN ret END)')} SELECT seq, regime, CASE WHEN regime = 'trending' THEN run_sign END AS direction, CASE WHEN regime = 'trending' THEN run_length / 100.0::DOUBLE END AS strength FROM c",
    "v_ticks",
)
def w17(spark, sf):
    return _regimes(spark, sf).select("seq", "regime", "direction", "strength")


_OBSERVED = f"WITH {_REG.replace('stddev_samp(ret)', 'stddev_samp(CASE WHEN ret <> 0 THEN ret END)')}"


@query(
    "w18_regime_states",
    f"""{_OBSERVED.replace('WITH ', 'WITH RECURSIVE ', 1)}, q AS (SELECT symbol, seq, ts_ns, regime, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS i FROM c),
    m(symbol, i, seq, regime, now, other, n, since) AS (SELECT DISTINCT symbol, 0::BIGINT, 0::BIGINT, 'calm', 'calm', 'calm', 0::BIGINT, 0::BIGINT FROM q UNION ALL
      SELECT x.symbol, x.i, x.seq, x.regime, CASE WHEN x.regime <> x.now AND n >= CASE WHEN x.regime = 'crisis' THEN 10 WHEN x.now = 'crisis' THEN 200 WHEN x.now = 'calm' AND x.regime = 'trending' THEN 50 WHEN x.now = 'volatile' AND x.regime = 'calm' THEN 100 WHEN x.now = 'trending' AND x.regime = 'calm' THEN 80 ELSE 20 END
          AND x.ts_ns - since >= {K.SEC} * CASE WHEN x.regime = 'crisis' THEN 1 WHEN x.now = 'crisis' THEN 30 WHEN x.now = 'calm' AND x.regime = 'trending' THEN 5 WHEN x.now = 'volatile' AND x.regime = 'calm' THEN 15 WHEN x.now = 'trending' AND x.regime = 'calm' THEN 10 ELSE 2 END THEN x.regime ELSE x.now END, other, n, since
      FROM (SELECT q.symbol, q.i, q.seq, q.ts_ns, q.regime, m.now, q.regime AS other, CASE WHEN q.regime = m.now THEN 0 WHEN q.regime = m.other THEN m.n + 1 ELSE 1 END AS n, CASE WHEN q.regime = m.now OR q.regime = m.other THEN m.since ELSE q.ts_ns END AS since FROM m JOIN q ON q.symbol = m.symbol AND q.i = m.i + 1) x)
    SELECT seq, regime, now AS state FROM m WHERE i > 0""",
    "v_ticks",
)
def w18(spark, sf):
    return regime_states(_regimes(spark, sf).select("symbol", "ts_ns", "seq", "regime")).select("seq", "regime", "state")


@query("w19_symbol_snapshots")
def w19(spark, sf):
    return symbol_snapshots(ticks(spark, sf))


@query("w20_vwap", f"SELECT symbol, ts_ns - ts_ns % {24 * HOUR} AS day, R4(sum(price * size) / nullif(sum(size), 0)) AS vwap FROM v_ticks GROUP BY 1, 2", "v_ticks")
def w20(spark, sf):
    return vwap(ticks(spark, sf).withColumn("day", F.col("ts_ns") - F.col("ts_ns") % (24 * HOUR)), ["symbol", "day"]).select("symbol", "day", r("vwap", 4))


@query(
    "q9_zscore_outliers",
    f"""WITH {_EW.format(a='2.0::DOUBLE/61')}, p AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY symbol ORDER BY i), 0) AS pm FROM e),
    v AS (SELECT a.symbol, a.i, sum(pow(59.0::DOUBLE / 61, a.i - b.i) * pow(b.price - b.pm, 2)) / sum(pow(59.0::DOUBLE / 61, a.i - b.i)) AS var FROM p a JOIN p b ON a.symbol = b.symbol AND b.i <= a.i AND b.i > a.i - 900 GROUP BY a.symbol, a.i),
    z AS (SELECT p.*, sqrt(coalesce(v.var, 0)) AS sd FROM p LEFT JOIN v ON v.symbol = p.symbol AND v.i = p.i - 1)
    SELECT symbol, ts_ns, R4(CASE WHEN sd > 1e-12 THEN abs(price - pm) / sd ELSE 0 END) AS z, i > 30 AND sd > 1e-12 AND abs(price - pm) / sd > 3 AS outlier FROM z""",
    "v_series",
)
def q9(spark, sf):
    return zscore_outliers(_daily(spark, sf), threshold=3.0).select("symbol", "ts_ns", r("z", 4), "outlier")


_QZ = """s AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS i FROM v_ticks WHERE price > 0 AND size > 0),
    z(symbol, i, price, mean, s, v, bm, bv) AS (SELECT symbol, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT symbol FROM s) UNION ALL
      SELECT s.symbol, s.i, s.price, (59.0::DOUBLE / 61 * z.s + 2.0::DOUBLE / 61 * s.price) / (1 - pow(59.0::DOUBLE / 61, s.i)), 59.0::DOUBLE / 61 * z.s + 2.0::DOUBLE / 61 * s.price,
        59.0::DOUBLE / 61 * z.v + 2.0::DOUBLE / 61 * pow(s.price - z.mean, 2), z.mean, CASE WHEN z.i = 0 THEN 0 ELSE z.v / (1 - pow(59.0::DOUBLE / 61, z.i)) END
      FROM z JOIN s ON s.symbol = z.symbol AND s.i = z.i + 1)"""


@query(
    "q11_outlier_pipeline",
    f"""WITH RECURSIVE {_QZ}, j AS (SELECT symbol, CASE WHEN i > 30 AND sqrt(bv) > 1e-12 AND abs(price - bm) / sqrt(bv) > 3 THEN 'zscore' END AS rejected_by FROM z WHERE i > 0
      UNION ALL SELECT symbol, 'sanity' FROM v_ticks WHERE NOT (price > 0 AND size > 0)) SELECT symbol, rejected_by, count(*) AS n FROM j GROUP BY 1, 2""",
    "v_ticks",
)
def q11(spark, sf):
    from .filters import sanity

    insane = lambda d: sanity(d).withColumn("outlier", F.col("reason").isNotNull())
    t = ticks(spark, sf).select("symbol", "ts_ns", "seq", "price", "size")
    return outlier_pipeline(t, [("sanity", insane), ("zscore", lambda d: zscore_outliers(d, threshold=3.0))]).groupBy("symbol", "rejected_by").agg(F.count("*").alias("n"))
