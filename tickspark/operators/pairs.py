"""Pair statistics: regressions, spreads, cointegration, signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions import kernels as K
from tickspark.functions.filtering import hedge_carry
from tickspark.functions.stretches import NEVER, over_rows, scan, stretches
from tickspark.plans.catalog import query, r, series

from .strategies import Strategy, run_strategy
from .windows import kalman_smoothed

#: Fixed critical values (1, 5, 10 %) of the unit-root tests and of cointegration with two series.
CRITICAL = {"no_constant": (-2.5658, -1.9393, -1.6156), "constant": (-3.4336, -2.8621, -2.5671), "trend": (-3.9638, -3.4126, -3.1279), "cointegration": (-3.9001, -3.3377, -3.0462)}


def ols2(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """y = a + b x per key: n, a, b, r2. Partial sums are folded before the shuffle by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"))


def gram(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Sums that a least-squares fit needs: one row per key."""
    cols = [*xs, y]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"_s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("_sy"), *sums)


def solve(sums: DataFrame, keys: list[str], p: int) -> DataFrame:
    """beta, se (arrays), rss, tss and error per row of ``gram``; the solve is p by p."""
    out = T.StructType([*[sums.schema[k] for k in keys], *T._parse_datatype_string("n long, beta array<double>, se array<double>, rss double, tss double, error string").fields])

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                g = np.zeros((p + 1, p + 1))
                for i in range(p + 1):
                    for j in range(i, p + 1):
                        g[i, j] = g[j, i] = rec[f"_s{i}_{j}"] if rec[f"_s{i}_{j}"] is not None else np.nan
                n, beta, se, rss, error = int(rec["n"]), None, None, None, None
                tss = g[p, p] - rec["_sy"] ** 2 / n
                if n <= p:
                    error = "underdetermined"
                else:
                    scale = np.sqrt(np.maximum(np.diag(g)[:p], 1e-300))
                    a = g[:p, :p] / np.outer(scale, scale)
                    if not np.isfinite(a).all() or np.linalg.matrix_rank(a, tol=1e-10) < p:
                        error = "singular"
                    else:
                        inv = np.linalg.inv(a) / np.outer(scale, scale)
                        b = inv @ g[:p, p]
                        rss = max(float(g[p, p] - b @ g[:p, p]), 0.0)
                        beta, se = b.tolist(), np.sqrt(np.maximum(np.diag(inv) * rss / (n - p), 0)).tolist()
                rows.append({**{k: rec[k] for k in keys}, "n": n, "beta": beta, "se": se, "rss": rss, "tss": float(tss), "error": error})
            yield pd.DataFrame(rows, columns=out.names)

    return sums.mapInPandas(run, out)


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Several regressors (put a column of ones among them for a constant)."""
    return solve(gram(df, keys, y, xs), keys, len(xs))


def hedge_static(df: DataFrame, b: float) -> DataFrame:
    return df.withColumn("beta", F.lit(b)).withColumn("intercept", F.lit(0.0))


def _over(keys: list[str], k: int):
    return Window.partitionBy(*keys).orderBy("ts_ns").rowsBetween(-(k - 1), 0)


def hedge_rolling(df: DataFrame, window: int = 256, key: str = "pair", length: int | None = None) -> DataFrame:
    """Slope and intercept over the last rows; a slope without variation of x (1e-12) is frozen and counted."""
    cut = stretches(df, key, ("ts_ns",), length, least=window)

    def fit(d: DataFrame, keys: list[str]) -> DataFrame:
        w = _over(keys, window)
        d = d.withColumns({"_var": F.coalesce(F.var_samp("x").over(w), F.lit(0.0)), "_cov": F.coalesce(F.covar_samp("y", "x").over(w), F.lit(0.0)), "_my": F.avg("y").over(w), "_mx": F.avg("x").over(w)})
        return d.withColumn("_raw", F.when(F.col("_var") >= 1e-12, F.col("_cov") / F.when(F.col("_var") >= 1e-12, F.col("_var"))))

    specs = {"_beta": ("last", F.col("_raw")), "frozen": ("sum", F.when(F.col("_raw").isNull(), 1).otherwise(0)), "_seen": ("count", F.lit(1))}
    out = cut.running(cut.bounded(cut.df, window, fit), specs).withColumn("beta", F.coalesce("_beta", F.lit(0.0)))
    out = out.withColumn("intercept", F.col("_my") - F.col("beta") * F.col("_mx")).withColumn("ready", F.col("_seen") >= 8).drop("_var", "_cov", "_my", "_mx", "_raw", "_beta", "_seen")
    few = max(window // 4, 2)
    return cut.done(cut.bounded(out, few, lambda d, keys: d.withColumn("beta_stdev", F.coalesce(F.stddev_samp("beta").over(_over(keys, few)), F.lit(0.0)))))


def hedge_kalman_smoothed(df: DataFrame, window: int = 256, key: str = "pair", snr: float = 0.01, warmup: int = 64, length: int | None = None) -> DataFrame:
    """P5: the rolling slope through the local-level filter."""
    return kalman_smoothed(hedge_rolling(df, window, key, length), "beta", "beta_smoothed", [key], ("ts_ns",), snr, warmup, length)


def hedge_kalman2(df: DataFrame, key: str = "pair", q_a: float = 1e-7, q_b: float = 1e-7, noise: float = 1e-3, length: int | None = None) -> DataFrame:
    """Random-walk intercept and slope; rows without finite values show the state before them."""

    def step(state, p: pd.DataFrame):
        state, a, b, e = K.kalman_hedge(state, p["y"].to_numpy(), p["x"].to_numpy(), q_a, q_b, noise)
        return state, {"alpha": a, "beta": b, "innovation": e}

    return scan(df, [key], ["ts_ns"], step, "alpha double, beta double, innovation double", hedge_carry("y", "x", q_a, q_b, noise), length)


def spread_z(df: DataFrame, window: int = 256, key: str = "pair", length: int | None = None) -> DataFrame:
    """Spread y - beta x - intercept and its z over the last rows; a deviation of 1e-12 or less gives 0."""
    s = df.withColumn("spread", F.col("y") - F.col("beta") * F.col("x") - F.col("intercept"))
    cut = stretches(s, key, ("ts_ns",), length, least=window)

    def rolled(d: DataFrame, keys: list[str]) -> DataFrame:
        w = _over(keys, window)
        return d.withColumns({"spread_mean": F.avg("spread").over(w), "spread_std": F.coalesce(F.stddev_samp("spread").over(w), F.lit(0.0)), "n": F.count("*").over(w)})

    z = F.when(F.col("spread_std") > 1e-12, (F.col("spread") - F.col("spread_mean")) / F.col("spread_std")).otherwise(0.0)
    return cut.done(cut.bounded(cut.df, window, rolled)).withColumn("z", z)


def adf_design(df: DataFrame, keys: list[str], col: str, variant: str, lag: int, length: int | None = None) -> tuple[DataFrame, list[str]]:
    def changes(rows: DataFrame, w) -> DataFrame:
        d = rows.withColumn("_l", F.lag(col).over(w)).withColumn("_d", F.col(col) - F.col("_l"))
        return d.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, lag + 1)})

    cut = stretches(df, keys, ("ts_ns",), length, least=lag + 2)
    d = cut.bounded(cut.df, lag + 2, lambda rows, own: changes(rows, Window.partitionBy(*own).orderBy("ts_ns")))
    xs = ["_l", *[f"_d{i}" for i in range(1, lag + 1)]]
    if variant in ("constant", "trend"):
        d, xs = d.withColumn("_one", F.lit(1.0)), [*xs, "_one"]
    if variant == "trend":
        d, xs = cut.running(d, {"_t": ("count", F.lit(1))}).withColumn("_t", F.col("_t").cast("double")), [*xs, "_t"]
    return cut.done(d).where(" and ".join(f"{c} is not null" for c in [*xs, "_d"])), xs


def adf(df: DataFrame, keys: list[str], col: str, variant: str = "no_constant", lag: int | str = 1, table: str | None = None, length: int | None = None) -> DataFrame:
    """T statistic of the lagged level and its p-value; ``lag='schwert'`` picks 1 to 4 lags by the length of each key."""
    if lag == "schwert":
        sized = df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys).withColumn("_lags", schwert(F.col("_n")))
        parts = [adf(sized.where(F.col("_lags") == k).drop("_n", "_lags"), keys, col, variant, k, table, length) for k in range(1, 5)]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
    design, xs = adf_design(df, keys, col, variant, lag, length)
    fit = ols(design, keys, "_d", xs).where(F.col("n") >= len(xs) + 4)
    t = F.try_divide(F.get("beta", F.lit(0)), F.get("se", F.lit(0)))
    return fit.select(*keys, F.lit(lag).alias("lag"), "n", t.alias("t_stat")).withColumn("p_value", mackinnon_p(F.col("t_stat"), table or variant))


def schwert(n: Column) -> Column:
    """12 (n / 100)^(1/4), floored, between 1 and 4."""
    return F.greatest(F.lit(1), F.least(F.lit(4), F.floor(12 * F.pow(n / 100, F.lit(0.25))).cast("int")))


def mackinnon_p(t: Column, table: str) -> Column:
    """P10: linear between the critical values, 0.001 below the first, at most 0.2 above the last."""
    c1, c5, c10 = CRITICAL[table]
    return (
        F.when(t <= c1, 0.001)
        .when(t <= c5, 0.01 + (t - c1) / (c5 - c1) * 0.04)
        .when(t <= c10, 0.05 + (t - c5) / (c10 - c5) * 0.05)
        .otherwise(F.least(F.lit(0.2), 0.1 + (t - c10) * 0.05))
    )


def engle_granger(df: DataFrame, keys: list[str], y: str = "y", x: str = "x", lag: int = 1, signif: float = 0.05, length: int | None = None) -> DataFrame:
    """Fit, residuals, unit-root test on them without constant."""
    fit = ols2(df, keys, y, x)
    residual = df.join(fit.select(*keys, "a", "b"), keys).withColumn("residual", F.col(y) - F.col("a") - F.col("b") * F.col(x))
    test = adf(residual, keys, "residual", "no_constant", lag, "cointegration", length)
    out = fit.join(test.select(*keys, "t_stat", "p_value"), keys, "left")
    return out.withColumn("cointegrated", F.coalesce((F.col("p_value") < signif) & (F.abs("b") > 1e-9), F.lit(False)))


def half_life(df: DataFrame, keys: list[str], col: str, length: int | None = None) -> DataFrame:
    """-ln 2 / ln |1 + slope of the change on the level|; null unless it reverts and has 8 changes."""
    d = over_rows(df, keys, 2, lambda rows, w: rows.withColumn("_l", F.lag(col).over(w)), length=length).where("_l is not null").withColumn("_d", F.col(col) - F.col("_l"))
    fit = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_d", "_l").alias("slope")).withColumn("phi", F.abs(1 + F.col("slope")))
    ok = (F.col("n") >= 8) & (F.col("phi") < 1) & (F.col("phi") > 1e-12)
    return fit.withColumn("half_life", F.when(ok, -math.log(2) / F.ln(F.when(ok, F.col("phi")))))


def significance(p: Column) -> Column:
    return F.when(p < 0.01, "strong").when(p < 0.10, "moderate").otherwise("weak")


def reversion_signals(df: DataFrame, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, key: str = "pair", length: int | None = None) -> DataFrame:
    """Position and signal from z; the machine has three states, so stretches of a long pair compose."""
    names = np.array(["hold", "long_spread", "exit", "short_spread"], object)

    def step(state, p: pd.DataFrame):
        state, position, signal = K.reversion(state, p["z"].to_numpy(), entry, leave, stop)
        return state, {"position": position, "signal": names[signal]}

    end = lambda held, p: K.reversion((held,), p["z"].to_numpy(), entry, leave, stop)[0][0]
    return scan(df, [key], ["ts_ns"], step, "position long, signal string", K.machine_carry([0, -1, 1], end), length)


def rolling_cointegration(bars: DataFrame, min_bars: int = 64, every: int = 64, key: str = "pair", length: int | None = None) -> DataFrame:
    """Every ``every`` bars the tests on the last 4 * min_bars closes.

    Each bar belongs to at most 4 * min_bars / every + 1 retests, found by arithmetic on its index, so rows are
    repeated a fixed number of times and nothing is range-joined.
    """
    held = 4 * min_bars
    cut = stretches(bars, key, ("ts_ns",), length)
    indexed = cut.done(cut.running(cut.df, {"i": ("count", F.lit(1))})).withColumn("i", F.col("i").cast("int"))
    sized = indexed.join(bars.groupBy(key).agg(F.count("*").cast("int").alias("_n")), key)
    first = F.greatest(F.lit(-(-min_bars // every)), F.ceil(F.col("i") / every)).cast("int")
    last = F.least(F.floor((F.col("i") + held - 1) / every), F.floor(F.col("_n") / every)).cast("int")
    windows = sized.where(last >= first).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("retest", F.col("_k") * every)
    keys = [key, "retest"]
    tested = engle_granger(windows, keys, length=NEVER)  # a retest is short
    residual = windows.join(tested.select(*keys, "a", "b"), keys).withColumn("residual", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    return tested.join(half_life(residual, keys, "residual", NEVER).select(*keys, "half_life"), keys, "left")


def published(df: DataFrame, key: str, publish_ns: int) -> DataFrame:
    """The rows that are at least ``publish_ns`` later than the last one published before them; a key's first row always."""

    def step(state, rows: pd.DataFrame) -> tuple:
        last, keep = throttle(state[0] if state else None, rows["ts_ns"].to_numpy(), publish_ns)
        return (last,), {"_published": keep}

    return scan(df, [key], ["ts_ns"], step, "_published boolean").where("_published").drop("_published")


def throttle(last: int | None, ts: np.ndarray, publish_ns: int) -> tuple[int | None, np.ndarray]:
    """Which of the ordered times are published, when the last one before them was at ``last``; and the last of them."""
    keep = np.zeros(len(ts), bool)
    i = 0 if last is None else int(np.searchsorted(ts, last + publish_ns))
    while i < len(ts):
        keep[i], last = True, int(ts[i])
        i = max(i + 1, int(np.searchsorted(ts, last + publish_ns)))
    return last, keep


def pair_snapshots(df: DataFrame, window: int = 256, key: str = "pair", min_publish_ns: int = 1_000_000, bars: DataFrame | None = None, volume_window: int = 64) -> DataFrame:
    """Hedge, correlation, spread, z and signal on each joined tick, with the last retest at or before it.

    ``bars``: pair bars (key, ts_ns of their close, y, x, volume of the smaller leg), in which retests run and
    ``avg_volume`` is taken; without them each joined tick counts as a bar. Snapshots lie ``min_publish_ns`` apart, from
    the last published one on.
    """
    from .joins import asof
    from .windows import over_last, with_corr

    # Whether a pair must be cut is asked once: what follows adds columns, no rows.
    length = NEVER if stretches(df, key, ("ts_ns",)).hot is None else None
    stats = spread_z(hedge_rolling(df, window, key, length), window, key, length)
    stats = over_last(stats, window, lambda d, w: with_corr(d, "y", "x", w), key, ("ts_ns",), length)
    signals = reversion_signals(stats, key=key, length=length)
    tested = df if bars is None else bars
    tests = rolling_cointegration(tested, key=key).withColumnsRenamed({"p_value": "adf_p_value", "t_stat": "adf_t_stat"})
    at = tested.withColumn("retest", F.row_number().over(Window.partitionBy(key).orderBy("ts_ns"))).select(key, "retest", "ts_ns")
    met = asof(signals, tests.join(at, [key, "retest"]).select(key, "ts_ns", "adf_p_value", "adf_t_stat", "half_life", "cointegrated"), [key], ["adf_p_value", "adf_t_stat", "half_life", "cointegrated"], length=length).drop("matched_ts")
    if bars is not None:
        means = over_last(bars.select(key, "ts_ns", "volume"), volume_window, lambda d, w: d.withColumn("avg_volume", F.avg("volume").over(w)), key, ("ts_ns",), length)
        met = asof(met, means.select(key, "ts_ns", "avg_volume"), [key], ["avg_volume"], length=length).drop("matched_ts")
    return published(met, key, min_publish_ns)


#: State of one pair between batches, and what its snapshots hold after the keys, ts_ns and seq. Per leg (y, then x): the
#: last price and its time, the open bar that ticks make, and the last closed bar. A time of NO_TIME: not yet.
PAIR_STATE = """price array<double>, price_ts array<long>, open_ts array<long>, open_close array<double>, open_volume array<double>, bar_ts array<long>, bar_close array<double>, bar_volume array<double>,
    last_event long, last_publish long, last_bar long, late long, n_ticks long, n_bars long, since long,
    beta double, frozen long, ys array<double>, xs array<double>, betas array<double>, spreads array<double>, position long,
    bar_ys array<double>, bar_xs array<double>, volumes array<double>, t double, p double, half double, cointegrated boolean"""
PAIR_SNAPSHOT = """y double, x double, beta double, intercept double, beta_stdev double, corr double, spread double, z double, n long, signal string, position long,
    adf_t_stat double, adf_p_value double, half_life double, cointegrated boolean, ready boolean, n_ticks long, n_bars long, late long, avg_volume double"""
SIGNALS = ("hold", "long_spread", "exit", "short_spread")
#: Joined ticks whose windows are taken together.
PAIR_CHUNK = 2048
NO_TIME = -(1 << 62)


def mackinnon_value(t: float, table: str) -> float:
    """``mackinnon_p`` of a number."""
    c1, c5, c10 = CRITICAL[table]
    if t <= c1:
        return 0.001
    if t <= c5:
        return 0.01 + (t - c1) / (c5 - c1) * 0.04
    return 0.05 + (t - c5) / (c10 - c5) * 0.05 if t <= c10 else min(0.2, 0.1 + (t - c10) * 0.05)


def retest(y: np.ndarray, x: np.ndarray, signif: float = 0.05) -> tuple[float | None, float | None, float | None, bool]:
    """P11 and P12 of one window: t, p, half-life (null where they are not defined) and whether it is cointegrated."""
    var = ((x - x.mean()) ** 2).sum()
    if var <= 0:
        return None, None, None, False
    b = ((x - x.mean()) * (y - y.mean())).sum() / var
    v = y - (y.mean() - b * x.mean()) - b * x
    d, level, t, p, half = np.diff(v), v[:-1], None, None, None
    a = np.stack([level[1:], d[:-1]], axis=1)
    if len(a) >= 6 and np.linalg.matrix_rank(a) == 2:
        inverse = np.linalg.inv(a.T @ a)
        fit = inverse @ a.T @ d[1:]
        rest = float(((d[1:] - a @ fit) ** 2).sum())
        se = math.sqrt(max(inverse[0, 0] * rest / (len(a) - 2), 0.0))
        t = float(fit[0]) / se if se > 0 else None
        p = None if t is None else mackinnon_value(t, "cointegration")
    spread = ((level - level.mean()) ** 2).sum()
    phi = abs(1 + ((level - level.mean()) * (d - d.mean())).sum() / spread) if spread > 0 else 1.0
    if len(d) >= 8 and 1e-12 < phi < 1:
        half = -math.log(2) / math.log(phi)
    return t, p, half, bool(p is not None and p < signif and abs(b) > 1e-9)


def _frames(tail: list[float], values: np.ndarray, window: int) -> np.ndarray:
    """Rows of the last ``window`` values up to each of ``values``, NaN before the first one of all."""
    kept = tail[-(window - 1) :] if window > 1 else []
    padded = np.concatenate((np.full(window - 1 - len(kept), np.nan), kept, values))
    return np.lib.stride_tricks.sliding_window_view(padded, window)


def _moments(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and n - 1 (1 at least) of each row."""
    n = np.count_nonzero(~np.isnan(frames), axis=1)
    mean = np.nansum(frames, axis=1) / n
    return mean, np.nan_to_num(frames - mean[:, None]), np.maximum(n - 1, 1)


class PairState:
    """One pair's running state over two kinds of events: ticks of its legs, and bars of its legs."""

    def __init__(self, held: tuple | None, tolerance_ns: int, window: int, min_bars: int, every: int, bar_ns: int | None, tick_bars: bool, volume_window: int):
        self.names = [field.split()[0] for field in PAIR_STATE.split(",")]
        never, zero = [NO_TIME, NO_TIME], [0.0, 0.0]
        fresh = (zero, never, never, zero, zero, never, zero, zero, NO_TIME, NO_TIME, NO_TIME, 0, 0, 0, 0, 0.0, 0, [], [], [], [], 0, [], [], [], None, None, None, False)
        for name, value in zip(self.names, held or fresh, strict=True):
            setattr(self, name, list(value) if isinstance(value, (list, np.ndarray)) else None if pd.isna(value) else value)
        self.tolerance_ns, self.window, self.min_bars, self.every, self.bar_ns, self.tick_bars, self.volume_window = tolerance_ns, window, min_bars, every, bar_ns, tick_bars, volume_window
        self.joined: list[tuple[int, float, float, int]] = []  # row, y, x, late ticks before it
        self.told: list[tuple] = [(0, self.n_bars, self._volume(), self.t, self.p, self.half, self.cointegrated)]  # from which joined tick on

    def _volume(self) -> float | None:
        return sum(self.volumes) / len(self.volumes) if self.volumes else None

    def tick(self, row: int, leg: int, ts: int, price: float, volume: float) -> None:
        """A tick before the pair's last event is dropped and counted, and its price is not taken."""
        if ts < self.last_event:
            self.late += 1
            return
        if self.bar_ns:
            start, held = ts // self.bar_ns * self.bar_ns, self.open_ts[leg]
            if NO_TIME < held < start:
                self.close(leg, held, held + self.bar_ns, self.open_close[leg], self.open_volume[leg])
            if held < start:
                self.open_ts[leg], self.open_volume[leg] = start, 0.0
            self.open_close[leg] = price
            self.open_volume[leg] += volume
        self.price[leg], self.price_ts[leg] = price, ts
        if self.price_ts[1 - leg] == NO_TIME or abs(ts - self.price_ts[1 - leg]) > self.tolerance_ns:
            return
        self.last_event = ts
        self.joined.append((row, self.price[0], self.price[1], self.late))
        if self.tick_bars:
            self.pair_bar(self.price[0], self.price[1], None)

    def close(self, leg: int, open_ts: int, close_ts: int, close: float, volume: float) -> None:
        """A bar of one leg; with the other leg's of the same start it makes a pair bar, if that is later than the last."""
        self.bar_ts[leg], self.bar_close[leg], self.bar_volume[leg] = open_ts, close, volume
        if self.bar_ts[1 - leg] != open_ts or close_ts <= self.last_bar:
            return
        self.last_bar = close_ts
        self.pair_bar(self.bar_close[0], self.bar_close[1], min(self.bar_volume))

    def pair_bar(self, y: float, x: float, volume: float | None) -> None:
        keep = 4 * self.min_bars
        self.n_bars += 1
        self.since += 1
        self.bar_ys, self.bar_xs = [*self.bar_ys, y][-keep:], [*self.bar_xs, x][-keep:]
        if volume is not None:
            self.volumes = [*self.volumes, volume][-self.volume_window :]
        if len(self.bar_ys) >= self.min_bars and self.since >= self.every:
            self.since = 0
            t, p, half, tied = retest(np.array(self.bar_ys), np.array(self.bar_xs))
            if t is not None:  # a test that cannot be made leaves the last one standing
                self.t, self.p, self.half, self.cointegrated = t, p, half, tied
        # A tick that is a bar itself shows its own retest; other bars come before the ticks after them.
        self.told.append((len(self.joined) - self.tick_bars, self.n_bars, self._volume(), self.t, self.p, self.half, self.cointegrated))

    def snapshots(self, ts: np.ndarray, publish_ns: int) -> list[tuple[int, tuple]]:
        """(row, snapshot) of the joined ticks that are published."""
        out, starts = [], np.array([m[0] for m in self.told])
        for i in range(0, len(self.joined), PAIR_CHUNK):
            part = self.joined[i : i + PAIR_CHUNK]
            rows, y, x = np.array([j[0] for j in part]), np.array([j[1] for j in part]), np.array([j[2] for j in part])
            my, dy, m = _moments(_frames(self.ys, y, self.window))
            mx, dx, _ = _moments(_frames(self.xs, x, self.window))
            vx, vy, cov = (dx * dx).sum(axis=1) / m, (dy * dy).sum(axis=1) / m, (dx * dy).sum(axis=1) / m
            moves = vx >= 1e-12
            beta = pd.Series(np.where(moves, cov / np.where(moves, vx, 1.0), np.nan)).ffill().fillna(self.beta).to_numpy()
            self.frozen += int((~moves).sum())
            intercept = my - beta * mx
            _, db, mb = _moments(_frames(self.betas, beta, max(self.window // 4, 2)))
            spread = y - beta * x - intercept
            frames = _frames(self.spreads, spread, self.window)
            ms, ds, mm = _moments(frames)
            sd = np.sqrt((ds * ds).sum(axis=1) / mm)
            z = np.where(sd > 1e-12, (spread - ms) / np.where(sd > 1e-12, sd, 1.0), 0.0)
            (self.position,), position, signal = K.reversion((self.position,), z)
            den = np.sqrt(vx * vy)
            corr = np.where(den < 1e-12, 0.0, np.clip(cov / np.where(den < 1e-12, 1.0, den), -1, 1))
            count, beta_sd = np.count_nonzero(~np.isnan(frames), axis=1), np.sqrt((db * db).sum(axis=1) / mb)
            last, keep = throttle(None if self.last_publish == NO_TIME else self.last_publish, ts[rows], publish_ns)
            self.last_publish = NO_TIME if last is None else last
            for k in np.flatnonzero(keep):
                _, bars, volume, *test = self.told[int(np.searchsorted(starts, i + k, "right")) - 1]
                n = self.n_ticks + int(k) + 1
                numbers = (y[k], x[k], beta[k], intercept[k], beta_sd[k], corr[k], spread[k], z[k])
                out.append((int(rows[k]), (*map(float, numbers), int(count[k]), SIGNALS[int(signal[k])], int(position[k]), *test, n >= 8, n, bars, part[k][3], volume)))
            few = max(self.window // 4, 2)
            self.n_ticks += len(part)
            self.beta = float(beta[-1])
            self.ys, self.xs = [*self.ys, *y.tolist()][-self.window :], [*self.xs, *x.tolist()][-self.window :]
            self.betas, self.spreads = [*self.betas, *beta.tolist()][-few:], [*self.spreads, *spread.tolist()][-self.window :]
        return out

    def held(self) -> tuple:
        return tuple(getattr(self, name) for name in self.names)


def pair_step(state: tuple | None, events: pd.DataFrame, tolerance_ns: int, window: int = 256, min_bars: int = 64, every: int = 64, publish_ns: int = 1_000_000, bar_ns: int | None = None, volume_window: int = 64, tick_bars: bool = False) -> tuple[tuple, list[tuple[int, tuple]]]:
    """P16 event by event: gives the state, which follows PAIR_STATE, and (row, snapshot) for each tick that is published.

    ``events``: is_y (which leg), is_bar, ts_ns (of a bar: its close), open_ts (of a bar), price, volume, in order of
    arrival. Ticks move the hedge, the spread and the signal; both legs must have a price, neither older than the other
    by more than ``tolerance_ns``. Bars with the same start on both legs move the volume mean and, every ``every`` of
    them, the retest over the last 4 * ``min_bars``. ``bar_ns`` makes bars from the ticks; ``tick_bars`` counts each
    joined tick as a bar. Late ticks are dropped and counted.
    """
    own = PairState(state, tolerance_ns, window, min_bars, every, bar_ns, tick_bars, volume_window)
    ts = events["ts_ns"].to_numpy()
    columns = (events["is_y"], events["is_bar"], events["ts_ns"], events["open_ts"], events["price"], events["volume"])
    for i, (is_y, is_bar, at, open_ts, price, volume) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
        leg = 0 if is_y else 1
        if is_bar:
            own.close(leg, int(open_ts), at, price, volume)
        else:
            own.tick(i, leg, at, price, volume)
    made = own.snapshots(ts, publish_ns)
    return own.held(), made


def select_pairs(snaps: DataFrame, min_n: int = 64, min_corr: float = 0.5, max_p: float = 0.05, half: tuple[float, float] = (1.0, 100.0), max_beta_stdev: float = 0.5, min_volume: float = 0.0) -> DataFrame:
    """Screen and rank, best first."""
    ok = (F.col("n") >= min_n) & (F.abs("corr") >= min_corr) & (F.col("p_value") <= max_p) & F.col("half_life").between(*half) & (F.col("beta_stdev") <= max_beta_stdev) & (F.col("avg_volume") >= min_volume)
    rank = 0.4 * (1 - F.col("p_value")) + 0.4 * F.abs("corr") + 0.2 / (1 + F.col("half_life"))
    return snaps.where(ok).withColumn("rank", rank).orderBy(F.desc("rank"))


def ou_fit(df: DataFrame, keys: list[str], col: str, dt: float = 1.0, length: int | None = None) -> DataFrame:
    """Mean reversion from an AR(1) fit; null outside 0 < b < 1."""
    d = over_rows(df, keys, 2, lambda rows, w: rows.withColumn("_l", F.lag(col).over(w)), length=length).where("_l is not null")
    fit = d.groupBy(*keys).agg(F.count("*").alias("m"), F.regr_slope(col, "_l").alias("b"), F.regr_intercept(col, "_l").alias("a"), F.regr_syy(col, "_l").alias("_syy"), F.regr_sxy(col, "_l").alias("_sxy"))
    ok = (F.col("b") > 0) & (F.col("b") < 1) & (F.col("m") > 2)
    b = F.when(ok, F.col("b"))
    theta = -F.ln(b) / dt
    var = F.greatest(F.col("_syy") - F.col("b") * F.col("_sxy"), F.lit(0.0)) / (F.col("m") - 2)
    return fit.withColumn("theta", theta).withColumn("mu", F.col("a") / (1 - b)).withColumn("sigma", F.sqrt(var * 2 * theta / (1 - b * b))).withColumn("half_life", math.log(2) / theta).drop("_syy", "_sxy")


def ou_expected(x0: Column, t: float) -> tuple[Column, Column]:
    """Expected value and variance after time t, from theta, mu and sigma."""
    e = F.exp(-F.col("theta") * t)
    return F.col("mu") + (x0 - F.col("mu")) * e, F.pow(F.col("sigma"), F.lit(2)) / (2 * F.col("theta")) * (1 - e * e)


def pair_states(df: DataFrame, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, key: str = "pair", opened: str | None = None, length: int | None = None) -> DataFrame:
    """``state`` after each z (normal, diverged, converging, position_open), ``side`` and ``leave``.

    A normal pair diverges at |z| >= entry; a diverged one converges at |z| <= leave and is normal again at
    |z| >= stop; a converging one is normal again at the next |z| <= leave; an open position ends at either. The
    boolean column ``opened`` says after which rows the caller opened a position. ``side`` is the entry signal of a
    diverged pair (-1: short y and long x, for a z above 0; 1: the other way), ``leave`` whether to get out:
    converging, or open with z at an end.
    """
    own = df.withColumn("_open", F.coalesce(F.col(opened), F.lit(False)) if opened else F.lit(False))

    def step(state, p: pd.DataFrame):
        state, out = K.pair_states(state, p["z"].to_numpy(), p["_open"].to_numpy(), entry, leave, stop)
        return state, {"_s": out}

    end = lambda held, p: K.pair_states((held,), p["z"].to_numpy(), p["_open"].to_numpy(), entry, leave, stop)[0][0]
    made = scan(own, [key], ["ts_ns"], step, "_s int", K.machine_carry([0, 1, 2, 3], end), length)
    z, s = F.col("z"), F.col("_s")
    is_open = (s == K.OPEN) | F.col("_open")
    state = F.when(F.col("_open"), F.lit("position_open")).otherwise(F.element_at(F.array(*map(F.lit, K.PAIR_STATES)), s + 1))
    gone = (s == K.CONVERGING) & ~F.col("_open") | is_open & ((F.abs(z) <= leave) | (F.abs(z) >= stop))
    side = F.when((s == K.DIVERGED) & ~F.col("_open") & (z > 0), -1).when((s == K.DIVERGED) & ~F.col("_open") & (z < 0), 1).otherwise(0)
    return made.withColumns({"state": state, "side": side, "leave": gone}).drop("_s", "_open")


def pair_stats_simple(df: DataFrame, key: str = "pair", length: int | None = None) -> DataFrame:
    """P20: correlation, one-lag-free unit-root t of the ratio spread, and a heuristic that is no Johansen test."""
    spread = df.withColumn("s", F.col("y") - F.col("x"))
    d = over_rows(spread, key, 2, lambda rows, w: rows.withColumn("_l", F.lag("s").over(w)), length=length).withColumn("_d", F.col("s") - F.col("_l"))
    fit = d.groupBy(key).agg(F.count("*").alias("n"), F.corr("y", "x").alias("corr"), F.regr_slope("_d", "_l").alias("slope"), F.regr_syy("_d", "_l").alias("_syy"), F.regr_sxx("_d", "_l").alias("_sxx"), F.regr_count("_d", "_l").alias("_m"))
    se = F.sqrt(F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0)) / (F.col("_m") - 2) / F.col("_sxx"))
    out = fit.withColumn("t_stat", F.try_divide("slope", se)).withColumn("p_value", F.when(F.col("t_stat") < -2.86, 0.01).otherwise(0.10))
    out = out.withColumn("half_life", F.when(F.col("slope") < 0, -math.log(2) / F.col("slope")))
    return out.withColumn("trace", F.abs("corr") * F.col("n")).withColumn("heuristic", (F.abs("corr") > 0.7) & (F.col("p_value") < 0.05) & (F.col("trace") > 15.41)).drop("_syy", "_sxx", "_m")


def pair_performance(pnl: DataFrame, key: str = "pair", length: int | None = None) -> DataFrame:
    """Counts, win %, largest loss from the top of the running P&L, mean over deviation."""
    cut = stretches(pnl, key, ("ts_ns",), length)
    run = cut.running(cut.running(cut.df, {"_c": ("sum", F.col("pnl"))}), {"_top": ("max", F.col("_c"))})
    run = cut.done(run).withColumn("_d", F.greatest(F.col("_top"), F.lit(0.0)) - F.col("_c"))
    return run.groupBy(key).agg(
        F.count("*").alias("trades"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        (F.count_if(F.col("pnl") > 0) * 100 / F.count("*")).alias("win_pct"),
        F.sum("pnl").alias("total"),
        F.max("_d").alias("max_drawdown"),
        F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("ratio"),
    )


def leg_sizes(df: DataFrame, target: float, pct: float) -> DataFrame:
    """Both legs of a position of gross min(target, pct * nav)."""
    gross = F.least(F.lit(target), F.lit(pct) * F.col("nav"))
    qy = F.try_divide(gross, F.col("y") + F.abs("beta") * F.col("x"))
    return df.withColumn("qy", qy).withColumn("qx", F.abs("beta") * F.col("qy"))


#: What became of the snapshots of a pair, as counted by pair_decisions.
OUTCOMES = ("signals", "entries", "exits", "not_ready", "screened", "repeated", "forced")


class PairsMeanReversion(Strategy):
    """P22 as a strategy: enters and leaves the two legs of a pair on the signals of P14.

    All five screens must hold: cointegrated, p-value, correlation, half-life in its band and finite. Repeats of the
    last signal are dropped (a hold resets it), a failing screen closes. Rows: ts_ns, y, x, beta, corr, p_value,
    half_life, cointegrated, ready, signal and, where there is one, nav.
    """

    out = "ts_ns long, action string, side int, qy double, qx double, reason string, " + ", ".join(f"{k} long" for k in OUTCOMES)
    defaults = {"target_gross_notional": 10_000.0, "max_gross_pct_of_nav": 0.30, "beta_hedge": 1.0, "min_half_life_bars": 2.0, "max_half_life_bars": 100.0, "max_adf_pvalue": 0.05, "min_abs_corr": 0.70}
    bounds = {
        "target_gross_notional": (1_000.0, 1_000_000.0),
        "max_gross_pct_of_nav": (0.01, 1.0),
        "beta_hedge": (0.0, 2.0),
        "min_half_life_bars": (0.5, 50.0),
        "max_half_life_bars": (5.0, 2000.0),
        "max_adf_pvalue": (0.001, 0.5),
        "min_abs_corr": (0.0, 0.99),
    }

    def check(self) -> None:
        if self.params["min_half_life_bars"] >= self.params["max_half_life_bars"]:
            raise ValueError("min_half_life_bars must be below max_half_life_bars")

    def create(self) -> dict:
        return {"side": 0, "qy": 0.0, "qx": 0.0, "acted": None, "ts": 0, "n": dict.fromkeys(OUTCOMES, 0)}

    def screened(self, s) -> bool:
        p = self.params
        ok = s.cointegrated and s.p_value <= p["max_adf_pvalue"] and abs(s.corr) >= p["min_abs_corr"]
        return bool(ok and p["min_half_life_bars"] <= s.half_life <= p["max_half_life_bars"] and math.isfinite(s.half_life))

    def legs(self, s) -> tuple[float, float] | None:
        hedge = abs(self.params["beta_hedge"] * s.beta)
        if not (s.y > 0 and s.x > 0):
            return None
        gross = min(self.params["target_gross_notional"], self.params["max_gross_pct_of_nav"] * getattr(s, "nav", math.inf))
        qy = gross / (s.y + hedge * s.x)
        return (qy, hedge * qy) if qy > 0 and hedge * qy > 0 else None

    def on_rows(self, st: dict, rows: pd.DataFrame) -> list[tuple]:
        out, n = [], st["n"]
        tell = lambda action, side, reason: out.append((int(st["ts"]), action, side, st["qy"], st["qx"], reason, *n.values()))
        for s in rows.itertuples(index=False):
            st["ts"] = s.ts_ns
            if not s.ready:
                n["not_ready"] += 1
            elif not self.screened(s):
                n["screened"] += 1
                if st["side"]:
                    n["forced"] += 1
                    tell("exit", -st["side"], "screen")
                    st["side"], st["acted"] = 0, None
            else:
                n["signals"] += 1
                if s.signal == st["acted"]:
                    n["repeated"] += 1
                    continue
                st["acted"] = s.signal
                if s.signal == "exit" and st["side"]:
                    n["exits"] += 1
                    tell("exit", -st["side"], "signal")
                    st["side"] = 0
                elif s.signal in ("long_spread", "short_spread") and not st["side"] and (legs := self.legs(s)):
                    st["qy"], st["qx"] = legs
                    st["side"] = 1 if s.signal == "long_spread" else -1
                    n["entries"] += 1
                    tell("enter", st["side"], "signal")
        return out

    def on_stop(self, st: dict) -> list[tuple]:
        """A last row with the counts: it flattens what is open, else its action is ``none``."""
        legs = (st["qy"], st["qx"]) if st["side"] else (0.0, 0.0)
        return [(int(st["ts"]), "flatten" if st["side"] else "none", -st["side"], *legs, "end", *st["n"].values())]


def pair_decisions(snaps: DataFrame, key: str = "pair", **params: float) -> DataFrame:
    """Entries, exits and a last row of each pair; ``params`` as in ``PairsMeanReversion``."""
    return run_strategy(snaps, PairsMeanReversion(**params), [key], ["ts_ns"])


def _pairs(spark, sf) -> DataFrame:
    """Daily prices of each couple of priorities: pair, ts_ns, y, x."""
    s = series(spark, sf)
    a, b = s.select(F.col("symbol").alias("ys"), "ts_ns", F.col("price").alias("y")), s.select(F.col("symbol").alias("xs"), "ts_ns", F.col("price").alias("x"))
    return a.join(b, "ts_ns").where("ys < xs").select(F.concat_ws("~", "ys", "xs").alias("pair"), "ts_ns", "y", "x")


_PAIRS = "p AS (SELECT a.symbol || '~' || b.symbol AS pair, a.ts_ns, a.price AS y, b.price AS x FROM v_series a JOIN v_series b ON a.ts_ns = b.ts_ns AND a.symbol < b.symbol)"
_N = "PARTITION BY pair ORDER BY ts_ns ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
_HEDGE = f"""{_PAIRS}, h0 AS (SELECT *, CASE WHEN coalesce(var_samp(x) OVER w, 0) >= 1e-12 THEN coalesce(covar_samp(y, x) OVER w, 0) / var_samp(x) OVER w END AS raw, avg(y) OVER w AS my, avg(x) OVER w AS mx FROM p WINDOW w AS ({_N.format(127)})),
    h1 AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER u, 0) AS beta, sum((raw IS NULL)::INT) OVER u AS frozen, count(*) OVER u >= 8 AS ready FROM h0 WINDOW u AS (PARTITION BY pair ORDER BY ts_ns ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT *, my - beta * mx AS intercept, coalesce(stddev_samp(beta) OVER ({_N.format(31)}), 0) AS beta_stdev FROM h1)"""
_SPREAD = f"""{_HEDGE}, s0 AS (SELECT *, y - beta * x - intercept AS spread FROM h), s1 AS (SELECT *, avg(spread) OVER w AS sm, coalesce(stddev_samp(spread) OVER w, 0) AS ss, count(*) OVER w AS n FROM s0 WINDOW w AS ({_N.format(127)})),
    s AS (SELECT *, CASE WHEN ss > 1e-12 THEN (spread - sm) / ss ELSE 0 END AS z FROM s1)"""


@query("p1_ols2", f"WITH {_PAIRS} SELECT pair, count(*) AS n, R2(regr_intercept(y, x)) AS a, R6(regr_slope(y, x)) AS b, R6(regr_r2(y, x)) AS r2 FROM p GROUP BY pair", "v_series")
def p1(spark, sf):
    return ols2(_pairs(spark, sf), ["pair"], "y", "x").select("pair", "n", r("a", 2), r("b"), r("r2"))


@query(
    "p2_ols",
    f"""WITH {_PAIRS}, f AS (SELECT pair, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS tss, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM p GROUP BY pair),
    g AS (SELECT *, (tss - b * sxy) AS rss FROM f) SELECT pair, n, R2(a) AS a, R6(b) AS b, R2(sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx))) AS se_a, R6(sqrt(rss / (n - 2) / sxx)) AS se_b, R4(rss / 1e10) AS rss FROM g""",
    "v_series",
)
def p2(spark, sf):
    f = ols(_pairs(spark, sf).withColumn("one", F.lit(1.0)), ["pair"], "y", ["one", "x"])
    b, s = (lambda i: F.get("beta", F.lit(i))), (lambda i: F.get("se", F.lit(i)))
    return f.select("pair", "n", r(b(0), 2).alias("a"), r(b(1)).alias("b"), r(s(0), 2).alias("se_a"), r(s(1)).alias("se_b"), r(F.col("rss") / 1e10, 4).alias("rss"))


@query("p3_hedge_static", f"WITH {_PAIRS} SELECT pair, R2(avg(y - 0.9::DOUBLE * x)) AS spread FROM p GROUP BY pair", "v_series")
def p3(spark, sf):
    return hedge_static(_pairs(spark, sf), 0.9).groupBy("pair").agg(r(F.avg(F.col("y") - F.col("beta") * F.col("x")), 2).alias("spread"))


@query("p4_hedge_rolling", f"WITH {_HEDGE} SELECT pair, ts_ns, R6(beta) AS beta, frozen::BIGINT AS frozen, R2(intercept) AS intercept, R6(beta_stdev) AS beta_stdev, ready FROM h", "v_series")
def p4(spark, sf):
    return hedge_rolling(_pairs(spark, sf), 128).select("pair", "ts_ns", r("beta"), F.col("frozen").cast("long").alias("frozen"), r("intercept", 2), r("beta_stdev"), "ready")


_KALMAN = """d AS (SELECT *, CASE WHEN {v} > 0 AND lag({v}) OVER (PARTITION BY pair ORDER BY i) > 0 THEN ln({v} / lag({v}) OVER (PARTITION BY pair ORDER BY i)) END AS ret FROM b), n AS (SELECT pair, greatest(coalesce(var_samp(ret), 0), 1e-12) AS noise FROM d WHERE i <= 64 GROUP BY pair),
    k(pair, ts_ns, i, v, level, p) AS (SELECT pair, ts_ns, i, {v}, {v}, 1.0::DOUBLE FROM b WHERE i = 1 UNION ALL
      SELECT b.pair, b.ts_ns, b.i, b.{v}, CASE WHEN b.i < 64 THEN 0.5 * k.level + 0.5 * b.{v} ELSE k.level + (k.p + noise * 0.01) / (k.p + noise * 0.01 + noise) * (b.{v} - k.level) END,
        CASE WHEN b.i < 64 THEN k.p ELSE (1 - (k.p + noise * 0.01) / (k.p + noise * 0.01 + noise)) * (k.p + noise * 0.01) END
      FROM k JOIN b ON b.pair = k.pair AND b.i = k.i + 1 JOIN n ON n.pair = k.pair)"""


@query("p5_hedge_kalman_smoothed", f"WITH RECURSIVE {_HEDGE}, b AS (SELECT pair, ts_ns, beta, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM h), {_KALMAN.format(v='beta')} SELECT pair, ts_ns, R6(v) AS beta, R6(level) AS beta_smoothed FROM k", "v_series")
def p5(spark, sf):
    return hedge_kalman_smoothed(_pairs(spark, sf), 128).select("pair", "ts_ns", r("beta"), r("beta_smoothed"))


@query(
    "p6_hedge_kalman2",
    f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT pair, ts_ns, y / 1e5 AS y, x / 1e5 AS x, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM p),
    k(pair, ts_ns, i, a, b, e, p00, p01, p11) AS (SELECT DISTINCT pair, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM b UNION ALL
      SELECT pair, ts_ns, i, a + k0 * e, b + k1 * e, e, ((1 - k0) * q00 - k0 * x * p01) * (1 - k0) - ((1 - k0) * p01 - k0 * x * q11) * k0 * x + k0 * 1e-3 * k0,
        -((1 - k0) * q00 - k0 * x * p01) * k1 + ((1 - k0) * p01 - k0 * x * q11) * (1 - k1 * x) + k0 * 1e-3 * k1, -(-k1 * q00 + (1 - k1 * x) * p01) * k1 + (-k1 * p01 + (1 - k1 * x) * q11) * (1 - k1 * x) + k1 * 1e-3 * k1
      FROM (SELECT *, (q00 + x * p01) / s AS k0, (p01 + x * q11) / s AS k1 FROM
        (SELECT *, q00 + 2 * x * p01 + x * x * q11 + 1e-3 AS s, y - a - b * x AS e FROM (SELECT o.pair, o.ts_ns, o.i, o.y, o.x, k.a, k.b, k.p00 + 1e-7 AS q00, k.p01, k.p11 + 1e-7 AS q11 FROM k JOIN b o ON o.pair = k.pair AND o.i = k.i + 1))))
    SELECT pair, ts_ns, R6(a) AS alpha, R6(b) AS beta, R6(e) AS innovation FROM k WHERE i > 0""",
    "v_series",
)
def p6(spark, sf):
    scaled = _pairs(spark, sf).withColumn("y", F.col("y") / 1e5).withColumn("x", F.col("x") / 1e5)
    return hedge_kalman2(scaled).select("pair", "ts_ns", r("alpha"), r("beta"), r("innovation"))


@query("p7_spread_z", f"WITH {_SPREAD} SELECT pair, ts_ns, R2(spread) AS spread, R4(z) AS z, n FROM s WHERE ready", "v_series")
def p7(spark, sf):
    return spread_z(hedge_rolling(_pairs(spark, sf), 128), 128).where("ready").select("pair", "ts_ns", r("spread", 2), r("z", 4), "n")


#: No constant and one lag: two regressors, solved in closed form.
_ADF1 = """{src}, d0 AS (SELECT *, lag(v) OVER (PARTITION BY {k} ORDER BY ts_ns) AS l FROM src), d1 AS (SELECT *, v - l AS d FROM d0), d2 AS (SELECT *, lag(d) OVER (PARTITION BY {k} ORDER BY ts_ns) AS e FROM d1),
    g AS (SELECT {k}, count(*) AS n, sum(l * l) AS a, sum(l * e) AS b, sum(e * e) AS c, sum(l * d) AS u, sum(e * d) AS w, sum(d * d) AS q FROM d2 WHERE e IS NOT NULL GROUP BY {k}),
    o AS (SELECT *, (c * u - b * w) / (a * c - b * b) AS r0, (a * w - b * u) / (a * c - b * b) AS r1, c / (a * c - b * b) AS i FROM g),
    t AS (SELECT {k}, n, r0 / sqrt((q - r0 * u - r1 * w) / (n - 2) * i) AS t_stat FROM o WHERE n >= 6)"""
_MP = "CASE WHEN t_stat <= {0} THEN 0.001 WHEN t_stat <= {1} THEN 0.01 + (t_stat - {0}) / ({1} - {0}) * 0.04 WHEN t_stat <= {2} THEN 0.05 + (t_stat - {1}) / ({2} - {1}) * 0.05 ELSE least(0.2, 0.1 + (t_stat - {2}) * 0.05) END"


def _mp(table: str) -> str:
    return _MP.format(*(f"({c}::DOUBLE)" for c in CRITICAL[table]))


@query("p8_adf", f"WITH {_ADF1.format(src='src AS (SELECT symbol, ts_ns, price - 250000 AS v FROM v_series)', k='symbol')} SELECT symbol, n, R4(t_stat) AS t_stat, R6({_mp('no_constant')}) AS p_value FROM t", "v_series")
def p8(spark, sf):
    return adf(series(spark, sf).withColumn("v", F.col("price") - 250000), ["symbol"], "v").select("symbol", "n", r("t_stat", 4), r("p_value"))


def _normal_equations(p: int) -> str:
    """SQL that solves the p + 1 sums of products g(k, i, j, v) by elimination: the inverse's corner, the fit and its rest."""
    out = []
    for step in range(p):
        before, after = f"e{step}", f"e{step + 1}"
        out.append(f"{after} AS (SELECT a.k, a.i, a.j, CASE WHEN a.i = {step} THEN a.v / d.v ELSE a.v - l.v * u.v / d.v END AS v FROM {before} a JOIN {before} d ON d.k = a.k AND d.i = {step} AND d.j = {step} JOIN {before} l ON l.k = a.k AND l.i = a.i AND l.j = {step} JOIN {before} u ON u.k = a.k AND u.i = {step} AND u.j = a.j)")
    return ", ".join(out)


def _schwert_sql(lag: int) -> str:
    """One branch of P9: regressors level, ``lag`` changes and a constant; columns p + 1 and on are the unit matrix."""
    xs = ["l", *[f"d{i}" for i in range(1, lag + 1)], "1.0"]
    p = len(xs)
    lags = ", ".join(f"lag(d, {i}) OVER (PARTITION BY symbol ORDER BY ts_ns) AS d{i}" for i in range(1, lag + 1))
    cols = [*xs, "d"]
    cells = " UNION ALL ".join(f"SELECT symbol AS k, {i} AS i, {j} AS j, sum({a} * {b})::DOUBLE AS v FROM r GROUP BY symbol" for i, a in enumerate(cols[:p]) for j, b in enumerate(cols))
    unit = f"SELECT k, i, {p + 1} AS j, (i = 0)::INT::DOUBLE AS v FROM (SELECT DISTINCT k, i FROM c)"
    return f"""(WITH s AS (SELECT *, price - 250000 AS q, 1 + 0 * count(*) OVER (PARTITION BY symbol) AS one, greatest(1, least(4, floor(12 * pow(count(*) OVER (PARTITION BY symbol) / 100.0, 0.25))))::INT AS lags FROM v_series),
        a AS (SELECT *, q - lag(q) OVER (PARTITION BY symbol ORDER BY ts_ns) AS d, lag(q) OVER (PARTITION BY symbol ORDER BY ts_ns) AS l FROM s WHERE lags = {lag}), b AS (SELECT *, {lags} FROM a), r AS (SELECT * FROM b WHERE d{lag} IS NOT NULL AND l IS NOT NULL),
        c AS ({cells}), e0 AS (SELECT * FROM c UNION ALL {unit}), {_normal_equations(p)},
        f AS (SELECT k, max(CASE WHEN i = 0 AND j = {p} THEN v END) AS beta, max(CASE WHEN i = 0 AND j = {p + 1} THEN v END) AS inv FROM e{p} GROUP BY k),
        y AS (SELECT e.k, sum(e.v * c.v) AS fitted FROM e{p} e JOIN c ON c.k = e.k AND c.i = e.i AND c.j = {p} WHERE e.j = {p} GROUP BY e.k), t AS (SELECT symbol AS k, count(*) AS n, sum(d * d) AS q FROM r GROUP BY symbol)
      SELECT f.k AS symbol, {lag}::INT AS lag, n, beta / sqrt((q - fitted) / (n - {p}) * inv) AS t_stat FROM f JOIN y ON y.k = f.k JOIN t ON t.k = f.k WHERE n >= {p + 4})"""


@query("p9_adf_schwert", f"WITH t AS ({' UNION ALL '.join(_schwert_sql(k) for k in range(1, 5))}) SELECT symbol, lag, n, R4(t_stat) AS t_stat, R6({_mp('constant')}) AS p_value FROM t", "v_series")
def p9(spark, sf):
    return adf(series(spark, sf).withColumn("q", F.col("price") - 250000), ["symbol"], "q", "constant", "schwert").select("symbol", "lag", "n", r("t_stat", 4), r("p_value"))


@query("p10_mackinnon_p", f"WITH t AS (SELECT ts_ns, (price - 250000) / 10000 - 2 AS t_stat FROM v_series) SELECT ts_ns, R6(t_stat) AS t_stat, R6({_mp('constant')}) AS p_value FROM t", "v_series")
def p10(spark, sf):
    t = series(spark, sf).select("ts_ns", ((F.col("price") - 250000) / 10000 - 2).alias("t_stat"))
    return t.select("ts_ns", r("t_stat"), r(mackinnon_p(F.col("t_stat"), "constant")).alias("p_value"))


_EG = f"""{_PAIRS}, f AS (SELECT pair, regr_intercept(y, x) AS ia, regr_slope(y, x) AS ib FROM p GROUP BY pair), """ + _ADF1.format(src="src AS (SELECT p.pair, ts_ns, y - ia - ib * x AS v FROM p JOIN f ON f.pair = p.pair)", k="pair")


@query("p11_engle_granger", f"WITH {_EG} SELECT t.pair, R6(ib) AS b, R4(t_stat) AS t_stat, R6({_mp('cointegration')}) AS p_value, {_mp('cointegration')} < 0.05 AND abs(ib) > 1e-9 AS cointegrated FROM t JOIN f ON f.pair = t.pair", "v_series")
def p11(spark, sf):
    return engle_granger(_pairs(spark, sf), ["pair"]).select("pair", r("b"), r("t_stat", 4), r("p_value"), "cointegrated")


_HL = "h0 AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts_ns) AS l FROM v_series), h1 AS (SELECT symbol, count(*) AS n, regr_slope(price - l, l) AS slope FROM h0 WHERE l IS NOT NULL GROUP BY symbol)"


@query("p12_half_life", f"WITH {_HL} SELECT symbol, n, R6(slope) AS slope, R6(CASE WHEN n >= 8 AND abs(1 + slope) < 1 AND abs(1 + slope) > 1e-12 THEN -ln(2) / ln(abs(1 + slope)) END) AS half_life FROM h1", "v_series")
def p12(spark, sf):
    return half_life(series(spark, sf), ["symbol"], "price").select("symbol", "n", r("slope"), r("half_life"))


@query("p13_significance", f"WITH t AS (SELECT symbol, ts_ns, (price - 250000) / 10000 - 3 AS t_stat FROM v_series), p AS (SELECT *, {_mp('constant')} AS p FROM t) SELECT symbol, CASE WHEN p < 0.01 THEN 'strong' WHEN p < 0.1 THEN 'moderate' ELSE 'weak' END AS bucket, count(*) AS n FROM p GROUP BY 1, 2", "v_series")
def p13(spark, sf):
    t = series(spark, sf).select("symbol", ((F.col("price") - 250000) / 10000 - 3).alias("t"))
    return t.groupBy("symbol", significance(mackinnon_p(F.col("t"), "constant")).alias("bucket")).agg(F.count("*").alias("n"))


_SIGNALS = f"""WITH RECURSIVE {_SPREAD}, k AS (SELECT pair, ts_ns, CASE WHEN abs(z) < 1e300 THEN z END AS z, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM s),
    m(pair, i, ts_ns, z, pos, sig) AS (SELECT pair, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0, 'hold' FROM (SELECT DISTINCT pair FROM k) UNION ALL
      SELECT k.pair, k.i, k.ts_ns, k.z, CASE WHEN m.pos = 0 THEN CASE WHEN k.z >= 2 THEN -1 WHEN k.z <= -2 THEN 1 ELSE 0 END WHEN abs(k.z) >= 4 OR (m.pos = 1 AND k.z >= -0.5) OR (m.pos = -1 AND k.z <= 0.5) THEN 0 ELSE m.pos END,
        CASE WHEN m.pos = 0 THEN CASE WHEN k.z >= 2 THEN 'short_spread' WHEN k.z <= -2 THEN 'long_spread' ELSE 'hold' END WHEN abs(k.z) >= 4 OR (m.pos = 1 AND k.z >= -0.5) OR (m.pos = -1 AND k.z <= 0.5) THEN 'exit' ELSE 'hold' END
      FROM m JOIN k ON k.pair = m.pair AND k.i = m.i + 1)"""


@query("p14_reversion_signals", f"{_SIGNALS} SELECT pair, ts_ns, pos::BIGINT AS position, sig AS signal FROM m WHERE i > 0", "v_series")
def p14(spark, sf):
    return reversion_signals(spread_z(hedge_rolling(_pairs(spark, sf), 128), 128)).select("pair", "ts_ns", "position", "signal")


_RETEST = f"""{_PAIRS}, ob AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM p), z AS (SELECT pair AS q, unnest(range(64, max(i) + 1, 64)) AS retest FROM ob GROUP BY pair),
    w AS (SELECT pair || '#' || retest AS key, ob.pair, retest, ts_ns, y, x FROM ob JOIN z ON z.q = ob.pair AND ob.i <= retest AND ob.i > retest - 256), f AS (SELECT key, any_value(pair) AS pair, any_value(retest) AS retest, count(*) AS n, regr_intercept(y, x) AS ia, regr_slope(y, x) AS ib FROM w GROUP BY key), """ + _ADF1.format(
    src="src AS (SELECT w.key, ts_ns, y - ia - ib * x AS v FROM w JOIN f ON f.key = w.key)", k="key"
) + """, hl AS (SELECT key, count(*) AS m, abs(1 + regr_slope(d, l)) AS phi FROM d1 WHERE l IS NOT NULL GROUP BY key),
    tests AS (SELECT f.*, t_stat, CASE WHEN m >= 8 AND phi < 1 AND phi > 1e-12 THEN -ln(2) / ln(phi) END AS half_life FROM f LEFT JOIN t ON t.key = f.key LEFT JOIN hl ON hl.key = f.key)"""


@query(
    "p15_rolling_cointegration",
    f"WITH {_RETEST} SELECT pair, retest, n, R6(ib) AS b, R4(t_stat) AS t_stat, R6({_mp('cointegration')}) AS p_value, {_mp('cointegration')} < 0.05 AND abs(ib) > 1e-9 AS cointegrated, R4(half_life) AS half_life FROM tests",
    "v_series",
)
def p15(spark, sf):
    return rolling_cointegration(_pairs(spark, sf)).select("pair", F.col("retest").cast("long").alias("retest"), "n", r("b"), r("t_stat", 4), r("p_value"), "cointegrated", r("half_life", 4))


_SNAPS = f"""WITH RECURSIVE {_SIGNALS.removeprefix('WITH RECURSIVE ')}, {_RETEST.removeprefix(_PAIRS + ', ')}, told AS (SELECT ob.pair, ob.ts_ns, {_mp('cointegration')} AS p_value, half_life, {_mp('cointegration')} < 0.05 AND abs(ib) > 1e-9 AS cointegrated FROM tests JOIN ob ON ob.pair = tests.pair AND ob.i = retest),
    c AS (SELECT *, coalesce(covar_samp(y, x) OVER w, 0) AS cov, sqrt(coalesce(var_samp(y) OVER w, 0) * coalesce(var_samp(x) OVER w, 0)) AS den FROM s WINDOW w AS ({_N.format(127)})),
    snaps AS (SELECT c.*, CASE WHEN den < 1e-12 THEN 0 ELSE greatest(-1, least(1, cov / den)) END AS corr, sig AS signal, pos AS position, p_value, half_life, cointegrated FROM c JOIN m ON m.pair = c.pair AND m.ts_ns = c.ts_ns AND m.i > 0 ASOF LEFT JOIN told ON told.pair = c.pair AND c.ts_ns >= told.ts_ns)"""


@query("p16_pair_snapshots", f"{_SNAPS} SELECT pair, ts_ns, R6(beta) AS beta, R6(corr) AS corr, R4(CASE WHEN ready THEN z END) AS z, signal, position::BIGINT AS position, R6(p_value) AS adf_p_value, R4(half_life) AS half_life, ready FROM snaps", "v_series")
def p16(spark, sf):
    s = pair_snapshots(_pairs(spark, sf), 128)
    return s.select("pair", "ts_ns", r("beta"), r("corr"), r(F.when(F.col("ready"), F.col("z")), 4).alias("z"), "signal", "position", r("adf_p_value"), r("half_life", 4), "ready")


@query("p17_select_pairs", f"""WITH {_PAIRS}, c AS (SELECT pair, count(*) AS n, corr(y, x) AS corr FROM p GROUP BY pair), h AS (SELECT *, 0.01::DOUBLE * (n % 7) AS p_value, 1.0::DOUBLE + n % 5 AS half_life FROM c)
    SELECT pair, R6(0.4 * (1 - p_value) + 0.4 * abs(corr) + 0.2 / (1 + half_life)) AS rank FROM h WHERE n >= 64 AND abs(corr) >= 0.001 AND p_value <= 0.05 AND half_life BETWEEN 1 AND 100""", "v_series")
def p17(spark, sf):
    c = _pairs(spark, sf).groupBy("pair").agg(F.count("*").alias("n"), F.corr("y", "x").alias("corr"))
    snaps = c.withColumns({"p_value": F.lit(0.01) * (F.col("n") % 7), "half_life": F.lit(1.0) + F.col("n") % 5, "beta_stdev": F.lit(0.0), "avg_volume": F.lit(1.0)})
    return select_pairs(snaps, min_corr=0.001).select("pair", r("rank"))


@query(
    "p18_ou_fit",
    """WITH l AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts_ns) AS l FROM v_series), f AS (SELECT symbol, count(*) AS m, regr_slope(price, l) AS b, regr_intercept(price, l) AS a, regr_syy(price, l) AS syy, regr_sxy(price, l) AS sxy FROM l WHERE l IS NOT NULL GROUP BY symbol),
    g AS (SELECT *, CASE WHEN b > 0 AND b < 1 AND m > 2 THEN b END AS k FROM f) SELECT symbol, m, R6(-ln(k)) AS theta, R2(a / (1 - k)) AS mu, R2(sqrt(greatest(syy - b * sxy, 0) / (m - 2) * 2 * -ln(k) / (1 - k * k))) AS sigma, R6(ln(2) / -ln(k)) AS half_life FROM g""",
    "v_series",
)
def p18(spark, sf):
    return ou_fit(series(spark, sf), ["symbol"], "price").select("symbol", "m", r("theta"), r("mu", 2), r("sigma", 2), r("half_life"))


@query(
    "p19_pair_states",
    f"""WITH RECURSIVE {_SPREAD}, k AS (SELECT pair, ts_ns, z, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM s),
    q(pair, i, ts_ns, z, state) AS (SELECT DISTINCT pair, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 'normal' FROM k UNION ALL SELECT k.pair, k.i, k.ts_ns, k.z,
      CASE WHEN k.i % 50 = 0 THEN 'position_open' WHEN state = 'normal' THEN CASE WHEN abs(k.z) >= 2 THEN 'diverged' ELSE 'normal' END WHEN state = 'diverged' THEN CASE WHEN abs(k.z) <= 0.5 THEN 'converging' WHEN abs(k.z) >= 3 THEN 'normal' ELSE 'diverged' END
        WHEN state = 'converging' THEN CASE WHEN abs(k.z) <= 0.5 THEN 'normal' ELSE 'converging' END WHEN abs(k.z) <= 0.5 OR abs(k.z) >= 3 THEN 'normal' ELSE 'position_open' END FROM q JOIN k ON k.pair = q.pair AND k.i = q.i + 1)
    SELECT pair, ts_ns, state, CASE WHEN state = 'diverged' THEN -sign(z)::INT ELSE 0 END AS side, state = 'converging' OR (state = 'position_open' AND (abs(z) <= 0.5 OR abs(z) >= 3)) AS leave FROM q WHERE i > 0""",
    "v_series",
)
def p19(spark, sf):
    s = spread_z(hedge_rolling(_pairs(spark, sf), 128), 128)
    opened = s.withColumn("opened", F.row_number().over(Window.partitionBy("pair").orderBy("ts_ns")) % 50 == 0)
    return pair_states(opened, stop=3.0, opened="opened").select("pair", "ts_ns", "state", "side", "leave")


@query(
    "p20_pair_stats_simple",
    f"""WITH {_PAIRS}, l AS (SELECT *, y - x AS s, lag(y - x) OVER (PARTITION BY pair ORDER BY ts_ns) AS l FROM p), f AS (SELECT pair, count(*) AS n, corr(y, x) AS corr, regr_slope(s - l, l) AS slope, regr_syy(s - l, l) AS syy, regr_sxx(s - l, l) AS sxx, regr_count(s - l, l) AS m FROM l GROUP BY pair),
    t AS (SELECT *, slope / sqrt(greatest(syy - slope * slope * sxx, 0) / (m - 2) / sxx) AS t_stat FROM f)
    SELECT pair, n, R6(corr) AS corr, R4(t_stat) AS t_stat, CASE WHEN t_stat < -2.86 THEN 0.01 ELSE 0.1 END::DOUBLE AS p_value, R6(CASE WHEN slope < 0 THEN -ln(2) / slope END) AS half_life, abs(corr) > 0.7 AND t_stat < -2.86 AND abs(corr) * n > 15.41 AS heuristic FROM t""",
    "v_series",
)
def p20(spark, sf):
    return pair_stats_simple(_pairs(spark, sf)).select("pair", "n", r("corr"), r("t_stat", 4), "p_value", r("half_life"), "heuristic")


@query(
    "p21_pair_performance",
    f"""WITH {_PAIRS}, q AS (SELECT pair, ts_ns, (y - x) / 1000 AS pnl FROM p), c AS (SELECT *, sum(pnl) OVER (PARTITION BY pair ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS c FROM q),
    d AS (SELECT *, greatest(max(c) OVER (PARTITION BY pair ORDER BY ts_ns ROWS UNBOUNDED PRECEDING), 0) - c AS d FROM c)
    SELECT pair, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, R6(count(*) FILTER (pnl > 0) * 100.0 / count(*)) AS win_pct, R4(sum(pnl)) AS total, R4(max(d)) AS max_drawdown, R6(avg(pnl) / stddev_samp(pnl)) AS ratio FROM d GROUP BY pair""",
    "v_series",
)
def p21(spark, sf):
    pnl = _pairs(spark, sf).select("pair", "ts_ns", ((F.col("y") - F.col("x")) / 1000).alias("pnl"))
    return pair_performance(pnl).select("pair", "trades", "wins", r("win_pct"), r("total", 4), r("max_drawdown", 4), r("ratio"))


_OK = "cointegrated AND p_value <= 0.2 AND abs(corr) >= 0.05 AND half_life >= 0.5 AND half_life <= 100"


#: Daily prices of the tables have no memory; their means over 20 days revert slowly enough to be traded.
_SMOOTH = _PAIRS.replace("p AS (", "p AS (SELECT pair, ts_ns, avg(y) OVER w AS y, avg(x) OVER w AS x FROM (") + " WINDOW w AS (PARTITION BY pair ORDER BY ts_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


@query(
    "p22_pair_decisions",
    f"""{_SNAPS.replace(_PAIRS, _SMOOTH)}, v AS (SELECT pair, ts_ns, y, x, beta, signal, ready, coalesce({_OK}, false) AS ok, row_number() OVER (PARTITION BY pair ORDER BY ts_ns) AS i FROM snaps),
    sized AS (SELECT *, least(10000.0, 0.3 * 20000) / (y + abs(beta) * x) AS uy FROM v), legs AS (SELECT *, y > 0 AND x > 0 AND uy > 0 AND abs(beta) * uy > 0 AS fits FROM sized),
    j(pair, i, ts_ns, side, acted, action, told, qy, qx, reason, signals, entries, exits, not_ready, screened, repeated, forced) AS (
      SELECT DISTINCT pair, 0::BIGINT, 0::BIGINT, 0, NULL::VARCHAR, NULL::VARCHAR, 0, 0.0::DOUBLE, 0.0::DOUBLE, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM legs UNION ALL
      SELECT pair, i, ts_ns, CASE WHEN NOT ready THEN side WHEN NOT ok THEN 0 WHEN enters THEN way WHEN leaves THEN 0 ELSE side END, CASE WHEN NOT ready THEN acted WHEN NOT ok THEN CASE WHEN side <> 0 THEN NULL ELSE acted END ELSE signal END,
        CASE WHEN forces OR leaves THEN 'exit' WHEN enters THEN 'enter' END, CASE WHEN forces OR leaves THEN -side WHEN enters THEN way ELSE 0 END, CASE WHEN enters THEN uy ELSE qy END, CASE WHEN enters THEN abs(beta) * uy ELSE qx END, CASE WHEN forces THEN 'screen' WHEN enters OR leaves THEN 'signal' END,
        signals + (ready AND ok)::INT, entries + enters::INT, exits + leaves::INT, not_ready + (NOT ready)::INT, screened + (ready AND NOT ok)::INT, repeated + (ready AND ok AND same)::INT, forced + forces::INT
      FROM (SELECT *, ready AND ok AND NOT same AND signal = 'exit' AND side <> 0 AS leaves, ready AND ok AND NOT same AND signal IN ('long_spread', 'short_spread') AND side = 0 AND fits AS enters, ready AND NOT ok AND side <> 0 AS forces, CASE WHEN signal = 'long_spread' THEN 1 ELSE -1 END AS way FROM
        (SELECT l.pair, l.i, l.ts_ns, l.beta, l.signal, l.ready, l.ok, l.uy, l.fits, j.side, j.acted, j.qy, j.qx, j.signals, j.entries, j.exits, j.not_ready, j.screened, j.repeated, j.forced, coalesce(l.signal = j.acted, false) AS same FROM j JOIN legs l ON l.pair = j.pair AND l.i = j.i + 1))),
    ends AS (SELECT * FROM j QUALIFY i = max(i) OVER (PARTITION BY pair))
    SELECT pair, ts_ns, action, told AS side, R6(qy) AS qy, R6(qx) AS qx, reason, signals, entries, exits, not_ready, screened, repeated, forced FROM j WHERE action IS NOT NULL
    UNION ALL SELECT pair, ts_ns, CASE WHEN side <> 0 THEN 'flatten' ELSE 'none' END, -side, R6(CASE WHEN side <> 0 THEN qy ELSE 0 END), R6(CASE WHEN side <> 0 THEN qx ELSE 0 END), 'end', signals, entries, exits, not_ready, screened, repeated, forced FROM ends""",
    "v_series",
)
def p22(spark, sf):
    from .windows import over_last

    smooth = over_last(_pairs(spark, sf), 20, lambda d, w: d.withColumns({"y": F.avg("y").over(w), "x": F.avg("x").over(w)}), "pair", ("ts_ns",))
    snaps = pair_snapshots(smooth, 128).withColumnRenamed("adf_p_value", "p_value").withColumn("nav", F.lit(20_000.0))
    columns = ("pair", "ts_ns", "y", "x", "beta", "corr", "p_value", "half_life", "cointegrated", "ready", "signal", "nav")
    made = pair_decisions(snaps.select(*columns), max_adf_pvalue=0.2, min_abs_corr=0.05, min_half_life_bars=0.5)
    return made.select("pair", "ts_ns", "action", "side", r("qy"), r("qx"), "reason", *OUTCOMES)


@query("p23_leg_sizes", f"WITH {_HEDGE}, g AS (SELECT pair, ts_ns, least(5000.0, 0.02::DOUBLE * (y + x)) / (y + abs(beta) * x) AS qy, beta FROM h) SELECT pair, ts_ns, R6(qy) AS qy, R6(abs(beta) * qy) AS qx FROM g", "v_series")
def p23(spark, sf):
    return leg_sizes(hedge_rolling(_pairs(spark, sf), 128).withColumn("nav", F.col("y") + F.col("x")), 5000.0, 0.02).select("pair", "ts_ns", r("qy"), r("qx"))
