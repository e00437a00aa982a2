"""Keys cut into many stretches give what whole keys give; recurrences and streams against plain loops."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickspark.functions import kernels as K
from tickspark.functions import stretches as S
from tickspark.operators import bars, execution, joins, models, pairs, performance, quality, risk, telemetry, windows

LENGTH = 40


@pytest.fixture(autouse=True)
def counted(monkeypatch):
    """Small tables are looked at too."""
    monkeypatch.setattr(S, "surely_short", lambda df, length: False)


@pytest.fixture(scope="module")
def hot(spark):
    """One symbol with most rows, ties in time, nulls and prices that are not positive; three short symbols."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(700):
        symbol = "hot" if i % 10 else f"s{i % 3}"
        price = float(np.round(100 + rng.normal() * 5, 3)) if i % 37 else (None if i % 2 else -1.0)
        rows.append((symbol, int(i // 2 * 1_000_000), i, price, float(i % 9 + 1), None if i % 13 == 0 else 99.0 + i % 4, 101.0 + i % 5))
    return spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, price double, size double, bid double, ask double").cache()


def same(make, by="seq"):
    def rows(length):
        out = make(length)
        assert "_st" not in out.columns
        return {r[by]: r.asDict() for r in out.collect()}

    whole, cut = rows(10**9), rows(LENGTH)
    assert whole.keys() == cut.keys() and len(whole) > 0
    for k, a in whole.items():
        for c, v in a.items():
            w = cut[k][c]
            near = v == w or (isinstance(v, float) and isinstance(w, float) and (math.isnan(v) and math.isnan(w) or math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9)))
            assert near, (k, c, v, w)


def legs(d):
    """Both legs of a pair from a symbol's ticks; prices that are missing stay missing."""
    return d.select(F.col("symbol").alias("pair"), F.col("seq").alias("ts_ns"), "seq", (F.col("price") / 100).alias("y"), (F.col("size") / 10 + F.col("price") / 200).alias("x"))


def test_there_are_many_stretches(hot):
    cut = S.stretches(hot, "symbol", ("ts_ns", "seq"), LENGTH)
    assert cut.hot.count() == 1 and cut.df.where("symbol = 'hot'").select("_st").distinct().count() >= 14
    assert S.stretches(hot, "symbol", ("ts_ns", "seq"), 10**6).hot is None


def test_cut_points_follow_each_key(spark):
    """One huge key and many just over the length: the cut points stay under 2 rows / length, and the search is right."""
    rows = spark.range(20_000).select(F.lit(0).alias("k"), F.col("id").alias("ts_ns"))
    rows = rows.unionAll(spark.range(50 * 220).select((F.col("id") % 50 + 1).cast("int").alias("k"), F.col("id").alias("ts_ns")))
    cut = S.stretches(rows, "k", ("ts_ns",), 100)
    cuts = {r["k"]: r["_cuts"] for r in cut.hot.collect()}
    assert len(cuts) == 51 and len(cuts[0]) == 199 and sum(map(len, cuts.values())) <= 2 * 31_000 / 100
    got = cut.df.collect()
    assert all(r["_st"] == sum(c <= r["ts_ns"] for c in cuts[r["k"]]) for r in got[::97])
    sizes = {}
    for r in got:
        sizes[r["k"], r["_st"]] = sizes.get((r["k"], r["_st"]), 0) + 1
    assert max(sizes.values()) <= 200


@pytest.mark.parametrize("k", [1, 2, 17, 33])
def test_bounded_frames(hot, k):
    same(lambda n: windows.over_last(hot, k, lambda d, w: d.withColumns({"m": F.avg("price").over(w), "v": windows.rolling_var("price", w), "n": F.count("price").over(w)}), length=n))


def test_frames_longer_than_a_stretch(hot):
    same(lambda n: windows.over_last(hot, 100, lambda d, w: d.withColumns({"m": F.avg("price").over(w), "n": F.count("*").over(w)}), length=n))


@pytest.mark.parametrize("before", [False, True])
def test_running_windows(hot, before):
    def make(n):
        cut = S.stretches(hot, "symbol", ("ts_ns", "seq"), n)
        specs = {"s": ("sum", F.col("price")), "c": ("count", F.col("price")), "hi": ("max", F.col("price")), "lo": ("min", F.col("price")), "l": ("last", F.col("bid")), "f": ("first", F.col("bid"))}
        return cut.done(cut.running(cut.df, specs, before))

    same(make)


@pytest.mark.parametrize(
    "make",
    [
        lambda d, n: windows.rolling_median_mad(d, "price", 9, length=n),
        lambda d, n: quality.hampel(d, 16, length=n),
        lambda d, n: windows.realized_vol(d, 8, length=n),
        lambda d, n: windows.running_drawdown(d, "price", length=n),
        lambda d, n: windows.return_runs(d, length=n),
        lambda d, n: windows.market_view(d, 16, length=n),
        lambda d, n: windows.ewma(d.where("price > 0"), "price", 20, length=n),
        lambda d, n: windows.ewma_var(d.where("price > 0"), "price", 20, length=n),
        lambda d, n: windows.ema(d.where("price > 0"), "price", 20, length=n),
        lambda d, n: windows.ewma_vol(d.where("price > 0"), 12, length=n),
        lambda d, n: windows.kalman_level(d, "price", warmup=64, length=n),
        lambda d, n: windows.kalman_level(d, "price", warmup=5, length=n),
        lambda d, n: windows.kalman_level(d, "price", warmup=1, length=n),
        lambda d, n: windows.kalman_level(d, "price", warmup=5000, length=n),
        lambda d, n: pairs.hedge_kalman2(legs(d), "pair", 1e-5, 1e-4, 0.5, length=n),
        lambda d, n: pairs.hedge_kalman2(legs(d), length=n),
        lambda d, n: pairs.hedge_kalman_smoothed(legs(d).where("y > 0"), 16, snr=0.05, length=n),
        lambda d, n: windows.zscore_outliers(d.where("price > 0"), 1.5, length=n),
        lambda d, n: bars.late_ticks(d, 50_000_000, n),
        lambda d, n: bars.fill_forward(d.withColumn("ts_ns", F.col("seq")), length=n),
        lambda d, n: bars.fill_linear(d.withColumn("ts_ns", F.col("seq")), length=n),
        lambda d, n: quality.drop_rewinds(d.withColumn("ts_ns", F.col("ts_ns") - F.when(F.col("seq") % 11 == 0, 90_000_000).otherwise(0)), length=n),
        lambda d, n: quality.cross_feed_basis(d.withColumn("price_a", F.col("price")).withColumn("price_b", F.col("price") * (1 + F.col("seq") % 5 / 1000)), 12, length=n),
        lambda d, n: joins.asof_pair(d.where("seq % 3 = 0 and price is not null"), d.where("seq % 3 = 1 and price is not null"), 30_000_000, length=n),
        lambda d, n: joins.asof(d.where("seq % 2 = 0").select("symbol", "ts_ns", "seq"), d.where("seq % 5 = 0").select("symbol", "ts_ns", "price"), ["symbol"], ["price"], ("ts_ns", "seq"), n),
        lambda d, n: models.garch_filter(d.where("price > 0").withColumn("ret", F.col("price") / 100 - 1).withColumn("ts_ns", F.col("seq")), ["symbol"], 1e-4, 0.1, 0.8, n),
        lambda d, n: risk.correlation_status(d.where("price > 0").select(F.col("symbol").alias("pair"), F.col("seq").alias("ts_ns"), "seq", (F.col("price") / 100 - 1).alias("corr")), length=n),
        lambda d, n: pairs.reversion_signals(d.where("price > 0").select("symbol", F.col("seq").alias("ts_ns"), "seq", ((F.col("price") - 100) / 2).alias("z")), key="symbol", length=n),
        lambda d, n: pairs.pair_states(d.where("price > 0").select("symbol", F.col("seq").alias("ts_ns"), "seq", ((F.col("price") - 100) / 2).alias("z"), (F.col("seq") % 41 == 0).alias("o")), key="symbol", opened="o", length=n),
        lambda d, n: pairs.spread_z(pairs.hedge_rolling(d.where("price > 0").select(F.col("symbol").alias("pair"), F.col("seq").alias("ts_ns"), "seq", F.col("price").alias("y"), F.col("size").alias("x")), 16, length=n), 16, length=n),
    ],
)
def test_operators_over_stretches(hot, make):
    same(lambda n: make(hot, n))


def whole(d):
    """Prices of the symbols as a plain series, in an order without ties."""
    return d.where("price > 0").select("symbol", F.col("seq").alias("ts_ns"), "seq", "price", "size")


@pytest.mark.parametrize(
    "make",
    [
        lambda d, n: pairs.adf(d, ["symbol"], "price", "trend", 2, length=n),
        lambda d, n: pairs.adf(d, ["symbol"], "price", "constant", "schwert", length=n),
        lambda d, n: pairs.engle_granger(d.withColumnsRenamed({"price": "y", "size": "x"}), ["symbol"], length=n),
        lambda d, n: pairs.half_life(d, ["symbol"], "price", n),
        lambda d, n: pairs.ou_fit(d, ["symbol"], "price", length=n),
        lambda d, n: pairs.pair_stats_simple(d.withColumnsRenamed({"price": "y", "size": "x"}), "symbol", n),
        lambda d, n: pairs.pair_performance(d.withColumn("pnl", F.col("price") - 100), "symbol", n),
        lambda d, n: pairs.rolling_cointegration(d.withColumnsRenamed({"price": "y", "size": "x"}), 16, 8, "symbol", n).withColumn("symbol", F.concat_ws("-", "symbol", "retest")),
        lambda d, n: models.ljung_box(d, ["symbol"], "price", 7, n),
        lambda d, n: performance.periodicity(d.withColumn("ts_ns", F.col("seq") * F.col("seq") * 1000), "symbol", n),
        lambda d, n: performance.pain(d.withColumnRenamed("price", "nav"), "symbol", n),
        lambda d, n: models.ks_1(d, ["symbol"], "price", lambda c: c / 200, n),
        lambda d, n: models.ks_2(d.withColumn("g", F.when(F.col("seq") % 3 == 0, "a").otherwise("b")), ["symbol"], "price", "g", "a", "b", n),
        lambda d, n: models.runs_test(d, ["symbol"], "price", length=n),
        lambda d, n: models.fit_regime_chain(d.selectExpr("symbol", "ts_ns", "seq", "price / 100 - 1 AS ret", "CASE WHEN size < 3 THEN 'calm' WHEN size < 6 THEN 'volatile' ELSE 'crisis' END AS state"), length=n).withColumn("symbol", F.concat_ws("-", "from", "to")),
    ],
)
def test_statistics_over_stretches(hot, make):
    same(lambda n: make(whole(hot), n), "symbol")


def tiers(d):
    return d.sparkSession.createDataFrame([("v", 0.0, 10.0, 20.0), ("v", 9000.0, 5.0, 15.0), ("v", 90000.0, 1.0, 3.0)], "venue string, threshold double, maker_bps double, taker_bps double")


@pytest.mark.parametrize(
    "make",
    [
        lambda d, n: performance.nav_returns(d.withColumnRenamed("price", "nav"), key="symbol", length=n),
        lambda d, n: performance.nav_returns(d.withColumn("nav", F.when((F.col("seq") != 333) | (F.col("symbol") != "hot"), F.col("price")).otherwise(0.0)), "log", "symbol", n),
        lambda d, n: performance.compound(d.withColumn("ret", F.when((F.col("seq") == 555) & (F.col("symbol") == "hot"), -1.5).otherwise(F.col("price") / 100 - 1)), key="symbol", length=n),
        lambda d, n: execution.financing(d.withColumnsRenamed({"price": "short", "size": "gross"}), 0.03, 0.01, "symbol", n),
        lambda d, n: performance.underwater(d.withColumnRenamed("price", "nav"), "symbol", n),
        lambda d, n: performance.drawdown_episodes(d.withColumnRenamed("price", "nav"), 0.0, "symbol", n).withColumn("seq", F.concat_ws("-", "symbol", "peak_ts")),
        lambda d, n: performance.realized_delta(d.withColumn("realized_after", F.sum("price").over(Window.partitionBy("symbol").orderBy("seq"))), "symbol", ("ts_ns", "seq"), n),
        lambda d, n: performance.holding_bucket(d.withColumn("signed_quantity", F.lit(1.0) - F.col("seq") % 3), ("symbol",), ("ts_ns", "seq"), (5, 12), n),
        lambda d, n: risk.drawdown_track(d.withColumnRenamed("price", "nav"), "symbol", n),
        lambda d, n: risk.circuit_states(d.withColumns({"drawdown": F.col("price") / 100 - 1, "reset": F.col("seq") % 150 == 0}), 0.05, 20, "symbol", length=n),
        lambda d, n: risk.circuit_states(d.withColumns({"drawdown": F.col("price") / 100 - 1, "reset": F.lit(False)}), 0.1, 200, "symbol", length=n),
        lambda d, n: risk.vol_regime(d.withColumn("ret", F.col("price") / 100 - 1), 8, 30, "symbol", length=n),
        lambda d, n: telemetry.flow_stats(d.withColumns({"published": F.col("seq") * 3, "dropped": F.col("size").cast("long")}), "symbol", n),
        lambda d, n: execution.commissions(d.withColumns({"quantity": F.col("size"), "is_maker": F.col("seq") % 2 == 0, "venue": F.lit("v")}), tiers(d), 0.5, "symbol", ("ts_ns", "seq"), n),
    ],
)
def test_curves_over_stretches(hot, make):
    same(lambda n: make(whole(hot), n))


def test_quality_gates_over_stretches(hot):
    q = hot.select(F.lit("x").alias("exchange"), "symbol", "seq", F.col("ts_ns").alias("exchange_ts_ns"), (F.col("ts_ns") + 10).alias("ingest_ts_ns"), "bid", (F.col("ask") - F.when(F.col("seq") % 9 == 0, 5).otherwise(0)).alias("ask"), (F.col("seq") - F.when(F.col("seq") % 7 == 0, 30).otherwise(0)).alias("sequence"))
    same(lambda n: quality.check_ticks(q, length=n))
    same(lambda n: quality.check_prints(q, length=n))


def test_numbers_of_all_rows(hot):
    got = S.numbered(hot, [F.desc("ts_ns"), "seq"], "i").collect()
    want = sorted(got, key=lambda r: (-r["ts_ns"], r["seq"]))
    assert [r["i"] for r in want] == list(range(1, len(want) + 1))


def test_state_goes_from_batch_to_batch(spark, hot):
    """Batches of seven rows give what one batch gives."""
    clean = hot.where("price > 0")
    frame = lambda: windows.kalman_level(clean, "price", warmup=50).select("seq", "level")
    whole = {r["seq"]: r["level"] for r in frame().collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r["seq"]: r["level"] for r in frame().collect()} == whole
        small = {r["seq"]: r for r in windows.symbol_snapshots(hot.where("price is not null")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    large = {r["seq"]: r for r in windows.symbol_snapshots(hot.where("price is not null")).collect()}
    assert small.keys() == large.keys()
    for k, r in large.items():
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(r, small[k])), (r, small[k])


def plain_kalman(x, snr, warmup):
    out, rets, p, r, level = [], [], 1.0, None, 0.0
    for n, v in enumerate(x, 1):
        if n == 1:
            level = v
        else:
            if n <= warmup:
                rets.append(math.log(v / x[n - 2]))
            if n == warmup:
                r = max(float(np.var(rets, ddof=1)), 1e-12)
            if n < warmup:
                level = 0.5 * level + 0.5 * v
            else:
                pred = p + r * snr
                k = pred / (pred + r)
                level, p = level + k * (v - level), (1 - k) * pred
        out.append(level)
    return out


def test_kalman_filters_at_the_last_value_of_the_warmup():
    x = 100 + np.random.default_rng(1).normal(size=90)
    got = K.kalman_level(None, x, 0.01, 32)[1]
    assert np.allclose(got, plain_kalman(list(x), 0.01, 32), rtol=1e-12)
    assert not np.isclose(got[31], 0.5 * got[30] + 0.5 * x[31])


def plain_snapshots(ts, price, size, window=256, publish_ns=10_000_000):
    """One symbol, one tick at a time, every filter by its definition."""
    newest, rejected, x, levels, vols, marks, peak, sign0, run, machine, sent, out = -math.inf, 0, [], [], [], [], 0.0, 0, 0, None, None, []
    zx = []
    for t, p, q in zip(ts, price, size):
        late = t < newest
        newest = max(newest, t)
        bad = late or not (p > 0 and q > 0)
        if not bad:
            mean, sd = (K.ewma(None, np.array(zx), 60)[1][-1], math.sqrt(K.ewma_var(None, np.array(zx), 60)[1][-1])) if zx else (0.0, 0.0)
            bad = len(zx) >= 30 and sd > 1e-12 and abs(p - mean) / sd > 5
            zx.append(p)
        if bad:
            rejected += 1
            continue
        before = levels[-1] if levels else 0.0
        x.append(p)
        levels = plain_kalman(x, 0.01, 1024)
        rets = np.diff(np.log(x))
        vols.append(math.sqrt(K.ewma_var(None, rets, 120)[1][-1]) if len(rets) else 0.0)
        if len(x) % 128 == 0:
            marks.append(vols[-1])
        median = sorted(marks)[(len(marks) - 1) // 2] if marks else 0.0
        peak = max(peak, levels[-1])
        down = max(0.0, (peak - levels[-1]) / peak)
        r = math.log(p / before) if before > 0 else 0.0
        sign = 1 if r > 1e-9 else -1 if r < -1e-9 else 0
        run = 0 if sign == 0 else run + 1 if sign == sign0 else 1
        sign0 = sign
        seen = K.CRISIS if down >= 0.05 else K.VOLATILE if median > 0 and vols[-1] > 1.8 * median else K.TRENDING if run >= 50 else K.CALM
        machine, state = K.regime_states(machine, np.array([seen]), np.array([t]))
        if sent is None or t - sent >= publish_ns:
            sent = t
            last = np.array(rets[-window:])
            out.append((t, min(len(x), window), p, levels[-1], last.std(ddof=1) if len(last) > 1 else 0.0, vols[-1], np.mean(x[-window:]), np.std(x[-window:], ddof=1) if len(x) > 1 else 0.0, down, K.REGIMES[state[0]], rejected, len(x) >= 1024))
    return out


def test_snapshots_against_one_tick_at_a_time():
    rng = np.random.default_rng(3)
    n = 420
    ts = np.cumsum(rng.integers(1, 40, n)) * 1_000_000
    ts[::23] -= 90_000_000
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    price[::61] *= 3.0
    price[::97] = -1.0
    price[300:] *= 0.9
    p = pd.DataFrame({"ts_ns": ts, "price": price, "size": 1.0})
    state, parts = None, []
    for i in range(0, n, 53):
        state, columns = windows.snapshot_step(state, p[i : i + 53].reset_index(drop=True), 64)
        parts.append(pd.DataFrame(columns).assign(ts_ns=ts[i : i + 53]))
    got = pd.concat(parts)
    got = got[got["publish"]]
    names = ["ts_ns", "n_ticks", "last_price", "denoised_price", "realized_vol", "ewma_vol", "rolling_mean", "rolling_std", "drawdown", "state", "rejected", "ready"]
    want = plain_snapshots(ts, price, np.ones(n), 64)
    assert len(got) == len(want) and len(want) > 100 and {"crisis", "calm"} <= {w[9] for w in want}
    for a, b in zip(got[names].itertuples(index=False), want):
        assert all(u == v or math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-9) for u, v in zip(a, b)), (a, b)


@pytest.fixture(scope="module")
def several_files(spark, tmp_path_factory):
    """An event table in six files, so that state goes over triggers; one of them holds ticks of the past."""
    rng = np.random.default_rng(5)
    path = tmp_path_factory.mktemp("events")
    rows = []
    for i in range(900):
        late = 40 if i % 50 == 49 else 0
        rows.append((i, pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=int(i * 20 - late * 20)), i % 7, "click" if i % 2 else "view", float(50 + (i % 2) * 10 + rng.normal()), f'{{"k": {i % 90 + 1}}}'))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for k in range(6):
        part = rows[k * 150 : (k + 1) * 150]
        spark.createDataFrame(pd.DataFrame(part, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]), schema).coalesce(1).write.mode("append").parquet(str(path / "events.parquet"))
    return str(path)


def test_positions(spark):
    """A2 over an account in 14 stretches and more, through flat, flipped and growing positions."""
    from tickspark.operators import performance

    rng = np.random.default_rng(11)
    drift = np.repeat(rng.choice([-1, 1], 20), 35)
    rows = [("hot" if i % 10 else f"s{i % 3}", "x", i * 1000, i, float(drift[i] * rng.integers(1, 5) * (1 if i % 3 else -1)), float(np.round(100 + rng.normal(), 2)), 0.25) for i in range(700)]
    df = spark.createDataFrame(rows, "account string, symbol string, ts_ns long, seq long, signed_quantity double, price double, commission double")
    made = lambda n: performance.positions(df, ("account", "symbol"), ("ts_ns", "seq"), n)
    same(made)
    hot = [r["position"] for r in made(LENGTH).where("account = 'hot'").orderBy("seq").collect()]
    assert S.stretches(df, ["account", "symbol"], ("ts_ns", "seq"), LENGTH).df.where("account = 'hot'").select("_st").distinct().count() >= 14
    assert min(hot) < 0 < max(hot) and sum(a * b < 0 for a, b in zip(hot, hot[1:], strict=False)) > 3


def test_last_positions_sort_narrow_rows_in_many_tasks(spark, monkeypatch):
    """Unused columns are not sorted, and the keys of many rows are dealt over tasks that are not merged."""
    from tickspark.operators import performance

    rows = [(f"a{i % 6}", "x", i * 1000, i, float(1 + i % 3), 100.0 + i % 7, 0.25, "unused") for i in range(600)]
    df = spark.createDataFrame(rows, "account string, symbol string, ts_ns long, seq long, signed_quantity double, price double, commission double, note string")
    met, plain = [], performance.positions
    monkeypatch.setattr(performance, "positions", lambda trades, *a: met.append(plain(trades, *a, length=150)) or met[0])
    got = {r["account"]: r["position"] for r in performance.last_positions(df, ("account", "symbol"), ("ts_ns", "seq")).collect()}
    assert got == {f"a{i}": 100.0 * (1 + i % 3) for i in range(6)}
    assert "note" not in met[0].columns and met[0].rdd.getNumPartitions() == 8 * 4
    assert S.stretches(df, ["account"], ("ts_ns",), 600).parts is None


def test_streamed_symbol_snapshots_equal_the_batch(spark, several_files):
    from tickspark.streaming import streams

    batch = windows.symbol_snapshots(_ticks(spark, several_files))
    want = {(r["symbol"], r["seq"]): r for r in batch.collect()}
    got = {(r["symbol"], r["seq"]): r for r in streams.drain(streams.stream_symbol_snapshots(streams.tick_stream(spark, several_files, files=1))).collect()}
    assert len(os.listdir(f"{several_files}/events.parquet")) >= 6
    # Triggers take files in the order they were written, so ticks arrive in the order of seq.
    assert got.keys() == want.keys() and len(want) > 300
    for k, r in want.items():
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(r, got[k])), (r, got[k])


def _ticks(spark, folder):
    from tickspark.plans.catalog import ticks

    return ticks(spark, folder).select("symbol", "ts_ns", "seq", "price", "size")


def test_streamed_pair_snapshots_equal_the_batch(spark, several_files):
    from tickspark.streaming import streams

    t = _ticks(spark, several_files).where("seq % 50 <> 49").withColumn("g", F.lit(1))
    joined = joins.asof_pair(t.where("symbol = 'click'"), t.where("symbol = 'view'"), 10**9, ("g",))
    want = {r["ts_ns"]: r for r in pairs.pair_snapshots(joined.drop("leg").withColumnRenamed("g", "pair"), 32).collect()}
    stream = streams.tick_stream(spark, several_files, files=1).where("seq % 50 <> 49").withColumn("g", F.lit(1))
    got = {r["ts_ns"]: r for r in streams.drain(streams.stream_pair_snapshots(stream, "click", "view", ["g"], 10**9, 32)).collect()}
    assert got.keys() == want.keys() and len(want) > 500
    names = ("y", "x", "beta", "corr", "spread", "z", "signal", "position", "adf_t_stat", "adf_p_value", "half_life", "beta_stdev")
    late = [k for k in sorted(want)][8:]
    for k in late:
        for c in names:
            a, b = want[k][c], got[k][c]
            assert a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6), (k, c, a, b)
    assert any(want[k]["half_life"] is not None for k in late)


def test_streamed_circuit_equals_the_batch(spark, tmp_path):
    from tickspark.streaming import streams

    rng = np.random.default_rng(2)
    rows = [("c", i, i, float(abs(rng.normal()) / 10), i % 60 == 59) for i in range(240)]
    df = spark.createDataFrame(rows, "curve_id string, ts_ns long, seq long, drawdown double, reset boolean")
    for k in range(4):
        df.where(f"floor(seq / 60) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    want = {r["seq"]: r["circuit"] for r in risk.circuit_states(df, 0.2, 20).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = {r["seq"]: r["circuit"] for r in streams.drain(streams.stream_states(stream, "circuit", 0.2, 20)).collect()}
    assert got == want and set(want.values()) == {"armed", "tripped", "recovering"}


def test_episodes_against_a_loop(hot):
    """Peaks, troughs and recoveries of each symbol, one value at a time; the last episode stays open."""
    rows = sorted(whole(hot).collect(), key=lambda r: r["seq"])
    want = set()
    for symbol in {r["symbol"] for r in rows}:
        peak, at, low = -math.inf, None, None
        for t, v in [(r["ts_ns"], r["price"]) for r in rows if r["symbol"] == symbol]:
            if v >= peak:
                if low:
                    want.add((symbol, at, low[1], t))
                peak, at, low = v, t, None
            elif low is None or v < low[0]:
                low = (v, t)
        if low:
            want.add((symbol, at, low[1], None))
    for n in (10**9, LENGTH):
        got = performance.drawdown_episodes(whole(hot).withColumnRenamed("price", "nav"), 0.0, "symbol", n).collect()
        assert {(r["symbol"], r["peak_ts"], r["trough_ts"], r["recovery_ts"]) for r in got} == want
