"""Hand-checked values of the reference's operators on tiny tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import kernels as K
from tickspark.operators import bars, books, execution, filters, pairs, performance, quality, resample, risk, scalars, telemetry, validation, windows

SEC = 1_000_000_000
DAY = 86_400 * SEC


def test_bars(spark):
    t = spark.createDataFrame([("a", 0, 1, 100.0, 1.0), ("a", SEC // 2, 2, 101.0, 1.0), ("a", SEC, 3, 102.0, 3.0), ("a", -1, 4, 7.0, 1.0)], "symbol string, ts_ns long, seq long, price double, size double")
    got = {r["open_ts"]: r for r in bars.build_bars(t, SEC).collect()}
    b = got[0]
    assert (b["open"], b["high"], b["low"], b["close"], b["volume"], b["n_ticks"], b["close_ts"]) == (100, 101, 100, 101, 2, 2, SEC)
    assert -SEC in got and got[SEC]["volume"] == 3
    late = spark.createDataFrame([("a", 5 * SEC, 1, 1.0, 1.0), ("a", SEC, 2, 1.0, 1.0)], t.schema)
    assert [r["late"] for r in bars.late_ticks(late, SEC).orderBy("seq").collect()] == [False, True]


def test_gap_fills(spark):
    def col(values):
        return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "symbol string, ts_ns long, price double")

    f = bars.fill_forward(col([1.0, None, None, 4.0, None]))
    assert [r["price"] for r in f.orderBy("ts_ns").collect()] == [1, 1, 1, 4, 4]
    assert bars.fill_count(f).first()["filled"] == 3
    g = bars.fill_linear(col([0.0, None, None, 9.0, None])).orderBy("ts_ns").collect()
    assert [r["price"] for r in g] == [0, 3, 6, 9, None] and sum(r["filled"] for r in g) == 2


def test_quality(spark):
    q = spark.createDataFrame([("x", "s", 1.0, 2.0, 0, 1, 5, 1), ("x", "s", 3.0, 2.0, 0, 1, 6, 2), ("x", "s", 1.0, 2.0, 0, 2 * SEC, 7, 3), ("x", "s", 1.0, 2.0, 0, 1, 8, 4)], "exchange string, symbol string, bid double, ask double, exchange_ts_ns long, ingest_ts_ns long, sequence long, seq long")
    got = quality.check_ticks(q).orderBy("seq").collect()
    assert [r["verdict"] for r in got] == ["ok", "crossed", "stale", "gap"]
    assert (got[3]["expected"], got[3]["dropped"]) == (6, 2)
    p = spark.createDataFrame([("x", "s", 10, 1), ("x", "s", 9, 2), ("x", "s", 10, 3), ("x", "s", 12, 4)], "exchange string, symbol string, sequence long, seq long")
    assert [r["verdict"] for r in quality.check_prints(p).orderBy("seq").collect()] == ["ok", "out_of_order", "ok", "gap"]


def test_corporate_actions(spark):
    schema = "ord int, kind string, symbol string, effective_at long, ratio double, `to` string, children array<struct<symbol:string,ratio:double>>, until_ns long"
    t = spark.createDataFrame([("X", 10, 100.0, 10.0)], "symbol string, ts_ns long, price double, size double")
    one = lambda *a: quality.apply_actions(t, spark.createDataFrame([a], schema)).collect()
    assert (one(1, "split", None, 5, 2.0, None, None, None)[0]["price"], one(1, "split", None, 5, 2.0, None, None, None)[0]["size"]) == (50, 20)
    assert {(r["symbol"], r["size"]) for r in one(1, "fork", "X", 5, None, None, [("A", 1.0), ("B", 0.5)], None)} == {("A", 10), ("B", 5)}
    assert one(1, "halt", None, 5, None, None, None, 20) == []
    assert one(1, "rename", "X", 5, None, "Y", None, None)[0]["symbol"] == "Y"


def test_book_walk(spark):
    levels = [(100.1, 100.0, 1), (100.2, 200.0, 1), (100.3, 500.0, 1)]
    o = spark.createDataFrame([("buy", 500.0, [(100.0, 100.0, 1)], levels), ("buy", 2000.0, [(100.0, 100.0, 1)], levels[:1])], f"side string, quantity double, bids {books.LEVEL}, asks {books.LEVEL}")
    a, b = books.book_impact(o).collect()
    assert (round(a["average"], 6), a["worst"], a["levels_used"], a["unfilled"]) == (100.22, 100.3, 3, 0)
    assert (b["filled"], b["unfilled"]) == (100, 1900)


def test_routing(spark):
    v = spark.createDataFrame([("a", 99.0, 100.1, 10.0, 100.0, 0.0), ("b", 99.0, 100.2, 10.0, 100.0, 0.0), ("c", 99.0, 100.3, 10.0, 200.0, 0.0)], "venue string, bid double, ask double, bid_depth double, ask_depth double, fee_bps double")
    o = spark.createDataFrame([(1, "buy", 300.0), (2, "buy", 1000.0)], "order_id int, side string, quantity double")
    got = {r["order_id"]: r for r in execution.route_summary(execution.route(o, v, "smart_split")).collect()}
    assert (got[1]["venues"], got[1]["unallocated"]) == (3, 0) and got[2]["unallocated"] == 600
    assert {r["venue"] for r in execution.route(o, v, "best_price").collect()} == {"a"}
    with pytest.raises(ValueError):
        execution.route(o, v, "elsewhere")


def test_impact_and_kelly(spark):
    d = spark.createDataFrame([(10_000.0, 1_000_000.0, 0.02)], "quantity double, adv double, sigma double")
    assert abs(execution.permanent_impact(d).first()["impact_bps"] - 10) < 1e-9
    k = spark.createDataFrame([(0.6, 1.0, 100.0), (float("nan"), 1.0, 100.0), (None, 1.0, 100.0)], "p double, b double, capital double")
    assert [round(r["kelly"], 9) for r in execution.kelly_size(k).collect()] == [0.2, 0, 0]


def test_quantiles(spark):
    d = spark.createDataFrame([("k", float(i)) for i in range(1, 11)], "k string, v double")
    q = performance.quantile(d, ["k"], "v", (0, 0.25, 0.5, 0.75, 1)).first()
    assert [q[f"q{i}"] for i in range(5)] == [1, 3.25, 5.5, 7.75, 10]


def test_episodes(spark):
    nav = spark.createDataFrame([("c", i * DAY, float(v)) for i, v in enumerate([100, 80, 100, 90, 100, 70, 75])], "curve_id string, ts_ns long, nav double")
    e = performance.drawdown_episodes(nav).orderBy("peak_ts").collect()
    assert [round(r["depth"], 9) for r in e] == [0.2, 0.1, 0.3]
    assert [r["recovery_ts"] is None for r in e] == [False, False, True]
    s = performance.episode_stats(performance.drawdown_episodes(nav)).first()
    assert s["episodes"] == 3 and abs(s["recovery_rate"] - 2 / 3) < 1e-12


def test_sharpe(spark):
    rets = [0.02 if i % 2 == 0 else -0.01 for i in range(252)]
    df = spark.createDataFrame([("c", i * DAY, r) for i, r in enumerate(rets)], "curve_id string, ts_ns long, ret double")
    nav = performance.compound(df).select("curve_id", "ts_ns", F.col("path").alias("nav"))
    per = spark.createDataFrame([("c", 252.0)], "curve_id string, ppy double")
    m = performance.metrics(df, nav, ppy=per).first()
    assert abs(m["sharpe"] - np.mean(rets) * 252 / (np.std(rets, ddof=1) * math.sqrt(252))) < 1e-9


def test_positions():
    _, q, a, g = K.average_cost(None, np.array([10.0, -4.0, -10.0, 4.0]), np.array([100.0, 110.0, 90.0, 80.0]), np.array([1.0, 1.0, 1.0, 1.0]))
    assert list(q) == [10, 6, -4, 0] and list(a) == [100, 100, 90, 0]
    assert list(g) == [-1, 38, -23, 16]


def test_attribution(spark):
    f = spark.createDataFrame([("u", 1, "BTC", 0.0, 1.0), ("u", 2, "BTC", 100.0, 1.0), ("u", 3, "ETH", 100.0, 0.5), ("u", 4, "ETH", 150.0, 0.5)], "account string, ts_ns long, symbol string, realized_after double, commission double")
    f = f.withColumns({"slippage_cost": F.lit(0.0), "price": F.lit(1.0), "quantity": F.lit(1.0)})
    got = {r["symbol"]: r for r in performance.attribution(performance.realized_delta(f, order=("ts_ns",)), "symbol").collect()}
    assert (got["BTC"]["realized"], got["BTC"]["commission"], got["BTC"]["net"], got["ETH"]["realized"]) == (100, 2, 98, 50)


def series(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.normal(size=n))
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.7 * e[i - 1] + rng.normal()
    y = 3 + 1.5 * x + e
    return spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "pair string, ts_ns long, y double, x double"), y, x


def test_cointegration_recovers(spark):
    df, y, x = series(spark)
    got = pairs.engle_granger(df, ["pair"]).first()
    b, a = np.polyfit(x, y, 1)
    assert abs(got["b"] - b) < 1e-6 and got["cointegrated"]
    resid = df.withColumn("v", F.col("y") - a - b * F.col("x"))
    h = pairs.half_life(resid, ["pair"], "v").first()["half_life"]
    assert 1 < h < 4
    assert pairs.rolling_cointegration(df).count() == 6
    fit = pairs.ols(df.withColumn("one", F.lit(1.0)), ["pair"], "y", ["one", "x"]).first()
    assert np.allclose(fit["beta"], [a, b], rtol=1e-6)
    bad = pairs.ols(df.withColumn("one", F.lit(1.0)).withColumn("two", F.lit(2.0)), ["pair"], "y", ["one", "two"]).first()
    assert bad["error"] == "singular"


def test_kernels_against_loops():
    rng = np.random.default_rng(0)
    x = rng.normal(100, 5, 300)
    a, s, w, m, out, var, sv = 2 / 21, 0.0, 0.0, 0.0, [], [], 0.0
    for v in x:
        sv = (1 - a) * sv + a * (v - m) ** 2
        s, w = (1 - a) * s + a * v, (1 - a) * w + a
        m = s / w
        out.append(m)
        var.append(sv / w)
    assert np.allclose(K.ewma(None, x, 20)[1], out) and np.allclose(K.ewma_var(None, x, 20)[1], var)
    _, pos, sig = K.reversion(None, np.array([0, 2.1, 1, 0.4, -2.5, -4.2, 2.0, 0.0]))
    assert list(pos) == [0, -1, -1, 0, 1, 0, -1, 0] and list(sig) == [0, -1, 0, 2, 1, 2, -1, 2]
    ts = np.arange(100) * SEC
    obs = np.array([K.CALM] * 10 + [K.CRISIS] * 90)
    _, state = K.regime_states(None, obs, ts)
    assert state[18] == K.CALM and state[19] == K.CRISIS


def test_run_lengths(spark):
    t = spark.createDataFrame([("a", i, i, p) for i, p in enumerate([1.0, 2.0, 3.0, 3.0, 2.0, 1.0])], "symbol string, ts_ns long, seq long, price double")
    got = windows.return_runs(t).orderBy("seq").collect()
    assert [(r["run_sign"], r["run_length"]) for r in got] == [(0, 0), (1, 1), (1, 2), (0, 0), (-1, 1), (-1, 2)]


def test_bootstrap_is_stable(spark):
    d = spark.createDataFrame([("c", i, float(i)) for i in range(50)], "curve_id string, i long, ret double")
    for kind in ("iid", "moving", "circular", "stationary"):
        one = resample.bootstrap(d, kind, 3, seed=1).select("run", "j", "i").collect()
        two = resample.bootstrap(d.repartition(3), kind, 3, seed=1).select("run", "j", "i").collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 150
        assert all(0 <= r["i"] < 50 for r in one)
    p = resample.permute(d, 2).collect()
    assert sorted(r["i"] for r in p if r["run"] == 1) == list(range(50))


def test_folds(spark):
    b = spark.createDataFrame([(0, 365 * DAY)], "lo long, hi long")
    f = validation.walk_forward_folds(b, 90 * DAY, 30 * DAY, 30 * DAY).orderBy("fold").collect()
    assert len(f) == 9 and all(r["train_hi"] == r["test_lo"] for r in f)
    splits, train = validation.cpcv(b, 6, 2, 5 * DAY)
    assert splits.select("split").distinct().count() == 15
    assert validation.is_leak_free(train, splits, validation.fold_groups(b, 6), 5 * DAY).count() == 0
    with pytest.raises(ValueError):
        validation.param_grid(spark, {"a": list(range(100)), "b": list(range(100))}, 1000)


def test_trials(spark):
    t = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 2.0), (4, float("inf")), (5, None)], "trial int, score double")
    ranks = {r["trial"]: r["rank"] for r in validation.rank_trials(t).collect()}
    assert (ranks[3], ranks[1]) == (1, 2)
    s = validation.trial_summary(t).first()
    assert (s["best"], s["failed"]) == (3, 3)


def test_breaches_and_circuit(spark):
    d = spark.createDataFrame([("c", 0, 0.1, False), ("c", 10, 0.3, False), ("c", 15, 0.0, False), ("c", 40, 0.0, False), ("c", 50, 0.0, True)], "curve_id string, ts_ns long, drawdown double, reset boolean")
    assert risk.breaches(d).count() == 1
    assert [r["circuit"] for r in risk.circuit_states(d, 0.2, 20).orderBy("ts_ns").collect()] == ["armed", "tripped", "tripped", "recovering", "armed"]


def test_histogram_buckets(spark):
    values = [0, 1, 15, 16, 17, 31, 32, 33, 1000, 2**20, 2**39, 2**45]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(telemetry.bucket_upper(F.col("v")).alias("u")).collect()
    for v, r in zip(values, got, strict=True):
        v = min(v, 2**40 - 1)
        shift = max(v.bit_length() - 5, 0)
        assert r["u"] == ((v >> shift) << shift) + (1 << shift) - 1


def test_chain_break(spark):
    a = spark.createDataFrame([("f", i, f"r{i}".encode()) for i in range(6)], "file string, sequence long, canonical binary")
    s = telemetry.seal(a)
    assert telemetry.verify_chain(s).where("problem is not null").count() == 0
    cut = telemetry.first_break(telemetry.verify_chain(s.where("sequence <> 3"))).first()
    assert (cut["sequence"], cut["problem"]) == (4, "gap")


def test_intervals_and_lineage(spark):
    assert [scalars.parse_interval(t) for t in ("30s", "5m", "1h")] == [30 * SEC, 300 * SEC, 3600 * SEC]
    with pytest.raises(ValueError):
        scalars.parse_interval("x")
    d = spark.createDataFrame([("feed/a", "b_1"), ("", "root"), ("feed", "No"), ("x" * 60, "yyyyy")], "p string, c string")
    assert [r[0] for r in d.select(filters.lineage_push(F.col("p"), F.col("c"))).collect()] == ["feed/a/b_1", "root", None, None]


def test_risk_monitor_parts(spark):
    n = 60
    navs = [1000.0] + [1000.0 + i % 2 for i in range(1, 40)] + [700.0] + [700.0 + i % 2 for i in range(1, 20)]
    curve = spark.createDataFrame([("a", i * DAY, v) for i, v in enumerate(navs)], "curve_id string, ts_ns long, nav double")
    held = spark.createDataFrame([("a", "s", 5 * DAY, 400.0), ("a", "t", 7 * DAY, -200.0), ("a", "s", 50 * DAY, 2800.0)], "curve_id string, symbol string, ts_ns long, value double")
    corrs = spark.createDataFrame([("p", i * DAY, 0.9 if i < 20 else -0.9) for i in range(n)], "pair string, ts_ns long, corr double")
    m = {r["ts_ns"] // DAY: r for r in risk.risk_monitor(curve, held, corrs).collect()}
    assert [m[i]["circuit"] for i in (39, 40, 41)] == ["armed", "tripped", "recovering" if risk.COOLDOWN <= DAY else "tripped"]
    assert (m[10]["gross"], m[10]["net"], m[10]["n_positions"], m[4]["n_positions"]) == (600, 200, 2, 0)
    assert m[10]["leverage"] == pytest.approx(600 / navs[10]) and m[10]["concentration"] == pytest.approx(400 / navs[10])
    assert m[19]["correlation"] == "stable" and "sign_flip" in {m[i]["correlation"] for i in range(20, n)}
    assert [b["limit"] for b in m[40]["breaches"]][:2] == ["drawdown", "daily_loss"] and "leverage" in [b["limit"] for b in m[51]["breaches"]] and m[10]["breaches"][0]["limit"] == "concentration"
    assert m[41]["score"] > m[30]["score"] + 0.15


def test_risk_monitor_garch(spark):
    curve = spark.createDataFrame([("a", i * DAY, 1000.0 + 7 * (i % 3)) for i in range(40)], "curve_id string, ts_ns long, nav double")
    none = spark.createDataFrame([], "curve_id string, symbol string, ts_ns long, value double")
    calm = spark.createDataFrame([], "pair string, ts_ns long, corr double")
    fit = spark.createDataFrame([("a", 1e-4, 0.0, 0.0)], "curve_id string, omega double, alpha double, beta double")
    m = risk.risk_monitor(curve, none, calm, garch=fit).orderBy("ts_ns").collect()
    assert len(m) == 39 and all(x["sd"] == pytest.approx(0.01) and x["leverage"] == 0 and x["correlation"] == "stable" for x in m)


def test_pair_decisions(spark):
    good = dict(y=10.0, x=5.0, beta=1.0, corr=0.9, p_value=0.01, half_life=10.0, cointegrated=True, ready=True, signal="long_spread")
    steps = [dict(ready=False), {}, {}, dict(signal="exit"), dict(signal="short_spread"), dict(cointegrated=False), {}]
    rows = [("p", i, *{**good, **x}.values()) for i, x in enumerate(steps)]
    for name, bad in (("corr", 0.5), ("p_value", 0.06), ("half_life", 1.0), ("half_life", 200.0), ("half_life", math.inf), ("half_life", None), ("cointegrated", False), ("cointegrated", None), ("p_value", None)):
        rows.append((f"{name} {bad}", 0, *{**good, name: bad}.values()))
    snaps = spark.createDataFrame(rows, "pair string, ts_ns long, y double, x double, beta double, corr double, p_value double, half_life double, cointegrated boolean, ready boolean, signal string")
    got = pairs.pair_decisions(snaps).orderBy("pair", "ts_ns").collect()
    p = [r for r in got if r["pair"] == "p"]
    assert sorted((r["ts_ns"], r["action"], r["side"], r["reason"]) for r in p) == [(1, "enter", 1, "signal"), (3, "exit", -1, "signal"), (4, "enter", -1, "signal"), (5, "exit", 1, "screen"), (6, "enter", 1, "signal"), (6, "flatten", -1, "end")]
    last = next(r for r in p if r["action"] == "flatten")
    assert {k: last[k] for k in pairs.OUTCOMES} == dict(signals=5, entries=3, exits=1, not_ready=1, screened=1, repeated=1, forced=1)
    assert p[0]["qy"] == pytest.approx(10_000 / 15)
    others = [r for r in got if r["pair"] != "p"]
    assert len(others) == 9 and all((r["action"], r["screened"]) == ("none", 1) for r in others)


def test_walk_forward_deflated(spark):
    results = spark.createDataFrame([(f, p, float(p), p * 0.1, 0.1) for f in (0, 1) for p in (1, 2, 3)], "fold int, point int, param double, is_score double, oos_score double")
    rng = np.random.default_rng(1)
    curve = {p: 100 * np.cumprod(1 + rng.normal(0.002, 0.01, 80)) for p in (1, 2, 3)}
    curves = spark.createDataFrame([(i // 40, p, i * DAY, float(v)) for p in curve for i, v in enumerate(curve[p])], "fold int, point int, ts_ns long, nav double")
    got = validation.walk_forward_report(results, curves).first()
    nav = curve[3].copy()
    nav[40:] *= nav[39] / nav[40]
    ret = np.diff(nav) / nav[:-1]
    z = (ret - ret.mean()) / ret.std()
    want = validation.deflated_sharpe(spark.createDataFrame([(got["oos_sharpe"], 79.0, float((z**3).mean()), float((z**4).mean() - 3))], "sr double, n double, skew double, kurt double"), 6, 0.1).first()["deflated"]
    assert got["oos_sharpe"] == pytest.approx(ret.mean() / ret.std(ddof=1) * math.sqrt(365), rel=0.02)
    assert got["trials"] == 6 and got["deflated"] == pytest.approx(want, abs=1e-6) and 0 < got["deflated"] <= 1
