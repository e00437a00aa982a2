"""Permutations, block jumps, stress tables and routing whose keys are spread over many tasks, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import stretches as S
from tickspark.operators import execution, resample


@pytest.fixture()
def counted(monkeypatch):
    """Small tables are looked at too."""
    monkeypatch.setattr(S, "surely_short", lambda df, length: False)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 101, 1000, 4097])
def test_a_permutation_holds_every_place_once(n):
    places = []
    for run in range(4):
        i = np.arange(n)
        out = resample.shuffled(i, np.full(n, n), np.full(n, 77), np.full(n, run), 5)
        assert sorted(out) == list(range(n))
        places.append(tuple(out))
    if n > 16:
        assert len(set(places)) == 4
        assert abs(np.corrcoef(np.arange(n), places[0])[0, 1]) < 0.6


def test_permutations_are_even():
    """Every row comes to every place about as often as to any other."""
    n, runs = 7, 7000
    i, run = np.tile(np.arange(n), runs), np.repeat(np.arange(runs), n)
    out = resample.shuffled(i, np.full(n * runs, n), np.full(n * runs, 3), run, 1)
    seen = np.zeros((n, n))
    np.add.at(seen, (i, out), 1)
    assert seen.min() > 850 and seen.max() < 1150


def test_permute_table(spark):
    """Two keys, one of a single row; no run is sorted or gathered."""
    df = spark.range(200).select(F.when(F.col("id") < 199, "a").otherwise("b").alias("curve_id"), F.when(F.col("id") < 199, F.col("id")).otherwise(0).alias("i"), F.col("id").cast("double").alias("ret"))
    out = resample.permute(df, 3, seed=2)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    for run in range(3):
        assert sorted(r["j"] for r in rows if r["run"] == run and r["curve_id"] == "a") == list(range(199))
        assert [r["j"] for r in rows if r["run"] == run and r["curve_id"] == "b"] == [0]
    again = resample.permute(df.repartition(7), 3, seed=2).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    assert resample.permute(df.where("false"), 3).count() == 0


def test_stationary_jumps_in_pieces(spark):
    df = spark.range(330).select(F.when(F.col("id") < 300, "a").otherwise("b").alias("curve_id"), F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") - 300).alias("i"), F.col("id").cast("double").alias("ret"))
    key = lambda length: {tuple(r) for r in resample.bootstrap(df, "stationary", 4, seed=3, block=60, length=length).select("curve_id", "run", "j", "i", "ret").collect()}
    whole = key(None)
    assert len(whole) == 4 * 330 and key(20) == whole


@pytest.mark.parametrize("gap", ["persistent", "single"])
def test_stress_in_pieces(spark, counted, gap):
    rows = [("hot" if i % 7 else "s", i * 3_600_000_000_000, i, 100.0 + i % 11, 99.0, 102.0) for i in range(400)]
    t = spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, price double, bid double, ask double")
    made = lambda n: {(r["scenario"], r["seq"]): r for r in resample.apply_stress(t, resample.stress_presets(spark), gap=gap, length=n).collect()}
    whole, cut = made(10**9), made(60)
    assert whole.keys() == cut.keys() and len(whole) > 2700
    for k, a in whole.items():
        assert all(math.isclose(a[c], cut[k][c], rel_tol=1e-9) for c in ("price", "bid", "ask")), k


def stress_loop(rows, presets, single):
    """V9 by a plain loop per scenario and symbol."""
    lo, hi, day = min(r[1] for r in rows), max(r[1] for r in rows), 86_400_000_000_000
    on, out = lo + int((hi - lo) * 0.5), {}
    for name, gap, drift, spread, _, vol, halt, dur, decay, half in presets:
        for symbol in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1:3])
            early = [r for r in own if r[1] <= on]
            pre, last, total, hits = early[-1][3] if early and symbol else None, None, 0.0, 0
            for _, ts, seq, price, bid, ask in own:
                t = ts - on
                if 0 <= t < halt:
                    continue
                k = 0.0 if t < 0 or t > dur else 1.0 if decay == "instant" else 1 - t / dur if decay == "linear" else math.exp(-math.log(2) * t / max(1e-9, half * dur))
                total += drift * ((ts - last) / day if last is not None else 0.0) * k
                last, hits = ts, hits + (k > 0)
                m = 1 + total + gap * ((k > 0 and hits == 1) if single else k)
                p = m * (max(pre + (price - pre) * (1 + (vol - 1) * k), 0.01) if k > 0 and pre is not None else price)
                wide = m * (1 + (spread - 1) * k)
                out[name, seq] = (p, p + (bid - price) * wide, p + (ask - price) * wide)
    return out


@pytest.mark.parametrize("gap, abreast", [("persistent", 32), ("persistent", 3), ("single", 3)])
def test_stress_orders_records_once_for_all_scenarios(spark, counted, monkeypatch, gap, abreast):
    """Each record is put in order once, not once per scenario; a record after a halt looks back before it."""
    rows = [("hot" if i % 7 else None if i % 2 else "s", i * 3_600_000_000_000 // 2, i, 100.0 + i % 11, 99.0, 102.0) for i in range(400)]
    t = spark.createDataFrame(rows, "symbol string, ts_ns long, seq long, price double, bid double, ask double")
    presets = [*resample.PRESETS, ("halted", -0.1, -0.02, 2.0, 1.0, 3.0, 7 * 3_600_000_000_000, 30 * 86_400_000_000_000, "linear", 0.0)]
    scenarios = spark.createDataFrame(presets, resample.stress_presets(spark).schema)
    met, plain = [], resample.stretches
    monkeypatch.setattr(resample, "stretches", lambda df, *a, **k: met.append(df.count()) or plain(df, *a, **k))
    monkeypatch.setattr(resample, "ABREAST", abreast, raising=False)
    got = {(r["scenario"], r["seq"]): r for r in resample.apply_stress(t, scenarios, gap=gap, length=60).collect()}
    assert set(met) == {400}
    want = stress_loop(rows, presets, gap == "single")
    assert got.keys() == want.keys() and len(want) < 8 * 400
    for k, x in want.items():
        assert all(math.isclose(a, got[k][c], rel_tol=1e-9) for a, c in zip(x, ("price", "bid", "ask"), strict=True)), k


def test_conditional_stress_in_pieces(spark, counted):
    """The windows that are drawn are the worst of a plain sort; a key in pieces gives the same rows."""
    rng = np.random.default_rng(4)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(0, 0.01, 300))] + [("b", i, float(x)) for i, x in enumerate(rng.normal(0, 0.01, 30))]
    df = spark.createDataFrame(rows, "curve_id string, i long, ret double")
    made = lambda n: {tuple(r) for r in resample.conditional_stress(df, 0.1, 10, 3, seed=6, length=n).select("curve_id", "run", "j", "i").collect()}
    whole = made(10**9)
    assert made(50) == whole and len(whole) == 3 * 330
    ret = np.array([r[2] for r in rows[:300]])
    sums = [(np.log1p(ret[k : k + 10]).sum(), k) for k in range(291)]
    worst = {k for _, k in sorted(sums)[:29]}
    assert {i for c, _, j, i in whole if c == "a" and j % 10 == 0} <= worst


def split_loop(orders, venues):
    out = {}
    for oid, side, quantity in orders:
        quote = [((v[2] * (1 + v[5] / 1e4), v[0], v[2], v[4]) if side == "buy" else (-v[1] * (1 - v[5] / 1e4), v[0], v[1], v[3])) for v in venues]
        left = quantity
        for _, venue, _, depth in sorted(quote):
            if left > 0 and depth > 0:
                out[oid, venue] = min(depth, left)
                left -= min(depth, left)
    return out


@pytest.mark.parametrize(("run", "broadcast"), [(1, 0), (3, 100), (256, 0)])
def test_smart_split(spark, counted, run, broadcast):
    """Ties in price, venues without depth, orders of nothing, of exactly one run's depth, and beyond all depths."""
    venues = [(f"v{i:02d}", 100 - i % 4 * 0.1, 100.2 + i % 3 * 0.1, float(i % 5), float(i % 6), float(i % 4)) for i in range(40)]
    orders = [(i, "buy" if i % 2 else "sell", float(q)) for i, q in enumerate([0, 0, 1, 2, 3, 5, 8, 9, 10, 11, 30, 31, 60, 75, 80, 100, 500, 501, 5, 5])]
    v = spark.createDataFrame(venues, "venue string, bid double, ask double, bid_depth double, ask_depth double, fee_bps double")
    o = spark.createDataFrame(orders, "order_id long, side string, quantity double")
    got = execution.route(o, v, "smart_split", run=run, length=10, broadcast=broadcast)
    assert {(r["order_id"], r["venue"]): r["take"] for r in got.collect()} == split_loop(orders, venues)
    assert execution.route(o, v.where("false"), "smart_split").count() == 0
    assert execution.route(o.where("false"), v, "smart_split").count() == 0


def test_best_venue(spark):
    venues = [("b", 99.0, 101.0, 1.0, 2.0, 1.0), ("a", 99.0, 101.0, 3.0, 4.0, 1.0), ("c", 98.0, 100.5, 5.0, 6.0, 2.0)]
    v = spark.createDataFrame(venues, "venue string, bid double, ask double, bid_depth double, ask_depth double, fee_bps double")
    o = spark.createDataFrame([(1, "buy", 5.0), (2, "sell", 5.0)], "order_id long, side string, quantity double")
    rows = lambda how: {r["order_id"]: (r["venue"], r["price"], r["depth"]) for r in execution.route(o, v, how).collect()}
    assert rows("cheapest") == {1: ("a", 101.0, 4.0), 2: ("a", 99.0, 3.0)}
    assert rows("best_price") == {1: ("c", 100.5, 6.0), 2: ("a", 99.0, 3.0)}


def test_routing_leaves_out_venues_that_no_order_reaches(spark):
    v = spark.range(3000).select(F.format_string("v%05d", "id").alias("venue"), F.lit(99.0).alias("bid"), (100 + F.col("id") / 1000).alias("ask"), F.lit(2.0).alias("bid_depth"), F.lit(2.0).alias("ask_depth"), F.lit(0.0).alias("fee_bps"))
    o = spark.createDataFrame([(1, "buy", 5.0), (2, "sell", 4.0), (3, "buy", 60.0)], "order_id long, side string, quantity double")
    made = execution.route(o, v, "smart_split", broadcast=100)
    assert "_part" not in made._jdf.queryExecution().optimizedPlan().toString()  # 30 venues of a side are left, so they are broadcast
    assert {r["order_id"]: (r["n"], r["q"]) for r in made.groupBy("order_id").agg(F.count("*").alias("n"), F.sum("take").alias("q")).collect()} == {1: (3, 5.0), 2: (2, 4.0), 3: (30, 60.0)}


@pytest.mark.parametrize("few", [0, 100])
def test_rows_meet_a_few_keys_by_broadcast(spark, few):
    from tickspark.functions.stretches import beside_few

    rows = spark.createDataFrame([(i, "a" if i % 2 else None if i % 3 else "b") for i in range(12)], "i long, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, v int")
    for how in ("inner", "left"):
        got = beside_few(rows, table, ["k"], how, few)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", how).collect()))
    assert ("ResolvedHint (strategy=broadcast)" in beside_few(rows, table, ["k"], few=few)._jdf.queryExecution().analyzed().toString()) is (few > 0)


def test_financing_is_not_one_task_per_account(spark):
    from tickspark.operators import performance

    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("account"), F.col("id").cast("double").alias("price"), F.lit(2.0).alias("quantity"))
    made = performance.allocate_financing(rows, 10.0)
    assert "(strategy=broadcast)" in made._jdf.queryExecution().analyzed().toString()
    assert abs(made.agg(F.sum("financing_cost")).first()[0] - 20.0) < 1e-9
