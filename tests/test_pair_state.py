"""The pair snapshot over ticks and bars, against a loop that follows every event by itself."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark.operators import pairs as P

MS = 1_000_000
FIELDS = [f.split()[0] for f in P.PAIR_SNAPSHOT.split(",")]


def loop(events, tolerance, window, min_bars, every, publish, volume_window=64):
    """events: (is_y, is_bar, ts, open_ts, price, volume), in order of arrival. One event at a time, whole windows anew."""
    price, bar, out = {}, {}, []
    ys, xs, betas, spreads, bys, bxs, volumes = [], [], [], [], [], [], []
    beta, position, late, since, last_event, last_publish, last_bar = 0.0, 0, 0, 0, None, None, None
    test = (None, None, None, False)
    for row, (is_y, is_bar, ts, open_ts, value, volume) in enumerate(events):
        if is_bar:
            bar[is_y] = (open_ts, value, volume)
            other = bar.get(not is_y)
            if other and other[0] == open_ts and (last_bar is None or ts > last_bar):
                last_bar, since = ts, since + 1
                bys, bxs = [*bys, bar[True][1]][-4 * min_bars :], [*bxs, bar[False][1]][-4 * min_bars :]
                volumes = [*volumes, min(bar[True][2], bar[False][2])][-volume_window:]
                if len(bys) >= min_bars and since >= every:
                    since = 0
                    new = P.retest(np.array(bys), np.array(bxs))
                    test = new if new[0] is not None else test
            continue
        if last_event is not None and ts < last_event:
            late += 1
            continue
        price[is_y] = (value, ts)
        if (not is_y) not in price or abs(ts - price[not is_y][1]) > tolerance:
            continue
        last_event = ts
        y, x = price[True][0], price[False][0]
        ys.append(y)
        xs.append(x)
        wy, wx = np.array(ys[-window:]), np.array(xs[-window:])
        n = len(wy)
        vx = wx.var(ddof=1) if n > 1 else 0.0
        vy = wy.var(ddof=1) if n > 1 else 0.0
        cov = ((wx - wx.mean()) * (wy - wy.mean())).sum() / (n - 1) if n > 1 else 0.0
        beta = cov / vx if vx >= 1e-12 else beta
        betas.append(beta)
        spreads.append(y - beta * x - (wy.mean() - beta * wx.mean()))
        s = np.array(spreads[-window:])
        sd = s.std(ddof=1) if len(s) > 1 else 0.0
        z = (s[-1] - s.mean()) / sd if sd > 1e-12 else 0.0
        signal = "hold"
        if position == 0 and abs(z) >= 2:
            position, signal = (-1, "short_spread") if z > 0 else (1, "long_spread")
        elif position and (abs(z) >= 4 or (position == 1 and z >= -0.5) or (position == -1 and z <= 0.5)):
            position, signal = 0, "exit"
        if last_publish is None or ts - last_publish >= publish:
            last_publish = ts
            few = betas[-max(window // 4, 2) :]
            corr = max(-1.0, min(1.0, cov / math.sqrt(vx * vy))) if math.sqrt(vx * vy) >= 1e-12 else 0.0
            sd_beta = float(np.std(few, ddof=1)) if len(few) > 1 else 0.0
            mean_volume = sum(volumes) / len(volumes) if volumes else None
            out.append((row, (y, x, beta, wy.mean() - beta * wx.mean(), sd_beta, corr, s[-1], z, len(s), signal, position, *test, len(ys) >= 8, len(ys), bar_count(events[:row]), late, mean_volume)))
    return out


def bar_count(events):
    seen, last, n = {}, None, 0
    for is_y, is_bar, ts, open_ts, _, _ in events:
        if is_bar:
            seen[is_y] = open_ts
            if seen.get(not is_y) == open_ts and (last is None or ts > last):
                last, n = ts, n + 1
    return n


def same(a, b):
    if a is None or b is None or isinstance(a, str):
        return a == b
    return math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9)


def stepped(events, cuts, **options):
    names = ["is_y", "is_bar", "ts_ns", "open_ts", "price", "volume"]
    state, out = None, []
    for i, j in zip([0, *cuts], [*cuts, len(events)], strict=True):
        state, made = P.pair_step(state, pd.DataFrame(events[i:j], columns=names), **options)
        out += [(row + i, snap) for row, snap in made]
    return state, out


def random_events(n, step, seed=1, bars=True):
    rng = np.random.default_rng(seed)
    walk = 100 + np.cumsum(rng.normal(0, 0.1, n))
    events, ts = [], 10**9
    for i in range(n):
        ts += step
        is_y = bool(rng.integers(0, 2))
        at = ts - 40 * step if rng.random() < 0.05 else ts
        price = walk[i] * (2 if is_y else 1) + rng.normal(0, 0.05)
        events.append((is_y, False, at, 0, float(price), 1.0))
        if bars and i % 5 == 4:
            for leg in (True, False):
                if rng.random() < 0.9:
                    events.append((leg, True, ts, ts - 5 * step, float(walk[i] * (2 if leg else 1) + rng.normal(0, 0.05)), float(rng.integers(1, 9))))
    return events


@pytest.mark.parametrize("step", [600_000, 3 * MS])
def test_against_the_loop(step, monkeypatch):
    monkeypatch.setattr(P, "PAIR_CHUNK", 37)
    events = random_events(1500, step)
    options = {"tolerance_ns": 10 * step, "window": 32, "min_bars": 16, "every": 8, "publish_ns": MS, "volume_window": 64}
    want = loop(events, 10 * step, 32, 16, 8, MS)
    for cuts in ([], [1, 7, 400, 401, 900]):
        state, got = stepped(events, cuts, **options)
        assert [r for r, _ in got] == [r for r, _ in want]
        for (_, g), (row, w) in zip(got, want, strict=True):
            assert all(same(a, b) for a, b in zip(g, w, strict=True)), (row, dict(zip(FIELDS, zip(g, w, strict=True), strict=True)))
    assert got[-1][1][FIELDS.index("late")] > 20 and any(w[FIELDS.index("half_life")] is not None for _, w in want)


def test_every_second_tick_of_0_6_ms():
    events = [(k % 2 == 0, False, 10**9 + k * 600_000, 0, 100.0 + k, 1.0) for k in range(21)]
    _, got = stepped(events, [], tolerance_ns=MS, window=8, publish_ns=MS)
    assert [r for r, _ in got] == list(range(1, 21, 2))


def test_late_tick_is_dropped_and_counted():
    sec = 10**9
    events = [(True, False, 10 * sec, 0, 1.0, 1.0), (False, False, 20 * sec, 0, 2.0, 1.0), (True, False, 30 * sec, 0, 3.0, 1.0), (True, False, 15 * sec, 0, 99.0, 1.0), (False, False, 40 * sec, 0, 4.0, 1.0)]
    _, got = stepped(events, [3], tolerance_ns=60 * sec, window=8)
    last = dict(zip(FIELDS, got[-1][1], strict=True))
    assert [r for r, _ in got] == [1, 2, 4] and (last["y"], last["x"], last["late"], last["n_ticks"]) == (3.0, 4.0, 1, 3)


def test_bars_made_of_ticks():
    """Ticks of both legs in buckets of 10: the closes and volumes of the buckets make the bars."""
    ticks = [(bool(k % 2), False, k, 0, float(k), 2.0) for k in range(100)]
    state, _ = stepped(ticks, [33], tolerance_ns=100, bar_ns=10, min_bars=4, every=100, window=8, publish_ns=0)
    held = dict(zip([f.split()[0] for f in P.PAIR_STATE.split(",")], state, strict=True))
    assert held["n_bars"] == 9 and held["bar_ys"] == [9.0 + 10 * k for k in range(9)] and held["bar_xs"] == [8.0 + 10 * k for k in range(9)]
    assert held["volumes"] == [10.0] * 9


def test_batch_equals_the_loop(spark):
    """P16 over joined ticks and pair bars: the same throttle, retests and volume mean."""
    step = 600_000
    events = [e for e in random_events(900, step, seed=4) if e[1] or True]
    ordered, newest = [], 0
    for e in events:  # the batch form knows no order of arrival
        if e[1] or e[2] >= newest:
            ordered.append(e)
            newest = max(newest, e[2])
    want = loop(ordered, 10 * step, 32, 64, 64, MS)
    price, joined, bar, bars = {}, [], {}, []
    for row, (is_y, is_bar, ts, open_ts, value, volume) in enumerate(ordered):
        if is_bar:
            bar[is_y] = (open_ts, value, volume)
            if (not is_y) in bar and bar[not is_y][0] == open_ts:
                bars.append(("p", ts, bar[True][1], bar[False][1], min(bar[True][2], bar[False][2])))
        else:
            price[is_y] = (value, ts)
            if (not is_y) in price and abs(ts - price[not is_y][1]) <= 10 * step:
                joined.append(("p", ts + row % 1, price[True][0], price[False][0]))
    # A bar closes with the tick of its time, which came before it.
    bars = [(k, ts + 1, y, x, v) for k, ts, y, x, v in bars]
    df = spark.createDataFrame(joined, "pair string, ts_ns long, y double, x double")
    got = P.pair_snapshots(df, 32, bars=spark.createDataFrame(bars, "pair string, ts_ns long, y double, x double, volume double")).orderBy("ts_ns").collect()
    assert [r["ts_ns"] for r in got] == [ordered[row][2] for row, _ in want]
    for r, (_, w) in zip(got, want, strict=True):
        w = dict(zip(FIELDS, w, strict=True))
        assert same(r["beta"], w["beta"]) and r["signal"] == w["signal"] and (r["avg_volume"] is None) == (w["avg_volume"] is None)
        assert w["avg_volume"] is None or same(r["avg_volume"], w["avg_volume"])


def test_streamed_bars_and_ticks(spark, tmp_path):
    """Ticks and bars from two streams meet in one state."""
    from tickspark.streaming import streams

    events = random_events(400, 600_000, seed=9)
    rows = [("g", "A" if e[0] else "B", e[2], k, e[4], e[5], e[3], e[1]) for k, e in enumerate(events)]
    df = spark.createDataFrame(rows, "g string, symbol string, ts_ns long, seq long, price double, volume double, open_ts long, is_bar boolean")
    for name, flag in (("ticks", False), ("bars", True)):
        df.where(F.col("is_bar") == flag).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
    bars = read("bars").withColumnRenamed("price", "close")
    got = streams.drain(streams.stream_pair_snapshots(read("ticks").drop("open_ts"), "A", "B", ["g"], 6 * MS, 32, 16, 8, bars=bars)).orderBy("seq").collect()
    want = loop(events, 6 * MS, 32, 16, 8, MS)
    assert [r["seq"] for r in got] == [row for row, _ in want]
    assert all(same(r[c], w[FIELDS.index(c)]) for r, (_, w) in zip(got, want, strict=True) for c in ("z", "adf_t_stat", "avg_volume", "late", "n_bars"))
