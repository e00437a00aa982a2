"""Streams with typed state and timers against plain loops: bars that close per key, sources that fall silent."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.streaming import timed

SCHEMA = "symbol string, ts_ns long, seq long, price double, size double, event_time timestamp"
SEC = 1_000_000_000
T0 = 1_700_000_000 * SEC


def plain_bars(ticks, interval):
    """One tick at a time: (closed bars, late ticks)."""
    bar, late, made = None, 0, []
    for ts, price, size in ticks:
        start = ts - ts % interval
        if bar is None or start > bar[1]:
            if bar is not None:
                made.append((*bar, late))
            bar = [interval, start, price, price, price, price, size, 1]
        elif start < bar[1]:
            late += 1
        else:
            bar = [interval, start, bar[2], max(bar[3], price), min(bar[4], price), price, bar[6] + size, bar[7] + 1]
    return made, late, bar


def some_ticks(n, seed):
    """In order of arrival; some go back, inside the open bar or before it."""
    rng = np.random.default_rng(seed)
    ts = T0 + np.cumsum(rng.integers(0, 400, n)) * (SEC // 1000) - rng.choice([0, 0, 0, 300, 5_000], n) * (SEC // 1000)
    return ts.astype("int64"), rng.integers(1, 500, n) / 4.0, rng.integers(1, 9, n).astype(float)


@pytest.mark.parametrize("pieces", [1, 2, 7, 200])
@pytest.mark.parametrize("interval", [SEC, 7 * SEC, 3600 * SEC])
def test_bars_in_any_batches(pieces, interval):
    ts, price, size = some_ticks(400, pieces)
    state, made = None, []
    for at in np.array_split(np.arange(400), pieces):
        state, closed = timed.bars_on(state, interval, ts[at], price[at], size[at])
        made += closed
    want, late, bar = plain_bars(list(zip(ts.tolist(), price.tolist(), size.tolist(), strict=True)), interval)
    assert made == want and state == (*bar, late)
    assert late > 0 or interval > 7 * SEC


def written(spark, path, files):
    """Each list of rows in a file of its own; later files are newer, so that a trigger takes them in turn."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000")))
        df.coalesce(1).write.mode("append").parquet(f"{path}/f{i}")
        time.sleep(0.01)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_streamed_bars_of_several_intervals(spark, tmp_path):
    a, b = some_ticks(300, 1), some_ticks(90, 2)
    rows = [("a", int(t), 2 * i, float(p), float(s)) for i, (t, p, s) in enumerate(zip(*a, strict=True))]
    rows += [("b", int(t), 2 * i + 1, float(p), float(s)) for i, (t, p, s) in enumerate(zip(*b, strict=True))]
    rows.sort(key=lambda r: r[2])
    bad = [("a", T0, -1, None, 1.0), ("a", T0, -2, 0.0, 1.0), ("a", None, -3, 5.0, 1.0), (None, T0, -4, 5.0, 1.0), ("c", T0, -5, 5.0, float("nan")), ("a", T0, -6, -1.0, 1.0)]
    cut = [bad, *[list(p)[::-1] for p in (rows[:120], rows[120:121], rows[121:260], rows[260:])]]  # no order inside a trigger
    got = timed.drain_typed(timed.stream_bars_by_key(written(spark, str(tmp_path), cut), [SEC, 9 * SEC])).collect()
    want = set()
    for symbol in "ab":
        own = [r[1:2] + r[3:] for r in rows if r[0] == symbol]
        for interval in (SEC, 9 * SEC):
            want |= {(symbol, *m) for m in plain_bars(own, interval)[0]}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and max(r["late_ticks"] for r in got) > 5


def plain_alarms(times, degraded, failed, clock):
    made, ordered = [], sorted(times)
    for last, then in zip(ordered, [*ordered[1:], None], strict=True):
        gap = (clock if then is None else then) - last
        made += [(last + n, last, n, s) for n, s in ((degraded, "degraded"), (failed, "failed")) if gap >= n]
        if then is not None and gap >= degraded:
            made.append((then, last, gap, "healthy"))
    return made


def test_alarms_by_event_time(spark, tmp_path):
    """A source that stops is found by the others' progress; gaps count alike within a trigger and between two."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for symbol, stop in (("a", 4_000), ("b", 900), ("c", 3_990)):
        t = 0
        while t < stop:
            rows.append((symbol, T0 + t * SEC, n, 1.0, 1.0))
            n, t = n + 1, t + int(rng.choice([1, 5, 29, 30, 31, 119, 120, 400]))
    rows.sort(key=lambda r: (r[1], r[2]))
    files = [[*p] for p in (rows[: len(rows) // 3], rows[len(rows) // 3 : -9], rows[-9:])]
    files[1] += [("a", None, -1, 1.0, 1.0), (None, T0 + 2_000 * SEC, -2, 1.0, 1.0), files[1][3]]  # nulls, a repeated row
    files[2].append(("b", T0 + 10 * SEC, -3, 1.0, 1.0))  # far too late
    alarms = timed.stream_silence_alarms(written(spark, str(tmp_path), files), 30 * SEC, 120 * SEC)
    got = [tuple(r) for r in timed.drain_typed(alarms).collect()]
    clock = max(r[1] for r in rows)
    want = [(s, *m) for s in "abc" for m in plain_alarms([r[1] for r in rows if r[0] == s], 30 * SEC, 120 * SEC, clock)]
    assert sorted(got) == sorted(want)
    assert any(w[0] == "b" and w[4] == "failed" and w[2] == max(r[1] for r in rows if r[0] == "b") for w in want)


def test_alarms_by_the_clock_need_no_rows(spark, tmp_path):
    stream = written(spark, str(tmp_path / "in"), [[("a", T0, 1, 1.0, 1.0), ("a", T0 - 9 * SEC, 2, 1.0, 1.0), ("b", T0, 3, 1.0, 1.0)]])
    alarms = timed.stream_silence_alarms(stream, SEC, 3 * SEC, clock="processing")
    with timed.typed_state(spark):
        q = alarms.writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:

        def until(n):
            end = time.time() + 90
            while time.time() < end and spark.table("alarms").count() < n:
                assert q.exception() is None
                time.sleep(0.3)
            return spark.table("alarms").collect()

        seen = until(4)
        assert sorted((r["symbol"], r["status"], r["age_ns"]) for r in seen) == sorted((s, w, n * SEC) for s in "ab" for w, n in (("degraded", 1), ("failed", 3)))
        assert all(r["at_ns"] - r["last_ns"] == r["age_ns"] for r in seen)
        written(spark, str(tmp_path / "in" / "more"), [[("a", T0 + SEC, 4, 1.0, 1.0)]])
        back = [r for r in until(5) if r["status"] == "healthy"]
        assert [r["symbol"] for r in back] == ["a"] and back[0]["age_ns"] >= 3 * SEC
    finally:
        q.stop()


def test_wrong_parameters(spark, tmp_path):
    ticks = spark.createDataFrame([], SCHEMA)
    for f in (
        lambda: timed.stream_silence_alarms(ticks, 5, 4),
        lambda: timed.stream_silence_alarms(ticks, 0, 4),
        lambda: timed.stream_silence_alarms(ticks, 1, 4, clock="sun"),
        lambda: timed.stream_bars_by_key(ticks, []),
        lambda: timed.stream_bars_by_key(ticks, [5, 5]),
    ):
        with pytest.raises(ValueError):
            f()


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(timed.PROVIDER)
    with timed.typed_state(spark):
        assert spark.conf.get(timed.PROVIDER) == timed.ROCKS
    assert spark.conf.get(timed.PROVIDER) == before
