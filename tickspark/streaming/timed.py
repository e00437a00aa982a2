"""Streams with typed state and timers: feeds that fall silent (K7) and bars that close per key (K1).

Both use ``transformWithStateInPandas``, whose state lives in RocksDB: start such a query inside ``typed_state``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickspark.plans.catalog import HOUR, MINUTE, query

from .streams import drain, tick_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1_000_000
HEALTHY, DEGRADED, FAILED = 0, 1, 2
STATUS = ("healthy", "degraded", "failed")


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state needs, for queries started inside; the session's own comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drain_typed(stream: DataFrame) -> DataFrame:
    with typed_state(stream.sparkSession):
        return drain(stream)


class Silence(StatefulProcessor):
    """One source: its last event, its status, and one timer for the next status that silence would bring."""

    def __init__(self, name: str, degraded_ns: int, failed_ns: int, by_event: bool) -> None:
        self.name, self.limits, self.by_event = name, (0, degraded_ns, failed_ns), by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("source", "last_ns long, status int, due_ms long")

    def _rows(self, key: tuple, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if made:
            yield pd.DataFrame([(key[0], *m) for m in made], columns=[self.name, "at_ns", "last_ns", "age_ns", "status"])

    def _aged(self, last: int, status: int, upto: int) -> tuple[int, list[tuple]]:
        """The alarms due by ``upto`` if nothing came after ``last``."""
        made = []
        while status < FAILED and last + self.limits[status + 1] <= upto:
            status += 1
            made.append((last + self.limits[status], last, self.limits[status], STATUS[status]))
        return status, made

    def _keep(self, last: int, status: int, due: int | None) -> None:
        """One timer stands, at the first millisecond by which the next status is due."""
        new = -(-(last + self.limits[status + 1]) // MS) if status < FAILED else None
        if due != new:
            if due is not None:
                self.handle.deleteTimer(due)
            if new is not None:
                self.handle.registerTimer(new)
        self.held.update((last, status, new))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, status, due = self.held.get() if self.held.exists() else (None, HEALTHY, None)
        width, ends = self.limits[DEGRADED], {}
        for part in rows:
            if not self.by_event:
                continue
            ts = part["ts_ns"].dropna().astype("int64")
            # Events that far apart never share a span of ``width``, so the ends of each span tell all gaps that count.
            found = ts.groupby(ts // width).agg(["min", "max"])
            for at, low, high in found.itertuples():
                one = ends.get(at)
                ends[at] = (low, high) if one is None else (min(low, one[0]), max(high, one[1]))
        if not self.by_event:
            now = timerValues.getCurrentProcessingTimeInMs() * MS
            ends[0] = (now, now)
        made: list[tuple] = []
        for at in sorted(ends):
            low, high = (int(v) for v in ends[at])
            if last is not None and high <= last:
                continue
            if last is not None and low > last:
                status, found = self._aged(last, status, low)
                made += found
                if status:
                    made.append((low, last, low - last, STATUS[HEALTHY]))
            elif status:
                made.append((high, last, high - last, STATUS[HEALTHY]))
            last, status = high, HEALTHY
        if last is not None:
            self._keep(last, status, due)
        yield from self._rows(key, made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, status, due = self.held.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        status, made = self._aged(last, status, max(now, due) * MS)
        self._keep(last, status, None)
        yield from self._rows(key, made)

    def close(self) -> None:
        pass


def stream_silence_alarms(ticks: DataFrame, degraded_ns: int, failed_ns: int, key: str = "symbol", clock: str = "event", delay: str = "0 seconds") -> DataFrame:
    """K7: a row whenever a source turns degraded, failed or healthy again, also while no row comes.

    A source is degraded once ``degraded_ns`` have passed since its last event, failed after ``failed_ns``; ``at_ns``
    says when that was so. ``clock="event"`` measures by event time: other sources move the watermark on, and a replay
    gives what the live stream gave. ``clock="processing"`` measures from the last arrival by the machine's clock; its
    query needs a processing-time trigger, which wakes it without data. Late events never move a source back. Rows
    without source or time are dropped.
    """
    if not 0 < degraded_ns <= failed_ns:
        raise ValueError("silence degrades a source before it fails it")
    if clock not in ("event", "processing"):
        raise ValueError(f"unknown clock {clock!r}")
    by_event = clock == "event"
    rows = ticks.where(F.col(key).isNotNull() & F.col("ts_ns").isNotNull())
    rows = (rows.withWatermark("event_time", delay) if by_event else rows).select(key, "ts_ns", *(["event_time"] if by_event else []))
    out = f"{key} {ticks.schema[key].dataType.simpleString()}, at_ns long, last_ns long, age_ns long, status string"
    return rows.groupBy(key).transformWithStateInPandas(Silence(key, degraded_ns, failed_ns, by_event), out, "append", "eventTime" if by_event else "processingTime")


BAR = "interval_ns long, open_ts long, open double, high double, low double, close double, volume double, n_ticks long, late_ticks long"


def bars_on(state: tuple | None, interval: int, ts: np.ndarray, price: np.ndarray, size: np.ndarray) -> tuple[tuple, list[tuple]]:
    """Ticks in order of arrival into bars: the open bar with its late count, and the bars that later ticks closed.

    Both are tuples of BAR. A tick before the open bar is late: counted, not taken. One inside it is taken in any order.
    """
    start = ts - ts % interval
    floor = np.maximum.accumulate(np.concatenate(([state[1]], start)) if state else start)
    floor = floor[1:] if state else floor
    fresh = start >= floor
    late, base = np.cumsum(~fresh), state[8] if state else 0
    ts, price, size, start, late = (v[fresh] for v in (ts, price, size, start, late))
    made: list[tuple] = []
    bar = state
    if len(ts):
        at = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1])))
        columns = zip(start[at], price[at], np.maximum.reduceat(price, at), np.minimum.reduceat(price, at), price[np.append(at[1:], len(ts)) - 1], np.add.reduceat(size, at), np.diff(np.append(at, len(ts))), late[at], strict=True)
        for t, o, h, low, c, v, n, seen in columns:
            if bar is not None and bar[1] == t:
                bar = (interval, bar[1], bar[2], max(bar[3], float(h)), min(bar[4], float(low)), float(c), bar[6] + float(v), bar[7] + int(n), bar[8])
                continue
            if bar is not None:
                made.append((*bar[:8], base + int(seen)))
            bar = (interval, int(t), float(o), float(h), float(low), float(c), float(v), int(n), 0)
    return (*bar[:8], base + int((~fresh).sum())), made


class KeyedBars(StatefulProcessor):
    """One symbol: its open bar of each interval, with the late ticks so far."""

    def __init__(self, intervals: tuple[int, ...]) -> None:
        self.intervals = intervals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", BAR)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Arrival is known only when all rows of the trigger are here; four plain columns of them are held.
        parts = [[p[c].to_numpy(t) for c, t in (("seq", "int64"), ("ts_ns", "int64"), ("price", float), ("size", float))] for p in rows]
        seq, ts, price, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(seq, kind="stable")
        ts, price, size = ts[order], price[order], size[order]
        held = {int(s[0]): tuple(s) for s in self.open.get()}
        made: list[tuple] = []
        for interval in self.intervals:
            held[interval], closed = bars_on(held.get(interval), interval, ts, price, size)
            made += closed
        self.open.put([held[i] for i in self.intervals])
        if made:
            out = pd.DataFrame(made, columns=[c.split()[0] for c in BAR.split(", ")])
            out.insert(0, "symbol", key[0])
            yield out

    def close(self) -> None:
        pass


def stream_bars_by_key(ticks: DataFrame, intervals: list[int]) -> DataFrame:
    """K1: bars of several intervals from one state per symbol; a bar leaves when a later tick of its symbol crosses its end.

    No clock and no other symbol closes a bar, open bars never leave, and ``late_ticks`` counts what came too late for
    that symbol and interval until the bar left. Ticks are taken in order of arrival (seq). Sane ticks only: positive
    price and size, nothing missing.
    """
    if not intervals or min(intervals) <= 0 or len(set(intervals)) < len(intervals):
        raise ValueError("intervals are positive and different")
    sane = ticks.where("price > 0 and size > 0 and symbol is not null and ts_ns is not null and seq is not null and not isnan(price) and not isnan(size)")
    columns = sane.select("symbol", "ts_ns", "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return columns.groupBy("symbol").transformWithStateInPandas(KeyedBars(tuple(intervals)), "symbol string, " + BAR, "append", "none")


_JUMPS = f"SELECT symbol, seq, price, size, ts_ns - CASE WHEN seq % 41 = 0 THEN {3 * HOUR} ELSE 0 END AS ts_ns FROM v_ticks WHERE price > 0 AND size > 0"


@query(
    "k1_stream_bars_by_key",
    f"""WITH t AS (SELECT t.*, iv, ts_ns - ts_ns % iv AS b FROM ({_JUMPS}) t, (SELECT unnest([{HOUR}, {4 * HOUR}]) AS iv) i), m AS (SELECT *, max(b) OVER (PARTITION BY symbol, iv ORDER BY seq) AS now FROM t),
    l AS (SELECT *, sum((b < now)::INT) OVER (PARTITION BY symbol, iv ORDER BY seq) AS late FROM m),
    g AS (SELECT symbol, iv, b, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume, count(*) AS n_ticks, min(late) AS seen FROM l WHERE b = now GROUP BY 1, 2, 3),
    n AS (SELECT *, lead(seen) OVER (PARTITION BY symbol, iv ORDER BY b) AS late_ticks FROM g)
    SELECT symbol, iv AS interval_ns, b AS open_ts, open, high, low, close, volume, n_ticks, late_ticks::BIGINT AS late_ticks FROM n WHERE late_ticks IS NOT NULL""",
    "v_ticks",
)
def k1_by_key(spark, sf):
    t = tick_stream(spark, sf)
    jumps = t.withColumn("ts_ns", F.col("ts_ns") - F.when(F.col("seq") % 41 == 0, 3 * HOUR).otherwise(0))
    return drain_typed(stream_bars_by_key(jumps, [HOUR, 4 * HOUR]))


_SHORT, _LONG = 10 * MINUTE, HOUR


@query(
    "k7_stream_silence_alarms",
    f"""WITH g AS (SELECT symbol, ts_ns AS last_ns, lead(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS next_ns FROM v_ticks), w AS (SELECT max(ts_ns) // {MS} * {MS} AS clock FROM v_ticks),
    a AS (SELECT symbol, last_ns, next_ns, coalesce(next_ns, clock) - last_ns AS gap FROM g, w)
    SELECT symbol, last_ns + {_SHORT} AS at_ns, last_ns, {_SHORT}::BIGINT AS age_ns, 'degraded' AS status FROM a WHERE gap >= {_SHORT}
    UNION ALL SELECT symbol, last_ns + {_LONG}, last_ns, {_LONG}::BIGINT, 'failed' FROM a WHERE gap >= {_LONG}
    UNION ALL SELECT symbol, next_ns, last_ns, gap, 'healthy' FROM a WHERE gap >= {_SHORT} AND next_ns IS NOT NULL""",
    "v_ticks",
)
def k7_alarms(spark, sf):
    return drain_typed(stream_silence_alarms(tick_stream(spark, sf), _SHORT, _LONG))
