"""Structured Streaming forms of the bounded operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.api.types import union_categoricals
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tickspark.functions import kernels as K
from tickspark.plans.catalog import HOUR, SECOND, query, r, scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, sf_dir: str, files: int = 8) -> DataFrame:
    """K8: the event table as a stream of ticks, so many files a trigger; ``event_time`` carries the watermark."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    t = F.col("ts").cast("timestamp")
    return raw.select(F.col("event_type").alias("symbol"), (F.unix_micros(t) * 1000).alias("ts_ns"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"), "user_id", t.alias("event_time"))


def drain(stream: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a written table, and returns that table."""
    spark = stream.sparkSession
    path = scratch(spark)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(path)


def stream_bars(ticks: DataFrame, interval_ns: int, delay: str = "0 seconds") -> DataFrame:
    """K1: a bar leaves once the watermark has passed its end; later ticks for it are dropped. Sane ticks only."""
    sane = ticks.where("price > 0 and size > 0").withWatermark("event_time", delay)
    order = F.struct("ts_ns", "seq")
    w = F.window("event_time", f"{interval_ns // 1000} microseconds")
    bars = sane.groupBy("symbol", w).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n_ticks"))
    ns = lambda c: F.unix_micros(F.col(c)) * 1000
    return bars.select("symbol", ns("window.start").alias("open_ts"), ns("window.end").alias("close_ts"), "open", "high", "low", "close", "volume", "n_ticks", F.col("window.end").alias("end_time"))


#: Rows that a step gets at a time.
CHUNK = 100_000


def _in_order(parts: Iterator[pd.DataFrame], key: dict, order: list[str], chunk: int) -> Iterator[pd.DataFrame]:
    """A key's rows of a trigger in order, a chunk at a time.

    Order is known only when all rows are here; held are their plain columns alone, texts as codes, and one sorted index.
    """
    names: list[str] = []
    held: dict[str, list] = {}
    for part in parts:
        names = list(part.columns)
        for c in names:
            if c not in key:
                text = pd.api.types.is_string_dtype(part[c].dtype) and pd.api.types.infer_dtype(part[c], skipna=True) in ("string", "empty")
                held.setdefault(c, []).append(pd.Categorical(part[c]) if text else part[c])
    columns = {}
    for c in list(held):
        pieces = held.pop(c)
        texts = all(isinstance(p, pd.Categorical) for p in pieces)
        columns[c] = pd.Series(union_categoricals(pieces)) if texts else pd.concat([pd.Series(p) for p in pieces], ignore_index=True)
        pieces.clear()
    at = np.lexsort([columns[c].to_numpy() for c in reversed(order)])
    for i in range(0, len(at), chunk):
        now = at[i : i + chunk]
        taken = {c: v.take(now).reset_index(drop=True) for c, v in columns.items()}
        plain = {c: v.astype(v.cat.categories.dtype) if isinstance(v.dtype, pd.CategoricalDtype) else v for c, v in taken.items()}
        yield pd.DataFrame({**plain, **key}, index=range(len(now)))[names]


def stateful(stream: DataFrame, keys: list[str], out: str, state: str, step, order: tuple[str, ...] = ("ts_ns", "seq"), expire_ms: int | None = None) -> DataFrame:
    """Rows of a key in order within each trigger go through ``step(state or None, rows) -> (state, rows)``.

    A step gets at most CHUNK rows, so it is called several times for a long trigger. ``maxFilesPerTrigger`` bounds the
    files of a trigger. With ``expire_ms`` a key without rows for that long loses its
    state; that is for queries with a processing-time trigger, since one that drains what is there would wait.
    """
    schema = T._parse_datatype_string(out)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = held.get if held.exists else None
        for rows in _in_order(parts, dict(zip(keys, key, strict=True)), list(order), CHUNK):
            state, made = step(state, rows)
            held.update(state)
            if expire_ms:
                held.setTimeoutDuration(expire_ms)
            yield made[schema.names]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, out, state, "append", timeout)


def stream_quality(frames: DataFrame, stale_ns: int = SECOND) -> DataFrame:
    """K2: the quote gate; the last good number of each (exchange, symbol) is the state."""

    def step(state, rows: pd.DataFrame):
        crossed = (rows["bid"] > 0) & (rows["ask"] > 0) & (rows["bid"] > rows["ask"])
        stale = rows["ingest_ts_ns"] - rows["ts_ns"] > stale_ns
        good = rows["sequence"].where(~(crossed | stale)).astype("Int64")
        known = pd.concat([pd.Series([state[0] if state else None], dtype="Int64"), good], ignore_index=True).ffill()
        gap = (good > known[:-1].to_numpy() + 1).fillna(False).to_numpy(bool)
        lost = np.where(gap, (good - known[:-1].to_numpy() - 1).fillna(0).to_numpy(np.int64), 0)
        last = known.iloc[-1]
        return (None if pd.isna(last) else int(last),), rows.assign(verdict=np.select([crossed, stale, gap], ["crossed", "stale", "gap"], "ok"), dropped=lost)

    return stateful(frames, ["exchange", "symbol"], "exchange string, symbol string, seq long, verdict string, dropped long", "last long", step)


def stream_symbol_snapshots(ticks: DataFrame, window: int = 256, publish_ns: int = 10_000_000) -> DataFrame:
    """K3: the symbol snapshots of W19, published at most every ``publish_ns``; ticks in order of arrival (seq)."""
    from tickspark.operators.windows import SNAPSHOT, SNAPSHOT_STATE, snapshot_step

    def step(state, rows: pd.DataFrame):
        state, columns = snapshot_step(state, rows, window, publish_ns)
        made = rows.assign(**columns)
        return tuple(v if isinstance(v, list) else v.item() if hasattr(v, "item") else v for v in state), made[made["publish"]]

    out = "symbol string, ts_ns long, seq long, price double, size double, " + SNAPSHOT.removesuffix(", publish boolean")
    return stateful(ticks.select("symbol", "ts_ns", "seq", "price", "size"), ["symbol"], out, SNAPSHOT_STATE, step, ("seq",))


def stream_pair_snapshots(
    ticks: DataFrame, y: str, x: str, keys: list[str], tolerance_ns: int, window: int = 256, min_bars: int = 64, every: int = 64, publish_ns: int = 1_000_000, bars: DataFrame | None = None, bar_ns: int | None = None
) -> DataFrame:
    """K4: the pair snapshots of P16 on every tick of either leg whose other leg is not too old.

    Retests and the volume mean follow bars: a second stream (keys, symbol, open_ts, ts_ns of the close, seq, close,
    volume) in one state with the ticks, or bars of ``bar_ns`` that the state makes of the ticks; without either, each
    joined tick counts as a bar. Late ticks are dropped and counted in ``late``.
    """
    from tickspark.operators.pairs import PAIR_SNAPSHOT, PAIR_STATE, pair_step

    columns = [f.name for f in T._parse_datatype_string(PAIR_SNAPSHOT).fields]
    tick_bars = bars is None and bar_ns is None

    def step(state, rows: pd.DataFrame):
        state, made = pair_step(state, rows, tolerance_ns, window, min_bars, every, publish_ns, bar_ns, tick_bars=tick_bars)
        at = [i for i, _ in made]
        return state, pd.concat([rows.loc[at, [*keys, "ts_ns", "seq"]].reset_index(drop=True), pd.DataFrame([v for _, v in made], columns=columns)], axis=1)

    def tagged(df: DataFrame, is_bar: bool, price: str, volume: str | None) -> DataFrame:
        size = F.col(volume).cast("double") if volume else F.lit(1.0)
        start = F.col("open_ts") if is_bar else F.lit(0)
        legs = df.where(F.col("symbol").isin(y, x))
        return legs.select(*keys, (F.col("symbol") == y).alias("is_y"), F.lit(is_bar).alias("is_bar"), "ts_ns", "seq", start.cast("long").alias("open_ts"), F.col(price).alias("price"), size.alias("volume"))

    events = tagged(ticks, False, "price", "size" if "size" in ticks.columns else None)
    if bars is not None:
        events = events.unionByName(tagged(bars, True, "close", "volume"))
    head = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return stateful(events, keys, f"{head}, ts_ns long, seq long, {PAIR_SNAPSHOT}", PAIR_STATE, step, ("seq",))


def stream_join_bars(y: DataFrame, x: DataFrame, delay: str = "1 hour") -> DataFrame:
    """K5: closes of two bar streams at the boundaries that both have."""
    a = y.select(F.col("open_ts").alias("y_ts"), F.col("close").alias("y"), F.col("end_time").alias("y_time")).withWatermark("y_time", delay)
    b = x.select(F.col("open_ts").alias("x_ts"), F.col("close").alias("x"), F.col("end_time").alias("x_time")).withWatermark("x_time", delay)
    return a.join(b, (F.col("y_ts") == F.col("x_ts")) & (F.col("y_time") == F.col("x_time"))).select(F.col("y_ts").alias("open_ts"), "y", "x")


def stream_states(df: DataFrame, machine: str, limit: float = 0.2, cooldown_ns: int = 10 * SECOND) -> DataFrame:
    """K6: ``regime`` (key symbol, column regime), ``alert`` (key code) or ``circuit`` (key curve_id) states.

    The circuit's rows have drawdown and a boolean reset: armed until the drawdown exceeds ``limit``, tripped for the
    cooldown, then recovering until a reset.
    """
    if machine == "regime":
        code = {n: i for i, n in enumerate(K.REGIMES)}

        def regime(state, rows: pd.DataFrame):
            state, out = K.regime_states(state, rows["regime"].map(code).to_numpy(), rows["ts_ns"].to_numpy())
            return state, rows.assign(state=np.array(K.REGIMES, object)[out])

        return stateful(df.select("symbol", "ts_ns", "seq", "regime"), ["symbol"], "symbol string, ts_ns long, seq long, regime string, state string", "now long, last long, count long, since long", regime)
    if machine == "alert":
        from tickspark.operators.telemetry import alert_states

        def raised(state, rows: pd.DataFrame):
            first, count = state or (None, 0)
            notify, counts, first, count = alert_states(rows["ts_ns"].to_numpy(), 30 * SECOND, first, count)
            return (int(first), int(count)), rows.assign(notify=notify, count=counts)

        return stateful(df.select("code", "ts_ns", "seq"), ["code"], "code string, ts_ns long, seq long, notify boolean, count long", "first long, count long", raised)
    if machine == "circuit":

        def circuit(state, rows: pd.DataFrame):
            tripped, out = state[0] if state else None, []
            for ts, drawdown, reset in zip(rows["ts_ns"], rows["drawdown"], rows["reset"], strict=True):
                if reset:
                    tripped = None
                elif tripped is None and drawdown > limit:
                    tripped = int(ts)
                out.append("armed" if tripped is None else "tripped" if ts - tripped < cooldown_ns else "recovering")
            return (tripped,), rows.assign(circuit=out)

        return stateful(df.select("curve_id", "ts_ns", "seq", "drawdown", "reset"), ["curve_id"], "curve_id string, ts_ns long, seq long, circuit string", "tripped long", circuit)
    raise ValueError(f"unknown machine {machine!r}")


def stream_feed_silence(ticks: DataFrame, key: str = "symbol") -> DataFrame:
    """K7: the last event of each source, for a look at any time by ``silence``; ``timed.stream_silence_alarms`` reports by itself."""
    return ticks.groupBy(key).agg(F.max("ts_ns").alias("last_ts"))


def silence(last: DataFrame, now_ns: int, degraded_ns: int, failed_ns: int) -> DataFrame:
    age = F.lit(now_ns) - F.col("last_ts")
    return last.withColumn("age_ns", age).withColumn("status", F.when(age >= failed_ns, "failed").when(age >= degraded_ns, "degraded").otherwise("healthy"))


def _gated(t: DataFrame) -> DataFrame:
    s = F.col("seq")
    return t.select(F.when(s % 2 == 0, "b").otherwise("c").alias("exchange"), "symbol", "seq", "ts_ns", (F.col("ts_ns") + F.when(s % 53 == 0, 2 * SECOND).otherwise(1000)).alias("ingest_ts_ns"), F.when(s % 31 == 0, F.lit(1e9)).otherwise(F.lit(0.9998) * F.col("price")).alias("bid"), (F.lit(1.0002) * F.col("price")).alias("ask"), (s - F.when(s % 97 == 0, 5).otherwise(0)).alias("sequence"))


@query(
    "k1_stream_bars",
    f"""WITH w AS (SELECT max(ts_ns) AS w FROM v_ticks WHERE price > 0 AND size > 0) SELECT symbol, ts_ns - ts_ns % {HOUR} AS open_ts, arg_min(price, (ts_ns, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ns, seq)) AS close, sum(size) AS volume, count(*) AS n_ticks
    FROM v_ticks, w WHERE price > 0 AND size > 0 AND ts_ns - ts_ns % {HOUR} + {HOUR} <= (w // 1000000) * 1000000 GROUP BY 1, 2""",
    "v_ticks",
)
def k1(spark, sf):
    return drain(stream_bars(tick_stream(spark, sf), HOUR)).drop("end_time", "close_ts")


@query(
    "k2_stream_quality",
    """WITH q AS (SELECT CASE seq % 2 WHEN 0 THEN 'b' ELSE 'c' END AS exchange, symbol, seq, CASE WHEN seq % 31 = 0 AND 1e9 > ask AND ask > 0 THEN 'crossed' WHEN seq % 53 = 0 THEN 'stale' END AS bad, seq - (seq % 97 = 0)::INT * 5 AS sequence FROM v_ticks),
    p AS (SELECT *, last_value(CASE WHEN bad IS NULL THEN sequence END IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM q)
    SELECT exchange, symbol, seq, coalesce(bad, CASE WHEN sequence > prev + 1 THEN 'gap' END, 'ok') AS verdict, CASE WHEN bad IS NULL AND sequence > prev + 1 THEN sequence - prev - 1 ELSE 0 END AS dropped FROM p""",
    "v_ticks",
)
def k2(spark, sf):
    return drain(stream_quality(_gated(tick_stream(spark, sf))))


@query("k3_stream_symbol_snapshots")
def k3(spark, sf):
    s = drain(stream_symbol_snapshots(tick_stream(spark, sf)))
    return s.select("symbol", "ts_ns", "seq", "n_ticks", *[r(c) for c in ("last_price", "denoised_price", "realized_vol", "ewma_vol", "rolling_mean", "rolling_std", "drawdown")], "state", "rejected", "ready")


@query("k4_stream_pair_snapshots")
def k4(spark, sf):
    t = tick_stream(spark, sf).withColumn("g", F.col("user_id") % 20)
    s = drain(stream_pair_snapshots(t, "click", "view", ["g"], 10 * HOUR, bar_ns=10 * HOUR))
    return s.select("g", "ts_ns", "seq", "y", "x", r("beta"), r("corr"), r("z", 4), "signal", "position", r("adf_p_value"), r("half_life", 4), "cointegrated", "ready", "n_bars", "late", r("avg_volume"))


@query(
    "k5_stream_join_bars",
    f"""WITH w AS (SELECT max(ts_ns) AS w FROM v_ticks WHERE price > 0 AND size > 0), b AS (SELECT symbol, ts_ns - ts_ns % {4 * HOUR} AS open_ts, arg_max(price, (ts_ns, seq)) AS close FROM v_ticks, w WHERE price > 0 AND size > 0 AND ts_ns - ts_ns % {4 * HOUR} + {4 * HOUR} <= (w // 1000000) * 1000000 GROUP BY 1, 2)
    SELECT a.open_ts, a.close AS y, c.close AS x FROM b a JOIN b c ON a.open_ts = c.open_ts WHERE a.symbol = 'click' AND c.symbol = 'view'""",
    "v_ticks",
)
def k5(spark, sf):
    bars = drain(stream_bars(tick_stream(spark, sf), 4 * HOUR))
    path = scratch(spark)
    bars.write.parquet(path)
    s = spark.readStream.schema(bars.schema).parquet(path)
    return drain(stream_join_bars(s.where("symbol = 'click'"), s.where("symbol = 'view'")))


@query(
    "k6_stream_states",
    f"""WITH RECURSIVE q AS (SELECT symbol, seq, ts_ns, CASE WHEN size < 80 THEN 'volatile' ELSE 'calm' END AS regime, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS i FROM v_ticks),
    m(symbol, i, ts_ns, seq, regime, now, other, n, since) AS (SELECT DISTINCT symbol, 0::BIGINT, 0::BIGINT, 0::BIGINT, 'calm', 'calm', 'calm', 0::BIGINT, 0::BIGINT FROM q UNION ALL
      SELECT x.symbol, x.i, x.ts_ns, x.seq, x.regime, CASE WHEN x.regime <> x.now AND n >= CASE WHEN x.regime = 'calm' THEN 100 ELSE 20 END AND x.ts_ns - since >= {SECOND} * CASE WHEN x.regime = 'calm' THEN 15 ELSE 2 END THEN x.regime ELSE x.now END, other, n, since
      FROM (SELECT q.*, m.now, q.regime AS other, CASE WHEN q.regime = m.now THEN 0 WHEN q.regime = m.other THEN m.n + 1 ELSE 1 END AS n, CASE WHEN q.regime = m.now OR q.regime = m.other THEN m.since ELSE q.ts_ns END AS since FROM m JOIN q ON q.symbol = m.symbol AND q.i = m.i + 1) x)
    SELECT symbol, ts_ns, seq, regime, now AS state FROM m WHERE i > 0""",
    "v_ticks",
)
def k6(spark, sf):
    size = F.col("size")
    t = tick_stream(spark, sf).withColumn("regime", F.when(size < 80, "volatile").otherwise("calm"))
    return drain(stream_states(t, "regime"))


@query("k7_stream_feed_silence", "WITH l AS (SELECT symbol, max(ts_ns) AS last_ts FROM v_ticks GROUP BY 1), n AS (SELECT max(last_ts) AS now FROM l) SELECT symbol, now - last_ts AS age_ns, CASE WHEN now - last_ts >= 3600000000000 THEN 'failed' WHEN now - last_ts >= 600000000000 THEN 'degraded' ELSE 'healthy' END AS status FROM l, n", "v_ticks")
def k7(spark, sf):
    path = scratch(spark)
    stream = stream_feed_silence(tick_stream(spark, sf))
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/{i}") if not df.isEmpty() else None).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.schema("symbol string, last_ts long").parquet(f"{path}/*").groupBy("symbol").agg(F.max("last_ts").alias("last_ts"))
    now = last.agg(F.max("last_ts")).first()[0]
    return silence(last, now, 600 * SECOND, 3600 * SECOND).select("symbol", "age_ns", "status")


@query("k8_replay", "SELECT symbol, seq, price FROM v_ticks WHERE symbol = 'view' AND price > 50", "v_ticks")
def k8(spark, sf):
    return drain(tick_stream(spark, sf).where("symbol = 'view' and price > 50").select("symbol", "seq", "price"))
