"""Bars, grids, alignment and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.stretches import stretches
from tickspark.plans.catalog import DAY, HOUR, query, r, series, ticks

FIELDS = ("open", "high", "low", "close", "volume")


def floor_to(col: str | Column, step: int | Column) -> Column:
    """Largest multiple of ``step`` at or below; floors negative times too."""
    c = F.col(col) if isinstance(col, str) else col
    return c - F.pmod(c, F.lit(step) if isinstance(step, int) else step)


def sane(df: DataFrame) -> DataFrame:
    """Keeps ticks without a sanity reason."""
    from .filters import sanity

    return sanity(df).where("reason is null").drop("reason")


def build_bars(ticks: DataFrame, interval_ns: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV bars over half-open buckets; open and close by (ts_ns, seq). Empty buckets give no row.

    Partial aggregation folds each bucket before the one shuffle by (key, bucket).
    """
    return _bars(ticks.withColumn("interval_ns", F.lit(interval_ns)), keys).drop("interval_ns")


def _bars(ticks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    order = F.struct("ts_ns", "seq")
    bucketed = ticks.withColumn("open_ts", floor_to("ts_ns", F.col("interval_ns")))
    bars = bucketed.groupBy(*keys, "interval_ns", "open_ts").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("n_ticks"),
    )
    return bars.withColumn("close_ts", F.col("open_ts") + F.col("interval_ns"))


def build_bars_multi(ticks: DataFrame, intervals: tuple[int, ...]) -> DataFrame:
    """Bars of several intervals in one pass over sane ticks."""
    return _bars(sane(ticks).withColumn("interval_ns", F.explode(F.array(*map(F.lit, intervals)))), ("symbol",))


def finalize_bars(bars: DataFrame, print_partial: bool = False) -> DataFrame:
    """Marks each symbol's newest bar partial; drops it unless ``print_partial``."""
    newest = bars.groupBy("symbol").agg(F.max("open_ts").alias("_newest"))
    marked = bars.join(newest, "symbol").withColumn("partial", F.col("open_ts") == F.col("_newest")).drop("_newest")
    return marked if print_partial else marked.where("not partial")


def late_ticks(ticks: DataFrame, interval_ns: int, length: int | None = None) -> DataFrame:
    """T4: flags ticks that arrive (by seq) after a later bucket has opened."""
    cut = stretches(ticks, "symbol", ("seq",), length)
    bucket = floor_to("ts_ns", interval_ns)
    return cut.done(cut.running(cut.df, {"_open": ("max", bucket)}, before=True).withColumn("late", F.coalesce(bucket < F.col("_open"), F.lit(False))).drop("_open"))


def latest_bars(bars: DataFrame, n: int = 1024) -> DataFrame:
    """T5: the newest ``n`` bars of each symbol; Spark applies the limit before its shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.desc("open_ts"))
    return bars.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def uniform_grid(bounds: DataFrame, step: int) -> DataFrame:
    """Grid points from ``start`` to ``end``, both inclusive, per row of ``bounds``."""
    if step <= 0:
        raise ValueError("step must be positive")
    return bounds.withColumn("ts_ns", F.explode(F.sequence("start", "end", F.lit(step)))).drop("start", "end")


def align_to_grid(series: DataFrame, grid: DataFrame, cols: tuple[str, ...] = ("price",), key: str = "symbol", length: int | None = None) -> DataFrame:
    """Last value at or before each grid point; null before the first. ``grid``: key, ts_ns.

    Rows and grid points are sorted together once per key and carried forward, so no row meets another.
    """
    left = series.select(key, "ts_ns", F.lit(0).alias("_grid"), *cols)
    right = grid.select(key, "ts_ns", F.lit(1).alias("_grid"), *[F.lit(None).cast(series.schema[c].dataType).alias(c) for c in cols])
    cut = stretches(left.unionByName(right), key, ("ts_ns", "_grid"), length)
    carried = cut.running(cut.df, {f"_last_{c}": ("last", F.col(c)) for c in cols})
    return cut.done(carried.where("_grid = 1").select(*[c for c in cut.df.columns if c not in (*cols, "_grid")], *[F.col(f"_last_{c}").alias(c) for c in cols]))


def pad(aligned: DataFrame, policy: str = "pad_nan", col: str = "price", key: str = "symbol") -> DataFrame:
    """``pad_nan`` keeps nulls; ``drop`` and ``skip_until_all_present`` drop rows before all series are valid."""
    if policy == "pad_nan":
        return aligned
    n = aligned.select(key).distinct().agg(F.count("*").alias("_n"))
    full = aligned.groupBy("ts_ns").agg(F.count(col).alias("_valid")).join(F.broadcast(n), F.col("_valid") == F.col("_n"))
    first = full.agg(F.min("ts_ns").alias("_first"))
    return aligned.join(F.broadcast(first), F.col("ts_ns") >= F.col("_first")).drop("_first")


def fill_forward(df: DataFrame, col: str = "price", key: str = "symbol", length: int | None = None) -> DataFrame:
    """The last value carried forward; ``filled`` marks filled rows."""
    cut = stretches(df, key, ("ts_ns",), length)
    carried = cut.done(cut.running(cut.df, {"_new": ("last", F.col(col))}))
    return carried.withColumn("filled", F.col(col).isNull() & F.col("_new").isNotNull()).withColumn(col, F.col("_new")).drop("_new")


def fill_linear(df: DataFrame, col: str = "price", key: str = "symbol", length: int | None = None) -> DataFrame:
    """Interior gaps by row position between their neighbours; leading and trailing gaps stay null.

    The next known value is the last one in the opposite order.
    """
    ahead = df.withColumn("_back", -F.col("ts_ns"))
    cut = stretches(ahead, key, ("ts_ns",), length)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(col).alias("v")))
    met = cut.done(cut.running(cut.running(cut.df, {"_i": ("count", F.lit(1))}), {"_a": ("last", known)}))
    turned = stretches(met, key, ("_back",), length)
    met = turned.done(turned.running(turned.df, {"_b": ("last", known)}))
    share = (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    value = F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_a.i") < F.col("_b.i"), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share)
    return met.withColumn("filled", F.col(col).isNull() & value.isNotNull()).withColumn(col, value).drop("_i", "_a", "_b", "_back")


def fill_none(df: DataFrame) -> DataFrame:
    """Leaves gaps; nothing is filled."""
    return df.withColumn("filled", F.lit(False))


def fill_count(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.count_if("filled").alias("filled"))


def bar_series(bars: DataFrame, cols: tuple[str, ...] = FIELDS) -> DataFrame:
    """Bars as long rows (symbol, open_ts, field, value)."""
    return bars.unpivot(["symbol", "open_ts"], [F.col(c).cast("double").alias(c) for c in cols], "field", "value")


_BARS = """SELECT symbol, ts_ns - ts_ns % {i} AS open_ts, arg_min(price, (ts_ns, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ns, seq)) AS close,
    sum(size) AS volume, count(*) AS n_ticks, ts_ns - ts_ns % {i} + {i} AS close_ts FROM v_ticks WHERE price > 0 AND size > 0 GROUP BY 1, 2, 9"""
_B1 = _BARS.format(i=HOUR)


def _hour(spark, sf):
    return build_bars(sane(ticks(spark, sf)), HOUR)


@query("t1_build_bars", f"WITH b AS ({_B1}) SELECT *, open_ts = max(open_ts) OVER (PARTITION BY symbol) AS partial FROM b", "v_ticks")
def t1(spark, sf):
    return finalize_bars(_hour(spark, sf), print_partial=True)


@query("t2_bars_multi", " UNION ALL ".join(f"SELECT {i}::BIGINT AS interval_ns, * FROM ({_BARS.format(i=i)})" for i in (HOUR, 4 * HOUR, DAY)), "v_ticks")
def t2(spark, sf):
    return build_bars_multi(ticks(spark, sf), (HOUR, 4 * HOUR, DAY))


@query("t3_finalize_bars", f"WITH b AS ({_B1}) SELECT *, false AS partial FROM b WHERE open_ts < (SELECT max(open_ts) FROM b c WHERE c.symbol = b.symbol)", "v_ticks")
def t3(spark, sf):
    return finalize_bars(_hour(spark, sf))


#: Events arrive in time order; a shifted clock makes some of them late.
_LATE = f"SELECT symbol, seq, ts_ns - (seq % 7 = 0)::INT * {2 * HOUR} AS ts_ns FROM v_ticks"


@query(
    "t4_late_ticks",
    f"""WITH s AS ({_LATE}), m AS (SELECT symbol, ts_ns - ts_ns % {HOUR} AS b, max(ts_ns - ts_ns % {HOUR}) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM s)
    SELECT symbol, count(*) AS n, count(*) FILTER (WHERE b < o) AS late FROM m GROUP BY symbol""",
    "v_ticks",
)
def t4(spark, sf):
    shifted = ticks(spark, sf).withColumn("ts_ns", F.col("ts_ns") - F.when(F.col("seq") % 7 == 0, 2 * HOUR).otherwise(0))
    return late_ticks(shifted, HOUR).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


@query("t5_latest_bars", f"WITH b AS ({_B1}) SELECT symbol, open_ts, close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_ts DESC) <= 50", "v_ticks")
def t5(spark, sf):
    return latest_bars(_hour(spark, sf), 50).select("symbol", "open_ts", "close")


_GRID = f"SELECT symbol, unnest(range(min(ts_ns), max(ts_ns) + 1, {7 * DAY})) AS ts_ns FROM v_series GROUP BY symbol"


def _grid(spark, sf, step):
    return uniform_grid(series(spark, sf).groupBy("symbol").agg(F.min("ts_ns").alias("start"), F.max("ts_ns").alias("end")), step)


@query("t6_uniform_grid", _GRID, "v_series")
def t6(spark, sf):
    return _grid(spark, sf, 7 * DAY)


_ALIGNED = f"""g AS (SELECT s.symbol, t.ts_ns FROM (SELECT DISTINCT symbol FROM v_series) s, (SELECT unnest(range(min(ts_ns), max(ts_ns) + 1, {5 * DAY})) AS ts_ns FROM v_series) t),
    a AS (SELECT g.symbol, g.ts_ns, v.price FROM g ASOF LEFT JOIN v_series v ON g.symbol = v.symbol AND g.ts_ns >= v.ts_ns)"""


def _aligned(spark, sf):
    s = series(spark, sf)
    span = s.agg(F.min("ts_ns").alias("start"), F.max("ts_ns").alias("end"))
    return align_to_grid(s, s.select("symbol").distinct().crossJoin(F.broadcast(uniform_grid(span, 5 * DAY))))


@query("t7_align_to_grid", f"WITH {_ALIGNED} SELECT symbol, ts_ns, R2(price) AS price FROM a", "v_series")
def t7(spark, sf):
    return _aligned(spark, sf).select("symbol", "ts_ns", r("price", 2))


@query(
    "t8_pad_policies",
    f"""WITH {_ALIGNED}, f AS (SELECT min(ts_ns) AS first FROM (SELECT ts_ns FROM a GROUP BY ts_ns HAVING count(price) = (SELECT count(DISTINCT symbol) FROM a)))
    SELECT symbol, ts_ns, R2(price) AS price FROM a, f WHERE ts_ns >= first""",
    "v_series",
)
def t8(spark, sf):
    return pad(_aligned(spark, sf), "skip_until_all_present").select("symbol", "ts_ns", r("price", 2))


#: Every day of the calendar; prices of days with few orders are missing.
_GAPS = """d AS (SELECT DISTINCT ts_ns FROM v_series), k AS (SELECT DISTINCT symbol FROM v_series),
    g AS (SELECT k.symbol, d.ts_ns, CASE WHEN v.volume > 1 THEN v.price END AS price FROM k CROSS JOIN d LEFT JOIN v_series v ON v.symbol = k.symbol AND v.ts_ns = d.ts_ns)"""


def _gaps(spark, sf):
    s = series(spark, sf)
    every = s.select("symbol").distinct().crossJoin(s.select("ts_ns").distinct())
    return every.join(s, ["symbol", "ts_ns"], "left").select("symbol", "ts_ns", F.when(F.col("volume") > 1, F.col("price")).alias("price"))


@query(
    "t9_fill_forward",
    f"""WITH {_GAPS}, c AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS p FROM g)
    SELECT symbol, ts_ns, R2(p) AS price, price IS NULL AND p IS NOT NULL AS filled FROM c""",
    "v_series",
)
def t9(spark, sf):
    return fill_forward(_gaps(spark, sf)).select("symbol", "ts_ns", r("price", 2), "filled")


@query(
    "t10_fill_linear",
    f"""WITH {_GAPS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS i FROM g),
    c AS (SELECT *, last_value(price IGNORE NULLS) OVER a AS pa, last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia,
          first_value(price IGNORE NULLS) OVER b AS pb, first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib FROM n
          WINDOW a AS (PARTITION BY symbol ORDER BY ts_ns ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    v AS (SELECT *, CASE WHEN price IS NOT NULL THEN price WHEN ia < ib THEN pa + (pb - pa) * ((i - ia)::DOUBLE / (ib - ia)) END AS p FROM c)
    SELECT symbol, ts_ns, R2(p) AS price, price IS NULL AND p IS NOT NULL AS filled FROM v""",
    "v_series",
)
def t10(spark, sf):
    return fill_linear(_gaps(spark, sf)).select("symbol", "ts_ns", r("price", 2), "filled")


@query("t11_fill_none", f"WITH {_GAPS} SELECT symbol, 0::BIGINT AS filled, count(*) - count(price) AS gaps FROM g GROUP BY symbol", "v_series")
def t11(spark, sf):
    gaps = fill_none(_gaps(spark, sf))
    return gaps.groupBy("symbol").agg(F.count_if("filled").alias("filled"), (F.count("*") - F.count("price")).alias("gaps"))


@query("t12_bar_series", f"WITH b AS ({_B1}) " + " UNION ALL ".join(f"SELECT symbol, open_ts, '{c}' AS field, {c}::DOUBLE AS value FROM b" for c in FIELDS), "v_ticks")
def t12(spark, sf):
    return bar_series(_hour(spark, sf))
