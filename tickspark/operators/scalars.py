"""Sorts, limits, unions and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.plans.catalog import DAY, HOUR, MINUTE, SECOND, nav, query, r, table

from .performance import _EPS, curve_returns, drawdown_episodes, safe, underwater, worst

UNITS = {"ms": 1_000_000, "s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}


def parse_interval(text: str) -> int:
    """Z3: ``30s``, ``5m``, ``1h`` and the like in nanoseconds."""
    for unit in ("ms", "s", "m", "h", "d"):
        number = text.removesuffix(unit)
        if number != text and number.isdigit() and int(number) > 0:
            return int(number) * UNITS[unit]
    raise ValueError(f"not an interval: {text!r}")


def interval_ns(col: Column) -> Column:
    """Z3: the same as a column; null for what is no interval."""
    n, unit = F.regexp_extract(col, "^([0-9]+)(ms|s|m|h|d)$", 1), F.regexp_extract(col, "^([0-9]+)(ms|s|m|h|d)$", 2)
    factor = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
    return n.try_cast("long") * F.try_element_at(factor, unit)


def distinct_times(*dfs: DataFrame) -> DataFrame:
    """The sorted distinct times of several tables."""
    out = dfs[0].select("ts_ns")
    for d in dfs[1:]:
        out = out.union(d.select("ts_ns"))
    return out.distinct().orderBy("ts_ns")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


@query("z1_worst_drawdowns", f"WITH {_EPS} SELECT curve_id, peak_ts, R6(depth) AS depth FROM eps QUALIFY row_number() OVER (PARTITION BY curve_id ORDER BY depth DESC, peak_ts) <= 3", "v_nav")
def z1(spark, sf):
    return worst(drawdown_episodes(nav(spark, sf)), 3, "depth", "curve_id").select("curve_id", "peak_ts", r("depth"))


@query("z2_distinct_times", "SELECT DISTINCT epoch_us(t) * 1000 AS ts_ns FROM (SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem)")
def z2(spark, sf):
    from tickspark.plans.catalog import ns

    return distinct_times(table(spark, sf, "orders").select(ns("o_orderdate").alias("ts_ns")), table(spark, sf, "lineitem").select(ns("l_shipdate").alias("ts_ns")))


@query("z3_interval", "SELECT event_id, (user_id % 60 + 1) * CASE event_id % 3 WHEN 0 THEN 1000000000 WHEN 1 THEN 60000000000 ELSE 3600000000000 END AS ns FROM events")
def z3(spark, sf):
    k = F.col("event_id") % 3
    text = F.concat((F.col("user_id") % 60 + 1).cast("string"), F.when(k == 0, "s").when(k == 1, "m").otherwise("h"))
    return table(spark, sf, "events").select("event_id", interval_ns(text).alias("ns"))


@query("z4_vectors", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT v AS u FROM e WHERE vec_id = 0) SELECT vec_id, R6(list_dot_product(v, u)) AS dot, R6(sqrt(list_dot_product(v, v))) AS norm FROM e, f")
def z4(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("u"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", r(dot(F.col("embedding"), F.col("u"))).alias("dot"), r(norm(F.col("embedding"))).alias("norm"))


@query("z5_scalar_risk", "WITH p AS (SELECT *, max(nav) OVER (PARTITION BY curve_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS peak FROM v_returns) SELECT curve_id, R6(max((peak - nav) / peak)) AS max_drawdown, R6(avg(r) / stddev_samp(r)) AS sharpe FROM p GROUP BY 1", "v_returns")
def z5(spark, sf):
    n = nav(spark, sf)
    d = underwater(n).groupBy("curve_id").agg(F.max("drawdown").alias("max_drawdown"))
    s = curve_returns(spark, sf).groupBy("curve_id").agg(safe(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"))
    return d.join(s, "curve_id").select("curve_id", r("max_drawdown"), r("sharpe"))
