"""Execution quality, routing, sizing and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.stretches import number, over_rows, stretches
from tickspark.plans.catalog import FILL_ORDER, YEAR, fills, query, r, table

from .joins import TIERS_SQL, effective_fee, tiers_view, venues_view


def permanent_impact(df: DataFrame, gamma: float = 0.5) -> DataFrame:
    """Gamma * sigma * sqrt(participation), participation at most 1, in basis points."""
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("quantity"), F.col("adv")), F.lit(0.0)))
    return df.withColumn("impact_bps", gamma * F.col("sigma") * F.sqrt(F.greatest(share, F.lit(0.0))) * 10000)


def tca(orders: DataFrame, fills: DataFrame, market: DataFrame) -> DataFrame:
    """Per order fill rate, average, signed slippage against arrival, difference from VWAP, shortfall, latencies.

    ``orders``: order_id, symbol, side, quantity, arrival_price, ts_ns; ``fills``: order_id, ts_ns, price, quantity,
    commission; ``market``: symbol, vwap. The first fill is the earliest.
    """
    f = fills.groupBy("order_id").agg(
        F.sum("quantity").alias("filled"), F.try_divide(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("average"), F.sum("commission").alias("commission"), F.min("ts_ns").alias("_first"), F.max("ts_ns").alias("_last")
    )
    o = orders.join(f, "order_id", "left").join(market, "symbol", "left")
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    bps = lambda ref: F.try_divide((F.col("average") - F.col(ref)) * sign, F.col(ref)) * 10000
    filled = F.coalesce("filled", F.lit(0.0))
    return (
        o.withColumn("fill_rate", F.try_divide(filled, F.col("quantity")))
        .withColumn("slippage_bps", bps("arrival_price"))
        .withColumn("vwap_bps", bps("vwap"))
        .withColumn("shortfall", (F.col("average") - F.col("arrival_price")) * sign * filled + F.col("commission"))
        .withColumn("first_fill_ns", F.col("_first") - F.col("ts_ns"))
        .withColumn("full_fill_ns", F.when(filled >= F.col("quantity"), F.col("_last") - F.col("ts_ns")))
        .drop("_first", "_last")
    )


def _quoted(venues: DataFrame) -> DataFrame:
    """Venues by side: side, price, depth and how adverse the price is."""
    sides = [venues.select("venue", "fee_bps", F.lit(side).alias("side"), F.col(quote).alias("price"), F.col(f"{quote}_depth").alias("depth"), (F.col(quote) * sign).alias("_adverse")) for side, quote, sign in (("buy", "ask", 1), ("sell", "bid", -1))]
    return sides[0].unionByName(sides[1])


#: Venues that an order meets at a time, the most such runs of venues of a side, and the parts orders are dealt to.
RUN, RUNS, PARTS = 16, 10_000, 64
#: Most venues that are broadcast to the orders.
BROADCAST_VENUES = 100_000


def _split(orders: DataFrame, quoted: DataFrame, run: int, length: int | None, broadcast: int) -> DataFrame:
    """Venues by price with fee, with the depth before each, in runs of ``run``; an order meets the runs it reaches.

    Venues with more depth before them than the largest order of their side are met by none. Where the runs of a side
    start is an array of at most RUNS depths, which each order searches. Up to ``broadcast`` venues that are left,
    counted, go to the orders; beyond it both meet by (side, run, part of the orders), so that neither side is one task,
    and a venue is copied to the parts.
    """
    fee = F.col("fee_bps") / 10000
    paid = F.when(F.col("side") == "buy", F.col("price") * (1 + fee)).otherwise(-F.col("price") * (1 - fee))
    cut = stretches(quoted.where("depth > 0").withColumn("_paid", paid), "side", ("_paid", "venue"), length)
    sums = {"_before": ("sum", F.col("depth")), "_i": ("count", F.lit(1))}
    ranked = cut.done(cut.running(cut.df, sums, before=True)).withColumn("_before", F.coalesce("_before", F.lit(0.0)))
    largest = orders.groupBy("side").agg(F.max("quantity").alias("_most"))
    ranked = ranked.join(F.broadcast(largest), "side").where(F.col("_before") < F.col("_most")).drop("_most")
    most = ranked.groupBy("side").count().agg(F.max("count")).first()[0] or 1
    width = max(run, -(-most // RUNS))
    ranked = ranked.withColumn("_run", F.floor(F.coalesce("_i", F.lit(0)) / width).cast("int")).drop("_i", "_paid", "_adverse")
    starts = ranked.groupBy("side", "_run").agg(F.min("_before").alias("_at")).groupBy("side").agg(F.sort_array(F.collect_list(-F.col("_at"))).alias("_at"))
    # A start equal to the quantity is not reached: take away those at or above it, found on the negated depths.
    below = F.size("_at") - number(F.col("_at"), -F.col("quantity"))
    reached = orders.join(F.broadcast(starts), "side").withColumn("_n", below).where("_n > 0").drop("_at")
    reached = reached.withColumn("_run", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    if most <= broadcast:
        met = reached.join(F.broadcast(ranked), ["side", "_run"])
    else:
        part = F.pmod(F.xxhash64(*orders.columns), F.lit(PARTS)).cast("int")
        copied = ranked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = reached.withColumn("_part", part).join(copied, ["side", "_run", "_part"])
    met = met.where(F.col("_before") < F.col("quantity"))
    taken = met.withColumn("take", F.least(F.col("depth"), F.col("quantity") - F.col("_before")))
    return taken.select(*orders.columns, "venue", "fee_bps", "price", "depth", "take")


def route(orders: DataFrame, venues: DataFrame, how: str, run: int = RUN, length: int | None = None, broadcast: int = BROADCAST_VENUES) -> DataFrame:
    """Where each order goes. ``venues``: venue, bid, ask, bid_depth, ask_depth, fee_bps, one row each.

    ``cheapest`` takes the lowest fee, ``best_price`` the best price for the side, ``smart_split`` fills venue after
    venue by price with fee until the quantity is gone; an order meets no venue that it does not use.
    """
    quoted = _quoted(venues)
    if how in ("cheapest", "best_price"):
        order = ("fee_bps", "_adverse", "venue") if how == "cheapest" else ("_adverse", "fee_bps", "venue")
        best = quoted.groupBy("side").agg(F.min_by(F.struct("venue", "fee_bps", "price", "depth"), F.struct(*order)).alias("_best")).select("side", "_best.*")
        return orders.join(F.broadcast(best), "side")  # one row per side
    if how != "smart_split":
        raise ValueError(f"unknown routing {how!r}")
    return _split(orders, quoted, run, length, broadcast)


def route_summary(split: DataFrame) -> DataFrame:
    """Weighted averages and the rest per order."""
    g = split.groupBy("order_id").agg(F.first("quantity").alias("quantity"), F.sum("take").alias("allocated"), F.count("*").alias("venues"), F.sum(F.col("take") * F.col("price")).alias("_p"), F.sum(F.col("take") * F.col("fee_bps")).alias("_f"))
    return g.select("order_id", "allocated", "venues", (F.col("_p") / F.col("allocated")).alias("price"), (F.col("_f") / F.col("allocated")).alias("fee_bps"), (F.col("quantity") - F.col("allocated")).alias("unallocated"))


#: Fixed legal changes of an order's status.
TRANSITIONS = {
    "pending": ("open", "rejected", "cancelled"),
    "open": ("partially_filled", "filled", "cancelled", "rejected", "expired"),
    "partially_filled": ("partially_filled", "filled", "cancelled", "expired"),
}


def check_transitions(log: DataFrame) -> DataFrame:
    """``violation`` of each status change: illegal, or terminal when it leaves a final status."""
    w = Window.partitionBy("order_id").orderBy("ts_ns", "seq")
    before, now = F.col("_before"), F.col("status")
    legal = F.lit(False)
    for a, bs in TRANSITIONS.items():
        legal = legal | ((before == a) & now.isin(*bs))
    from .filters import TERMINAL

    bad = F.when(before.isin(*TERMINAL), "terminal").when(~legal, "illegal")
    return log.withColumn("_before", F.lag("status").over(w)).withColumn("violation", F.when(before.isNotNull(), bad)).drop("_before")


def order_fills(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled quantity, average price and status per order."""
    f = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.try_divide(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("average"))
    o = orders.join(f, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    return o.withColumn("status", F.when(F.col("filled") >= F.col("quantity"), "filled").when(F.col("filled") > 0, "partially_filled").otherwise("open"))


def kelly_size(df: DataFrame, fraction: float = 0.5, cap: float = 0.25) -> DataFrame:
    """Win rate p and payoff b: p - (1 - p) / b, never negative, NaN or null is 0; a fraction of it, capped."""
    full = F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col("p") - F.try_divide(1 - F.col("p"), F.col("b")), F.lit(0.0)), F.lit(0.0)))
    return df.withColumn("kelly", full).withColumn("size", F.least(F.lit(cap), fraction * full) * F.col("capital"))


def vol_size(df: DataFrame, target: float) -> DataFrame:
    """Capital * target / volatility, at most the capital."""
    return df.withColumn("size", F.least(F.col("capital"), F.coalesce(F.try_divide(F.col("capital") * target, F.col("vol")), F.lit(0.0))))


def atr_size(df: DataFrame, risk: float, multiple: float = 2.0) -> DataFrame:
    """Units that lose ``risk`` of the capital on a move of ``multiple`` ATR, worth at most the capital."""
    units = F.coalesce(F.try_divide(F.col("capital") * risk, F.col("atr") * multiple), F.lit(0.0))
    return df.withColumn("units", F.least(units, F.try_divide("capital", "price")))


#: Fixed multiples of the cost in each regime; calm and unknown are 1.
REGIME_COST = {"trending": 1.2, "volatile": 1.8, "crisis": 3.0}


def slippage(df: DataFrame, model: str, bps: float = 5.0, share: float = 0.5, k: float = 0.1, floor: float = 0.0) -> Column:
    """X11: adverse cost per unit: fixed, spread, volatility, regime or their sum (composite).

    The volatility model takes the square root of the share of ``adv`` that ``quantity`` is, at least ``floor``.
    """
    times = F.lit(1.0)
    for regime, m in REGIME_COST.items():
        times = F.when(F.col("regime") == regime, m).otherwise(times)
    part = F.sqrt(F.greatest(F.lit(floor), F.abs(F.try_divide("quantity", "adv"))))
    known = (F.col("sigma") > 0) & (F.col("adv") > 0)
    price, half = F.col("price"), (F.col("ask") - F.col("bid")) / 2
    parts = {
        "fixed": price * bps / 10000,
        "spread": half * share,
        "volatility": F.when(known, price * F.col("sigma") * k * part).otherwise(0.0),
        "regime": price * bps / 10000 * times,
    }
    if model == "composite":
        return F.greatest(F.lit(0.0), parts["fixed"] + parts["spread"] + parts["volatility"])
    return F.greatest(F.lit(0.0), parts[model])


def commissions(fills: DataFrame, tiers: DataFrame, minimum: float = 0.0, account: str = "account", order: tuple[str, ...] = FILL_ORDER, length: int | None = None) -> DataFrame:
    """Fee of the tier reached before the fill, maker or taker, with a minimum per fill.

    ``tiers``: venue, threshold, maker_bps, taker_bps; ``fills`` has a venue.
    """
    notional = F.col("price") * F.col("quantity")
    cut = stretches(fills, account, order, length)
    f = cut.done(cut.running(cut.df, {"volume": ("sum", notional)}, before=True))
    f = f.withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumn("taker", ~F.col("is_maker"))
    return effective_fee(f, tiers).withColumn("fee", F.greatest(F.lit(minimum), notional * F.col("fee_bps") / 10000)).drop("taker")


def financing(exposures: DataFrame, borrow: float, funding: float, key: str = "account", length: int | None = None) -> DataFrame:
    """Per interval the borrow cost of the shorts and the funding of the gross held since the row before."""

    def charged(rows: DataFrame, w) -> DataFrame:
        years = (F.col("ts_ns") - F.lag("ts_ns").over(w)) / F.lit(float(YEAR))
        cost = (F.lag("short").over(w) * borrow + F.lag("gross").over(w) * funding) * years
        return rows.withColumn("financing", F.coalesce(cost, F.lit(0.0)))

    return over_rows(exposures, key, 2, charged, length=length)


@query("x2_permanent_impact", "SELECT ts_ns, k1, k2, k3, k4, R6(0.5 * 0.02 * sqrt(least(1, quantity / 40)) * 10000) AS impact_bps FROM v_fills", "v_fills")
def x2(spark, sf):
    return permanent_impact(fills(spark, sf).withColumns({"sigma": F.lit(0.02), "adv": F.lit(40.0)})).select(*FILL_ORDER, r("impact_bps"))


def _order_fills(spark, sf):
    """Lines as fills of their orders: line n is filled n days after the order."""
    line = table(spark, sf, "lineitem")
    day = 86_400_000_000_000
    f = line.select(F.col("l_orderkey").alias("order_id"), (F.col("l_linenumber").cast("long") * day).alias("ts_ns"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("commission"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(100.0).alias("quantity"), F.lit(1500.0).alias("arrival_price"), F.lit(0).cast("long").alias("ts_ns"))
    return o, f


_OF = """f AS (SELECT l_orderkey AS order_id, l_linenumber * 86400000000000 AS ts_ns, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_extendedprice * l_tax / 100 AS commission FROM lineitem),
    o AS (SELECT o_orderkey AS order_id, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 100.0::DOUBLE AS quantity FROM orders),
    g AS (SELECT order_id, sum(quantity) AS filled, sum(price * quantity) / sum(quantity) AS average, sum(commission) AS commission, min(ts_ns) AS t0, max(ts_ns) AS t1 FROM f GROUP BY 1)"""


@query(
    "x3_tca",
    f"""WITH {_OF}, j AS (SELECT o.*, filled, average, commission, t0, t1, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg FROM o LEFT JOIN g ON g.order_id = o.order_id)
    SELECT order_id, R6(coalesce(filled, 0) / quantity) AS fill_rate, R4((average - 1500) * sg / 1500 * 10000) AS slippage_bps, R4((average - 1400) * sg / 1400 * 10000) AS vwap_bps, R2((average - 1500) * sg * coalesce(filled, 0) + commission) AS shortfall, t0 AS first_fill_ns, CASE WHEN filled >= quantity THEN t1 END AS full_fill_ns FROM j""",
)
def x3(spark, sf):
    o, f = _order_fills(spark, sf)
    market = o.select("symbol").distinct().withColumn("vwap", F.lit(1400.0))
    return tca(o, f, market).select("order_id", r("fill_rate"), r("slippage_bps", 4), r("vwap_bps", 4), r("shortfall", 2), "first_fill_ns", "full_fill_ns")


_VEN = "v AS (SELECT s_name AS venue, 100 - (s_suppkey % 7) * 0.1::DOUBLE AS bid, 100.2 + (s_suppkey % 5) * 0.1::DOUBLE AS ask, (s_suppkey % 11 + 1) * 2.0::DOUBLE AS bid_depth, (s_suppkey % 13 + 1) * 2.0::DOUBLE AS ask_depth, (s_suppkey % 4)::DOUBLE AS fee_bps FROM supplier)"
_RO = "o AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (o_orderkey % 400 + 1)::DOUBLE AS quantity FROM orders)"


def _routing(spark, sf):
    k = F.col("s_suppkey")
    v = table(spark, sf, "supplier").select(F.col("s_name").alias("venue"), (100 - (k % 7) * F.lit(0.1)).alias("bid"), (F.lit(100.2) + (k % 5) * F.lit(0.1)).alias("ask"), ((k % 11 + 1) * 2.0).alias("bid_depth"), ((k % 13 + 1) * 2.0).alias("ask_depth"), (k % 4).cast("double").alias("fee_bps"))
    ok = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(ok.alias("order_id"), F.when(ok % 2 == 0, "buy").otherwise("sell").alias("side"), (ok % 400 + 1).cast("double").alias("quantity"))
    return o, v


_MET = f"{_VEN}, {_RO}, m AS (SELECT o.*, venue, fee_bps, CASE WHEN side = 'buy' THEN ask ELSE bid END AS price, CASE WHEN side = 'buy' THEN ask_depth ELSE bid_depth END AS depth FROM o, v)"


@query("x4_route_cheapest", f"WITH {_MET} SELECT order_id, venue, R4(price) AS price, fee_bps FROM m QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY fee_bps, CASE WHEN side = 'buy' THEN price ELSE -price END, venue) = 1")
def x4(spark, sf):
    return route(*_routing(spark, sf), "cheapest").select("order_id", "venue", r("price", 4), "fee_bps")


@query("x5_route_best_price", f"WITH {_MET} SELECT order_id, venue, R4(price) AS price, fee_bps FROM m QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY CASE WHEN side = 'buy' THEN price ELSE -price END, fee_bps, venue) = 1")
def x5(spark, sf):
    return route(*_routing(spark, sf), "best_price").select("order_id", "venue", r("price", 4), "fee_bps")


@query(
    "x6_route_smart_split",
    f"""WITH {_MET}, p AS (SELECT *, CASE WHEN side = 'buy' THEN price * (1 + fee_bps / 10000) ELSE -price * (1 - fee_bps / 10000) END AS paid FROM m),
    b AS (SELECT *, coalesce(sum(depth) OVER (PARTITION BY order_id ORDER BY paid, venue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), t AS (SELECT *, greatest(0, least(depth, quantity - before)) AS take FROM b)
    SELECT order_id, sum(take) AS allocated, count(*) AS venues, R6(sum(take * price) / sum(take)) AS price, R6(sum(take * fee_bps) / sum(take)) AS fee_bps, any_value(quantity) - sum(take) AS unallocated FROM t WHERE take > 0 GROUP BY 1""",
)
def x6(spark, sf):
    return route_summary(route(*_routing(spark, sf), "smart_split")).select("order_id", "allocated", "venues", r("price"), r("fee_bps"), "unallocated")


_LOG = "l AS (SELECT l_orderkey AS order_id, l_linenumber AS seq, l_shipdate, l_partkey, l_suppkey, ['pending', 'open', 'partially_filled', 'filled', 'cancelled'][((l_linenumber + l_orderkey % 3) % 5 + 1)::INT] AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS i FROM lineitem)"


@query(
    "x7_check_transitions",
    f"""WITH {_LOG}, b AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY i) AS p FROM l), v AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN p IN ('filled', 'cancelled', 'rejected', 'expired') THEN 'terminal' WHEN (p = 'pending' AND status IN ('open', 'rejected', 'cancelled')) OR (p IN ('open', 'partially_filled') AND status IN ('filled', 'cancelled', 'expired', 'partially_filled')) THEN NULL ELSE 'illegal' END AS violation FROM b)
    SELECT status, violation, count(*) AS n FROM v GROUP BY 1, 2""",
)
def x7(spark, sf):
    line = table(spark, sf, "lineitem")
    names = F.array(*map(F.lit, ("pending", "open", "partially_filled", "filled", "cancelled")))
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"))
    log = line.select(F.col("l_orderkey").alias("order_id"), i.cast("long").alias("ts_ns"), F.lit(0).alias("seq"), F.get(names, ((F.col("l_linenumber") + F.col("l_orderkey") % 3) % 5).cast("int")).alias("status"))
    return check_transitions(log).groupBy("status", "violation").agg(F.count("*").alias("n"))


@query("x8_order_fills", f"WITH {_OF} SELECT o.order_id, coalesce(filled, 0) AS filled, R4(average) AS average, CASE WHEN filled >= quantity THEN 'filled' WHEN filled > 0 THEN 'partially_filled' ELSE 'open' END AS status FROM o LEFT JOIN g ON g.order_id = o.order_id")
def x8(spark, sf):
    return order_fills(*_order_fills(spark, sf)).select("order_id", "filled", r("average", 4), "status")


@query("x9_kelly_size", "WITH s AS (SELECT symbol, count(*) FILTER (price > 50)::DOUBLE / count(*) AS p, avg(price) FILTER (price > 50) / avg(price) FILTER (price <= 50) AS b FROM v_ticks GROUP BY 1) SELECT symbol, R6(greatest(0, p - (1 - p) / b)) AS kelly, R2(least(0.25, 0.5 * greatest(0, p - (1 - p) / b)) * 1e6) AS size FROM s", "v_ticks")
def x9(spark, sf):
    from tickspark.plans.catalog import ticks

    up = F.col("price") > 50
    s = ticks(spark, sf).groupBy("symbol").agg((F.count_if(up) / F.count("*")).alias("p"), (F.avg(F.when(up, F.col("price"))) / F.avg(F.when(~up, F.col("price")))).alias("b"))
    return kelly_size(s.withColumn("capital", F.lit(1e6))).select("symbol", r("kelly"), r("size", 2))


@query("x10_vol_size", "WITH s AS (SELECT curve_id, stddev_samp(r) AS vol, avg(abs(nav * r)) AS atr, arg_max(nav, ts_ns) AS price FROM v_returns GROUP BY 1) SELECT curve_id, R2(least(1e6, 1e6 * 0.0001::DOUBLE / vol)) AS size, R6(least(1e6 * 0.01::DOUBLE / (atr * 2), 1e6 / price)) AS units FROM s", "v_returns")
def x10(spark, sf):
    from tickspark.plans.catalog import returns

    s = returns(spark, sf).groupBy("curve_id").agg(F.stddev_samp("r").alias("vol"), F.avg(F.abs(F.col("nav") * F.col("r"))).alias("atr"), F.max_by("nav", "ts_ns").alias("price"))
    return atr_size(vol_size(s.withColumn("capital", F.lit(1e6)), 0.0001), 0.01).select("curve_id", r("size", 2), r("units"))


@query(
    "x11_slippage",
    "WITH s AS (SELECT *, CASE WHEN size < 10 THEN 'crisis' WHEN size < 30 THEN 'volatile' WHEN size < 50 THEN 'trending' ELSE 'calm' END AS regime FROM v_ticks) SELECT seq, R6(price * 0.0005) AS fixed, R6((ask - bid) / 4) AS spread, R6(price * 0.002 * sqrt(size / 100)) AS volatility, R6(price * 0.0005 * CASE regime WHEN 'crisis' THEN 3 WHEN 'volatile' THEN 1.8 WHEN 'trending' THEN 1.2 ELSE 1 END) AS regime_cost, R6(price * 0.0005 + (ask - bid) / 4 + price * 0.002 * sqrt(size / 100)) AS composite FROM s",
    "v_ticks",
)
def x11(spark, sf):
    from tickspark.plans.catalog import ticks

    s = F.col("size")
    t = ticks(spark, sf).withColumns({"sigma": F.lit(0.02), "adv": F.lit(100.0), "quantity": s}).withColumn("regime", F.when(s < 10, "crisis").when(s < 30, "volatile").when(s < 50, "trending").otherwise("calm"))
    return t.select("seq", r(slippage(t, "fixed")).alias("fixed"), r(slippage(t, "spread")).alias("spread"), r(slippage(t, "volatility")).alias("volatility"), r(slippage(t, "regime")).alias("regime_cost"), r(slippage(t, "composite")).alias("composite"))


@query(
    "x12_commissions",
    f"""WITH {TIERS_SQL}, f AS (SELECT *, coalesce(sum(price * quantity) OVER (PARTITION BY account, symbol ORDER BY ts_ns, k1, k2, k3, k4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000 AS volume FROM v_fills JOIN supplier ON s_suppkey = k4),
    e AS (SELECT f.*, (SELECT arg_max(CASE WHEN f.is_maker THEN maker_bps ELSE taker_bps END, threshold) FROM tiers t WHERE t.venue = f.s_name AND threshold <= f.volume) AS hit, (SELECT arg_min(CASE WHEN f.is_maker THEN maker_bps ELSE taker_bps END, threshold) FROM tiers t WHERE t.venue = f.s_name) AS low FROM f)
    SELECT account, symbol, R2(sum(greatest(20, price * quantity * coalesce(hit, low, 0) / 10000))) AS fee FROM e GROUP BY 1, 2""",
    "v_fills",
)
def x12(spark, sf):
    f = fills(spark, sf).join(F.broadcast(venues_view(spark, sf)), F.col("k4") == F.col("id")).withColumn("acc", F.concat_ws("/", "account", "symbol"))
    tiers = tiers_view(spark, sf).withColumn("threshold", F.col("threshold") * 100000)
    return commissions(f, tiers, 20.0, "acc").groupBy("account", "symbol").agg(r(F.sum("fee"), 2).alias("fee"))


@query(
    "x13_financing",
    f"""WITH d AS (SELECT account, ts_ns, sum(greatest(-signed_quantity, 0) * price) AS short, sum(quantity * price) AS gross FROM v_fills GROUP BY 1, 2)
    SELECT account, ts_ns, R6(coalesce((lag(short) OVER w * 0.03::DOUBLE + lag(gross) OVER w * 0.01::DOUBLE) * (ts_ns - lag(ts_ns) OVER w) / {365 * 86_400_000_000_000}.0::DOUBLE, 0)) AS financing FROM d WINDOW w AS (PARTITION BY account ORDER BY ts_ns)""",
    "v_fills",
)
def x13(spark, sf):
    d = fills(spark, sf).groupBy("account", "ts_ns").agg(F.sum(F.greatest(-F.col("signed_quantity"), F.lit(0.0)) * F.col("price")).alias("short"), F.sum(F.col("quantity") * F.col("price")).alias("gross"))
    return financing(d, 0.03, 0.01).select("account", "ts_ns", r("financing"))
