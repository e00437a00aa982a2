"""Row filters, predicates and per-row measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.plans.catalog import fills, query, r, table, ticks

#: Fixed names of the event payloads and the message type that each is routed as.
MESSAGE_TYPES = {"trade_print": "trade_execution", "data_gap": "risk_alert"}
#: Fixed priority bands, most urgent first.
PRIORITIES = ("critical", "high", "normal", "low")
#: Fixed seed rows of the symbol map: exchange, raw symbol, canonical symbol.
SYMBOLS = (
    ("binance", "BTCUSDT", "BTC/USDT"),
    ("binance", "ETHUSDT", "ETH/USDT"),
    ("binance", "SOLUSDT", "SOL/USDT"),
    ("binance", "BNBUSDT", "BNB/USDT"),
    ("binance", "BTCUSDC", "BTC/USDC"),
    ("binance", "ETHUSDC", "ETH/USDC"),
    ("coinbase", "BTC-USD", "BTC/USD"),
    ("coinbase", "ETH-USD", "ETH/USD"),
    ("coinbase", "SOL-USD", "SOL/USD"),
    ("coinbase", "ETH-BTC", "ETH/BTC"),
)


class EventFilter:
    """predicates over event columns that combine with &, | and ~; ``column`` goes into ``where``."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: EventFilter) -> EventFilter:
        return EventFilter(self.column & other.column)

    def __or__(self, other: EventFilter) -> EventFilter:
        return EventFilter(self.column | other.column)

    def __invert__(self) -> EventFilter:
        return EventFilter(~self.column)

    any = classmethod(lambda cls: cls(F.lit(True)))
    by_priority = classmethod(lambda cls, p: cls(F.col("priority") == p))
    min_priority = classmethod(lambda cls, p: cls(priority_rank(F.col("priority")) <= PRIORITIES.index(p)))
    by_source = classmethod(lambda cls, s: cls(F.col("source") == s))
    by_message_type = classmethod(lambda cls, m: cls(message_type(F.col("payload_type")) == m))
    by_symbol = classmethod(lambda cls, s: cls(F.col("symbol") == s))
    custom = classmethod(lambda cls, c: cls(c))


def priority_rank(priority: Column) -> Column:
    return reduce(lambda out, x: F.when(priority == x[1], x[0]).otherwise(out), list(enumerate(PRIORITIES)), F.lit(None).cast("int"))


def message_type(payload_type: Column) -> Column:
    """a trade print is routed as a trade execution, a data gap as a risk alert."""
    return reduce(lambda out, x: F.when(payload_type == x[0], x[1]).otherwise(out), MESSAGE_TYPES.items(), payload_type)


def symbol_of(*cols: str) -> Column:
    """the symbol of whichever payload holds one."""
    return F.coalesce(*map(F.col, cols))


def priority_order(df: DataFrame) -> DataFrame:
    """strict priority bands, first in first out inside each."""
    return df.orderBy(priority_rank(F.col("priority")), "sequence_id")


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def sanity(df: DataFrame) -> DataFrame:
    """``reason`` of the first failed check, null for sane ticks."""
    reason = F.when(~finite("price"), "non_finite_price").when(~finite("size"), "non_finite_size").when(F.col("price") <= 0, "non_positive_price").when(F.col("size") <= 0, "non_positive_size")
    return df.withColumn("reason", reason)


def quote_metrics(df: DataFrame, now: Column, max_age: int) -> DataFrame:
    """validity, spread, mid, age and staleness of quotes."""
    return (
        df.withColumn("valid", (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") < F.col("ask")))
        .withColumn("spread", F.col("ask") - F.col("bid"))
        .withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
        .withColumn("age", now - F.col("ts_ns"))
        .withColumn("stale", F.col("age") > max_age)
    )


def canonicalize(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """(exchange, raw) to ``canonical``; unknown is null. ``mapping`` is a small dimension table."""
    return df.join(F.broadcast(mapping), ["exchange", "raw"], "left")


def to_exchange(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """(exchange, canonical) back to ``raw``."""
    return df.join(F.broadcast(mapping), ["exchange", "canonical"], "left")


def symbol_map(spark) -> DataFrame:
    return spark.createDataFrame(list(SYMBOLS), "exchange string, raw string, canonical string")


def lineage_valid(path: Column) -> Column:
    """F8: lower-case segments joined by slashes, 64 characters at most."""
    return path.rlike("^[a-z0-9_]+(/[a-z0-9_]+)*$") & (F.length(path) <= 64)


def lineage_push(path: Column, child: Column) -> Column:
    """F8: the child's path, or null when it is not valid."""
    pushed = F.when(path == "", child).otherwise(F.concat_ws("/", path, child))
    return F.when(child.rlike("^[a-z0-9_]+$") & lineage_valid(pushed), pushed)


def validate_ticks(df: DataFrame, assets: DataFrame) -> DataFrame:
    """``problem``: below_min_size first, then off_grid; a tick size of 0 or less is no grid."""
    q = F.try_divide("price", "tick_size")
    problem = F.when(F.col("size") < F.col("min_size"), "below_min_size").when((F.col("tick_size") > 0) & (F.abs(q - F.rint(q)) >= 1e-6), "off_grid")
    return df.join(F.broadcast(assets), "symbol").withColumn("problem", problem)


def trade_metrics(df: DataFrame, reference: Column) -> DataFrame:
    """gross, net, P&L against a reference price, commission %, effective price."""
    buy = F.col("side") == "buy"
    gross = F.col("price") * F.col("quantity")
    return (
        df.withColumn("gross", gross)
        .withColumn("net", F.when(buy, gross + F.col("commission")).otherwise(gross - F.col("commission")))
        .withColumn("pnl", F.when(buy, reference - F.col("price")).otherwise(F.col("price") - reference) * F.col("quantity") - F.col("commission"))
        .withColumn("commission_pct", F.try_divide(F.col("commission"), gross) * 100)
        .withColumn("effective_price", F.try_divide(F.col("net"), F.col("quantity")))
    )


def trade_quality(df: DataFrame, benchmark: Column) -> DataFrame:
    """signed slippage and shortfall against a benchmark price, in percent."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    slip = F.try_divide(F.col("price") - benchmark, benchmark) * 100 * sign
    return df.withColumn("slippage_pct", slip).withColumn("shortfall_pct", slip + F.try_divide("commission", F.col("price") * F.col("quantity")) * 100).withColumn("favourable", slip < 0)


TERMINAL = ("filled", "cancelled", "rejected", "expired")


def order_metrics(df: DataFrame) -> DataFrame:
    """remaining, fill %, notional (limit orders only), terminal and active flags."""
    return (
        df.withColumn("remaining", F.col("quantity") - F.col("filled_quantity"))
        .withColumn("fill_pct", F.try_divide("filled_quantity", "quantity") * 100)
        .withColumn("notional", F.when(F.col("order_type") == "limit", F.col("quantity") * F.col("limit_price")))
        .withColumn("terminal", F.col("status").isin(*TERMINAL))
        .withColumn("active", ~F.col("status").isin(*TERMINAL))
    )


def signed_qty(df: DataFrame) -> DataFrame:
    """signed quantity, its sign, the side a signed quantity means, and the opposite side."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return df.withColumn("sign", sign).withColumn("signed", sign * F.col("quantity")).withColumn("opposite", F.when(F.col("side") == "buy", "sell").otherwise("buy"))


def mid(df: DataFrame) -> DataFrame:
    """mid of a two-sided quote, else the last price; half the spread in basis points."""
    both = (F.col("bid") > 0) & (F.col("ask") > 0)
    value = F.when(both, (F.col("bid") + F.col("ask")) / 2).otherwise(F.col("price"))
    return df.withColumn("mid", value).withColumn("half_spread_bps", F.when(both, F.try_divide((F.col("ask") - F.col("bid")) / 2, value) * 10000))


def _events(spark, sf):
    """The event table as envelopes: priority by user, source by event type."""
    e = table(spark, sf, "events")
    band = reduce(lambda out, x: F.when(F.col("user_id") % 4 == x[0], x[1]).otherwise(out), list(enumerate(PRIORITIES)), F.lit("low"))
    kind = F.when(F.col("event_id") % 3 == 0, "trade_print").when(F.col("event_id") % 3 == 1, "data_gap").otherwise("market_tick")
    return e.select(F.col("event_id").alias("sequence_id"), band.alias("priority"), F.col("event_type").alias("source"), kind.alias("payload_type"), (F.col("user_id") % 5).cast("string").alias("symbol"))


_EVENTS = """e AS (SELECT event_id AS sequence_id, ['critical', 'high', 'normal', 'low'][(user_id % 4 + 1)::INT] AS priority, (user_id % 4)::INT AS rank, event_type AS source,
    CASE event_id % 3 WHEN 0 THEN 'trade_print' WHEN 1 THEN 'data_gap' ELSE 'market_tick' END AS payload_type, (user_id % 5)::VARCHAR AS symbol FROM events)"""


@query("f1_event_filter", f"WITH {_EVENTS} SELECT sequence_id FROM e WHERE rank <= 1 AND (source = (SELECT min(source) FROM e) OR payload_type = 'data_gap') AND NOT symbol = '3'")
def f1(spark, sf):
    e = _events(spark, sf)
    least = e.agg(F.min("source")).first()[0]
    chosen = EventFilter.min_priority("high") & (EventFilter.by_source(least) | EventFilter.by_message_type("risk_alert")) & ~EventFilter.by_symbol("3")
    return e.where(chosen.column).select("sequence_id")


@query("f2_message_type", f"WITH {_EVENTS} SELECT CASE payload_type WHEN 'trade_print' THEN 'trade_execution' WHEN 'data_gap' THEN 'risk_alert' ELSE payload_type END AS message_type, symbol, count(*) AS n FROM e GROUP BY 1, 2")
def f2(spark, sf):
    return _events(spark, sf).groupBy(message_type(F.col("payload_type")).alias("message_type"), symbol_of("symbol", "source").alias("symbol")).agg(F.count("*").alias("n"))


@query("f3_priority_order", f"WITH {_EVENTS} SELECT sequence_id, priority, rank FROM e")
def f3(spark, sf):
    return priority_order(_events(spark, sf)).select("sequence_id", "priority", priority_rank(F.col("priority")).alias("rank"))


@query("f4_sanity", "SELECT symbol, CASE WHEN price <= 0 THEN 'non_positive_price' WHEN size <= 0 THEN 'non_positive_size' END AS reason, count(*) AS n FROM v_ticks GROUP BY 1, 2", "v_ticks")
def f4(spark, sf):
    return sanity(ticks(spark, sf)).groupBy("symbol", "reason").agg(F.count("*").alias("n"))


@query(
    "f5_quote_metrics",
    """WITH n AS (SELECT max(ts_ns) AS now FROM v_ticks) SELECT seq, bid > 0 AND ask > 0 AND bid < ask AS valid, R6(ask - bid) AS spread, R6((bid + ask) / 2) AS mid, now - ts_ns AS age,
    now - ts_ns > 86400000000000 AS stale FROM v_ticks, n""",
    "v_ticks",
)
def f5(spark, sf):
    t = ticks(spark, sf)
    now = F.broadcast(t.agg(F.max("ts_ns").alias("now")))
    return quote_metrics(t.crossJoin(now), F.col("now"), 86_400_000_000_000).select("seq", "valid", r("spread"), r("mid"), "age", "stale")


_RAW = "SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'binance' ELSE 'coinbase' END AS exchange, CASE event_id % 4 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'BTC-USD' WHEN 2 THEN 'ETHUSDT' ELSE 'DOGE-USD' END AS raw FROM events"


@query("f7_canonicalize", f"SELECT exchange, raw, CASE raw WHEN 'BTCUSDT' THEN 'BTC/USDT' WHEN 'BTC-USD' THEN 'BTC/USD' WHEN 'ETHUSDT' THEN 'ETH/USDT' END AS canonical, count(*) AS n FROM ({_RAW}) GROUP BY 1, 2, 3")
def f7(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = e.select(F.when(F.col("event_id") % 2 == 0, "binance").otherwise("coinbase").alias("exchange"), F.when(k == 0, "BTCUSDT").when(k == 1, "BTC-USD").when(k == 2, "ETHUSDT").otherwise("DOGE-USD").alias("raw"))
    return canonicalize(raw, symbol_map(spark)).groupBy("exchange", "raw", "canonical").agg(F.count("*").alias("n"))


@query(
    "f8_lineage",
    """WITH e AS (SELECT event_id, 'feed/' || replace(event_type, '-', '_') AS path, CASE WHEN event_id % 5 = 0 THEN 'Bad Child' ELSE 'user_' || user_id END AS child FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(child, '[a-z0-9_]+') AND regexp_full_match(path || '/' || child, '[a-z0-9_]+(/[a-z0-9_]+)*') AND length(path || '/' || child) <= 64 THEN path || '/' || child END AS pushed FROM e""",
)
def f8(spark, sf):
    e = table(spark, sf, "events")
    path = F.concat(F.lit("feed/"), F.replace("event_type", F.lit("-"), F.lit("_")))
    child = F.when(F.col("event_id") % 5 == 0, "Bad Child").otherwise(F.concat(F.lit("user_"), F.col("user_id")))
    return e.select("event_id", lineage_push(path, child).alias("pushed"))


@query(
    "f9_validate_ticks",
    """SELECT symbol, CASE WHEN size < 5 THEN 'below_min_size' WHEN abs(price / 0.05::DOUBLE - round_even(price / 0.05::DOUBLE, 0)) >= 1e-6 THEN 'off_grid' END AS problem, count(*) AS n FROM v_ticks GROUP BY 1, 2""",
    "v_ticks",
)
def f9(spark, sf):
    t = ticks(spark, sf)
    assets = t.select("symbol").distinct().select("symbol", F.lit(0.05).alias("tick_size"), F.lit(5.0).alias("min_size"))
    return validate_ticks(t, assets).groupBy("symbol", "problem").agg(F.count("*").alias("n"))


_KEYS = "ts_ns, k1, k2, k3, k4"


@query(
    "f10_trade_metrics",
    f"""WITH m AS (SELECT symbol AS s, avg(price) AS ref FROM v_fills GROUP BY 1), g AS (SELECT v.*, ref, price * quantity AS gross FROM v_fills v JOIN m ON s = symbol),
    n AS (SELECT *, CASE WHEN side = 'buy' THEN gross + commission ELSE gross - commission END AS net FROM g)
    SELECT {_KEYS}, R4(gross) AS gross, R4(net) AS net, R2(CASE WHEN side = 'buy' THEN ref - price ELSE price - ref END * quantity - commission) AS pnl,
    R6(commission / gross * 100) AS commission_pct, R4(net / quantity) AS effective_price FROM n""",
    "v_fills",
)
def f10(spark, sf):
    f = fills(spark, sf)
    ref = f.groupBy("symbol").agg(F.avg("price").alias("ref"))
    return trade_metrics(f.join(F.broadcast(ref), "symbol"), F.col("ref")).select(*_KEYS.split(", "), r("gross", 4), r("net", 4), r("pnl", 2), r("commission_pct"), r("effective_price", 4))


@query(
    "f11_trade_quality",
    f"""WITH s AS (SELECT *, (price - 1500.0) / 1500.0 * 100 * CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS slip FROM v_fills)
    SELECT {_KEYS}, R4(slip) AS slippage_pct, R4(slip + commission / (price * quantity) * 100) AS shortfall_pct, slip < 0 AS favourable FROM s""",
    "v_fills",
)
def f11(spark, sf):
    return trade_quality(fills(spark, sf), F.lit(1500.0)).select(*_KEYS.split(", "), r("slippage_pct", 4), r("shortfall_pct", 4), "favourable")


_ORDERS = """o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'limit' WHEN 1 THEN 'market' ELSE 'stop' END AS order_type, (o_orderkey % 50 + 1)::DOUBLE AS quantity, o_totalprice AS limit_price,
    CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partially_filled' END AS status,
    CASE o_orderstatus WHEN 'F' THEN (o_orderkey % 50 + 1)::DOUBLE WHEN 'O' THEN 0 ELSE floor((o_orderkey % 50 + 1) / 2) END AS filled_quantity FROM orders)"""


def orders_view(spark, sf):
    k = F.col("o_orderkey")
    q = (k % 50 + 1).cast("double")
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 3 == 0, "limit").when(k % 3 == 1, "market").otherwise("stop").alias("order_type"),
        q.alias("quantity"),
        F.col("o_totalprice").alias("limit_price"),
        F.when(s == "F", "filled").when(s == "O", "open").otherwise("partially_filled").alias("status"),
        F.when(s == "F", q).when(s == "O", 0.0).otherwise(F.floor(q / 2).cast("double")).alias("filled_quantity"),
    )


@query(
    "f12_order_metrics",
    f"WITH {_ORDERS} SELECT o_orderkey, quantity - filled_quantity AS remaining, R6(filled_quantity / quantity * 100) AS fill_pct, CASE WHEN order_type = 'limit' THEN R2(quantity * limit_price) END AS notional, status = 'filled' AS terminal, status <> 'filled' AS active FROM o",
)
def f12(spark, sf):
    return order_metrics(orders_view(spark, sf)).select("o_orderkey", "remaining", r("fill_pct"), r("notional", 2), "terminal", "active")


@query("f13_signed_qty", f"SELECT {_KEYS}, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sign, signed_quantity AS signed, CASE WHEN side = 'buy' THEN 'sell' ELSE 'buy' END AS opposite FROM v_fills", "v_fills")
def f13(spark, sf):
    return signed_qty(fills(spark, sf)).select(*_KEYS.split(", "), "sign", "signed", "opposite")


@query(
    "f14_mid",
    """WITH q AS (SELECT seq, price, CASE WHEN seq % 3 = 0 THEN 0 ELSE bid END AS bid, ask FROM v_ticks)
    SELECT seq, R6(CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE price END) AS mid, CASE WHEN bid > 0 AND ask > 0 THEN R6((ask - bid) / 2 / ((bid + ask) / 2) * 10000) END AS half_spread_bps FROM q""",
    "v_ticks",
)
def f14(spark, sf):
    t = ticks(spark, sf).withColumn("bid", F.when(F.col("seq") % 3 == 0, 0.0).otherwise(F.col("bid")))
    return mid(t).select("seq", r("mid"), r("half_spread_bps"))
