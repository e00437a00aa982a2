"""Exchange frames, event payloads, record scans and corporate-action files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.plans.catalog import HOUR, SECOND, query, r, ticks

TICK = ("symbol", "ts_ns", "price", "size", "bid", "ask", "sequence", "aggressor", "kind")


def _num(raw: Column, path: str) -> Column:
    """A number that comes as a number or as text; anything else is 0."""
    return F.coalesce(F.get_json_object(raw, f"$.{path}").try_cast("double"), F.lit(0.0))


def _long(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, f"$.{path}").try_cast("long"), F.lit(0).cast("long"))


def _tick(**cols: Column) -> list[Column]:
    kinds = {"symbol": "string", "ts_ns": "long", "price": "double", "size": "double", "bid": "double", "ask": "double", "sequence": "long", "aggressor": "string", "kind": "string"}
    return [cols.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in TICK]


def route_frames(raw: DataFrame) -> DataFrame:
    """``frame`` out of its envelope, ``symbol`` and ``type``; control messages, bad JSON and frames without a symbol go."""
    body = F.coalesce(F.get_json_object("raw", "$.data"), F.col("raw"))
    f = raw.withColumn("frame", body)
    symbol = F.coalesce(F.get_json_object("frame", "$.s"), F.get_json_object("frame", "$.product_id"))
    kind = F.coalesce(F.get_json_object("frame", "$.type"), F.get_json_object("frame", "$.e"), F.when(F.get_json_object("frame", "$.u").isNotNull(), "bookTicker"))
    # Through a generator, so that filters on the two do not take the parsing, and what made the text, once more for each use.
    return f.select("*", F.inline(F.array(F.struct(symbol.alias("frame_symbol"), kind.alias("frame_type"))))).where("frame_symbol is not null and frame_symbol <> ''")


def frame_counts(raw: DataFrame) -> DataFrame:
    """How many frames are routed and how many are dropped."""
    ok = route_frames(raw.withColumn("_i", F.monotonically_increasing_id())).agg(F.count("*").alias("routed"))
    return raw.agg(F.count("*").alias("seen")).crossJoin(ok).withColumn("dropped", F.col("seen") - F.col("routed"))


def parse_book_ticker(raw: DataFrame) -> DataFrame:
    """Best quotes of exchange B: mid of a two-sided quote (else 0), both sizes added, time of ingestion."""
    f = F.col("frame")
    bid, ask = _num(f, "b"), _num(f, "a")
    price = F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(0.0)
    return route_frames(raw).where("frame_type = 'bookTicker'").select(*_tick(symbol=F.col("frame_symbol"), ts_ns=F.col("ingest_ts_ns"), price=price, size=_num(f, "B") + _num(f, "A"), bid=bid, ask=ask, kind=F.lit("tick")))


def parse_trades_b(raw: DataFrame) -> DataFrame:
    """Trades of exchange B: the trade id is the dense sequence; a buyer who was the maker means a sale."""
    f = F.col("frame")
    side = F.when(F.get_json_object(f, "$.m") == "true", "sell").otherwise("buy")
    return route_frames(raw).where("frame_type = 'trade'").select(*_tick(symbol=F.col("frame_symbol"), ts_ns=_long(f, "T") * 1_000_000, price=_num(f, "p"), size=_num(f, "q"), sequence=_long(f, "t"), aggressor=side, kind=F.lit("trade")))


def parse_ticker_c(raw: DataFrame) -> DataFrame:
    """S3: tickers of exchange C: the last price, both sizes added."""
    f = F.col("frame")
    return route_frames(raw).where("frame_type = 'ticker'").select(*_tick(symbol=F.col("frame_symbol"), ts_ns=F.col("ingest_ts_ns"), price=_num(f, "price"), size=_num(f, "best_bid_size") + _num(f, "best_ask_size"), bid=_num(f, "best_bid"), ask=_num(f, "best_ask"), kind=F.lit("tick")))


def parse_matches_c(raw: DataFrame) -> DataFrame:
    """Matches of exchange C: the trade id is the sequence; a side other than buy is a sale."""
    f = F.col("frame")
    ts = F.unix_micros(F.try_to_timestamp(F.get_json_object(f, "$.time"))) * 1000
    side = F.when(F.get_json_object(f, "$.side") == "buy", "buy").otherwise("sell")
    return route_frames(raw).where("frame_type in ('match', 'last_match')").select(*_tick(symbol=F.col("frame_symbol"), ts_ns=F.coalesce(ts, F.col("ingest_ts_ns")), price=_num(f, "price"), size=_num(f, "size"), sequence=_long(f, "trade_id"), aggressor=side, kind=F.lit("trade")))


#: Exchange adapters by name; more can be added.
ADAPTERS: dict[str, list[Callable[[DataFrame], DataFrame]]] = {"b": [parse_book_ticker, parse_trades_b], "c": [parse_ticker_c, parse_matches_c]}


def parse_frames(raw: DataFrame, exchange: str) -> DataFrame:
    out = None
    for parse in ADAPTERS[exchange]:
        out = parse(raw) if out is None else out.unionByName(parse(raw))
    return out


def known_side(side: Column) -> Column:
    s = F.lower(side)
    return F.when(s.isin("buy", "b", "bid"), "buy").when(s.isin("sell", "s", "ask"), "sell")


def to_records(events: DataFrame) -> DataFrame:
    """Market ticks and trade prints; a bid or ask of 0 or less is unknown; other payloads are ignored."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    quotes = events.where("payload_type = 'market_tick'").select(F.lit("tick").alias("kind"), "symbol", "ts_ns", "seq", "price", "size", positive("bid").alias("bid"), positive("ask").alias("ask"), F.lit(None).cast("string").alias("aggressor"))
    prints = events.where("payload_type = 'trade_print'").select(F.lit("trade").alias("kind"), "symbol", "ts_ns", "seq", "price", "size", F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"), known_side(F.col("side")).alias("aggressor"))
    return quotes.unionByName(prints)


def read_records(records: DataFrame, symbols: list[str] | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Symbols and an inclusive time window; both reach the scan."""
    out = records
    if symbols:
        out = out.where(F.col("symbol").isin(symbols))
    if lo is not None:
        out = out.where(F.col("ts_ns") >= lo)
    return out if hi is None else out.where(F.col("ts_ns") <= hi)


def from_records(df: DataFrame) -> DataFrame:
    """By time, ties in input order."""
    return df.orderBy("ts_ns", "seq")


def bars_to_ticks(bars: DataFrame) -> DataFrame:
    """The close at the end of each bar; no quote."""
    none = F.lit(None).cast("double")
    return bars.select("symbol", F.col("close_ts").alias("ts_ns"), F.col("close").alias("price"), F.col("volume").alias("size"), none.alias("bid"), none.alias("ask"))


def concat(dfs: list[DataFrame]) -> DataFrame:
    """One after the other; ``source_ord`` keeps the order of the list."""
    out = None
    for i, d in enumerate(dfs):
        own = d.withColumn("source_ord", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def symbols(df: DataFrame) -> DataFrame:
    """In the order in which they are first seen."""
    return df.groupBy("symbol").agg(F.min(F.struct("ts_ns", "seq")).alias("_f")).orderBy("_f").select("symbol", F.col("_f.ts_ns").alias("first_ts"), F.col("_f.seq").alias("first_seq"))


ACTION = "effective_at_ns long, kind string, symbol string, ratio double, amount double, currency string, `from` string, `to` string, parent string, children array<struct<symbol:string,ratio:double>>, until_ns long, source string"
#: Fields that each kind of action must have.
REQUIRED = {"split": ("ratio",), "dividend": ("amount", "currency"), "symbol_change": ("from", "to"), "fork": ("parent", "children"), "halt": ("until_ns",)}


def check_actions(df: DataFrame) -> DataFrame:
    """``error`` of each action: the first field that its kind lacks, or an unknown kind."""
    error = F.when(F.col("effective_at_ns").isNull(), "missing effective_at_ns")
    for kind, fields in REQUIRED.items():
        for f in fields:
            error = error.when((F.col("kind") == kind) & F.col(f"`{f}`").isNull(), f"{kind}: missing {f}")
    return df.withColumn("error", error.when(~F.col("kind").isin(*REQUIRED) | F.col("kind").isNull(), "unknown kind"))


def read_actions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array, or one action a line (``lines``), which splits among tasks."""
    return check_actions(spark.read.schema(ACTION).option("multiLine", not lines).json(path))


def _events(spark, sf):
    s = F.col("seq")
    t = ticks(spark, sf)
    return t.withColumn("payload_type", F.when(s % 3 == 0, "trade_print").when(s % 3 == 1, "market_tick").otherwise("heartbeat")).withColumn("side", F.when(s % 2 == 0, "Bid").otherwise("S")).withColumn("bid", F.when(s % 5 == 0, 0.0).otherwise(F.col("bid")))


def _frames(spark, sf, kind):
    t = ticks(spark, sf)
    text = lambda c: F.col(c).cast("string")
    bodies = {
        "book": F.struct(F.col("seq").alias("u"), F.col("symbol").alias("s"), text("bid").alias("b"), text("size").alias("B"), text("ask").alias("a"), text("size").alias("A")),
        "trade": F.struct(F.lit("trade").alias("e"), F.col("symbol").alias("s"), F.col("seq").alias("t"), text("price").alias("p"), text("size").alias("q"), F.expr("ts_ns div 1000000").alias("T"), (F.col("seq") % 2 == 0).alias("m")),
        "ticker": F.struct(F.lit("ticker").alias("type"), F.col("symbol").alias("product_id"), text("price").alias("price"), text("bid").alias("best_bid"), text("size").alias("best_bid_size"), text("ask").alias("best_ask"), text("size").alias("best_ask_size")),
        "match": F.struct(F.when(F.col("seq") % 10 == 0, "last_match").otherwise("match").alias("type"), F.col("seq").alias("trade_id"), F.col("symbol").alias("product_id"), text("price").alias("price"), text("size").alias("size"), F.when(F.col("seq") % 2 == 0, "buy").otherwise("other").alias("side"), F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time")),
    }
    json = F.to_json(bodies[kind])
    wrapped = F.when(F.col("seq") % 4 == 0, F.concat(F.lit('{"stream":"x","data":'), json, F.lit("}"))).when(F.col("seq") % 17 == 0, "{broken").when(F.col("seq") % 19 == 0, '{"result":null,"id":1}').otherwise(json)
    return t.select(wrapped.alias("raw"), F.col("ts_ns").alias("ingest_ts_ns"))


_KEPT = "seq % 4 = 0 OR (seq % 17 <> 0 AND seq % 19 <> 0)"


@query("s1_book_ticker", f"SELECT symbol, ts_ns, R6(CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE 0 END) AS price, size * 2 AS size, R6(bid) AS bid, R6(ask) AS ask FROM v_ticks WHERE {_KEPT}", "v_ticks")
def s1(spark, sf):
    return parse_book_ticker(_frames(spark, sf, "book")).select("symbol", "ts_ns", r("price"), "size", r("bid"), r("ask"))


@query("s2_trades_b", f"SELECT symbol, ts_ns // 1000000 * 1000000 AS ts_ns, price, size, seq AS sequence, CASE WHEN seq % 2 = 0 THEN 'sell' ELSE 'buy' END AS aggressor FROM v_ticks WHERE {_KEPT}", "v_ticks")
def s2(spark, sf):
    return parse_trades_b(_frames(spark, sf, "trade")).select("symbol", "ts_ns", "price", "size", "sequence", "aggressor")


@query("s3_ticker_c", f"SELECT symbol, ts_ns, price, size * 2 AS size, R6(bid) AS bid, R6(ask) AS ask FROM v_ticks WHERE {_KEPT}", "v_ticks")
def s3(spark, sf):
    return parse_ticker_c(_frames(spark, sf, "ticker")).select("symbol", "ts_ns", "price", "size", r("bid"), r("ask"))


@query("s4_matches_c", f"SELECT symbol, ts_ns, price, size, seq AS sequence, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS aggressor FROM v_ticks WHERE {_KEPT}", "v_ticks")
def s4(spark, sf):
    return parse_matches_c(_frames(spark, sf, "match")).select("symbol", "ts_ns", "price", "size", "sequence", "aggressor")


@query("s5_route_frames", f"SELECT count(*) AS seen, count(*) FILTER ({_KEPT}) AS routed, count(*) FILTER (NOT ({_KEPT})) AS dropped FROM v_ticks", "v_ticks")
def s5(spark, sf):
    return frame_counts(_frames(spark, sf, "book"))


@query(
    "s6_to_records",
    """SELECT CASE seq % 3 WHEN 0 THEN 'trade' ELSE 'tick' END AS kind, symbol, ts_ns, price, size, CASE WHEN seq % 3 = 1 AND seq % 5 <> 0 AND bid > 0 THEN R6(bid) END AS bid, CASE WHEN seq % 3 = 1 AND ask > 0 THEN R6(ask) END AS ask, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END END AS aggressor FROM v_ticks WHERE seq % 3 < 2""",
    "v_ticks",
)
def s6(spark, sf):
    return to_records(_events(spark, sf)).select("kind", "symbol", "ts_ns", "price", "size", r("bid"), r("ask"), "aggressor")


@query("s7_read_records", "WITH b AS (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM v_ticks) SELECT symbol, ts_ns, seq, price FROM v_ticks, b WHERE symbol IN ('click', 'view') AND ts_ns BETWEEN lo + 86400000000000 AND hi - 86400000000000", "v_ticks")
def s7(spark, sf):
    t = ticks(spark, sf)
    b = t.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    return read_records(t, ["click", "view"], b[0] + 86_400 * SECOND, b[1] - 86_400 * SECOND).select("symbol", "ts_ns", "seq", "price")


@query("s8_from_records", "SELECT symbol, ts_ns, seq FROM v_ticks", "v_ticks")
def s8(spark, sf):
    return from_records(ticks(spark, sf)).select("symbol", "ts_ns", "seq")


@query("s9_bars_to_ticks", f"SELECT symbol, ts_ns - ts_ns % {HOUR} + {HOUR} AS ts_ns, arg_max(price, (ts_ns, seq)) AS price, sum(size) AS size, NULL::DOUBLE AS bid, NULL::DOUBLE AS ask FROM v_ticks GROUP BY symbol, ts_ns - ts_ns % {HOUR}", "v_ticks")
def s9(spark, sf):
    from tickspark.operators.bars import build_bars

    return bars_to_ticks(build_bars(ticks(spark, sf), HOUR))


@query("s10_concat", "SELECT 0 AS source_ord, symbol, seq FROM v_ticks WHERE symbol = 'view' UNION ALL SELECT 1, symbol, seq FROM v_ticks WHERE symbol = 'click'", "v_ticks")
def s10(spark, sf):
    t = ticks(spark, sf).select("symbol", "seq")
    return concat([t.where("symbol = 'view'"), t.where("symbol = 'click'")])


@query("s11_symbols", "SELECT symbol, arg_min(ts_ns, (ts_ns, seq)) AS first_ts, arg_min(seq, (ts_ns, seq)) AS first_seq FROM v_ticks GROUP BY 1", "v_ticks")
def s11(spark, sf):
    return symbols(ticks(spark, sf))


@query(
    "s12_read_actions",
    """SELECT CASE event_id % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'halt' WHEN 2 THEN 'split' ELSE 'merger' END AS kind, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'split: missing ratio' ELSE 'unknown kind' END AS error, count(*) AS n FROM events GROUP BY 1, 2""",
)
def s12(spark, sf):
    from tickspark.plans.catalog import scratch

    k = F.col("seq") % 4
    a = ticks(spark, sf).select(F.col("ts_ns").alias("effective_at_ns"), F.when(k == 1, "halt").when(k == 3, "merger").otherwise("split").alias("kind"), F.when(k == 0, 2.0).alias("ratio"), F.when(k == 1, F.col("ts_ns")).alias("until_ns"))
    path = scratch(spark)
    a.write.json(path)
    return read_actions(spark, path, lines=True).groupBy("kind", "error").agg(F.count("*").alias("n"))
