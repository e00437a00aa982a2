"""Registered queries, their SQL twins, and the market-data views over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY, HOUR, MINUTE, SECOND = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000, 1_000_000_000
YEAR = 365 * DAY

VIEW_SQL = {
    "v_ticks": """SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, value AS price, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::DOUBLE AS size,
        0.9998::DOUBLE * value AS bid, 1.0002::DOUBLE * value AS ask, user_id FROM events""",
    "v_series": "SELECT o_orderpriority AS symbol, epoch_us(o_orderdate) * 1000 AS ts_ns, avg(o_totalprice) AS price, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2",
    "v_nav": """SELECT curve_id, ts_ns, 1e6 + sum(d) OVER (PARTITION BY curve_id ORDER BY ts_ns) AS nav FROM
        (SELECT o_orderpriority AS curve_id, epoch_us(o_orderdate) * 1000 AS ts_ns, sum((o_totalprice - 255000) / 1000) AS d FROM orders GROUP BY 1, 2)""",
    "v_returns": """SELECT curve_id, ts_ns, nav, nav / lag(nav) OVER (PARTITION BY curve_id ORDER BY ts_ns) - 1 AS r,
        row_number() OVER (PARTITION BY curve_id ORDER BY ts_ns) - 1 AS i FROM v_nav""",
    "v_fills": """SELECT l_returnflag AS account, (l_suppkey % 10)::VARCHAR AS symbol, epoch_us(l_shipdate) * 1000 AS ts_ns, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
        CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice * l_tax / 100 AS commission,
        l_extendedprice * l_discount / 100 AS slippage_cost, l_linenumber % 2 = 0 AS is_maker, l_extendedprice * (l_discount - l_tax) AS realized,
        CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS signed_quantity FROM lineitem""",
    "v_levels": """SELECT l_partkey AS book, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side, l_extendedprice / l_quantity + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 110000 END AS price,
        l_quantity AS size, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3 FROM lineitem""",
    "v_latency": "SELECT event_type AS source, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, (value * 1000000)::BIGINT AS latency_ns FROM events",
    "v_pair": """SELECT ts_ns, max(CASE WHEN symbol = '1-URGENT' THEN price END) AS y, max(CASE WHEN symbol = '2-HIGH' THEN price END) AS x FROM v_series
        WHERE symbol IN ('1-URGENT', '2-HIGH') GROUP BY ts_ns HAVING y IS NOT NULL AND x IS NOT NULL""",
}
#: Views that stand on others.
NEEDS = {"v_returns": ["v_nav"], "v_pair": ["v_series"]}
FILL_ORDER = ("ts_ns", "k1", "k2", "k3", "k4")


def rounded(sql: str) -> str:
    """Writes out R6(x) and the like: x rounded as ``r`` does it."""
    while m := re.search(r"\bR(\d)\(", sql):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        d = int(m[1])
        sql = f"{sql[: m.start()]}(round(({sql[m.end() : at - 1]})::DOUBLE + 1.3717e-{d + 2}, {d}) + 0.0){sql[at:]}"
    return sql


def with_views(sql: str, views: tuple[str, ...]) -> str:
    names: list[str] = []
    for v in views:
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    sql = sql.strip()
    if not names:
        return sql
    recursive = sql.upper().startswith("WITH RECURSIVE")
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    rest = sql[len("WITH RECURSIVE") :] if recursive else sql[4:] if sql.upper().startswith("WITH") else None
    return f"WITH {'RECURSIVE ' * recursive}{head}, {rest}" if rest is not None else f"WITH {head} {sql}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()) -> Callable[[Query], Query]:
    """Registers a query, and with ``sql`` its twin over the named views."""

    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(rounded(sql), (views,) if isinstance(views, str) else tuple(views))
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(col: str) -> Column:
    """Nanoseconds of a timestamp without zone, under a UTC session."""
    return F.unix_micros(F.col(col).cast("timestamp")) * 1000


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounds for comparison with other engines: a hundredth of the last digit is added, so no value is a tie."""
    name = col if isinstance(col, str) else None
    out = F.round((F.col(col) if isinstance(col, str) else col).cast("double") + 1.3717 * 10.0 ** -(digits + 2), digits)
    return out.alias(name) if name else out


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        ns("ts").alias("ts_ns"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        (F.lit(0.9998) * F.col("value")).alias("bid"),
        (F.lit(1.0002) * F.col("value")).alias("ask"),
        "user_id",
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), ns("o_orderdate").alias("ts_ns"))
    return days.agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("volume"))


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("curve_id"), ns("o_orderdate").alias("ts_ns")).agg(F.sum((F.col("o_totalprice") - 255000) / 1000).alias("d"))
    return days.select("curve_id", "ts_ns", (F.lit(1e6) + F.sum("d").over(Window.partitionBy("curve_id").orderBy("ts_ns"))).alias("nav"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("curve_id").orderBy("ts_ns")
    return nav(spark, sf_dir).select("curve_id", "ts_ns", "nav", (F.col("nav") / F.lag("nav").over(w) - 1).alias("r"), (F.row_number().over(w) - 1).cast("long").alias("i"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, qty, tax, disc = (F.col(c) for c in ("l_extendedprice", "l_quantity", "l_tax", "l_discount"))
    buy = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("account"),
        (F.col("l_suppkey") % 10).cast("string").alias("symbol"),
        ns("l_shipdate").alias("ts_ns"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"),
        F.col("l_suppkey").alias("k4"),
        F.when(buy, "buy").otherwise("sell").alias("side"),
        qty.alias("quantity"),
        (price / qty).alias("price"),
        (price * tax / 100).alias("commission"),
        (price * disc / 100).alias("slippage_cost"),
        (F.col("l_linenumber") % 2 == 0).alias("is_maker"),
        (price * (disc - tax)).alias("realized"),
        F.when(buy, qty).otherwise(-qty).alias("signed_quantity"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = F.col("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("book"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity") + F.when(bid, 0).otherwise(110000)).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_suppkey").alias("k3"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per book: bids best first, asks best first, levels as struct<price, size, orders>."""
    from tickspark.operators.books import build_books

    return build_books(levels(spark, sf_dir), "book")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), ns("ts").alias("ts_ns"), F.col("event_id").alias("seq"), F.round(F.col("value") * 1000000).cast("long").alias("latency_ns"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of two symbols where both have one: ts_ns, y, x."""
    s = series(spark, sf_dir)
    y = s.where("symbol = '1-URGENT'").select("ts_ns", F.col("price").alias("y"))
    return y.join(s.where("symbol = '2-HIGH'").select("ts_ns", F.col("price").alias("x")), "ts_ns")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one takes a temporary folder, a cluster may not."""
    import tempfile

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tables-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables in the shared folder."""
    import uuid

    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
