"""As-of, alignment and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.stretches import stretches
from tickspark.plans.catalog import DAY, MINUTE, SECOND, nav, query, r, series, table, ticks

from .bars import build_bars, sane


def asof(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], order: tuple[str, ...] = ("ts_ns",), length: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it: one union, one shuffle by key, one sort."""
    rows = right.select(*keys, *order[:1], *[F.lit(-1).cast("long").alias(c) for c in order[1:]], F.lit(0).alias("_side"), F.struct(*order[:1], *cols).alias("_r"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in {*keys, *order}])
    own = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(rows.schema["_r"].dataType))
    cut = stretches(own.unionByName(rows), keys, (order[0], "_side", *order[1:]), length)
    met = cut.done(cut.running(cut.df, {"_m": ("last", F.col("_r"))}).where("_side = 1"))
    return met.withColumns({c: F.col(f"_m.{c}") for c in cols}).withColumn("matched_ts", F.col(f"_m.{order[0]}")).drop("_r", "_m", "_side")


def asof_pair(y: DataFrame, x: DataFrame, tolerance_ns: int = 5 * SECOND, keys: tuple[str, ...] = (), length: int | None = None) -> DataFrame:
    """On every tick of either leg the other leg's latest price, unless it is older than the tolerance.

    Without ``keys`` there is one pair; a pair of any length is cut by time.
    """
    legs = y.select(*keys, "ts_ns", "seq", F.lit("y").alias("leg"), F.struct("ts_ns", "price").alias("_y"), F.lit(None).cast("struct<ts_ns:long,price:double>").alias("_x"))
    legs = legs.unionByName(x.select(*keys, "ts_ns", "seq", F.lit("x").alias("leg"), F.lit(None).cast("struct<ts_ns:long,price:double>").alias("_y"), F.struct("ts_ns", "price").alias("_x")))
    own = legs if keys else legs.withColumn("_pair", F.lit(0))
    cut = stretches(own, list(keys) or ["_pair"], ("ts_ns", "seq"), length)
    met = cut.running(cut.df, {"_ly": ("last", F.col("_y")), "_lx": ("last", F.col("_x"))})
    near = F.abs(F.col("_ly.ts_ns") - F.col("_lx.ts_ns")) <= tolerance_ns
    return met.where(near).select(*keys, "ts_ns", "seq", "leg", F.col("_ly.price").alias("y"), F.col("_lx.price").alias("x"))


def join_bars(y: DataFrame, x: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Closes of both legs at the boundaries they share."""
    return y.select(*keys, "open_ts", F.col("close").alias("y")).join(x.select(*keys, "open_ts", F.col("close").alias("x")), [*keys, "open_ts"])


def asof_label(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """The last label at or before each row, else ``unlabelled``."""
    met = asof(rows, labels, keys, ["label"])
    return met.withColumn("label", F.coalesce("label", F.lit("unlabelled"))).drop("matched_ts")


def align_nav(a: DataFrame, b: DataFrame, length: int | None = None) -> DataFrame:
    """Both curves at the union of their times within the common window, carried forward.

    ``a`` and ``b``: key, ts_ns, nav (and seq, to keep the last of equal times).
    """
    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key", "ts_ns").agg(F.max_by("nav", "seq").alias(name))

    one, two = last(a, "a"), last(b, "b")
    span = one.groupBy("key").agg(F.min("ts_ns").alias("_a0"), F.max("ts_ns").alias("_a1")).join(two.groupBy("key").agg(F.min("ts_ns").alias("_b0"), F.max("ts_ns").alias("_b1")), "key")
    cut = stretches(one.join(two, ["key", "ts_ns"], "full"), "key", ("ts_ns",), length)
    both = cut.done(cut.running(cut.df, {"_la": ("last", F.col("a")), "_lb": ("last", F.col("b"))})).select("key", "ts_ns", F.col("_la").alias("a"), F.col("_lb").alias("b"))
    inside = (F.col("ts_ns") >= F.greatest("_a0", "_b0")) & (F.col("ts_ns") <= F.least("_a1", "_b1"))
    return both.join(span, "key").where(inside).select("key", "ts_ns", "a", "b")


def enumerate_pairs(symbols: DataFrame) -> DataFrame:
    """Every couple of distinct symbols once, in lexicographic order."""
    a, b = symbols.select(F.col("symbol").alias("y_symbol")).distinct(), symbols.select(F.col("symbol").alias("x_symbol")).distinct()
    return a.join(b, F.col("y_symbol") < F.col("x_symbol")).withColumn("pair", F.concat_ws("~", "y_symbol", "x_symbol"))


def effective_fee(df: DataFrame, tiers: DataFrame, taker: str = "taker") -> DataFrame:
    """Fee of the highest tier at or below ``volume``, else the first tier, else 0.

    ``tiers``: venue, threshold, maker_bps, taker_bps, a bounded dimension. ``taker``: a boolean column.
    """
    lists = tiers.groupBy("venue").agg(F.array_sort(F.collect_list(F.struct("threshold", "maker_bps", "taker_bps"))).alias("_tiers"))
    met = df.join(F.broadcast(lists), "venue", "left")
    reached = F.filter("_tiers", lambda t: t["threshold"] <= F.col("volume"))
    tier = F.coalesce(F.try_element_at(reached, F.lit(-1)), F.try_element_at("_tiers", F.lit(1)))
    fee = F.when(F.col(taker), tier["taker_bps"]).otherwise(tier["maker_bps"])
    return met.withColumn("fee_bps", F.coalesce(fee, F.lit(0.0))).drop("_tiers")


def eligible_venues(orders: DataFrame, venues: DataFrame) -> DataFrame:
    """Venues that take an order's type, by their supports_stop and supports_iceberg; rows of ``orders`` may be types."""
    kind = F.col("order_type")
    takes = kind.isin("market", "limit") | (kind.startswith("stop") & F.col("supports_stop")) | ((kind == "iceberg") & F.col("supports_iceberg"))
    return venues.join(orders, takes)


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the role they play in each fold; ``folds`` is a bounded table of train and test intervals."""
    inside = lambda a, b: (F.col("ts_ns") >= F.col(a)) & (F.col("ts_ns") < F.col(b))
    role = F.when(inside("train_lo", "train_hi"), "train").when(inside("test_lo", "test_hi"), "test")
    return df.join(F.broadcast(folds), inside("train_lo", "train_hi") | inside("test_lo", "test_hi")).withColumn("role", role)


def purge(groups: DataFrame, splits: DataFrame, embargo: int) -> DataFrame:
    """Train groups of each split: no test group, and none that starts within the embargo after one."""
    every = groups.crossJoin(F.broadcast(splits.select("split").distinct()))
    tests = splits.join(F.broadcast(groups.select(F.col("group").alias("test_group"), F.col("lo").alias("_tlo"), F.col("hi").alias("_thi"))), "test_group").select(F.col("split").alias("_s"), F.col("test_group"), "_thi")
    hit = (F.col("split") == F.col("_s")) & ((F.col("group") == F.col("test_group")) | ((F.col("lo") >= F.col("_thi")) & (F.col("lo") < F.col("_thi") + embargo)))
    return every.join(F.broadcast(tests), hit, "left_anti")


def sweep(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every point of a bounded parameter grid."""
    return df.crossJoin(F.broadcast(grid))


_LEGS = """l AS (SELECT user_id % 20 AS g, ts_ns, seq, price, symbol FROM v_ticks WHERE symbol IN ('click', 'view')),
    m AS (SELECT *, last_value(CASE WHEN symbol = 'click' THEN price END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN symbol = 'view' THEN price END IGNORE NULLS) OVER w AS x,
      last_value(CASE WHEN symbol = 'click' THEN ts_ns END IGNORE NULLS) OVER w AS ty, last_value(CASE WHEN symbol = 'view' THEN ts_ns END IGNORE NULLS) OVER w AS tx FROM l
      WINDOW w AS (PARTITION BY g ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING))"""


@query("j1_asof_pair", f"WITH {_LEGS} SELECT g, ts_ns, seq, y, x FROM m WHERE abs(ty - tx) <= {600 * MINUTE}", "v_ticks")
def j1(spark, sf):
    t = ticks(spark, sf).withColumn("g", F.col("user_id") % 20)
    return asof_pair(t.where("symbol = 'click'"), t.where("symbol = 'view'"), 600 * MINUTE, ("g",)).drop("leg")


@query(
    "j2_join_bars",
    """WITH b AS (SELECT symbol, ts_ns - ts_ns % 14400000000000 AS open_ts, arg_max(price, (ts_ns, seq)) AS close FROM v_ticks WHERE price > 0 AND size > 0 GROUP BY 1, 2)
    SELECT a.open_ts, a.close AS y, c.close AS x FROM b a JOIN b c ON a.open_ts = c.open_ts WHERE a.symbol = 'click' AND c.symbol = 'view'""",
    "v_ticks",
)
def j2(spark, sf):
    bars = build_bars(sane(ticks(spark, sf)), 14_400_000_000_000)
    return join_bars(bars.where("symbol = 'click'"), bars.where("symbol = 'view'"))


@query(
    "j3_asof_label",
    """WITH l AS (SELECT symbol, ts_ns, CASE WHEN volume > 3 THEN 'busy' ELSE 'quiet' END AS label FROM v_series WHERE volume % 2 = 0), d AS (SELECT o_orderkey, o_orderpriority AS symbol, epoch_us(o_orderdate) * 1000 AS ts_ns FROM orders)
    SELECT o_orderkey, coalesce(label, 'unlabelled') AS label FROM d ASOF LEFT JOIN l ON d.symbol = l.symbol AND d.ts_ns >= l.ts_ns""",
    "v_series",
)
def j3(spark, sf):
    from tickspark.plans.catalog import ns

    labels = series(spark, sf).where("volume % 2 = 0").select("symbol", "ts_ns", F.when(F.col("volume") > 3, "busy").otherwise("quiet").alias("label"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), ns("o_orderdate").alias("ts_ns"))
    return asof_label(rows, labels, ["symbol"]).select("o_orderkey", "label")


@query(
    "j4_align_nav",
    """WITH a AS (SELECT ts_ns, nav FROM v_nav WHERE curve_id = '1-URGENT'), b AS (SELECT ts_ns, nav FROM v_nav WHERE curve_id = '5-LOW'),
    u AS (SELECT ts_ns FROM a UNION SELECT ts_ns FROM b), w AS (SELECT greatest((SELECT min(ts_ns) FROM a), (SELECT min(ts_ns) FROM b)) AS lo, least((SELECT max(ts_ns) FROM a), (SELECT max(ts_ns) FROM b)) AS hi)
    SELECT u.ts_ns, R2(x.nav) AS a, R2(y.nav) AS b FROM u ASOF LEFT JOIN a x ON u.ts_ns >= x.ts_ns ASOF LEFT JOIN b y ON u.ts_ns >= y.ts_ns, w WHERE u.ts_ns BETWEEN lo AND hi""",
    "v_nav",
)
def j4(spark, sf):
    n = nav(spark, sf).withColumn("key", F.lit(0)).withColumn("seq", F.lit(0))
    return align_nav(n.where("curve_id = '1-URGENT'"), n.where("curve_id = '5-LOW'")).select("ts_ns", r("a", 2), r("b", 2))


@query("j5_enumerate_pairs", "WITH s AS (SELECT DISTINCT symbol FROM v_series) SELECT a.symbol AS y_symbol, b.symbol AS x_symbol, a.symbol || '~' || b.symbol AS pair FROM s a JOIN s b ON a.symbol < b.symbol", "v_series")
def j5(spark, sf):
    return enumerate_pairs(series(spark, sf))


def venues_view(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_name").alias("venue"), k.alias("id"), (k % 2 == 0).alias("supports_stop"), (k % 3 == 0).alias("supports_iceberg"))


def tiers_view(spark, sf):
    k = F.col("s_suppkey")
    rows = F.array(*[F.struct((F.lit(t) * (k % 3 + 1)).cast("double").alias("threshold"), (F.lit(m) + k % 3).cast("double").alias("maker_bps"), (F.lit(m + 5) + k % 3).cast("double").alias("taker_bps")) for t, m in ((100, 10), (1000, 6), (5000, 2))])
    return table(spark, sf, "supplier").select(F.col("s_name").alias("venue"), F.explode(rows).alias("t")).select("venue", "t.*")


TIERS_SQL = "tiers AS (SELECT s_name AS venue, x[1] * (s_suppkey % 3 + 1) AS threshold, (x[2] + s_suppkey % 3)::DOUBLE AS maker_bps, (x[2] + 5 + s_suppkey % 3)::DOUBLE AS taker_bps FROM supplier, (SELECT unnest([[100, 10], [1000, 6], [5000, 2]]) AS x))"


@query(
    "j6_effective_fee",
    f"""WITH {TIERS_SQL}, q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, s_name AS venue, l_extendedprice / 10 AS volume, l_linenumber % 2 = 0 AS taker FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    f AS (SELECT q.*, (SELECT arg_max(CASE WHEN q.taker THEN taker_bps ELSE maker_bps END, threshold) FROM tiers t WHERE t.venue = q.venue AND threshold <= q.volume) AS hit,
      (SELECT arg_min(CASE WHEN q.taker THEN taker_bps ELSE maker_bps END, threshold) FROM tiers t WHERE t.venue = q.venue) AS low FROM q)
    SELECT venue, coalesce(hit, low, 0) AS fee_bps, count(*) AS n FROM f GROUP BY 1, 2""",
)
def j6(spark, sf):
    line = table(spark, sf, "lineitem").join(F.broadcast(venues_view(spark, sf)), F.col("l_suppkey") == F.col("id"))
    rows = line.select("venue", (F.col("l_extendedprice") / 10).alias("volume"), (F.col("l_linenumber") % 2 == 0).alias("taker"))
    return effective_fee(rows, tiers_view(spark, sf)).groupBy("venue", "fee_bps").agg(F.count("*").alias("n"))


@query(
    "j7_eligible_venues",
    """WITH o AS (SELECT o_orderkey, ['market', 'limit', 'stop_limit', 'iceberg'][(o_orderkey % 4 + 1)::INT] AS order_type FROM orders)
    SELECT order_type, s_name AS venue, count(*) AS n FROM o JOIN supplier ON order_type IN ('market', 'limit') OR (order_type = 'stop_limit' AND s_suppkey % 2 = 0) OR (order_type = 'iceberg' AND s_suppkey % 3 = 0) GROUP BY 1, 2""",
)
def j7(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "market").when(k % 4 == 1, "limit").when(k % 4 == 2, "stop_limit").otherwise("iceberg")
    types = table(spark, sf, "orders").groupBy(kind.alias("order_type")).agg(F.count("*").alias("n"))  # four rows
    return eligible_venues(types, venues_view(spark, sf)).select("order_type", "venue", "n")


_FOLDS = f"f AS (SELECT i::INT AS fold, lo + i * {100 * DAY} AS train_lo, lo + i * {100 * DAY} + {300 * DAY} AS train_hi, lo + i * {100 * DAY} + {300 * DAY} AS test_lo, lo + i * {100 * DAY} + {400 * DAY} AS test_hi FROM (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM v_series), range((hi - lo - {400 * DAY}) // {100 * DAY} + 1) t(i))"


def _folds(spark, sf):
    """As many folds as fit, from the first row to the last."""
    from .validation import walk_forward_folds

    bounds = series(spark, sf).agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"))
    return walk_forward_folds(bounds, 300 * DAY, 100 * DAY).withColumn("fold", F.col("fold").cast("int"))


@query(
    "j8_assign_folds",
    f"WITH {_FOLDS} SELECT symbol, fold, CASE WHEN ts_ns < train_hi THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM v_series JOIN f ON ts_ns >= train_lo AND ts_ns < test_hi GROUP BY 1, 2, 3",
    "v_series",
)
def j8(spark, sf):
    return assign_folds(series(spark, sf), _folds(spark, sf)).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"))


@query(
    "j9_purge",
    f"""WITH b AS (SELECT min(ts_ns) AS lo FROM v_series), g AS (SELECT i::INT AS "group", lo + i * {100 * DAY} AS lo, lo + (i + 1) * {100 * DAY} AS hi FROM b, range(10) t(i)), s AS (SELECT i::INT AS split, i::INT AS test_group FROM range(10) t(i))
    SELECT split, g."group", g.lo, g.hi FROM g, s WHERE NOT EXISTS (SELECT 1 FROM g t WHERE t."group" = s.test_group AND (g."group" = t."group" OR (g.lo >= t.hi AND g.lo < t.hi + {50 * DAY})))""",
    "v_series",
)
def j9(spark, sf):
    lo = series(spark, sf).agg(F.min("ts_ns").alias("_lo")).withColumn("group", F.explode(F.array(*[F.lit(i) for i in range(10)])))
    groups = lo.select("group", (F.col("_lo") + F.col("group").cast("long") * (100 * DAY)).alias("lo"), (F.col("_lo") + (F.col("group").cast("long") + 1) * (100 * DAY)).alias("hi"))
    return purge(groups, groups.select(F.col("group").alias("split"), F.col("group").alias("test_group")), 50 * DAY).select("split", "group", "lo", "hi")


@query("j10_sweep", "SELECT symbol, e AS entry, x AS exit, count(*) AS n, count(*) FILTER (price > e * 100000) AS above FROM v_series, (SELECT unnest([1.0, 1.5, 2.0])::DOUBLE AS e), (SELECT unnest([0.25, 0.5])::DOUBLE AS x) GROUP BY 1, 2, 3", "v_series")
def j10(spark, sf):
    grid = spark.createDataFrame([(e, x) for e in (1.0, 1.5, 2.0) for x in (0.25, 0.5)], "entry double, exit double")
    return sweep(series(spark, sf), grid).groupBy("symbol", "entry", "exit").agg(F.count("*").alias("n"), F.count_if(F.col("price") > F.col("entry") * 100000).alias("above"))
