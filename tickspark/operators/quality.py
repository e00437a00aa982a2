"""Quality gates, corporate actions and cross-feed checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.stretches import number, scan, stretches
from tickspark.plans.catalog import cut, query, r, ticks

STALE_NS = 1_000_000_000


def check_ticks(df: DataFrame, stale_ns: int = STALE_NS, keys: tuple[str, ...] = ("exchange", "symbol"), length: int | None = None) -> DataFrame:
    """Q1: ``verdict`` of each quote: crossed, stale, gap or ok.

    ``df``: keys, bid, ask, exchange_ts_ns, ingest_ts_ns, sequence (null: feed numbers nothing) and seq, the order
    of arrival. Crossed and stale rows leave the sequence alone; a lower number resets it. Adds expected and dropped.
    """
    crossed = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") > F.col("ask"))
    stale = F.col("ingest_ts_ns") - F.col("exchange_ts_ns") > stale_ns
    flagged = df.withColumn("_bad", F.when(crossed, "crossed").when(stale, "stale"))
    cut = stretches(flagged, list(keys), ("seq",), length)
    gap = F.col("sequence") > F.col("_prev") + 1
    return cut.done(
        cut.running(cut.df, {"_prev": ("last", F.when(F.col("_bad").isNull(), F.col("sequence")))}, before=True)
        .withColumn("verdict", F.coalesce("_bad", F.when(gap, "gap"), F.lit("ok")))
        .withColumn("expected", F.when(F.col("verdict") == "gap", F.col("_prev") + 1))
        .withColumn("dropped", F.when(F.col("verdict") == "gap", F.col("sequence") - F.col("_prev") - 1).otherwise(0))
        .drop("_bad", "_prev")
    )


def check_prints(df: DataFrame, keys: tuple[str, ...] = ("exchange", "symbol"), length: int | None = None) -> DataFrame:
    """Q2: out_of_order below the running maximum (kept), gap above it by more than one, else ok."""
    cut = stretches(df, list(keys), ("seq",), length)
    return cut.done(
        cut.running(cut.df, {"_top": ("max", F.col("sequence"))}, before=True)
        .withColumn("verdict", F.when(F.col("sequence") < F.col("_top"), "out_of_order").when(F.col("sequence") > F.col("_top") + 1, "gap").otherwise("ok"))
        .withColumn("expected", F.when(F.col("verdict") == "gap", F.col("_top") + 1))
        .withColumn("dropped", F.when(F.col("verdict") == "gap", F.col("sequence") - F.col("_top") - 1).otherwise(0))
        .drop("_top")
    )


def quality_stats(df: DataFrame) -> DataFrame:
    """Q3: counters per exchange over rows with a verdict."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return df.groupBy("exchange").agg(
        F.count("*").alias("observed"), count("gap").alias("gaps"), F.sum("dropped").alias("dropped"), count("stale").alias("stale"), count("crossed").alias("crossed"), count("out_of_order").alias("out_of_order")
    )


def quality_events(df: DataFrame) -> DataFrame:
    """Q4: side outputs of a gate: an alert or a data gap per row that is not ok, with its priority."""
    v = F.col("verdict")
    code = F.when(v == "stale", "STALE_TICK").when(v == "crossed", "CROSSED_BOOK").when(v == "out_of_order", "OUT_OF_ORDER_TRADE").when(v == "gap", "DATA_GAP")
    rows = df.where(v != "ok").withColumn("code", code)
    return rows.select("exchange", "symbol", "seq", "code", F.when(v == "crossed", 2).when(v == "gap", None).otherwise(1).alias("severity"), F.when(v == "gap", "critical").otherwise("high").alias("priority"), "expected", F.when(v == "gap", F.col("sequence")).alias("received"), "dropped")


def passing(df: DataFrame) -> DataFrame:
    """Q4: the rows a gate lets through."""
    return df.where(~F.col("verdict").isin("stale", "crossed"))


def drop_rewinds(df: DataFrame, key: str | None = None, length: int | None = None) -> DataFrame:
    """Q5: drops rows older than the newest seen in order of arrival; without ``key`` the guard spans the whole feed."""
    own = df if key else df.withColumn("_feed", F.lit(0))
    cut = stretches(own, key or "_feed", ("seq",), length)
    met = cut.done(cut.running(cut.df, {"_top": ("max", F.col("ts_ns"))})).where("ts_ns >= _top").drop("_top")
    return met if key else met.drop("_feed")


def feed_health(obs: DataFrame, recent: int = 1024, limit_ns: int = 5_000_000) -> DataFrame:
    """Q6: per source ticks, last event, mean of the last ``recent`` latencies (whole ns), maximum, violations.

    The last ones are a limit per source, which Spark applies before its shuffle; all else is partial aggregates.
    """
    w = Window.partitionBy("source").orderBy(F.desc("seq"))
    last = obs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= recent)
    late = last.groupBy("source").agg(F.expr("sum(latency_ns) div count(latency_ns)").alias("mean_latency"), F.max("latency_ns").alias("recent_max"))
    g = obs.groupBy("source").agg(F.count("*").alias("ticks"), F.max("ts_ns").alias("last_ts"), F.max("latency_ns").alias("max_latency"), F.count_if(F.col("latency_ns") > limit_ns).alias("violations"))
    return g.join(late, "source", "left").select("source", "ticks", "last_ts", "mean_latency", "max_latency", "violations", "recent_max")


_ACTION = ("ord", "kind", "symbol", "effective_at", "ratio", "to", "children", "until_ns")


def _seen(actions: DataFrame) -> DataFrame:
    """(origin, sees): the symbols whose actions can meet a tick of ``origin``, its own and those it may be renamed to.

    A null origin stands for all symbols that no action names. One round per link of the longest chain of renames.
    """
    named = actions.select(F.col("symbol").alias("origin")).where("origin is not null").distinct()
    seen = named.withColumn("sees", F.col("origin")).unionByName(actions.sparkSession.range(1).select(F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("sees")))
    renames = actions.where("kind = 'rename' and `to` is not null").select(F.col("symbol").alias("_from"), "to").distinct()
    if renames.isEmpty():
        return seen
    of_all = renames.where("_from is null").select(F.col("to").alias("sees"))
    last = seen.unionByName(seen.select("origin").distinct().join(F.broadcast(of_all)).select("origin", "sees")).distinct()
    seen = last = cut(last)
    while True:
        new = last.join(renames, F.col("sees") == F.col("_from")).select("origin", F.col("to").alias("sees")).distinct()
        known = seen.select(F.col("origin").alias("_o"), F.col("sees").alias("_s"))
        last = cut(new.join(known, F.col("origin").eqNullSafe(F.col("_o")) & F.col("sees").eqNullSafe(F.col("_s")), "left_anti"))
        if last.isEmpty():
            return seen
        seen = cut(seen.unionByName(last))


def action_timelines(actions: DataFrame) -> DataFrame:
    """Per symbol the times at which its actions change, and what all actions in force from each time on compose to.

    Columns: origin (null: symbols that no action names), points, outcomes: symbol, factor, gone, children.
    """
    known = actions.select(*_ACTION).where("effective_at is not null")
    seen = _seen(known)
    own = seen.join(known.where("symbol is not null"), F.col("sees") == F.col("symbol")).select("origin", F.struct(*_ACTION).alias("_a"))
    general = seen.select("origin").distinct().join(F.broadcast(known.where("symbol is null").select(F.struct(*_ACTION).alias("_a"))))
    lists = own.unionByName(general).groupBy("origin").agg(F.array_sort(F.collect_list("_a")).alias("_actions"))
    none = F.lit(None).cast("array<struct<symbol:string,ratio:double>>")

    def state(symbol: Column, factor: Column, gone: Column, children: Column) -> Column:
        return F.struct(symbol.alias("symbol"), factor.alias("factor"), gone.alias("gone"), children.alias("children"))

    def at(time: Column) -> Column:
        def fold(acc: Column, a: Column) -> Column:
            mine = a["symbol"].isNull() | F.coalesce(a["symbol"] == acc["symbol"], F.lit(False))
            on = ~acc["gone"] & acc["children"].isNull() & (time >= a["effective_at"]) & mine
            return state(
                F.when(on & (a["kind"] == "rename"), a["to"]).otherwise(acc["symbol"]),
                F.when(on & (a["kind"] == "split"), acc["factor"] * a["ratio"]).otherwise(acc["factor"]),
                acc["gone"] | F.coalesce(on & (a["kind"] == "halt") & (time < a["until_ns"]), F.lit(False)),
                F.when(on & (a["kind"] == "fork"), a["children"]).otherwise(acc["children"]),
            )

        return F.aggregate("_actions", state(F.col("origin"), F.lit(1.0), F.lit(False), none), fold)

    ends = F.transform(F.filter("_actions", lambda a: a["until_ns"].isNotNull()), lambda a: a["until_ns"])
    lists = lists.withColumn("points", F.array_sort(F.array_distinct(F.concat(F.transform("_actions", lambda a: a["effective_at"]), ends))))
    return lists.select("origin", "points", F.transform("points", at).alias("outcomes"))


def apply_actions(df: DataFrame, actions: DataFrame) -> DataFrame:
    """Q7: corporate actions in listed order on each tick from their effective time on.

    ``actions``: ord, kind (split, rename, fork, halt, dividend), symbol (null: all), effective_at, ratio, to,
    children array<struct<symbol, ratio>>, until_ns. A split divides the price and multiplies the size, a rename
    changes the symbol, a halt drops until its end, and a fork ends the row in one row per child. An action without
    effective time and a halt without end do nothing. A tick meets the composed timeline of its own symbol, one row
    that holds no other symbol's actions, and finds its time in there by search.
    """
    lines = action_timelines(actions)
    named = lines.where("origin is not null").select(F.col("origin").alias("symbol"), F.col("points").alias("_p"), F.col("outcomes").alias("_o"))
    general = lines.where("origin is null").agg(F.first("points").alias("_gp"), F.first("outcomes").alias("_go"))  # one row, of the actions on all symbols
    met = df.join(named, "symbol", "left").join(F.broadcast(general))
    met = met.withColumn("_go", F.when(F.col("_p").isNull(), F.col("_go"))).withColumn("_p", F.coalesce("_p", "_gp")).withColumn("_o", F.coalesce("_o", "_go"))
    met = met.withColumn("_n", number(F.col("_p"), F.col("ts_ns"))).withColumn("_f", F.when(F.col("_n") > 0, F.element_at("_o", F.col("_n"))))
    met = met.where("_f is null or not _f.gone")
    # Symbols that no action names keep their name, unless one on all symbols renames them.
    own = F.array(F.struct(F.coalesce("_f.symbol", "symbol").alias("symbol"), F.lit(1.0).alias("ratio")))
    out = met.withColumn("_c", F.explode(F.coalesce("_f.children", own))).withColumn("_k", F.coalesce("_f.factor", F.lit(1.0)))
    made = {"symbol": F.col("_c.symbol"), "price": F.col("price") / F.col("_k"), "size": F.col("size") * F.col("_k") * F.col("_c.ratio")}
    return out.withColumns(made).select(*df.columns)


def cross_feed_basis(df: DataFrame, window: int = 256, key: str = "symbol", length: int | None = None) -> DataFrame:
    """Q8: relative basis of two feeds (price_a, price_b), its rolling mean and deviation, and the z of the last."""
    both = df.where((F.col("price_a") > 0) & (F.col("price_b") > 0)).withColumn("basis", (F.col("price_a") - F.col("price_b")) / ((F.col("price_a") + F.col("price_b")) / 2))
    cut = stretches(both, key, ("ts_ns", "seq"), length, least=window)

    def rolled(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("ts_ns", "seq").rowsBetween(-(window - 1), 0)
        return d.withColumn("mean", F.avg("basis").over(w)).withColumn("std", F.coalesce(F.stddev_samp("basis").over(w), F.lit(0.0)))

    return cut.done(cut.bounded(cut.df, window, rolled)).withColumn("z", F.when(F.col("std") > 1e-12, (F.col("basis") - F.col("mean")) / F.col("std")).otherwise(0.0))


def sliding_median(df: DataFrame, col: str, k: int, key: str = "symbol", order: tuple[str, ...] = ("ts_ns", "seq"), length: int | None = None) -> DataFrame:
    """``median`` and ``mad`` (0 for less than two values) of the ``k`` last rows, nulls passed over.

    Batches of sorted rows meet the k - 1 values before them; the windows of a batch are sorted as one matrix.
    """

    def middle_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.count_nonzero(~np.isnan(rows), axis=1)
        ranked, at = np.sort(rows, axis=1), np.arange(len(rows))
        return (ranked[at, np.maximum(n - 1, 0) // 2] + ranked[at, np.minimum(n // 2, rows.shape[1] - 1)]) / 2, n

    def step(state, p: pd.DataFrame):
        before = np.array(state[0]) if state else np.full(k - 1, np.nan)
        x = np.concatenate((before, p[col].to_numpy(dtype=float)))
        windows = np.lib.stride_tricks.sliding_window_view(x, k)
        median, mad = np.empty(len(p)), np.empty(len(p))
        for i in range(0, len(p), 8192):
            part = windows[i : i + 8192]
            median[i : i + 8192], n = middle_of(part)
            mad[i : i + 8192] = np.where(n < 2, 0.0, middle_of(np.abs(part - median[i : i + 8192, None]))[0])
        return (x[len(x) - k + 1 :],), {"median": median, "mad": mad}

    cut = stretches(df, key, order, length, least=k)
    return cut.done(cut.bounded(cut.df, k, lambda d, keys: scan(d, keys, list(order), step, "median double, mad double")))


def hampel(df: DataFrame, window: int = 64, threshold: float = 4.5, warmup: int = 30, col: str = "price", key: str = "symbol", length: int | None = None) -> DataFrame:
    """Q10: median and scaled deviation over the last ``window`` values, the current one included."""
    held = sliding_median(df, col, window, key, length=length)
    cut = stretches(held, key, ("ts_ns", "seq"), length)
    numbered = cut.done(cut.running(cut.df, {"_n": ("count", F.lit(1))}))
    far = F.abs(F.col(col) - F.col("median")) > threshold * 1.4826 * F.col("mad")
    return numbered.withColumn("outlier", (F.col("_n") > warmup) & (F.col("mad") > 0) & far).drop("_n")


def middle(values: Column) -> Column:
    """Median of an array: the mean of the two middle values."""
    v, n = F.array_sort(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


#: Quotes of two exchanges with planted faults: seq is the order of arrival.
_Q = """q AS (SELECT CASE seq % 2 WHEN 0 THEN 'b' ELSE 'c' END AS exchange, symbol, seq, ts_ns AS exchange_ts_ns, ts_ns + CASE WHEN seq % 53 = 0 THEN 2000000000 ELSE 1000 END AS ingest_ts_ns,
    CASE WHEN seq % 31 = 0 THEN ask + 1 ELSE bid END AS bid, ask, seq - (seq % 97 = 0)::INT * 5 AS sequence FROM v_ticks),
    c AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 AND bid > ask THEN 'crossed' WHEN ingest_ts_ns - exchange_ts_ns > 1000000000 THEN 'stale' END AS bad FROM q),
    p AS (SELECT *, last_value(CASE WHEN bad IS NULL THEN sequence END IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
    g AS (SELECT *, coalesce(bad, CASE WHEN sequence > prev + 1 THEN 'gap' END, 'ok') AS verdict FROM p)"""


def _quotes(spark, sf):
    s = F.col("seq")
    return ticks(spark, sf).select(
        F.when(s % 2 == 0, "b").otherwise("c").alias("exchange"),
        "symbol",
        "seq",
        F.col("ts_ns").alias("exchange_ts_ns"),
        (F.col("ts_ns") + F.when(s % 53 == 0, 2_000_000_000).otherwise(1000)).alias("ingest_ts_ns"),
        F.when(s % 31 == 0, F.col("ask") + 1).otherwise(F.col("bid")).alias("bid"),
        "ask",
        (s - F.when(s % 97 == 0, 5).otherwise(0)).alias("sequence"),
    )


@query("q1_check_ticks", f"WITH {_Q} SELECT seq, verdict, CASE WHEN verdict = 'gap' THEN prev + 1 END AS expected, CASE WHEN verdict = 'gap' THEN sequence - prev - 1 ELSE 0 END AS dropped FROM g", "v_ticks")
def q1(spark, sf):
    return check_ticks(_quotes(spark, sf)).select("seq", "verdict", "expected", "dropped")


_P = """t AS (SELECT *, max(sequence) OVER (PARTITION BY exchange, symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM q),
    v AS (SELECT *, CASE WHEN sequence < top THEN 'out_of_order' WHEN sequence > top + 1 THEN 'gap' ELSE 'ok' END AS verdict FROM t)"""


@query("q2_check_prints", f"WITH {_Q}, {_P} SELECT seq, verdict, CASE WHEN verdict = 'gap' THEN top + 1 END AS expected, CASE WHEN verdict = 'gap' THEN sequence - top - 1 ELSE 0 END AS dropped FROM v", "v_ticks")
def q2(spark, sf):
    return check_prints(_quotes(spark, sf)).select("seq", "verdict", "expected", "dropped")


@query(
    "q3_quality_stats",
    f"""WITH {_Q} SELECT exchange, count(*) AS observed, count(*) FILTER (verdict = 'gap') AS gaps, sum(CASE WHEN verdict = 'gap' THEN sequence - prev - 1 ELSE 0 END)::BIGINT AS dropped,
    count(*) FILTER (verdict = 'stale') AS stale, count(*) FILTER (verdict = 'crossed') AS crossed, 0::BIGINT AS out_of_order FROM g GROUP BY exchange""",
    "v_ticks",
)
def q3(spark, sf):
    return quality_stats(check_ticks(_quotes(spark, sf)))


@query(
    "q4_quality_events",
    f"""WITH {_Q} SELECT exchange, symbol, seq, CASE verdict WHEN 'stale' THEN 'STALE_TICK' WHEN 'crossed' THEN 'CROSSED_BOOK' ELSE 'DATA_GAP' END AS code, CASE verdict WHEN 'crossed' THEN 2 WHEN 'stale' THEN 1 END AS severity,
    CASE verdict WHEN 'gap' THEN 'critical' ELSE 'high' END AS priority, CASE WHEN verdict = 'gap' THEN prev + 1 END AS expected, CASE WHEN verdict = 'gap' THEN sequence END AS received,
    CASE WHEN verdict = 'gap' THEN sequence - prev - 1 ELSE 0 END AS dropped FROM g WHERE verdict <> 'ok'""",
    "v_ticks",
)
def q4(spark, sf):
    return quality_events(check_ticks(_quotes(spark, sf)))


_REWOUND = "s AS (SELECT symbol, seq, ts_ns - (seq % 11 = 0)::INT * 36000000000000 AS ts_ns FROM v_ticks)"


@query("q5_drop_rewinds", f"WITH {_REWOUND} SELECT symbol, seq, ts_ns FROM (SELECT *, max(ts_ns) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM s) WHERE ts_ns >= top", "v_ticks")
def q5(spark, sf):
    shifted = ticks(spark, sf).withColumn("ts_ns", F.col("ts_ns") - F.when(F.col("seq") % 11 == 0, 36_000_000_000_000).otherwise(0))
    return drop_rewinds(shifted).select("symbol", "seq", "ts_ns")


@query(
    "q6_feed_health",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS rank FROM v_latency)
    SELECT source, count(*) AS ticks, max(ts_ns) AS last_ts, (sum(latency_ns) FILTER (rank <= 1024))::BIGINT // count(*) FILTER (rank <= 1024) AS mean_latency, max(latency_ns) AS max_latency,
    count(*) FILTER (latency_ns > 5000000) AS violations, max(latency_ns) FILTER (rank <= 1024) AS recent_max FROM k GROUP BY source""",
    "v_latency",
)
def q6(spark, sf):
    from tickspark.plans.catalog import latency

    return feed_health(latency(spark, sf))


@query(
    "q7_apply_actions",
    """WITH b AS (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi, min(symbol) AS first, max(symbol) AS last FROM v_ticks), m AS (SELECT lo, hi, (lo + hi) // 2 AS mid, lo + (hi - lo) // 4 AS q1, lo + (hi - lo) // 8 AS q0, first, last FROM b),
    h AS (SELECT t.*, mid, first, last FROM v_ticks t, m WHERE NOT (ts_ns >= q0 AND ts_ns < q1)),
    s AS (SELECT seq, symbol, CASE WHEN ts_ns >= mid AND symbol = first THEN price / 2 ELSE price END AS price, CASE WHEN ts_ns >= mid AND symbol = first THEN size * 2 ELSE size END AS size, ts_ns >= mid AND symbol = last AS forks FROM h)
    SELECT seq, symbol, R6(price) AS price, size FROM s WHERE NOT forks UNION ALL SELECT seq, 'A', R6(price), size FROM s WHERE forks UNION ALL SELECT seq, 'B', R6(price), size * 0.5 FROM s WHERE forks""",
    "v_ticks",
)
def q7(spark, sf):
    t = ticks(spark, sf)
    b = t.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"), F.min("symbol").alias("first"), F.max("symbol").alias("last"))
    half = F.expr("(lo + hi) div 2")
    none = F.lit(None).cast("double")
    kids = F.array(*[F.struct(F.lit(k).alias("symbol"), F.lit(v).alias("ratio")) for k, v in (("A", 1.0), ("B", 0.5))])
    empty, text, long = F.lit(None).cast("array<struct<symbol:string,ratio:double>>"), F.lit(None).cast("string"), F.lit(None).cast("long")
    cols = ("ord", "kind", "symbol", "effective_at", "ratio", "to", "children", "until_ns")
    rows = [
        (F.lit(1), F.lit("halt"), text, F.expr("lo + (hi - lo) div 8"), none, text, empty, F.expr("lo + (hi - lo) div 4")),
        (F.lit(2), F.lit("split"), F.col("first"), half, F.lit(2.0), text, empty, long),
        (F.lit(3), F.lit("dividend"), text, half, none, text, empty, long),
        (F.lit(4), F.lit("fork"), F.col("last"), half, none, text, kids, long),
    ]
    actions = b.select(F.explode(F.array(*[F.struct(*[v.alias(c) for c, v in zip(cols, row, strict=True)]) for row in rows])).alias("a")).select("a.*")
    return apply_actions(t, actions).select("seq", "symbol", r("price"), "size")


@query(
    "q8_cross_feed_basis",
    """WITH f AS (SELECT symbol, ts_ns, seq, price AS price_a, price * (1 + (seq % 13 - 6) / 1000.0::DOUBLE) AS price_b FROM v_ticks WHERE price > 0),
    b AS (SELECT *, (price_a - price_b) / ((price_a + price_b) / 2) AS basis FROM f WHERE price_a > 0 AND price_b > 0),
    w AS (SELECT *, avg(basis) OVER x AS mean, coalesce(stddev_samp(basis) OVER x, 0) AS std FROM b WINDOW x AS (PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN 255 PRECEDING AND CURRENT ROW))
    SELECT seq, R6(basis) AS basis, R6(mean) AS mean, R6(std) AS std, R4(CASE WHEN std > 1e-12 THEN (basis - mean) / std ELSE 0 END) AS z FROM w""",
    "v_ticks",
)
def q8(spark, sf):
    t = ticks(spark, sf).where("price > 0").withColumn("price_a", F.col("price")).withColumn("price_b", F.col("price") * (1 + (F.col("seq") % 13 - 6) / F.lit(1000.0)))
    return cross_feed_basis(t).select("seq", r("basis"), r("mean"), r("std"), r("z", 4))


@query(
    "q10_hampel",
    """WITH w AS (SELECT *, list(price) OVER (PARTITION BY symbol ORDER BY ts_ns, seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, seq) AS n FROM v_ticks),
    m AS (SELECT *, list_aggregate(v, 'median') AS med FROM w), d AS (SELECT *, list_aggregate(list_transform(v, lambda x: abs(x - med)), 'median') AS mad FROM m)
    SELECT seq, R4(med) AS median, R4(mad) AS mad, n > 30 AND mad > 0 AND abs(price - med) > 4.5::DOUBLE * 1.4826::DOUBLE * mad AS outlier FROM d""",
    "v_ticks",
)
def q10(spark, sf):
    return hampel(ticks(spark, sf)).select("seq", r("median", 4), r("mad", 4), "outlier")
