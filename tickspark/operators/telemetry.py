"""Latency, flow, alerts, health and audit tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.ranks import cold_rows, hot_keys, values_at
from tickspark.functions.stretches import NEVER, numbered, over_rows, scan
from tickspark.plans.catalog import SECOND, latency, nav, query, r, table

from .performance import safe

#: Bits of a sub-bucket and the largest exponent of the latency histogram.
SUB_BITS, MAX_EXPONENT = 4, 40


def pick_ranks(df: DataFrame, keys: list[str], col: str, ranks: dict[str, Column], length: int | None = None) -> DataFrame:
    """Values at 0-based ranks of the sorted column (``_n`` is the count), from counts per value; of keys with more than
    ``length`` values by histograms."""
    hot = hot_keys(df, keys, col, length)
    if hot is not None:
        long = values_at(df, keys, col, hot, ranks).drop("_n")
        return pick_ranks(cold_rows(df, keys, hot), keys, col, ranks, NEVER).unionByName(long)
    w = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    c = df.groupBy(*keys, col).agg(F.count("*").alias("_c"))
    c = c.withColumn("_up", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("_up") > rank, F.col(col))).alias(name) for name, rank in ranks.items()])


def latency_summary(df: DataFrame, sla_ns: int, keys: list[str] | None = None) -> DataFrame:
    """L1: count, mean, percentiles by rank, maximum, SLA violations; negative samples are rejected and counted."""
    keys = keys or ["source"]
    good = df.where("latency_ns >= 0")
    at = lambda p: F.ceil(F.col("_n") * p) - 1
    ranks = pick_ranks(good, keys, "latency_ns", {"p50": at(0.5), "p90": at(0.9), "p99": at(0.99), "p999": at(0.999)})
    g = df.groupBy(*keys).agg(
        F.count_if(F.col("latency_ns") >= 0).alias("n"), F.avg(F.when(F.col("latency_ns") >= 0, F.col("latency_ns"))).alias("mean"), F.max("latency_ns").alias("max"),
        F.count_if(F.col("latency_ns") > sla_ns).alias("violations"), F.count_if(F.col("latency_ns") < 0).alias("rejected"),
    )
    return g.join(ranks, keys, "left").withColumn("violation_pct", safe(F.col("violations") * 100.0, F.col("n").cast("double")))


def bucket_upper(v: Column) -> Column:
    """L2: largest value of the log-linear bucket of ``v``: 16 sub-buckets to a power of two, up to 2^40."""
    capped = F.least(v, F.lit((1 << MAX_EXPONENT) - 1))
    one = F.lit(1).cast("long")
    left = lambda c, n: F.call_function("shiftleft", c, n)
    e = F.floor(F.log2(F.greatest(capped, one).cast("double"))).cast("int")
    # log2 of a double may round up next to a power of two
    e = F.when(left(one, e) > capped, e - 1).otherwise(e)
    shift = F.greatest(e - SUB_BITS, F.lit(0))
    low = left(F.call_function("shiftright", capped, shift), shift)
    return F.when(capped < 1 << SUB_BITS, capped).otherwise(low + left(one, shift) - 1)


def latency_histogram(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """L2: count and running count per bucket."""
    keys = keys or ["source"]
    h = df.where("latency_ns >= 0").groupBy(*keys, bucket_upper(F.col("latency_ns")).alias("upper")).agg(F.count("*").alias("n"))
    return h.withColumn("running", F.sum("n").over(Window.partitionBy(*keys).orderBy("upper")))


def histogram_percentile(hist: DataFrame, p: float, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["source"]
    total = F.max("running").over(Window.partitionBy(*keys))
    return hist.withColumn("_t", total).where(F.col("running") >= F.ceil(F.col("_t") * p)).groupBy(*keys).agg(F.min("upper").alias("value"))


def latency_stats_exact(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """L3: median (mean of the middle two), p95 and p99 at index floor(n p)."""
    keys = keys or ["source"]
    n = F.col("_n")
    at = lambda p: F.least(F.floor(n * p), n - 1)
    k = pick_ranks(df, keys, "latency_ns", {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2), "p95": at(0.95), "p99": at(0.99)})
    return k.withColumn("median", (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def flow_stats(df: DataFrame, key: str = "band", length: int | None = None) -> DataFrame:
    """L4: per band and sample counters, drop % and events per second since the sample before."""

    def rated(d: DataFrame, w) -> DataFrame:
        return d.withColumn("events_per_s", safe((F.col("published") - F.lag("published").over(w)).cast("double"), (F.col("ts_ns") - F.lag("ts_ns").over(w)) / SECOND))

    return over_rows(df.withColumn("drop_pct", safe(F.col("dropped") * 100.0, F.col("published").cast("double"))), key, 2, rated, length=length)


def alerts(df: DataFrame, sla_ns: int) -> DataFrame:
    """One row per rule that a sample breaks."""
    tests = [
        F.when(F.col("p99") > sla_ns, F.struct(F.lit("LATENCY_SLA").alias("code"), F.lit(2).alias("severity"))),
        F.when(F.col("drop_pct") > 0.1, F.struct(F.lit("EVENT_DROPS").alias("code"), F.lit(1).alias("severity"))),
        F.when(F.col("handler_errors") > 0, F.struct(F.lit("HANDLER_ERRORS").alias("code"), F.lit(1).alias("severity"))),
    ]
    return df.withColumn("_a", F.explode(F.array_compact(F.array(*tests)))).select(*df.columns, "_a.*")


def alert_states(ts: np.ndarray, window_ns: int, first: int | None = None, count: int = 0) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """Whether each raise notifies, and its count; the window runs from the start of the burst."""
    notify, counts = np.zeros(len(ts), bool), np.zeros(len(ts), np.int64)
    for i, t in enumerate(ts):
        if first is None or t - first >= window_ns:
            first, notify[i] = t, True
        count += 1
        counts[i] = count
    return notify, counts, first, count


def dedup_alerts(raises: DataFrame, window_ns: int = 30 * SECOND) -> DataFrame:
    """``notify`` and the running count of each code."""

    def step(state, p: pd.DataFrame):
        first, count = state or (None, 0)
        notify, counts, first, count = alert_states(p["ts_ns"].to_numpy(), window_ns, first, count)
        return (first, count), {"notify": notify, "count": counts}

    return scan(raises, ["code"], ["ts_ns", "seq"], step, "notify boolean, count long")


def active_alerts(deduped: DataFrame) -> DataFrame:
    """Latest state of each code, most severe and most recent first."""
    g = deduped.groupBy("code").agg(F.max_by("severity", F.struct("ts_ns", "seq")).alias("severity"), F.max("ts_ns").alias("last_ts"), F.max("count").alias("count"))
    return g.orderBy(F.desc("severity"), F.desc("last_ts"))


def health(df: DataFrame, degraded_ns: int, failed_ns: int) -> DataFrame:
    """Status of each component by its age and value, and the worst of all beside it."""
    age = F.col("now") - F.col("last_ts")
    status = F.when(age > failed_ns, "failed").when((age > degraded_ns) | (F.col("value") > F.col("threshold")), "degraded").otherwise("healthy")
    rank = lambda c: F.when(c == "failed", 2).when(c == "degraded", 1).otherwise(0)
    d = df.withColumn("status", status)
    worst = d.agg(F.max_by("status", rank(F.col("status"))).alias("worst"))
    return d.crossJoin(F.broadcast(worst))


def metric_rows(df: DataFrame, ids: list[str]) -> DataFrame:
    """Snapshots as (ids, name, value)."""
    cols = [f.name for f in df.schema.fields if f.name not in ids and f.dataType.typeName() in ("double", "long", "integer", "float")]
    return df.unpivot(ids, [F.col(c).cast("double").alias(c) for c in cols], "name", "value")


def runtime_summary(df: DataFrame) -> DataFrame:
    """Strategies with their share of NAV and an even share."""
    t = df.agg(F.sum("nav").alias("total_nav"), F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(t)).withColumn("allocation", safe(F.col("nav"), F.col("total_nav"))).withColumn("even", 1 / F.col("_n")).drop("_n")


def seal(audit: DataFrame, order: str = "sequence") -> DataFrame:
    """Test data for L10: ``canonical`` rows with a stored hash that covers the one before, chained per file in order."""

    def step(state, p: pd.DataFrame):
        import hashlib

        out, before = [], state[0] if state else b"\x00" * 32
        for c in p["canonical"]:
            before = hashlib.sha256(before + bytes(c)).digest()
            out.append(before)
        return (before,), {"chain_hash": out}

    return scan(audit, ["file"], [order], step, "chain_hash binary")


def verify_chain(audit: DataFrame) -> DataFrame:
    """``problem`` of each record: gap in the numbers, or a hash that is not that of (stored hash before, content).

    A record needs only the stored hash before it, so all records are checked at once.
    """
    w = Window.partitionBy("file").orderBy("sequence")
    before = F.coalesce(F.lag("chain_hash").over(w), F.unhex(F.lit("00" * 32)))
    a = audit.withColumn("_made", F.unhex(F.sha2(F.concat(before, F.col("canonical")), 256))).withColumn("_prev", F.lag("sequence").over(w))
    problem = F.when(F.col("_prev").isNotNull() & (F.col("sequence") != F.col("_prev") + 1), "gap").when(F.col("_made") != F.col("chain_hash"), "hash")
    return a.withColumn("problem", problem).drop("_made", "_prev")


def first_break(verified: DataFrame) -> DataFrame:
    return verified.where("problem is not null").groupBy("file").agg(F.min_by(F.struct("sequence", "problem"), "sequence").alias("x")).select("file", "x.*")


def verify_files(heads: DataFrame) -> DataFrame:
    """Each file's stored previous hash against the head of the file before, met by the files' numbers in order."""
    met = _with_previous(heads)
    return met.withColumn("linked", F.coalesce(F.col("previous_hash") == F.col("_before"), F.lit(True))).drop("_before")


def _with_previous(heads: DataFrame) -> DataFrame:
    """``heads`` with ``_before``, the head of the file before."""
    placed = numbered(heads, ["file"], "_i")
    before = placed.select((F.col("_i") + 1).alias("_i"), F.col("head_hash").alias("_before"))
    return placed.join(before, "_i", "left").drop("_i")


def audit_tail(audit: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` records."""
    return audit.orderBy(F.desc("sequence")).limit(n)


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("outcome").agg(F.count("*").alias("n"))


_LAT = "WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY latency_ns) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM v_latency)"


@query(
    "l1_latency_summary",
    _LAT + """ SELECT source, count(*) AS n, R2(avg(latency_ns)) AS mean, min(latency_ns) FILTER (i = ceil(n * 0.5) - 1) AS p50, min(latency_ns) FILTER (i = ceil(n * 0.9::DOUBLE) - 1) AS p90, min(latency_ns) FILTER (i = ceil(n * 0.99::DOUBLE) - 1) AS p99,
    min(latency_ns) FILTER (i = ceil(n * 0.999::DOUBLE) - 1) AS p999, max(latency_ns) AS max, count(*) FILTER (latency_ns > 50000000) AS violations, R6(count(*) FILTER (latency_ns > 50000000) * 100.0 / count(*)) AS violation_pct, 0::BIGINT AS rejected FROM k GROUP BY 1""",
    "v_latency",
)
def l1(spark, sf):
    return latency_summary(latency(spark, sf), 50_000_000).select("source", "n", r("mean", 2), "p50", "p90", "p99", "p999", "max", "violations", r("violation_pct"), "rejected")


_UP = "CASE WHEN latency_ns < 16 THEN latency_ns ELSE ((latency_ns >> greatest(length(bin(latency_ns)) - 5, 0)::INT) << greatest(length(bin(latency_ns)) - 5, 0)::INT) + (1::BIGINT << greatest(length(bin(latency_ns)) - 5, 0)::INT) - 1 END"


@query("l2_latency_histogram", f"WITH h AS (SELECT source, {_UP} AS upper, count(*) AS n FROM v_latency GROUP BY 1, 2) SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY upper))::BIGINT AS running FROM h", "v_latency")
def l2(spark, sf):
    return latency_histogram(latency(spark, sf))


@query(
    "l3_latency_stats_exact",
    _LAT + " SELECT source, R2((min(latency_ns) FILTER (i = (n - 1) // 2) + min(latency_ns) FILTER (i = n // 2)) / 2.0) AS median, min(latency_ns) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, min(latency_ns) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM k GROUP BY 1",
    "v_latency",
)
def l3(spark, sf):
    return latency_stats_exact(latency(spark, sf)).select("source", r("median", 2), "p95", "p99")


_FLOW = "c AS (SELECT event_type AS band, epoch_us(ts) * 1000 // 3600000000000 * 3600000000000 AS ts_ns, count(*) AS n, count(*) FILTER (value < 1) AS d, approx_quantile(value, 0.5) AS x FROM events GROUP BY 1, 2), f AS (SELECT band, ts_ns, (sum(n) OVER w)::BIGINT AS published, (sum(d) OVER w)::BIGINT AS dropped FROM c WINDOW w AS (PARTITION BY band ORDER BY ts_ns))"


def _flow(spark, sf):
    from tickspark.plans.catalog import ns

    e = table(spark, sf, "events").select(F.col("event_type").alias("band"), (F.floor(ns("ts") / (3600 * SECOND)) * (3600 * SECOND)).alias("ts_ns"), "value")
    c = e.groupBy("band", "ts_ns").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 1).alias("d"))
    w = Window.partitionBy("band").orderBy("ts_ns")
    return c.select("band", "ts_ns", F.sum("n").over(w).alias("published"), F.sum("d").over(w).alias("dropped"))


@query("l4_flow_stats", f"WITH {_FLOW} SELECT band, ts_ns, published, dropped, R6(dropped * 100.0 / published) AS drop_pct, R6((published - lag(published) OVER w)::DOUBLE / ((ts_ns - lag(ts_ns) OVER w) / 1e9)) AS events_per_s FROM f WINDOW w AS (PARTITION BY band ORDER BY ts_ns)")
def l4(spark, sf):
    return flow_stats(_flow(spark, sf)).select("band", "ts_ns", "published", "dropped", r("drop_pct"), r("events_per_s"))


@query("l5_alerts", f"WITH {_FLOW}, s AS (SELECT *, dropped * 100.0 / published AS drop_pct FROM f) SELECT band, ts_ns, 'EVENT_DROPS' AS code, 1 AS severity FROM s WHERE drop_pct > 0.1 UNION ALL SELECT band, ts_ns, 'HANDLER_ERRORS', 1 FROM s WHERE dropped % 3 > 0")
def l5(spark, sf):
    s = flow_stats(_flow(spark, sf)).withColumns({"p99": F.lit(0), "handler_errors": F.col("dropped") % 3})
    return alerts(s, 1).select("band", "ts_ns", "code", "severity")


_AL = "a AS (SELECT 'E' || user_id % 7 AS code, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, (event_id % 3)::INT AS severity FROM events)"


def _raises(spark, sf):
    from tickspark.plans.catalog import ns

    return table(spark, sf, "events").select(F.concat(F.lit("E"), F.col("user_id") % 7).alias("code"), ns("ts").alias("ts_ns"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("severity"))


@query(
    "l6_dedup_alerts",
    f"""WITH RECURSIVE {_AL}, k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts_ns, seq) AS i FROM a), m(code, i, seq, first, notify) AS (SELECT code, i, seq, ts_ns, true FROM k WHERE i = 1 UNION ALL
      SELECT k.code, k.i, k.seq, CASE WHEN k.ts_ns - m.first >= 36000000000000 THEN k.ts_ns ELSE m.first END, k.ts_ns - m.first >= 36000000000000 FROM m JOIN k ON k.code = m.code AND k.i = m.i + 1)
    SELECT code, seq, notify, i AS count FROM m""",
)
def l6(spark, sf):
    return dedup_alerts(_raises(spark, sf), 36_000 * SECOND).select("code", "seq", "notify", "count")


@query(
    "l7_health",
    """WITH s AS (SELECT source, max(ts_ns) AS last_ts, avg(latency_ns) / 1e6 AS value FROM v_latency GROUP BY 1), n AS (SELECT max(ts_ns) AS now FROM v_latency), d AS (SELECT source, CASE WHEN now - last_ts > 3600000000000 THEN 'failed' WHEN now - last_ts > 600000000000 OR value > 50 THEN 'degraded' ELSE 'healthy' END AS status FROM s, n)
    SELECT source, status, (SELECT arg_max(status, CASE status WHEN 'failed' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) FROM d) AS worst FROM d""",
    "v_latency",
)
def l7(spark, sf):
    s = latency(spark, sf).groupBy("source").agg(F.max("ts_ns").alias("last_ts"), (F.avg("latency_ns") / 1e6).alias("value"))
    now = s.agg(F.max("last_ts").alias("now"))
    return health(s.crossJoin(F.broadcast(now)).withColumn("threshold", F.lit(50.0)), 600 * SECOND, 3600 * SECOND).select("source", "status", "worst")


@query("l8_metric_rows", "WITH s AS (SELECT source, count(*)::DOUBLE AS n, max(latency_ns)::DOUBLE AS max_ns FROM v_latency GROUP BY 1) SELECT source, 'n' AS name, n AS value FROM s UNION ALL SELECT source, 'max_ns', max_ns FROM s", "v_latency")
def l8(spark, sf):
    return metric_rows(latency(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.max("latency_ns").alias("max_ns")), ["source"])


@query("l9_runtime_summary", "WITH s AS (SELECT curve_id, arg_max(nav, ts_ns) AS nav FROM v_nav GROUP BY 1) SELECT curve_id, R2(nav) AS nav, R2(sum(nav) OVER ()) AS total_nav, R6(nav / sum(nav) OVER ()) AS allocation, R6(1.0 / count(*) OVER ()) AS even FROM s", "v_nav")
def l9(spark, sf):
    return runtime_summary(nav(spark, sf).groupBy("curve_id").agg(F.max_by("nav", "ts_ns").alias("nav"))).select("curve_id", r("nav", 2), r("total_nav", 2), r("allocation"), r("even"))


def _audit(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("log-"), F.floor(F.col("event_id") / 1000)).alias("file"), F.col("event_id").alias("sequence"), F.concat_ws("|", "event_id", "event_type", "user_id").cast("binary").alias("canonical"), F.when(F.col("user_id") % 10 == 0, "denied").when(F.col("user_id") % 10 == 1, "failed").otherwise("allowed").alias("outcome"))
    sealed = seal(e)
    return sealed.withColumn("chain_hash", F.when(F.col("sequence") == 777, F.unhex(F.lit("ff" * 32))).otherwise(F.col("chain_hash"))).where("sequence <> 1500")


@query(
    "l10_verify_chain",
    """WITH f AS (SELECT event_id AS sequence, 'log-' || event_id // 1000 AS file FROM events WHERE event_id <> 1500), p AS (SELECT *, lag(sequence) OVER (PARTITION BY file ORDER BY sequence) AS prev FROM f)
    SELECT file, sequence, CASE WHEN prev IS NOT NULL AND sequence <> prev + 1 THEN 'gap' ELSE 'hash' END AS problem FROM p WHERE (prev IS NOT NULL AND sequence <> prev + 1) OR sequence IN (777, 778)""",
)
def l10(spark, sf):
    return verify_chain(_audit(spark, sf)).where("problem is not null").select("file", "sequence", "problem")


@query("l11_verify_files", "SELECT DISTINCT 'log-' || lpad((event_id // 1000)::VARCHAR, 9, '0') AS file, event_id // 1000 <> 3 AS linked FROM events")
def l11(spark, sf):
    a = _audit(spark, sf).withColumn("file", F.concat(F.lit("log-"), F.lpad(F.floor(F.col("sequence") / 1000).cast("string"), 9, "0")))
    heads = a.groupBy("file").agg(F.max_by("chain_hash", "sequence").alias("head_hash"))
    heads = _with_previous(heads).withColumn("previous_hash", F.when(F.col("file") == "log-000000003", F.unhex(F.lit("00"))).otherwise(F.col("_before"))).drop("_before")
    return verify_files(heads).select("file", "linked")


@query("l12_audit_counts", "SELECT CASE user_id % 10 WHEN 0 THEN 'denied' WHEN 1 THEN 'failed' ELSE 'allowed' END AS outcome, count(*) AS n FROM events WHERE event_id <> 1500 GROUP BY 1")
def l12(spark, sf):
    return audit_counts(_audit(spark, sf))


@query("l12_audit_tail", "SELECT event_id AS sequence FROM events WHERE event_id <> 1500 ORDER BY 1 DESC LIMIT 20")
def l12t(spark, sf):
    return audit_tail(_audit(spark, sf), 20).select("sequence")
