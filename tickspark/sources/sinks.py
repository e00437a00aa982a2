"""CSV and JSON sinks and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.plans.catalog import FILL_ORDER, HOUR, fills, nav, query, r, scratch, ticks

BAR_COLUMNS = ("symbol", "open_ts", "close_ts", "open", "high", "low", "close", "volume", "n_ticks", "partial")


def finite_only(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in floats})


def export(df: DataFrame, fmt: str, path: str) -> None:
    """CSV (RFC 4180 quoting, empty cells for null) or JSON lines; other formats are rejected."""
    clean = finite_only(df)
    if fmt == "csv":
        clean.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    elif fmt == "json":
        clean.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_bars_csv(bars: DataFrame, path: str) -> None:
    """Ten columns, numbers with ten digits."""
    digits = {c: F.format_string("%.10g", F.col(c).cast("double")) for c in ("open", "high", "low", "close", "volume")}
    bars.withColumns(digits).select(*BAR_COLUMNS).write.option("header", True).csv(path)


def write_equity(df: DataFrame, path: str) -> None:
    """S14."""
    export(df, "csv", path)


write_blotter = write_equity


def report(name: str, **tables: DataFrame) -> DataFrame:
    """A named report as a table; performance, risk and summary are (curve_id, metric, value)."""
    from tickspark.operators import performance as P
    from tickspark.operators import risk as R
    from tickspark.operators.telemetry import audit_tail

    long = lambda d: d.unpivot(["curve_id"], [F.col(c).cast("double").alias(c) for c in d.columns if c != "curve_id"], "metric", "value")
    if name == "performance":
        return long(P.metrics(P.nav_returns(tables["nav"]), tables["nav"]))
    if name == "drawdowns":
        return P.worst(P.drawdown_episodes(tables["nav"]), 10, "depth", "curve_id")
    if name == "risk":
        rets = P.nav_returns(tables["nav"])
        return long(R.var_parametric(rets, ["curve_id"], 0.95).select("curve_id", "var", "es"))
    if name == "attribution":
        return P.attribution(tables["fills"], "symbol")
    if name == "positions":
        return P.last_positions(tables["fills"])
    if name == "fills":
        return tables["fills"]
    if name == "audit":
        return audit_tail(tables["audit"], 100)
    if name == "summary":
        last = tables["nav"].groupBy("curve_id").agg(F.min_by("nav", "ts_ns").alias("start"), F.max_by("nav", "ts_ns").alias("end"), F.count("*").alias("points"))
        return long(last)
    raise ValueError(f"unknown report {name!r}")


@query("s13_bars_csv", f"SELECT symbol, ts_ns - ts_ns % {24 * HOUR} AS open_ts, R4(arg_max(price, (ts_ns, seq))) AS close, count(*)::INT AS n_ticks FROM v_ticks WHERE price > 0 AND size > 0 GROUP BY 1, 2", "v_ticks")
def s13(spark, sf):
    from tickspark.operators.bars import build_bars, finalize_bars, sane

    path = scratch(spark)
    write_bars_csv(finalize_bars(build_bars(sane(ticks(spark, sf)), 24 * HOUR), True), path)
    back = spark.read.option("header", True).schema("symbol string, open_ts long, close_ts long, open double, high double, low double, close double, volume double, n_ticks int, partial boolean").csv(path)
    return back.select("symbol", "open_ts", r("close", 4), "n_ticks")


@query("s14_blotter_csv", "SELECT ts_ns, k1, k2, k3, k4, account || ', \"' || symbol || '\"' AS note, quantity FROM v_fills", "v_fills")
def s14(spark, sf):
    path = scratch(spark)
    write_blotter(fills(spark, sf).select(*FILL_ORDER, F.concat("account", F.lit(', "'), "symbol", F.lit('"')).alias("note"), "quantity"), path)
    return spark.read.option("header", True).option("escape", '"').schema("ts_ns long, k1 long, k2 int, k3 long, k4 long, note string, quantity double").csv(path)


@query("s15_export", "SELECT seq, CASE WHEN seq % 10 <> 0 THEN price END AS price FROM v_ticks", "v_ticks")
def s15(spark, sf):
    path = scratch(spark)
    t = ticks(spark, sf)
    export(t.select("seq", F.when(F.col("seq") % 10 == 0, float("nan")).otherwise(F.col("price")).alias("price")), "json", path)
    return spark.read.schema("seq long, price double").json(path)


@query("s16_report_summary", "WITH s AS (SELECT curve_id, arg_min(nav, ts_ns) AS a, arg_max(nav, ts_ns) AS z, count(*)::DOUBLE AS n FROM v_nav GROUP BY 1) SELECT curve_id, 'start' AS metric, R2(a) AS value FROM s UNION ALL SELECT curve_id, 'end', R2(z) FROM s UNION ALL SELECT curve_id, 'points', R2(n) FROM s", "v_nav")
def s16(spark, sf):
    return report("summary", nav=nav(spark, sf)).select("curve_id", "metric", r("value", 2))
