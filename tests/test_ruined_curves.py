"""Curves whose NAV passes 0: the given curves go on, a curve by the reference's rule ends there."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tickspark import registry
from tickspark.operators import performance as P

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def falling(spark, tmp_path_factory):
    """Orders whose totals take every curve below 0 and back, as those of large tables do."""
    folder = tmp_path_factory.mktemp("falling")
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT i AS o_orderkey, i % 7 AS o_custkey, 'O' AS o_orderstatus, 255000 + 4e8 * (CASE WHEN i // 2 % 9 < 5 THEN -1 ELSE 1 END) * (1 + (i * 37 % 11) / 50.0) AS o_totalprice,
        TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * (i // 2) AS o_orderdate, CASE i % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(160) t(i)) TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    con.execute("SET timezone = 'UTC'")
    return str(folder), con


def same(spark, falling, name):
    folder, con = falling
    df = QUERIES[name](spark, folder)
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(x[c]) for c in columns) for x in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(show(x[i]) for i in at) for x in want.fetchall())


SHARE = "a7_nav_returns a19_benchmark_compare a21_risk_metrics_simple a22_performance_summary a24_summarize a25_interval a27_mc_standard_error m3_t_test m5_ks_1 m7_jarque_bera m11_garch_filter z5_scalar_risk"


@pytest.mark.parametrize("name", SHARE.split())
def test_queries_on_curves_below_zero(spark, falling, name):
    assert falling[1].sql(ORACLES["a7_nav_returns"]).fetchall() and P.nav_returns(P.nav(spark, falling[0])).count() < P.curve_returns(spark, falling[0]).count()
    same(spark, falling, name)


def test_returns_after_zero_are_those_of_ieee_numbers(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([2.0, 0.0, 0.0, -3.0, 6.0])], "curve_id string, ts_ns long, nav double")
    ret = [x["ret"] for x in P.nav_returns(df, ends=False).orderBy("ts_ns").collect()]
    assert ret[0] == -1.0 and math.isnan(ret[1]) and ret[2] == -math.inf and ret[3] == -3.0
    log = [x["ret"] for x in P.nav_returns(df, "log", ends=False).orderBy("ts_ns").collect()]
    assert log[0] == -math.inf and all(math.isnan(x) for x in (log[1], log[3]))
    assert [x["ret"] for x in P.nav_returns(df.where(F.col("ts_ns") < 1)).collect()] == []


@pytest.mark.parametrize("name", ["a9_return_stats", "a10_metrics", "o5_objectives"])
def test_total_return_beyond_a_total_loss_is_not_a_number(spark, falling, name):
    same(spark, falling, name)


def test_paths_beyond_a_total_loss_are_not_numbers(spark, falling):
    same(spark, falling, "a28_compound")
