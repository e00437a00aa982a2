"""Curves that go below 0 over several folds, and paths drawn from them, against the SQL."""

import math

import duckdb
import numpy as np
import pytest

from tickspark import registry
from tickspark.operators import resample, validation

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def sinking(spark, tmp_path_factory):
    """Orders whose totals take one curve below 0 and back within 1,200 days, while the other stays above."""
    folder = tmp_path_factory.mktemp("sinking")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(
        f"""COPY (SELECT 2 * t + c AS o_orderkey, t % 7 AS o_custkey, 'O' AS o_orderstatus, 255000 + 1e9 * [2.0, 0.5][c + 1] * (sin(0.007 * (t + 1)) - sin(0.007 * t) + (t * 37 % 11 - 5) / 5000.0) AS o_totalprice,
        TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * t AS o_orderdate, ['1-URGENT', '2-HIGH'][c + 1] AS o_orderpriority FROM range(1200) a(t), range(2) b(c)) TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    return str(folder), con


def same(spark, sinking, name):
    folder, con = sinking
    df, ran = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    columns = [x[0] for x in ran.description]
    assert sorted(df.columns) == sorted(columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(show, x)) for x in ran.fetchall())
    assert any("nan" in x for x in want)
    assert sorted(tuple(show(x[c]) for c in columns) for x in df.collect()) == want


def test_stitched_curves_keep_folds_from_below_zero(spark, sinking):
    same(spark, sinking, "o7_stitch_nav")


def test_folds_go_on_as_ieee_numbers(spark):
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 2, -2.0), ("a", 1, 3, -4.0), ("a", 2, 4, 3.0), ("a", 2, 5, 0.0), ("a", 3, 6, 0.0), ("a", 3, 7, 5.0), ("a", 4, 8, 1.0)]
    df = spark.createDataFrame(rows, "curve_id string, fold int, ts_ns long, nav double")
    got = [x["nav"] for x in validation.stitch_nav(df, skip=False).orderBy("ts_ns").collect()]
    assert got[:6] == pytest.approx([1, 2, 2, 4, 4, 0]) and all(map(math.isnan, got[6:]))
    assert [x["ts_ns"] for x in validation.stitch_nav(df).orderBy("ts_ns").collect()] == [0, 1, 4, 5, 8]


def test_drawn_paths_beyond_a_total_loss_count_as_not_a_number(spark, sinking):
    same(spark, sinking, "v7_bootstrap_metrics")


def test_kernel_equals_the_join_beyond_a_total_loss(spark):
    """Paths that lose more than all, all, or nearly all; those that lose all keep nothing of their growth, or what is left."""
    rng = np.random.default_rng(5)
    few = {"a": [(7, -1.5)], "b": [(7, -1.0)], "c": [(7, -1 + 1e-14), (30, -1 + 1e-14)], "d": [(7, np.inf)], "e": []}
    rows = []
    for k, at in few.items():
        ret = rng.normal(0.001, 0.02, 60)
        for i, v in at:
            ret[i] = v
        rows += [(k, i, float(v)) for i, v in enumerate(ret)]
    df = spark.createDataFrame(rows, "curve_id string, i int, ret double")
    for ends in (True, False):
        kernel, joined = ({(x["curve_id"], x["run"]): x for x in resample.bootstrap_paths(df, 8, 365.0, seed=3, longest=n, ends=ends).collect()} for n in (resample.ARRAY, 10))
        assert kernel.keys() == joined.keys() and len(kernel) == 40
        assert {k[0] for k, x in kernel.items() if math.isnan(x["cagr"])} == {"a"} == {k[0] for k, x in kernel.items() if math.isnan(x["max_drawdown"])} - {"d"}
        assert any(x["cagr"] == (0.0 if ends else -1.0) for k, x in kernel.items() if k[0] == "b")
        for k, x in joined.items():
            for c in x.asDict():
                a, b = x[c], kernel[k][c]
                if k[0] != "d" and isinstance(a, float):
                    assert math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-10), (ends, k, c, a, b)


def test_compared_paths_beyond_a_total_loss_count_as_not_a_number(spark, sinking):
    same(spark, sinking, "v8_bootstrap_compare")


def test_compared_growth_after_a_total_loss(spark):
    """With ``ends`` the growth after a loss of all is 0, without it is -1; a loss of more than all is NaN on either side."""
    both = lambda v: spark.createDataFrame([("both", i, v if i == 7 else 0.001 * (i % 3), 0.001 * (i % 5 - 1)) for i in range(20)], "curve_id string, i int, a double, b double")
    growth = lambda df, **k: resample.bootstrap_compare(df, 12, 365.0, seed=3, names=("cagr",), **k).first()
    assert growth(both(-1.0), ends=False)["max"] > 0.9 > growth(both(-1.0))["max"]
    ruined = growth(both(-1.5), ends=False)
    assert ruined["n"] == 12 and math.isnan(ruined["mean"]) and math.isnan(ruined["max"]) and not math.isnan(ruined["min"])
