"""Order statistics of long keys by refined histograms, against sorted arrays and against the short way."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import ranks as R
from tickspark.functions import stretches as S
from tickspark.operators import performance, telemetry, windows


@pytest.fixture
def short(monkeypatch):
    """Keys of more than 500 rows are long, and at most 64 values are ranked at once."""
    monkeypatch.setattr(S, "LENGTH", 500)
    monkeypatch.setattr(R, "SMALL", 64)


def columns():
    rng = np.random.default_rng(8)
    n = 6000
    heavy = np.exp(rng.normal(0, 30, n)) * rng.choice([-1, 1], n)
    far = np.concatenate((rng.normal(0, 1e-9, n - 3), [1e300, -1e300, 5e-324]))
    return {"normal": rng.normal(0, 1, n), "heavy": heavy, "far": far, "ties": rng.integers(0, 4, n).astype(float), "same": np.full(n, 2.5), "mixed": np.concatenate((np.zeros(n // 2), 10.0 ** rng.uniform(-300, 300, n - n // 2))), "brief": rng.normal(0, 1, 90)}


def frame(spark, data):
    rows = [(k, float(x), float(x)) for k, v in data.items() for x in v] + [("normal", None, 0.0), ("brief", None, 0.0), (None, 1.0, 1.0), (None, 3.0, 3.0)]
    return spark.createDataFrame(rows, "k string, v double, ret double").repartition(5)


def test_every_rank(spark, short):
    data = columns()
    df = frame(spark, data)
    wanted = [0, 1, 17, 2999, 3000, 5998, 5999, 6000]
    targets = spark.createDataFrame([(k, r) for k in data for r in wanted], "k string, rank long")
    got = {(r["k"], r["rank"]): r["value"] for r in R.ranked_values(df, ["k"], "v", targets).collect()}
    assert got == {(k, r): np.sort(v)[r] for k, v in data.items() for r in wanted if r < len(v)}


def test_whole_numbers_keep_their_last_digit(spark, short):
    values = [(1 << 60) + 3 * i for i in range(2000)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v long")
    targets = spark.createDataFrame([("a", 1234)], "k string, rank long")
    assert R.ranked_values(df, ["k"], "v", targets).first()["value"] == values[1234]


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))


def test_percentiles_equal_the_short_way(spark, monkeypatch):
    df = frame(spark, {k: v for k, v in columns().items() if k in ("heavy", "ties", "brief")})
    ps = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    want = {r["k"]: r["_q"] for r in R.percentiles(df, ["k"], "v", ps).collect()}
    monkeypatch.setattr(R, "SMALL", 64)
    got = {r["k"]: r["_q"] for r in R.percentiles(df, ["k"], "v", ps, length=500).collect()}
    assert got.keys() == want.keys() and None in got
    assert all(close(a, b) for k in want for a, b in zip(got[k] or [None], want[k] or [None], strict=True))


@pytest.mark.parametrize(
    "name, run",
    [
        ("a24", lambda df: performance.summarize(df, ["k"], "v")),
        ("r1", lambda df: performance.historical_tail(df.where("v is not null"), ["k"], 0.95)),
        ("l3", lambda df: telemetry.pick_ranks(df.where("v is not null"), ["k"], "v", {"p50": F.ceil(F.col("_n") * 0.5) - 1})),
    ],
)
def test_operators_equal_the_short_way(spark, monkeypatch, name, run):
    df = frame(spark, {k: v for k, v in columns().items() if k in ("normal", "brief")})
    want = {r["k"]: r for r in run(df).collect()}
    monkeypatch.setattr(S, "LENGTH", 500)
    monkeypatch.setattr(R, "SMALL", 64)
    got = {r["k"]: r for r in run(df).collect()}
    assert got.keys() == want.keys() and "normal" in got
    for k in want:
        assert set(got[k].asDict()) == set(want[k].asDict())
        assert all(a == b or math.isclose(a, got[k][c], rel_tol=1e-9, abs_tol=1e-12) for c, a in want[k].asDict().items() for b in [got[k][c]]), (k, got[k], want[k])


def test_no_task_holds_a_hot_key(spark, short):
    """Rows of a hot key are counted in bins before any exchange by key; only counts of bins are dealt out."""
    df = spark.range(0, 400_000, 1, 8).select(F.concat(F.lit("k"), F.col("id") % 1).alias("k"), (F.hash("id") / 7.0).alias("v"))
    counted = R._inside(df.withColumnRenamed("v", "_v"), spark.createDataFrame([("k0", -1e18, 1e18)], "k string, lo double, hi double"), ["k"])
    bins = counted.groupBy("k", "lo", "hi", F.floor(F.col("_v") / 1e6).alias("b")).count()
    plan = bins._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan and "SortMergeJoin" not in plan.split("partial_count")[1].split("Exchange")[0]
    assert bins.agg(F.sum("count")).first()[0] == 400_000
