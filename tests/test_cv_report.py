"""O12 keeps the keys whose scores all failed."""

import duckdb

from tickspark import registry
from tickspark.operators import validation


def test_keys_without_a_finite_score_stay(spark):
    scores = [("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", None), ("b", float("inf")), (None, float("nan")), (None, 5.0)]
    got = {x["k"]: x for x in validation.cv_report(spark.createDataFrame(scores, "k string, score double"), ["k"]).collect()}
    assert {k: (x["n"], x["mean"], x["failed"]) for k, x in got.items()} == {"a": (2, 2.0, 1), "b": (0, None, 2), None: (1, 5.0, 1)}


def test_query_on_days_of_many_orders_equals_its_sql(spark, tmp_path):
    """Every third day and more has over five orders: no score is left in some groups."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(
        f"""COPY (SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, 1000.0 + i AS o_totalprice, TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * d AS o_orderdate, '5-LOW' AS o_orderpriority
        FROM (SELECT d, row_number() OVER () AS i FROM range(12) t(d), range(8) u(k) WHERE k < CASE WHEN d % 3 = 1 THEN 2 + d % 2 ELSE 7 END)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(registry.oracle_sql()["o12_cv_report"]).fetchall()
    got = [(x["g"], x["n"], x["mean"], x["failed"]) for x in registry.queries()["o12_cv_report"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 and sorted(got, key=str) == sorted(want, key=str)
