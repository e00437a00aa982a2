"""X1 against its SQL on books with an empty side and keys that occur more than once."""

import duckdb
import pytest

from tickspark import registry

#: l_partkey, l_linestatus (F: bid, O: ask), l_quantity, l_extendedprice
BOTH = [(8, "F", 5.0, 500.0), (8, "O", 30.0, 900.0), (8, "O", 30.0, 900.0), (8, "O", 40.0, 800.0), (9, "F", 50.0, 5000.0), (9, "F", 70.0, 7700.0), (9, "O", 1.0, 10.0)]
ONE_SIDED = [(2, "F", 5.0, 100.0), (3, "O", 5.0, 100.0), (1, "F", 5.0, 100.0), (4, "O", 70.0, 100.0)]


@pytest.mark.parametrize("keys, levels", [((8, 9), BOTH), ((1, 2, 3, 4, 8, 9), BOTH + ONE_SIDED), ((8, 8, 8, 9, 9), BOTH)], ids=["plain", "one-sided", "repeated"])
def test_book_impact_query_equals_its_sql(spark, tmp_path, keys, levels):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    lines = ", ".join(f"({i}::BIGINT, {k}::BIGINT, 1::BIGINT, {i}::INT, {q}::DOUBLE, {p}::DOUBLE, '{s}')" for i, (k, s, q, p) in enumerate(levels))
    con.execute(f"COPY (SELECT * FROM (VALUES {lines}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT unnest({list(keys)})::BIGINT AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    ran = con.execute(registry.oracle_sql()["x1_book_impact"])
    columns, want = [x[0] for x in ran.description], ran.fetchall()
    df = registry.queries()["x1_book_impact"](spark, str(tmp_path))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(str(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(map(str, x)) for x in want)
    assert {x[columns.index("book")] for x in want} == set(keys) - {2, 3}
