"""A key's rows of a trigger go through the step in chunks, in order, with the same result."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickspark.streaming import streams


def test_chunks_are_in_order_and_bounded():
    rng = np.random.default_rng(3)
    n = 1000
    rows = pd.DataFrame({"symbol": "a", "ts_ns": rng.integers(0, 40, n), "seq": rng.permutation(n), "name": [None if i % 7 == 0 else f"x{i % 5}" for i in range(n)], "flag": rng.random(n) < 0.5, "v": rng.random(n)})
    parts = [rows.iloc[i : i + 130].reset_index(drop=True) for i in range(0, n, 130)]
    parts[2]["name"] = None
    whole = pd.concat(parts, ignore_index=True).sort_values(["ts_ns", "seq"], kind="stable").reset_index(drop=True)
    made = list(streams._in_order(iter(parts), {"symbol": "a"}, ["ts_ns", "seq"], 64))
    assert max(map(len, made)) == 64 and len(made) == 16
    got = pd.concat(made, ignore_index=True).astype({"name": object})
    pd.testing.assert_frame_equal(got.where(got.notna(), None), whole.where(whole.notna(), None))


def test_steps_get_chunks_and_keep_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", 50)
    folder = str(tmp_path / "rows")
    spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), ((F.col("id") * 37) % 1000).alias("seq"), F.col("id").alias("ts_ns")).repartition(1).write.parquet(folder)

    def step(state, rows):
        n = (state[0] if state else 0) + np.arange(1, len(rows) + 1)
        return (int(n[-1]),), rows.assign(n=n, size=len(rows))

    rows = spark.readStream.schema("k string, seq long, ts_ns long").parquet(folder)
    got = streams.drain(streams.stateful(rows, ["k"], "k string, seq long, n long, size long", "n long", step, ("seq",))).toPandas().sort_values(["k", "seq"])
    assert len(got) == 1000 and got["size"].max() == 50
    for _, g in got.groupby("k"):
        assert g["n"].tolist() == list(range(1, len(g) + 1))


def test_frames_are_made_and_parsed_once(spark):
    """A filter on the routed columns must not repeat the text that they come from."""
    from tickspark.sources import frames

    raw = spark.range(20).select(F.to_json(F.struct(F.col("id").alias("u"), F.lit("x").alias("s"), F.col("id").cast("string").alias("b"))).alias("raw"), F.col("id").alias("ingest_ts_ns"))
    made = frames.parse_book_ticker(raw)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("StructsToJson") == 1
    assert made.count() == 20 and {r["symbol"] for r in made.collect()} == {"x"}
