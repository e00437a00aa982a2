import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import hard_negatives as H


def brute(rows, every=100, positives=5, negatives=10):
    """rows: (vec_id, vector, label); the rules of op12."""
    ok = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for x, (i, a, label) in enumerate(ok):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b, strict=True)), j, other == label) for y, (j, b, other) in enumerate(ok) if y != x and len(b) == len(a)]
        best = sorted((s, j) for s, j, same in scored if same)[:positives]
        for ps, j in best:
            fit = sorted((s, k) for s, k, same in scored if not same and 30 * -ps <= 100 * -s <= 90 * -ps)[:negatives]
            out += [(i, j, n + 1, k, -ps, -s) for n, (s, k) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"piece": F.lit(1), "uid": F.lit("u"), "q": F.lit(3), "width": F.lit(2), "w": F.lit(0), "block": F.lit(7)})


def mined(spark, rows, every=100):
    ready = H.usable(frame(spark, rows))
    moved = ready.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in H.hard_negatives(moved, F.col("vec_id") % every == 0).collect())


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    return [(i, (base[i % 6] + rng.normal(size=dims) * 0.3).tolist(), i % 4) for i in range(n)]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = clustered(900, 12)
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(200)]  # a common vector
    rows += [(300, rows[300][1], 0), (100, [5.0, 1.0], 1), (101, [4.0, 1.0], 1), (102, [3.0, 1.0], 2), (200, [], 1), (201, [], 2)]
    rows += [(2000, None, 1), (2100, [float("nan")] * 12, 1), (2200, [1.0] * 11 + [None], 1), (2300, [float("inf")] * 12, 0), (2400, [1.0] * 12, None), (None, [1.0] * 12, 1), (2500, [0.0] * 12, 3)]
    assert mined(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
    rows = [(0, [1.0], 0), (1, [0.5], 1), (2, [0.9], 1), (3, [0.3], 1)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(1, 1 << 20, 4) * 4.0).tolist(), i % 3) for i in range(60)]
    assert mined(spark, rows, every=20) == brute(rows, every=20)


@pytest.mark.parametrize("dims", [1, 3])
def test_hilbert_steps(dims):
    side = np.stack(np.meshgrid(*[np.arange(8)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = H.hilbert(side, 3)
    assert sorted(place) == list(range(8**dims))
    assert (np.abs(np.diff(side[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, q = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (300, 6))
    lo, hi = H.bounds(a, q.min(axis=0)[None], q.max(axis=0)[None])
    scores = H.products(a, q)
    assert (lo <= scores).all() and (scores <= hi).all()


def test_blocks_out_of_bounds_are_not_read(spark, monkeypatch):
    """Two far groups: no anchor of one multiplies the other's blocks."""
    rng = np.random.default_rng(6)
    q = np.concatenate([rng.integers(90, 110, (64, 4)), rng.integers(-110, -90, (64, 4))])
    piece = H._Piece(q, np.arange(128), np.arange(128) % 2, np.arange(128), np.repeat(np.arange(8), 16))
    read = []
    real = H.products
    monkeypatch.setattr(H, "products", lambda a, b: read.append(len(b)) or real(a, b))
    got = list(piece.search(q[:1], np.array([0]), np.array([0]), np.array([0]), np.array([1]), np.array([H.LONG_MAX]), True, 5))
    assert len(got[0][1]) == 5 and sum(read) <= 64


def test_index_is_read_by_piece(spark, tmp_path):
    index = H.build_index(H.usable(frame(spark, clustered(300, 4))), str(tmp_path / "index"), piece_rows=50)
    pieces = [r[0] for r in index.select("piece").distinct().collect()]
    assert len(pieces) > 3 and index.count() == 300
    plan = index.where(F.col("piece").isin(pieces[:1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "piece" in plan.split("PartitionFilters: [")[1].split("]")[0]
