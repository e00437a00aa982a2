import numpy as np
import pytest

from tickspark.llm.embedding_dedup import _merge, compare, compare_small, embedding_dedup


def brute(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.asarray(v, float)
            ok[i] = (label, u / np.linalg.norm(u))
    links = {i: set() for i, _, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold:
                links[a].add(b)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def sample(n=400, dims=32, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = base[i % 12] + rng.normal(size=dims) * (0.1 if i % 2 else 2.0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(n + k, rows[0][1], 0) for k in range(150)]
    rows += [(n + 200, None, 0), (n + 201, [0.0] * dims, 0), (n + 202, [float("nan")] + [1.0] * (dims - 1), 0), (n + 203, rows[0][1], None), (n + 204, [1.0, 2.0], 0), (n + 205, [1.0, 2.0], 0), (n + 206, [x * 3 for x in rows[0][1]], 0)]
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({"rep": F.lit(1), "v": F.lit("x"), "pivot": F.lit(2), "n": F.lit(3), "copies": F.lit(1)})


def test_recall_and_exact_links(spark):
    rows = sample()
    rows = [(i, None if v is None else [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = {r[0]: tuple(r) for r in embedding_dedup(frame(spark, rows)).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert got.keys() == want.keys()
    assert all(got[i][1] <= want[i][1] for i in got), "no link below the threshold"
    assert sum(g[1] for g in got.values()) >= 0.97 * sum(w[1] for w in want.values())
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(want)


def test_empty_and_unusable(spark):
    assert embedding_dedup(frame(spark, [])).count() == 0
    got = embedding_dedup(frame(spark, [(1, None, 0), (2, [1.0], None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("n", [1, 2])
def test_tiny(spark, n):
    rows = [(i, [1.0, 0.0], 5) for i in range(n)]
    assert sorted(map(tuple, embedding_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for width in range(2, 90):
        v = [float(np.float32(x)) for x in rng.normal(size=width)]
        rows += [(2 * width, v, 1), (2 * width + 1, [float(np.float32(x * 2)) for x in v], 1)]
    assert sorted(map(tuple, embedding_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (3, None, 0), (3, None, 0)]
    got = sorted(map(tuple, embedding_dedup(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True), (3, 0, 3, True)], key=repr)


def test_pivot_lists_against_all_pairs(spark):
    """More than WHOLE vectors: the lists retrieve, the counts select, and nearly every link is found."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(2400):
        v = base[i % 40] + rng.normal(size=24) * (0.35 if i % 3 else 3.0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 5 else 0))
    got = {r[0]: tuple(r) for r in embedding_dedup(frame(spark, rows)).collect()}
    want = {r[0]: r for r in brute(rows)}
    total = sum(w[1] for w in want.values())
    assert total > 1000 and all(got[i][1] <= want[i][1] for i in got)
    assert sum(g[1] for g in got.values()) >= 0.95 * total


def test_counts_retrieve_before_cosines():
    """Equal vectors that share too few pivots, or meet in an earlier list, are not compared in this one."""
    rep, copies, v = np.array([7, 8]), np.array([1, 1]), np.ones((2, 3))
    both, key = np.arange(2), (4 << 32) | 6
    run = lambda a, b: compare(key, rep, copies, v, np.array([a, b], np.int32), both, both, True, 0.9, need=3, keyed=3)
    few = lambda a, b: compare_small(np.array([key, key]), np.array([2, 2]), rep, copies, v, np.array([a, b], np.int32), 0.9, need=3, keyed=3)
    for a, b in (([4, 6, 9, 1], [6, 4, 9, 2]), ([4, 6, 9, 1], [6, 4, 8, 2]), ([4, 6, 5, 1], [6, 4, 5, 2])):
        assert (few(a, b) is None) == (run(a, b) is None)
    assert run([4, 6, 9, 1], [6, 4, 9, 2]) is not None
    assert run([4, 6, 9, 1], [6, 4, 8, 2]) is None, "two shared pivots"
    assert run([4, 6, 5, 1], [6, 4, 5, 2]) is None, "the list of 4 and 5 comes first"


def test_merge_against_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        root = _merge(np.arange(60), x, y)
        part = list(range(60))
        for a, b in zip(x, y):
            p, q = part[a], part[b]
            part = [min(p, q) if k in (p, q) else k for k in part]
        assert list(root) == part
