"""Corporate actions by composed timelines against a fold over the whole list, tick by tick."""

import math

import numpy as np
import pytest

from tickspark.operators import quality

ACTION = "ord long, kind string, symbol string, effective_at long, ratio double, to string, children array<struct<symbol:string,ratio:double>>, until_ns long"
TICK = "symbol string, ts_ns long, seq long, price double, size double, note string"


def plain(tick, actions):
    symbol, ts, seq, price, size, note = tick
    for _, kind, who, at, ratio, to, children, until in sorted(actions, key=lambda a: a[0]):
        if at is None or ts is None or ts < at or (who is not None and who != symbol):
            continue
        if kind == "split":
            price, size = (None if price is None else price / ratio), size * ratio
        elif kind == "rename":
            symbol = to
        elif kind == "halt" and until is not None and ts < until:
            return []
        elif kind == "fork":
            return [(c, ts, seq, price, size * r, note) for c, r in children]
    return [(symbol, ts, seq, price, size, note)]


def same(spark, ticks, actions):
    out = quality.apply_actions(spark.createDataFrame(ticks, TICK), spark.createDataFrame(actions, ACTION))
    assert out.columns == [c.split()[0] for c in TICK.split(", ")]
    key = lambda t: (t[2], str(t[0]))
    got, want = sorted(map(tuple, out.collect()), key=key), sorted((x for t in ticks for x in plain(t, actions)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or math.isclose(a, b, rel_tol=1e-12), (g, w)


def some_ticks(n, symbols, seed):
    rng = np.random.default_rng(seed)
    return [(symbols[int(rng.integers(len(symbols)))], int(rng.integers(0, 1_000)), i, None if i % 50 == 3 else float(rng.integers(1, 900)), float(rng.integers(1, 9)), f"n{i}") for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_random_actions(spark, seed):
    rng = np.random.default_rng(seed)
    symbols = ["a", "b", "c", "d", "e", None]
    actions = []
    for i in range(24):
        kind = str(rng.choice(["split", "split", "rename", "halt", "dividend"] + ["fork"] * (i > 15)))
        who = symbols[int(rng.integers(6))] if kind in ("split", "halt", "rename") else symbols[int(rng.integers(5))]
        at = None if i == 5 else int(rng.integers(0, 1_000))
        until = None if kind != "halt" or i % 7 == 0 else at and at + int(rng.integers(-20, 60))
        to = str(rng.choice(["a", "b", "c", "f"])) if kind == "rename" else None
        actions.append((i, kind, who, at, float(rng.integers(2, 5)), to, [("x", 1.0), ("y", 0.5)] if kind == "fork" else None, until))
    order = rng.permutation(24)
    same(spark, some_ticks(600, [*symbols, "f", "z"], seed), [actions[i] for i in order])


def test_chains_of_renames(spark):
    """a becomes b, b becomes c, and so on round to a; each has a split of its own; a tick sees them in listed order."""
    names = list("abcdef")
    actions = [(2 * i, "rename", s, 100 * i, None, names[(i + 1) % 6], None, None) for i, s in enumerate(names)]
    actions += [(2 * i + 1, "split", s, 90 * i, float(i + 2), None, None, None) for i, s in enumerate(names)]
    same(spark, some_ticks(400, [*names, "z"], 9), actions)


def test_edges_and_empty_tables(spark):
    ticks = [("a", t, t, 6.0, 2.0, None) for t in (9, 10, 11, 19, 20, 21)] + [("a", None, 30, 6.0, 2.0, "x"), (None, 15, 31, 6.0, 2.0, "y")]
    same(spark, ticks, [(1, "split", "a", 10, 2.0, None, None, None), (2, "halt", None, 11, None, None, None, 20), (3, "fork", "a", 21, None, None, [], None)])
    same(spark, ticks, [])
    same(spark, [], [(1, "split", "a", 10, 2.0, None, None, None)])


def test_a_list_holds_one_symbols_actions(spark):
    rng = np.random.default_rng(1)
    actions = [(i, "split", f"s{i % 500}", int(rng.integers(0, 1_000)), 1.0 + i % 3, None, None, None) for i in range(10_000)]
    actions += [(20_000, "halt", None, 500, None, None, None, 510)]
    lines = quality.action_timelines(spark.createDataFrame(actions, ACTION))
    sizes = lines.selectExpr("origin", "size(points) AS n", "size(outcomes) AS m").collect()
    assert len(sizes) == 501 and all(r["n"] == r["m"] <= 22 for r in sizes)
    ticks = some_ticks(300, [f"s{i}" for i in range(0, 520, 13)], 2)
    own = {}
    for a in actions:
        own.setdefault(a[2], []).append(a)
    out = quality.apply_actions(spark.createDataFrame(ticks, TICK), spark.createDataFrame(actions, ACTION)).collect()
    want = {x[2]: x for t in ticks for x in plain(t, own.get(t[0], []) + own[None])}
    assert len(out) == len(want)
    assert all(r["price"] is None and want[r["seq"]][3] is None or math.isclose(r["price"], want[r["seq"]][3], rel_tol=1e-9) for r in out)
