"""Filter elements: any grouping of the rows gives what the filter gives row by row."""

import numpy as np
import pandas as pd
import pytest

from tickspark.functions import filtering
from tickspark.functions import kernels as K

RNG = np.random.default_rng(5)


def cuts(n, k):
    return np.sort(RNG.choice(np.arange(n + 1), k))


@pytest.mark.parametrize("q_a, q_b, r, p0", [(1e-7, 1e-7, 1e-3, 1.0), (1e-3, 0.0, 10.0, 100.0), (0.0, 0.0, 1.0, 1.0)])
def test_hedge_elements(q_a, q_b, r, p0):
    n = 900
    x = 5 + np.cumsum(RNG.normal(size=n)) / 10
    y = 0.3 + 1.7 * x + RNG.normal(size=n) / 20
    y[[3, 500, 501]], x[700] = np.nan, np.inf
    y[200:260] = np.nan  # a stretch may hold nothing but such rows
    rows = pd.DataFrame({"y": y, "x": x})
    carry = filtering.hedge_carry("y", "x", q_a, q_b, r, p0)
    for edges in (np.array([0, n]), np.array([0, 205, 250, n]), np.array([0, *cuts(n, 20), n])):
        state = plain = None
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            summary = None
            for a in range(i, j, 37):  # batches of a stretch
                summary = carry.fold(summary, rows[a : min(a + 37, j)])
            if summary is not None:
                state = carry.apply(state, summary)
            plain = K.kalman_hedge(plain, y[i:j], x[i:j], q_a, q_b, r, p0)[0]
            if state is not None:
                assert np.allclose(state, plain, rtol=1e-8, atol=1e-11), (i, j)
    assert len(summary) == len(carry.summary.split(","))


@pytest.mark.parametrize("warmup", [0, 1, 2, 3, 40, 64, 5_000])
def test_level_elements(warmup):
    n = 700
    x = 100 * np.exp(np.cumsum(RNG.normal(size=n)) / 100)
    x[[7, 30, 31, 300]] = [np.nan, -1.0, 0.0, np.inf]
    x[400:450] = np.nan
    nth = np.cumsum(np.isfinite(x))
    rows = pd.DataFrame({"v": x, "nth": nth})
    carry = filtering.level_carry("v", "nth", 0.01, warmup)
    for edges in (np.array([0, n]), np.array([0, 1, 2, 3, 41, 63, 64, 65, 405, 440, n]), np.array([0, *cuts(n, 25), n])):
        state = plain = None
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            summary = None
            for a in range(i, j, 13):
                summary = carry.fold(summary, rows[a : min(a + 13, j)])
            if summary is not None:
                state = carry.apply(state, summary)
            plain = K.kalman_level(plain, x[i:j], 0.01, warmup)[0]
            if state is not None:
                assert np.allclose(state, plain, rtol=1e-9, atol=1e-12), (i, j, state, plain)
    assert len(summary) == len(carry.summary.split(","))


def test_a_constant_series_has_the_least_noise():
    rows = pd.DataFrame({"v": np.full(50, 3.0), "nth": np.arange(1, 51)})
    carry = filtering.level_carry("v", "nth", 0.01, 10)
    state = carry.apply(carry.apply(None, carry.fold(None, rows[:17])), carry.fold(None, rows[17:]))
    plain = K.kalman_level(None, rows["v"].to_numpy(), 0.01, 10)[0]
    assert np.allclose(state, plain, rtol=1e-9) and state[3] == 1e-12


def test_missing_values_are_no_steps():
    _, level = K.kalman_level(None, np.array([np.nan, 4.0, np.nan, 6.0]))
    assert np.isnan(level[0]) and list(level[1:]) == [4.0, 4.0, 5.0]
    state, a, b, e = K.kalman_hedge(None, np.array([np.nan, 1.0, 2.0]), np.array([1.0, 1.0, np.nan]))
    assert a[0] == b[0] == 0 and np.isnan(e[[0, 2]]).all() and a[1] == a[2] == state[0]
