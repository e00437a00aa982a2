"""Kalman filters whose stretches compose: what a run of rows does to any state before it.

A run of rows is an element (A, b, C, eta, J): given the state x before it, the state after it has the mean A x + b and
the covariance C, and the rows tell of x as much as the information vector eta and matrix J do. Two elements in a row
give one, in any grouping, so a stretch is summed up without the state that it starts from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .stretches import Carry

Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def elements(y: np.ndarray, h: np.ndarray, q: np.ndarray, r: float) -> Element:
    """One element per row of a random walk with variances ``q`` (d of them), seen as y = h x + noise of variance ``r``."""
    d = len(q)
    s = (h * h * q).sum(axis=1) + r
    gain = h * q / s[:, None]
    rest = np.eye(d) - gain[:, :, None] * h[:, None, :]
    return rest, gain * y[:, None], rest * q, h * (y / s)[:, None], h[:, :, None] * h[:, None, :] / s[:, None, None]


def combined(one: Element, two: Element) -> Element:
    """The elements of ``one`` each followed by that of ``two``."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = one, two
    mid = np.linalg.inv(np.eye(a1.shape[-1]) + c1 @ j2)
    on, back = a2 @ mid, np.swapaxes(a1, 1, 2) @ np.swapaxes(mid, 1, 2)
    times = lambda m, v: (m @ v[:, :, None])[:, :, 0]
    cov = on @ c1 @ np.swapaxes(a2, 1, 2) + c2
    info = back @ j2 @ a1 + j1
    even = lambda m: (m + np.swapaxes(m, 1, 2)) / 2
    return on @ a1, times(on, b1 + times(c1, e2)) + b2, even(cov), times(back, e2 - times(j2, b1)) + e1, even(info)


def composed(rows: Element) -> Element:
    """All rows in one element, by pairs of neighbours, then pairs of those."""
    while len(rows[0]) > 1:
        n = len(rows[0]) // 2 * 2
        met = combined(tuple(x[:n:2] for x in rows), tuple(x[1:n:2] for x in rows))
        rows = tuple(np.concatenate((m, x[n:])) for m, x in zip(met, rows, strict=True))
    return rows


def moved(mean: np.ndarray, cov: np.ndarray, element: Element) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance after the rows of an element."""
    a, b, c, e, j = (x[0] for x in element)
    on = a @ np.linalg.inv(np.eye(len(mean)) + cov @ j)
    return on @ (mean + cov @ e) + b, on @ cov @ a.T + c


def flat(element: Element) -> tuple:
    return tuple(float(v) for x in element for v in x.ravel())


def unflat(numbers: tuple, d: int) -> Element:
    x, sizes = np.array(numbers, float), (d * d, d, d * d, d, d * d)
    parts = np.split(x, np.cumsum(sizes)[:-1])
    return tuple(p.reshape((1, d, d) if n == d * d and k % 2 == 0 else (1, d)) for k, (p, n) in enumerate(zip(parts, sizes, strict=True)))


def _joined(held: tuple | None, new: Element, d: int) -> tuple:
    return flat(combined(unflat(held, d), new) if held else new)


def _fields(d: int) -> str:
    return ", ".join(f"k{i} double" for i in range(3 * d * d + 2 * d))


def identity(d: int) -> tuple:
    """The element of no rows."""
    one, none, zero = np.eye(d), np.zeros((d, d)), np.zeros(d)
    return flat((one, zero, none, zero, none))


def hedge_carry(y: str, x: str, q_a: float = 1e-7, q_b: float = 1e-7, r: float = 1e-3, p0: float = 1.0) -> Carry:
    """``kernels.kalman_hedge`` over stretches; rows without finite values are no steps."""
    q = np.array([q_a, q_b])

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple:
        u, v = rows[y].to_numpy(float), rows[x].to_numpy(float)
        known = np.isfinite(u) & np.isfinite(v)
        if not known.any():
            return held or identity(2)
        u, v = u[known], v[known]
        return _joined(held, composed(elements(u, np.column_stack((np.ones(len(v)), v)), q, r)), 2)

    def apply(state: tuple | None, summary: tuple) -> tuple:
        a, b, p00, p01, p11 = state or (0.0, 0.0, p0, 0.0, p0)
        mean, cov = moved(np.array([a, b]), np.array([[p00, p01], [p01, p11]]), unflat(summary, 2))
        return float(mean[0]), float(mean[1]), float(cov[0, 0]), float((cov[0, 1] + cov[1, 0]) / 2), float(cov[1, 1])

    return Carry(_fields(2), "a double, b double, p00 double, p01 double, p11 double", fold, apply)


def level_carry(col: str, number: str, snr: float = 0.01, warmup: int = 1024) -> Carry:
    """``kernels.kalman_level`` where ``number`` counts the finite values of the key so far.

    Before the warm-up ends the level is affine in the level before and the log returns add up; after it the filter is
    taken in units of its noise, which no stretch but the first ones knows: its variance is then 1 and ``snr``.
    A stretch is (values, first, last, number, mean and squares of its log returns, the affine map, filtered values, element).
    """
    end = max(warmup, 2)

    def added(m: float, mean: float, sq: float, m2: float, mean2: float, sq2: float) -> tuple[float, float, float]:
        n = m + m2
        if not n:
            return 0, 0.0, 0.0
        gap = mean2 - mean
        return n, mean + gap * m2 / n, sq + sq2 + gap * gap * m * m2 / n

    def fold(held: tuple | None, rows: pd.DataFrame) -> tuple:
        n, first, last, m, mean, sq, h, c, k, *element = held or (0, 0.0, 0.0, 0, 0.0, 0.0, 1.0, 0.0, 0, *identity(1))
        x, at = rows[col].to_numpy(float), rows[number].to_numpy()
        known = np.isfinite(x)
        x, at = x[known], at[known]
        if not len(x):
            return n, first, last, m, mean, sq, h, c, k, *element
        first, before = (first, last) if n else (float(x[0]), 0.0)
        early = int(np.searchsorted(at, end, side="right"))
        for i, v in zip(at[:early], x[:early], strict=True):
            if before > 0 and v > 0:
                m, mean, sq = added(m, mean, sq, 1, float(np.log(v / before)), 0.0)
            if i == 1:
                h, c = 0.0, float(v)
            elif i < end:
                h, c = 0.5 * h, 0.5 * c + 0.5 * float(v)
            before = v
        late = x[int(np.searchsorted(at, end, side="left")) :]
        if len(late):
            element = _joined(tuple(element) if k else None, composed(elements(late, np.ones((len(late), 1)), np.array([snr]), 1.0)), 1)
        return n + len(x), first, float(x[-1]), m, mean, sq, h, c, k + len(late), *element

    def apply(state: tuple | None, summary: tuple) -> tuple:
        n, level, p, noise, last, m, mean, sq = state or (0, 0.0, 1.0, 0.0, 0.0, 0, 0.0, 0.0)
        rows, first, final, m2, mean2, sq2, h, c, k, *element = summary
        if not rows:
            return n, level, p, noise, last, m, mean, sq
        if noise == 0.0:
            if n and last > 0 and first > 0:
                m, mean, sq = added(m, mean, sq, 1, float(np.log(first / last)), 0.0)
            m, mean, sq = added(m, mean, sq, m2, mean2, sq2)
        level = h * level + c
        if k:
            noise = noise or max(sq / (m - 1) if m > 1 else 0.0, 1e-12)
            at, var = moved(np.array([level]), np.array([[p / noise]]), unflat(tuple(element), 1))
            level, p = float(at[0]), float(var[0, 0]) * noise
        return int(n + rows), level, p, noise, final, int(m), mean, sq

    return Carry(
        "n long, first double, last double, m long, mean double, sq double, h double, c double, k long, " + _fields(1).replace("k", "e"),
        "n long, level double, p double, noise double, last double, m long, mean double, sq double",
        fold,
        apply,
    )
