"""Recurrences as steps over arrays: each takes the state it left (None at the start) and gives the new one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from .stretches import Carry

State = tuple | None


def _decayed(x: np.ndarray, before: float, a: float) -> np.ndarray:
    """s = (1 - a) s + a x, started from ``before``."""
    return pd.Series(np.concatenate(([before], x))).ewm(alpha=a, adjust=False).mean().to_numpy()[1:]


def ewma(state: State, x: np.ndarray, period: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Weighted sum over weight sum, alpha = 2 / (period + 1), and the weight; state (sum, rows)."""
    a = 2 / (period + 1)
    s, n = state or (0.0, 0)
    sums = _decayed(x, s, a)
    weight = 1 - (1 - a) ** (n + np.arange(1, len(x) + 1))
    return (float(sums[-1]), int(n) + len(x)) if len(x) else (s, n), sums / weight, weight


def ewma_carry(col: str, period: int) -> Carry:
    a = 2 / (period + 1)
    fold = lambda held, rows: ewma(held, rows[col].to_numpy(), period)[0]

    def apply(state: State, summary: tuple) -> tuple:
        s, n = state or (0.0, 0)
        return (s * (1 - a) ** summary[1] + summary[0], int(n + summary[1]))

    return Carry("s double, n long", "s double, n long", fold, apply)


def ewma_var(state: State, x: np.ndarray, period: int, seed: str = "zero") -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """Corrected mean of squared deviations from the mean before; the mean before, and the variance before.

    Before the first value that mean is 0 (or the value, with seed "first") and the variance 0. State (mean's sum,
    rows, mean, variance's sum).
    """
    s, n, mean, vs = state or (0.0, 0, 0.0 if seed == "zero" or not len(x) else float(x[0]), 0.0)
    if not len(x):
        return (s, n, mean, vs), x, x, x
    (s2, n2), means, _ = ewma((s, n), x, period)
    before = np.concatenate(([mean], means[:-1]))
    (vs2, _), var, _ = ewma((vs, n), (x - before) ** 2, period)
    a = 2 / (period + 1)
    first = vs / (1 - (1 - a) ** n) if n else 0.0
    return (s2, n2, float(means[-1]), vs2), var, before, np.concatenate(([first], var[:-1]))


def ema(state: State, x: np.ndarray, period: int) -> tuple[tuple, np.ndarray]:
    """Seeded with the first value."""
    out = _decayed(x, state[0], 2 / (period + 1)) if state else pd.Series(x).ewm(span=period, adjust=False).mean().to_numpy()
    return (float(out[-1]),) if len(out) else state, out


def ema_carry(col: str, period: int) -> Carry:
    """A stretch is (rows, its sum from 0, its first value): the first stretch of a key starts at that value."""
    keep = 1 - 2 / (period + 1)

    def fold(held: State, rows: pd.DataFrame) -> tuple:
        x = rows[col].to_numpy()
        n, s, first = held or (0, 0.0, float(x[0]))
        return (int(n) + len(x), float(_decayed(x, s, 1 - keep)[-1]), first)

    def apply(state: State, summary: tuple) -> tuple:
        n, s, first = summary
        return ((state[0] if state else first) * keep**n + s,)

    return Carry("n long, s double, first double", "y double", fold, apply)


def kalman_level(state: State, x: np.ndarray, snr: float = 0.01, warmup: int = 1024) -> tuple[tuple, np.ndarray]:
    """Half-and-half smoothing before the ``warmup``-th value; from it on a local level with R = var(log returns), Q = R * snr.

    State (rows, level, P, R, last value, number, mean and squares of the log returns). A value that is missing or not
    finite is no step and shows the level before it.
    """
    n, level, p, noise, last, m, mean, sq = state or (0, 0.0, 1.0, 0.0, 0.0, 0, 0.0, 0.0)
    out = np.empty(len(x))
    for i, v in enumerate(np.asarray(x, float).tolist()):
        if not math.isfinite(v):
            out[i] = level if n else math.nan
            continue
        n += 1
        if n == 1:
            level = v
        else:
            if noise == 0.0 and last > 0 and v > 0:
                d = math.log(v / last)
                m += 1
                gap = d - mean
                mean += gap / m
                sq += gap * (d - mean)
            if n < warmup:
                level = 0.5 * level + 0.5 * v
            else:
                if noise == 0.0:
                    noise = max(sq / (m - 1) if m > 1 else 0.0, 1e-12)
                p += noise * snr
                level += p / (p + noise) * (v - level)
                p *= noise / (p + noise)  # not 1 - gain, which cancels while P is far above R
        last = v
        out[i] = level
    return (n, level, p, noise, last, m, mean, sq), out


CALM, TRENDING, VOLATILE, CRISIS = 0, 1, 2, 3
REGIMES = ("calm", "trending", "volatile", "crisis")
SEC = 1_000_000_000
#: Fixed dwell (ns) and number of observations that a change of regime needs; the last is for all other changes.
TO_CRISIS, FROM_CRISIS = (1 * SEC, 10), (30 * SEC, 200)
DWELLS = {(CALM, TRENDING): (5 * SEC, 50), (CALM, VOLATILE): (2 * SEC, 20), (VOLATILE, CALM): (15 * SEC, 100), (TRENDING, CALM): (10 * SEC, 80)}
OTHER = (2 * SEC, 20)


def regime_dwell(now: int, to: int) -> tuple[int, int]:
    return TO_CRISIS if to == CRISIS else FROM_CRISIS if now == CRISIS else DWELLS.get((now, to), OTHER)


def regime_states(state: State, observed: np.ndarray, ts: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The regime after each observation: a change needs both its dwell in event time and its number of observations.

    State (regime, last other observation, its number, since when).
    """
    out = np.empty(len(observed), np.int64)
    now, last, count, since = state or (CALM, CALM, 0, 0)
    for i, (o, t) in enumerate(zip(observed, ts, strict=True)):
        if o == now:
            last, count = o, 0
        elif o == last:
            count += 1
        else:
            last, count, since = o, 1, t
        dwell, least = regime_dwell(now, o)
        if o != now and count >= least and t - since >= dwell:
            now = o
        out[i] = now
    return (int(now), int(last), int(count), int(since)), out


def reversion(state: State, z: np.ndarray, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Position (-1, 0, 1) after each z, and the signal: 1 long, -1 short, 2 exit, 0 hold. State (position,)."""
    position, signal = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
    held = int(state[0]) if state else 0
    for i, v in enumerate(z):
        if held == 0:
            if abs(v) >= entry:
                held = signal[i] = -1 if v > 0 else 1
        elif abs(v) >= stop or (held == 1 and v >= -leave) or (held == -1 and v <= leave):
            held, signal[i] = 0, 2
        position[i] = held
    return (int(held),), position, signal


def machine_carry(states: list[int], run) -> Carry:
    """A machine of few states: a stretch maps each of them to the state that it ends in. ``run(state, rows)`` gives the end."""
    schema = ", ".join(f"m{k} long" for k in range(len(states)))
    fold = lambda held, rows: tuple(run(s, rows) for s in (held or states))
    apply = lambda state, summary: (int(summary[states.index(int(state[0]) if state else states[0])]),)
    return Carry(schema, "held long", fold, apply)


NORMAL, DIVERGED, CONVERGING, OPEN = 0, 1, 2, 3
PAIR_STATES = ("normal", "diverged", "converging", "position_open")


def pair_states(state: State, z: np.ndarray, opened: np.ndarray, entry: float, leave: float, stop: float) -> tuple[tuple, np.ndarray]:
    """The state of a pair after each z; ``opened`` says where a position was opened after the update. State (state,)."""
    now = int(state[0]) if state else NORMAL
    out = np.empty(len(z), np.int64)
    for i, v in enumerate(np.abs(z)):
        if now == NORMAL:
            now = DIVERGED if v >= entry else NORMAL
        elif now == DIVERGED:
            now = CONVERGING if v <= leave else NORMAL if v >= stop else DIVERGED
        elif now == CONVERGING:
            now = NORMAL if v <= leave else CONVERGING
        elif v <= leave or v >= stop:
            now = NORMAL
        out[i] = now
        if opened[i]:
            now = OPEN
    return (now,), out


def kalman_hedge(state: State, y: np.ndarray, x: np.ndarray, q_a: float = 1e-7, q_b: float = 1e-7, r: float = 1e-3, p0: float = 1.0) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """Random-walk intercept and slope of y on x (Joseph form): a, b, innovation. State (a, b, P in three numbers).

    A row without finite y and x is no step: it shows the state before it and no innovation.
    """
    a, b, p00, p01, p11 = state or (0.0, 0.0, p0, 0.0, p0)
    out = np.empty((3, len(y)))
    for i, (u, v) in enumerate(zip(np.asarray(y, float).tolist(), np.asarray(x, float).tolist(), strict=True)):
        if not (math.isfinite(u) and math.isfinite(v)):
            out[:, i] = a, b, math.nan
            continue
        p00, p11 = p00 + q_a, p11 + q_b
        e = u - a - b * v
        s = p00 + 2 * v * p01 + v * v * p11 + r
        k0, k1 = (p00 + v * p01) / s, (p01 + v * p11) / s
        a, b = a + k0 * e, b + k1 * e
        l0, l1, l2, l3 = 1 - k0, -k0 * v, -k1, 1 - k1 * v  # I - K H
        m0, m1, m2, m3 = l0 * p00 + l1 * p01, l0 * p01 + l1 * p11, l2 * p00 + l3 * p01, l2 * p01 + l3 * p11
        p00, p01, p11 = m0 * l0 + m1 * l1 + r * k0 * k0, m0 * l2 + m1 * l3 + r * k0 * k1, m2 * l2 + m3 * l3 + r * k1 * k1
        out[:, i] = a, b, e
    return (float(a), float(b), float(p00), float(p01), float(p11)), out[0], out[1], out[2]


def garch_filter(state: State, ret: np.ndarray, omega: float, alpha: float, beta: float) -> tuple[tuple, np.ndarray]:
    """Conditional variance before each return; starts at the long-run variance. State (the next variance,)."""
    out = np.empty(len(ret))
    s = state[0] if state else omega / max(1 - alpha - beta, 1e-12)
    for i, v in enumerate(ret):
        out[i] = s
        s = omega + alpha * v * v + beta * s
    return (float(s),), out


def garch_carry(col: str, omega: float, alpha: float, beta: float) -> Carry:
    """Affine in the variance: a stretch is (rows, what it makes of a variance of 0)."""

    def fold(held: State, rows: pd.DataFrame) -> tuple:
        n, s = held or (0, 0.0)
        (s,), _ = garch_filter((s,), rows[col].to_numpy(), omega, alpha, beta)
        return (int(n) + len(rows), s)

    def apply(state: State, summary: tuple) -> tuple:
        s = state[0] if state else omega / max(1 - alpha - beta, 1e-12)
        return (s * beta ** summary[0] + summary[1],)

    return Carry("n long, s double", "s double", fold, apply)


def average_cost(state: State, qty: np.ndarray, price: np.ndarray, commission: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """Position, average price and realised P&L after each trade: average cost, trade price on a flip, costs always realised."""
    out = np.empty((3, len(qty)))
    held, average, realised = state or (0.0, 0.0, 0.0)
    for i, (q, p, c) in enumerate(zip(qty, price, commission, strict=True)):
        realised -= c
        new = held + q
        if held == 0 or held * q > 0:
            average = (held * average + q * p) / new if new else 0.0
        else:
            realised += min(abs(q), abs(held)) * (p - average) * (1 if held > 0 else -1)
            average = p if held * new < 0 else average if new else 0.0
        held = new
        out[:, i] = held, average, realised
    return (float(held), float(average), float(realised)), out[0], out[1], out[2]


def average_cost_carry(held: str, qty: str, price: str, commission: str) -> Carry:
    """``average_cost`` where the position before each trade is known (``held``): affine in the average price.

    A stretch is (aa, ab, ra, rb): an average price x before it becomes aa x + ab, and it realises ra x + rb.
    """

    def fold(sums: State, rows: pd.DataFrame) -> tuple:
        aa, ab, ra, rb = sums or (1.0, 0.0, 0.0, 0.0)
        for h, q, p, c in zip(*(rows[k].tolist() for k in (held, qty, price, commission)), strict=True):
            rb -= c
            new = h + q
            if h == 0 or h * q > 0:
                aa, ab = (h * aa / new, (h * ab + q * p) / new) if new else (0.0, 0.0)
                continue
            closed = min(abs(q), abs(h)) * (1 if h > 0 else -1)
            ra, rb = ra - closed * aa, rb + closed * (p - ab)
            if h * new < 0:
                aa, ab = 0.0, p
            elif not new:
                aa, ab = 0.0, 0.0
        return aa, ab, ra, rb

    def apply(state: State, summary: tuple) -> tuple:
        average, realised = state or (0.0, 0.0)
        aa, ab, ra, rb = summary
        return aa * average + ab, realised + ra * average + rb

    return Carry("aa double, ab double, ra double, rb double", "average double, realised double", fold, apply)
