"""Strategies of users: parameters with bounds, and decisions made row by row of each key."""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from tickspark.functions.stretches import replay


def checked(params: dict[str, float], defaults: dict[str, float], bounds: dict[str, tuple[float, float]]) -> dict[str, float]:
    """``defaults`` with ``params`` in their place; each known, finite and inside its bounds, else an error."""
    for name in params.keys() - defaults.keys():
        raise ValueError(f"unknown parameter {name}")
    out = {**defaults, **params}
    for name, value in out.items():
        if not math.isfinite(value):
            raise ValueError(f"parameter {name} is not finite ({value:g})")
        lo, hi = bounds.get(name, (-math.inf, math.inf))
        if not lo <= value <= hi:
            raise ValueError(f"parameter {name} = {value:g} is outside [{lo:g}, {hi:g}]")
    return out


def whole(params: dict[str, float], name: str) -> int:
    """A parameter that must be a whole number."""
    if abs(params[name] - round(params[name])) > 1e-9:
        raise ValueError(f"parameter {name} = {params[name]:g} must be an integer")
    return round(params[name])


class Strategy:
    """Subclass it, name the ``defaults`` and ``bounds`` of its parameters and the columns of ``out``, and decide.

    ``create`` gives the state of a key, ``on_rows(state, rows)`` is called with each batch of a key's rows in order
    and ``on_stop(state)`` after the last; both change the state in place and give tuples of ``out``.
    Parameters are checked where the strategy is made, on the driver.
    """

    out: str
    defaults: dict[str, float] = {}
    bounds: dict[str, tuple[float, float]] = {}

    def __init__(self, **params: float):
        self.params = checked(params, self.defaults, self.bounds)
        self.check()

    def check(self) -> None:
        """Conditions between parameters; raises ValueError."""

    def create(self) -> Any:
        return {}

    def on_rows(self, state: Any, rows: pd.DataFrame) -> list[tuple]:
        raise TypeError(f"{type(self).__name__} decides nothing")

    def on_stop(self, state: Any) -> list[tuple]:
        return []


def run_strategy(rows: DataFrame, strategy: Strategy, keys: list[str], order: list[str]) -> DataFrame:
    """The decisions of ``strategy`` over the rows of each key in order, as rows of keys and ``strategy.out``.

    Keys run in parallel; a key's rows stream through in batches, so only its state is held.
    """

    def step(state: Any, part: pd.DataFrame) -> tuple[Any, list[tuple]]:
        state = strategy.create() if state is None else state
        return state, strategy.on_rows(state, part)

    return replay(rows, keys, order, step, strategy.on_stop, strategy.out)
