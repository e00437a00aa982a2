"""All queries of the library with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

import tickspark.operators
import tickspark.sources
import tickspark.streaming
from tickspark.plans import catalog

for _package in (tickspark.sources, tickspark.operators, tickspark.streaming):
    for _module in pkgutil.iter_modules(_package.__path__):
        importlib.import_module(f"{_package.__name__}.{_module.name}")


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
