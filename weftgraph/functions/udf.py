"""User functions for query text: compositions of Columns, pandas UDFs, grouped aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql.functions import pandas_udf

from weftgraph.functions import aggregate
from weftgraph.functions.scalar import CUSTOM, register, unregister


def register_vectorized(name: str, fn: Callable[..., Any], returns: str) -> None:
    """A function of pandas Series, sent in Arrow batches."""
    register(name, pandas_udf(fn, returns))


def register_aggregate(name: str, fn: Callable[..., Any], returns: str) -> None:
    """A function of a group's Series to one value; the group is in one worker's memory, as for any such function."""
    aggregate.AGGREGATES[name.lower()] = pandas_udf(fn, returns)


def listed() -> list[str]:
    return sorted(CUSTOM)


__all__ = ["listed", "register", "register_aggregate", "register_vectorized", "unregister"]
