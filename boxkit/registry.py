"""All queries of the library by name, each with its SQL where SQL can express it, and all operators by name and settings."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under a name."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


MODULES = ("filters", "matching", "scoring", "fusion", "stats", "tracks", "search", "hashing", "footprints", "quantiles", "trainers", "accumulate", "survey", "components")
_own: dict[str, Callable] = {}


def operator(name: str):
    """Registers a function of DataFrames, for user code, under a name that create() knows."""

    def add(f):
        _own[name] = f
        return f

    return add


def operators() -> dict[str, Callable]:
    """All operators by name: those of the library, as module.function, and registered ones."""
    out = {}
    for m in MODULES:
        module = importlib.import_module(f".operators.{m}", __package__)
        out |= {f"{m}.{k}": f for k, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and k[0] != "_"}
    return out | _own


def create(name: str, **config) -> Callable:
    """The operator of a name with its settings; TypeError if it has no such setting, KeyError if there is no such operator.

    create("matching.match_greedy", least=0.4)(computed, truth)
    """
    f = operators()[name]
    inspect.signature(f).bind_partial(**config)
    return partial(f, **config)
