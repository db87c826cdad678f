"""Metrics of user code as mergeable states: start, add, merge and finish.

Each task keeps one state for each key it meets and adds its batches to it; states are
moved, not rows, and merged level by level, a bounded number of them at a time, so that
neither a task nor a group holds the rows of a key, however large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANIN = 16


class Metric:
    """A metric over rows, as a state of numbers. Subclasses are registered by a name and made by metric()."""

    #: The columns of the result, as DDL.
    result = "value double"

    def start(self) -> np.ndarray:
        """The state before any row: a vector of numbers."""
        raise NotImplementedError

    def add(self, state: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Has to give the same for any order and grouping."""
        return a + b

    def finish(self, state: np.ndarray) -> tuple:
        raise NotImplementedError


_metrics: dict[str, Callable[..., Metric]] = {}


def register(name: str):
    """Registers a class or function that makes a Metric, under a name for metric()."""

    def add(make):
        _metrics[name] = make
        return make

    return add


def metric(name: str, **settings) -> Metric:
    return _metrics[name](**settings)


@register("counts")
class Counts(Metric):
    """tp, fp and fn of rows with kind tp, fp or fn, and what follows from them."""

    result = "tp long, fp long, fn long, precision double, recall double, f1 double"

    def start(self):
        return np.zeros(3)

    def add(self, state, rows):
        return state + [(rows.kind == k).sum() for k in ("tp", "fp", "fn")]

    def finish(self, state):
        tp, fp, fn = (int(x) for x in state)
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        return tp, fp, fn, p, r, 2 * p * r / (p + r) if p + r else 0.0


@register("mean")
class Mean(Metric):
    """The mean and population variance of a column, merged without loss of digits."""

    result = "n long, mean double, variance double"

    def __init__(self, column: str = "value"):
        self.column = column

    def start(self):
        return np.zeros(3)

    def add(self, state, rows):
        v = rows[self.column].dropna().to_numpy(float)
        return self.merge(state, np.array([len(v), v.mean(), ((v - v.mean()) ** 2).sum()])) if len(v) else state

    def merge(self, a, b):
        n = a[0] + b[0]
        if not n:
            return a
        d = b[1] - a[1]
        return np.array([n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n])

    def finish(self, state):
        n, mean, m2 = state
        return int(n), float(mean) if n else None, float(m2 / n) if n else None


@register("histogram")
class Histogram(Metric):
    """Counts of a column's values within [low, high] in equal bins; the ends hold what lies outside."""

    result = "counts array<long>"

    def __init__(self, column: str = "value", low: float = 0.0, high: float = 1.0, bins: int = 10):
        self.column, self.low, self.high, self.bins = column, low, high, bins

    def start(self):
        return np.zeros(self.bins)

    def add(self, state, rows):
        v = rows[self.column].dropna().to_numpy(float)
        at = np.clip(np.floor((v - self.low) / (self.high - self.low) * self.bins), 0, self.bins - 1).astype(int)
        return state + np.bincount(at, minlength=self.bins)

    def finish(self, state):
        return ([int(x) for x in state],)


def accumulate(df: DataFrame, keys: list[str], of: Metric | str, fanin: int = FANIN, **settings) -> DataFrame:
    """keys and the result columns of a metric over the rows of each key."""
    m = metric(of, **settings) if isinstance(of, str) else of
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    state = f"{kinds}, state array<double>, part long"

    def partial(batches):
        """One state for each key of a task."""
        from pyspark import TaskContext

        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, rows in b.groupby(keys, dropna=False, sort=False):
                held[key] = m.add(held[key] if key in held else m.start(), rows)
        part = TaskContext.get().partitionId()
        if held:
            out = pd.DataFrame(list(held), columns=keys)
            yield out.assign(state=[np.asarray(s, float).tolist() for s in held.values()], part=part)

    def together(d: pd.DataFrame) -> np.ndarray:
        states = [np.asarray(s, float) for s in d.sort_values("part").state]
        out = states[0]
        for s in states[1:]:
            out = m.merge(out, s)
        return out

    def merged(d: pd.DataFrame) -> pd.DataFrame:
        return d.iloc[:1][keys].assign(state=[together(d).tolist()], part=int(d.part.iloc[0]) // fanin)

    def finished(d: pd.DataFrame) -> pd.DataFrame:
        row = m.finish(together(d))
        out = d.iloc[:1][keys].reset_index(drop=True)
        for name, v in zip(names, row, strict=True):
            out[name] = pd.Series([v], dtype=object)
        return out

    names = [c.split()[0] for c in m.result.split(", ")]
    states, tasks = df.mapInPandas(partial, state), df.rdd.getNumPartitions()
    while tasks > fanin * fanin:  # so many states of a key at most meet in the end
        states = states.withColumn("group", F.floor(F.col("part") / fanin)).groupBy(*keys, "group").applyInPandas(merged, state)
        tasks = -(-tasks // fanin)
    return states.groupBy(*keys).applyInPandas(finished, f"{kinds}, {m.result}")
