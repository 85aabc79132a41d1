"""Metrics by name in SQL: aggregates over (place, value) and the replicate paths they are resampled along.

A metric is a function of a return array; registered, it is a grouped Arrow-batched aggregate, so `SELECT key, worst_drawdown(date, r) ... GROUP BY key` works on
any table, and spreads by the key. A group is one series, which a task holds. `block_path` gives the rows of a stationary block bootstrap's
replicates as a table function, to be joined to a numbered series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap

Metric = Callable[[np.ndarray], float]


def _column(kernel: Callable[[np.ndarray], np.ndarray]) -> Metric:
    """A metric of paths (path, dates, columns) as one of a single series."""
    return lambda r: float(kernel(np.asarray(r, float)[None, :, None])[0, 0])


#: What is there from the start; further ones come through `register`.
METRICS: dict[str, Metric] = {
    "worst_drawdown": _column(bootstrap.worst_drawdown),
    "tail_mean_05": _column(lambda r: bootstrap.tail_mean(r, 0.05)),
    "total_growth": lambda r: float(np.prod(1 + np.asarray(r, float)) - 1),
}


def register(spark: SparkSession, name: str, metric: Metric) -> None:
    """`name`(place, value) in SQL: the metric of a group's values in the order of their places; rows without a value are left out, and a group
    without any is null."""

    @F.pandas_udf("double")
    def aggregate(place: pd.Series, value: pd.Series) -> float:
        held = value[value.notna()]
        if held.empty:
            return None
        return float(metric(held.to_numpy(float)[np.argsort(place[held.index].to_numpy(), kind="stable")]))

    spark.udf.register(name, aggregate)


def register_all(spark: SparkSession) -> None:
    """Every metric of METRICS, and block_path(n, block, seed, first, last): replicate, step, i of the replicates from first to before last."""
    for name, metric in METRICS.items():
        register(spark, name, metric)

    @F.udtf(returnType="replicate: long, step: long, i: long")
    class BlockPath:
        def eval(self, n: int, block: float, seed: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
            for replicate in range(first, last):
                path = bootstrap.index_paths(n, float(block), seed, np.array([replicate]))[0]
                yield from ((replicate, step, int(i)) for step, i in enumerate(path))

    spark.udtf.register("block_path", BlockPath)
