"""Models as table functions: a registry of loaders, one model for each worker, errors kept with their row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A loader makes a function from one input (a string) to one output (a string) out of parameters.
Loader = Callable[[Mapping[str, str]], Callable[[str], str]]
LOADERS: dict[str, Loader] = {}
_LOADED: dict[tuple, Callable[[str], str]] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    """Register a loader under a name."""

    def enter(f: Loader) -> Loader:
        LOADERS[name] = f
        return f

    return enter


def checked(params: Mapping[str, str], bounds: Mapping[str, tuple[float, float]]) -> dict[str, str]:
    """The parameters, if all numbers lie within their bounds and no other is named; else an error that says which."""
    for k, v in params.items():
        if k not in bounds:
            raise ValueError(f"unknown parameter {k}")
        low, high = bounds[k]
        if not low <= float(v) <= high:
            raise ValueError(f"{k} = {v} is not between {low} and {high}")
    return dict(params)


def run_model(rows: DataFrame, name: str, column: str, params: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with ``output`` and ``error`` of the model: a row that fails has its error, the others their output.

    The model is loaded once for each worker and parameters.  A null input has neither output nor error.
    """
    load, given = LOADERS[name], dict(params or {})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (name, *sorted(given.items()))
        if key not in _LOADED:
            _LOADED[key] = load(given)
        model = _LOADED[key]

        def one(value: str | None) -> tuple[str | None, str | None]:
            if value is None:
                return None, None
            try:
                return model(value), None
            except Exception as problem:  # noqa: BLE001 - a bad line must not end the page
                return None, f"{type(problem).__name__}: {problem}"[:200]

        for batch in batches:
            out = [one(v) for v in batch[column]]
            yield batch.assign(output=[o for o, _ in out], error=[e for _, e in out])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", output string, error string"
    return rows.mapInPandas(apply, schema)


def some_succeeded(results: DataFrame, group: str) -> DataFrame:
    """The results, unless all rows of a group failed: that is an error when they are read."""
    n = results.groupBy(group).agg(F.count("error").alias("__bad"), F.count("output").alias("__good"), F.first("error", ignorenulls=True).alias("__why"))
    failed = (F.col("__bad") > 0) & (F.col("__good") == 0)
    told = F.when(failed, F.raise_error(F.concat(F.lit("all rows failed: "), "__why"))).otherwise(F.col(group))
    return results.join(n, group).withColumn(group, told).select(*results.columns)
