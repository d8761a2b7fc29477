"""Registered queries: functions of a Data object, with the DuckDB text that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.views import Data, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, rounded: str = "") -> Callable:
    """Register a function under its name; the named double columns are rounded to six places on both sides."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Data(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in rounded.split()}) if rounded else df

        run.__name__ = run.__qualname__ = f.__name__
        run.__doc__ = f.__doc__
        run.__wrapped_module__ = f.__module__.rpartition(".")[2]
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = duck(sql, rounded)
        return f

    return register
