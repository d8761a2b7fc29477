"""User functions: row callables, group callables, predicates from rules, table-valued expansion."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_rows(df: DataFrame, name: str, f: Callable, kind: str, *columns: str) -> DataFrame:
    """A Python callable for each row, in Arrow batches: the last resort where no column expression will do."""
    return df.withColumn(name, F.udf(f, kind, useArrow=True)(*columns))


def apply_groups(df: DataFrame, keys: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """A callable for each whole group, which must fit in a task's memory."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def merged(defaults: dict, own: dict) -> dict:
    """D3: own settings over defaults, nested dictionaries merged."""
    out = copy.deepcopy(defaults)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def rule(column: str, spec: dict) -> Column:
    """D3: one predicate: above, below (both strict), least, most, one_of, not_null."""
    c, parts = F.col(column), {
        "above": lambda c, v: c > v, "below": lambda c, v: c < v, "least": lambda c, v: c >= v,
        "most": lambda c, v: c <= v, "one_of": lambda c, v: c.isin(v), "not_null": lambda c, v: c.isNotNull() if v else c.isNull(),
    }
    unknown = set(spec) - set(parts)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    out = F.lit(True)
    for k, v in spec.items():
        out = out & parts[k](c, v)
    return out


def build_filter(rules: dict[str, dict]) -> Column:
    """D3: all rules together."""
    out = F.lit(True)
    for column, spec in rules.items():
        out = out & rule(column, spec)
    return out


def rules_to_filter(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    return df.filter(build_filter(rules))


def expand(df: DataFrame, values: Column, name: str) -> DataFrame:
    """One row for each element of an array expression."""
    return df.withColumn(name, F.explode(values))
