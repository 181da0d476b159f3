"""What users add to the engine: functions, filters, tests and globals, each in a namespace of its own.

A column callable takes and gives columns and is the first choice; a value callable runs on plain values, in
templates rendered by value, or in SQL as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from .plans.templates import Environment

MOST = 64
KINDS = ("function", "filter", "test", "global")


class RegistryError(ValueError):
    """A name that is taken, or too many names."""


@dataclass
class Registry:
    columns: dict[str, dict[str, Callable[..., Column]]] = field(default_factory=lambda: {k: {} for k in KINDS})
    values: dict[str, dict[str, Any]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def register(self, kind: str, name: str, by_column: Callable[..., Column] | None = None, by_value: Any = None, replace: bool = False) -> None:
        if kind not in KINDS:
            raise RegistryError(f"no namespace is named {kind}")
        names = self.columns[kind].keys() | self.values[kind].keys()
        if name in names and not replace:
            raise RegistryError(f"{kind} {name} is registered")
        if name not in names and len(names) >= MOST:
            raise RegistryError(f"more than {MOST} names")
        if by_column is not None:
            self.columns[kind][name] = by_column
        if by_value is not None:
            self.values[kind][name] = by_value

    def environment(self, **options: Any) -> Environment:
        """An environment for templates that are rendered by value."""
        env = Environment(**options)
        env.filters |= self.values["filter"]
        env.tests |= self.values["test"]
        env.globals |= self.values["function"] | self.values["global"]
        return env

    def in_sql(self, spark: SparkSession, name: str, returns: str) -> None:
        """A registered value function as a SQL function."""
        f = self.values["function"][name]

        @F.pandas_udf(returns)
        def call(*args: pd.Series) -> pd.Series:
            return pd.Series([f(*row) for row in zip(*args, strict=True)])

        spark.udf.register(name, call)
