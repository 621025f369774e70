"""Helpers of the query modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import table


_COUNT_IF = re.compile(r"count_if\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)")


class Family:
    """Collects queries with their SQL: ``@family.query(sql)`` on a function of (spark, sf_dir)."""

    def __init__(self) -> None:
        self.found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.found[f.__name__] = f
            if sql:  # counts as BIGINT, which count_if isn't there
                self.sql[f.__name__] = _COUNT_IF.sub(r"count(*) filter (where \1)", sql)
            return f

        return add


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Repeats count once; they are equal but for when they arrived."""
    return df.dropDuplicates(list(keys))

