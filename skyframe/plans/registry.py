"""The list of queries: a name, a callable of (spark, sf_dir), and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        key = name or run.__name__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return run

    return add
