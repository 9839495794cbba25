"""Limits that say when they cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

_PLACE = "__place"


def _numbered(df: DataFrame, max_rows: int) -> DataFrame:
    """At most one row more than the cap, in one partition, numbered from zero."""
    if max_rows < 0:
        raise ValueError("a row cap is not negative")
    return df.limit(max_rows + 1).coalesce(1).withColumn(_PLACE, F.monotonically_increasing_id())


def capped(df: DataFrame, max_rows: int) -> tuple[DataFrame, Observation]:
    """At most `max_rows` rows; and, once they were delivered, `.get["overflow"]`: whether there
    were more. A cap of zero keeps the columns.

    The run that delivers the rows is what looks for one past the cap, so the query runs once and
    the whole table is never counted. Order the table first where the same rows are wanted each time.
    """
    told = Observation()
    rows = _numbered(df, max_rows).observe(told, F.count_if(F.col(_PLACE) >= max_rows).cast("boolean").alias("overflow"))
    return rows.where(F.col(_PLACE) < max_rows).drop(_PLACE), told


def with_overflow(df: DataFrame, max_rows: int, name: str = "overflow") -> DataFrame:
    """At most `max_rows` rows, each with whether there were more: out of the rows up to one past the
    cap, which one partition holds."""
    rows = _numbered(df, max_rows)
    more = F.max(F.col(_PLACE)).over(Window.partitionBy()) >= max_rows
    return rows.withColumn(name, more).where(F.col(_PLACE) < max_rows).drop(_PLACE)


def top(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """`TOP n`, after skipping `offset` rows. Ties are cut like any other rows."""
    return (df.offset(offset) if offset else df).limit(n)
