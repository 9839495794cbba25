"""Set operations and subqueries, with repeated rows counted before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.operators.skew import HOT_ROWS, lookup, small

# Copies of one row that a single task writes out.
COPIES = 100_000


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().subtract(right.distinct())


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().intersect(right.distinct())


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.toDF(*left.columns)
    tagged = left.withColumns({"__l": F.lit(1), "__r": F.lit(0)}).unionByName(
        right.withColumns({"__l": F.lit(0), "__r": F.lit(1)})
    )
    return tagged.groupBy(*left.columns).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))


def _copied(counts: DataFrame, copies, columns: list[str]) -> DataFrame:
    """Each row as often as it is due, a row due very often from several tasks."""
    due = counts.withColumn("__due", copies).where(F.col("__due") > 0)
    shares = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__due") - 1) / COPIES))
    due = due.select(*columns, "__due", F.explode(shares).alias("__share"))
    due = due.repartition(*columns, "__share")
    here = F.least(F.lit(COPIES).cast("bigint"), F.col("__due") - F.col("__share") * COPIES)
    return due.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), here)).alias("__copy")).drop("__copy")


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return _copied(_counted(left, right), F.col("__l") - F.col("__r"), left.columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return _copied(_counted(left, right), F.least("__l", "__r"), left.columns)


def in_(df: DataFrame, column: str, values: DataFrame, **options) -> DataFrame:
    """`column IN (SELECT ...)`."""
    return _marked(df, column, values.toDF(column).where(F.col(column).isNotNull()).distinct(), True, **options)


def among(df: DataFrame, column: str, values: DataFrame, few: bool) -> DataFrame:
    """`column IN` a table of distinct values that has been measured: `few` are handed out."""
    values = values.toDF(column)
    if few:
        found = df.join(F.broadcast(values), column, "left_semi")
        return found.select(*[F.col(f"`{name}`") for name in df.columns])
    return _marked(df, column, values.where(F.col(column).isNotNull()), True, handed_out=False)


def not_in(df: DataFrame, column: str, values: DataFrame, **options) -> DataFrame:
    """`column NOT IN (SELECT ...)`: no row at all once a value is null, every row if there is no
    value. Asked first, so that the join is an ordinary one and need not be broadcast."""
    values = values.toDF(column).distinct()
    seen = values.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    if seen.n == 0:
        return df
    if seen.nulls:
        return df.where(F.lit(False))
    return _marked(df.where(F.col(column).isNotNull()), column, values, False, **options)


_COMPARISONS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compared(value: Column, comparison: str, quantifier: str, values: DataFrame) -> Column:
    """`value > ALL (SELECT ...)` or `ANY`, for any order comparison, as a condition.

    ALL holds of an empty set and ANY does not. A null in the set leaves ALL unknown unless some
    value refutes it, and ANY unless some value proves it; a null `value` is unknown but over an
    empty set. Only the least, the greatest and the number of nulls of the set are asked for.
    """
    if comparison not in _COMPARISONS or quantifier not in ("ALL", "ANY"):
        raise ValueError("a set is compared by <, <=, > or >=, with ALL or ANY of it")
    (name,) = values.columns
    column = F.col(f"`{name}`")
    seen = values.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("known")).first()
    every = quantifier == "ALL"
    if seen.n == 0:
        return F.lit(every)
    # ALL is settled by the value that is hardest to pass, ANY by the easiest.
    above = comparison in (">", ">=")
    bound = F.lit(seen.high if above == every else seen.low).cast(values.schema[name].dataType)
    held = _COMPARISONS[comparison](value, bound)
    if seen.known == seen.n:
        return held
    unknown = F.lit(None).cast("boolean")
    return F.when(~held, False).otherwise(unknown) if every else F.when(held, True).otherwise(unknown)


def _marked(
    df: DataFrame, column: str, values: DataFrame, wanted: bool, handed_out: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows whose column is, or is not, one of some distinct values.

    Values that measure few are handed out and nothing is shuffled. More are looked up, which
    splits a hot value of the column.
    """
    if handed_out and small(values):
        how = "left_semi" if wanted else "left_anti"
        return df.join(F.broadcast(values), column, how).select(*[F.col(f"`{name}`") for name in df.columns])
    found = lookup(df, values.withColumn("__in", F.lit(True)), [column], hot_rows)
    return found.where(F.col("__in").isNotNull() if wanted else F.col("__in").isNull()).drop("__in")
