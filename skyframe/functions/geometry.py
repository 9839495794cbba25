"""Angles on the sky as Column arithmetic. Positions are ICRS degrees throughout."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. PAD widens a derived bound so that rounding never drops a boundary row;
# NEAR_ONE is where asin gets too steep for its result to be trusted as a bound.
PAD = 1e-9
NEAR_ONE = 1e-6


def number(value) -> Column:
    """A column name, a Column or a Python number as a double Column."""
    if isinstance(value, Column):
        return value.cast("double")
    if isinstance(value, str):
        return F.col(value).cast("double")
    return F.lit(float(value))


def point(ra, dec) -> tuple:
    """A position: a pair of columns or numbers, never a value of its own."""
    return (ra, dec)


def haversine(ra_a, dec_a, ra_b, dec_b) -> Column:
    """sin^2(angle / 2) between two positions; monotone in the angle, and needs no ra wrap."""
    ra_a, dec_a, ra_b, dec_b = (number(v) for v in (ra_a, dec_a, ra_b, dec_b))
    # pow(x, 2) is x * x exactly, and unlike the product names x once: a filter evaluates
    # every mention of a subexpression.
    half_dec = F.pow(F.sin(F.radians(dec_a - dec_b) / 2), F.lit(2.0))
    half_ra = F.pow(F.sin(F.radians(ra_a - ra_b) / 2), F.lit(2.0))
    return half_dec + F.cos(F.radians(dec_a)) * F.cos(F.radians(dec_b)) * half_ra


def haversine_of(radius) -> Column:
    """The haversine of an angle in degrees, which a radius is compared as."""
    return F.pow(F.sin(F.radians(number(radius)) / 2), F.lit(2.0))


def distance(a, b) -> Column:
    """The angle between two points in degrees. The clamp keeps antipodes at 180 and not NaN."""
    clamped = F.least(haversine(*a, *b), F.lit(1.0))
    return F.when(all_present(*a, *b), F.degrees(2 * F.asin(F.sqrt(clamped))))


def all_present(*values) -> Column:
    """None of the values is null. `least` skips nulls, so it cannot be left to propagate them."""
    return all_of([number(value).isNotNull() for value in values])


def separated_by_at_most(a, b, radius) -> Column:
    """Whether two points are within `radius` degrees, inclusive; any of the five may be a column."""
    return haversine(*a, *b) <= haversine_of(radius)


def ra_reach(dec: float, radius: float) -> float:
    """The greatest ra offset inside a disk; 180 where ra is not bounded at all."""
    if abs(dec) + radius >= 90.0:
        return 180.0
    ratio = math.sin(math.radians(radius)) / math.cos(math.radians(dec))
    return 180.0 if ratio > 1.0 - NEAR_ONE else math.degrees(math.asin(ratio)) + PAD


def quoted(name: str) -> str:
    """A dotted column name for SQL text."""
    return ".".join(f"`{part}`" for part in name.replace("`", "").split("."))


def column_type(df: DataFrame, name: str) -> T.DataType:
    """The type of a dotted column name; any casing, as Spark itself reads names."""
    at: T.DataType = df.schema
    for part in name.replace("`", "").split("."):
        found = [f for f in at.fields if f.name == part] or [f for f in at.fields if f.name.lower() == part.lower()]
        if len(found) != 1:
            raise ValueError(f"{name!r} names no column; there are {', '.join(df.columns)}")
        at = found[0].dataType
    return at


def haversine_sql(ra: str, dec: str, ra_b: float, dec_b: float) -> str:
    """`haversine` against a known point."""
    ra, dec = f"CAST({quoted(ra)} AS DOUBLE)", f"CAST({quoted(dec)} AS DOUBLE)"
    return (
        f"pow(sin(radians({dec} - ({dec_b!r}D)) / 2), 2D) + "
        f"cos(radians({dec})) * cos(radians({dec_b!r}D)) * pow(sin(radians({ra} - ({ra_b!r}D)) / 2), 2D)"
    )


def _between(name: str, type_: T.DataType, low: float, high: float) -> str:
    """`low <= column <= high` on the column as stored, so that the comparison is pushed down.

    A double bound against a float column would cast the column, which pushes nothing. The
    smallest float not below `low` and the largest not above `high` select the same floats.
    """
    if not isinstance(type_, T.FloatType):
        return f"{quoted(name)} BETWEEN {float(low)!r}D AND {float(high)!r}D"
    first, last = np.float32(low), np.float32(high)
    if float(first) < low:
        first = np.nextafter(first, np.float32(np.inf))
    if float(last) > high:
        last = np.nextafter(last, np.float32(-np.inf))
    return f"{quoted(name)} BETWEEN CAST({float(first)!r}D AS FLOAT) AND CAST({float(last)!r}D AS FLOAT)"


def dec_between(df: DataFrame, name: str, low: float, high: float) -> str | None:
    """A declination range, or None where it leaves nothing out."""
    if low <= -90.0 and high >= 90.0:
        return None
    return _between(name, column_type(df, name), max(low, -90.0), min(high, 90.0))


def ra_between(df: DataFrame, name: str, start: float, width: float) -> str | None:
    """The eastward arc from `start` over `width` degrees, or None for the whole circle.

    The arc is matched a turn either way, which covers files written in 0..360 and in
    -180..180 and the seam of both, with no arithmetic on the column.
    """
    if width >= 360.0:
        return None
    start, type_ = start % 360.0, column_type(df, name)
    turns = (-360.0, 0.0, 360.0)
    return any_sql([_between(name, type_, start + turn, start + width + turn) for turn in turns])


def any_sql(conditions: list[str]) -> str:
    """OR of SQL conditions, which Spark's parser makes a balanced tree."""
    return " OR ".join(f"({condition})" for condition in conditions)


def all_sql(conditions: list[str]) -> str:
    return " AND ".join(f"({condition})" for condition in conditions)


def any_of(conditions: list[Column]) -> Column:
    """OR as a balanced tree: one branch per shape would otherwise nest as deep as the list."""
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return any_of(conditions[:middle]) | any_of(conditions[middle:])


def all_of(conditions: list[Column]) -> Column:
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return all_of(conditions[:middle]) & all_of(conditions[middle:])


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
