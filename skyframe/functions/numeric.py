"""Scalar functions where Spark's own differ: IEEE results, doubles kept doubles, and the ones
Spark has not got. Everything else of the surface (`abs`, `sqrt`, `cbrt`, `exp`, `pow`, `round`,
`degrees`, the trigonometric and hyperbolic functions, `signum`, `nanvl`, `lower`, `upper`,
`coalesce`, `concat`, `struct`, `cast`, `try_cast`) is `pyspark.sql.functions`, as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def _column(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def floor(x) -> Column:
    """A double, as its argument is; Spark's is a bigint."""
    return F.floor(_column(x).cast("double")).cast("double")


def ceil(x) -> Column:
    return F.ceil(_column(x).cast("double")).cast("double")


def trunc(x, digits: int = 0) -> Column:
    """A number cut, not rounded, to `digits` decimals. Spark's `trunc` is of dates."""
    scaled = _column(x).cast("double") * F.lit(10.0**digits)
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double") / F.lit(10.0**digits)


def mod(x, y) -> Column:
    """The remainder, with the sign of the dividend."""
    return _column(x) % _column(y)


def divide(x, y) -> Column:
    """IEEE division of doubles: infinities and NaN where Spark's ANSI mode raises."""
    x, y = _column(x).cast("double"), _column(y).cast("double")
    # Its text is what still tells a negative zero from a positive one.
    infinite = F.when(y.cast("string").startswith("-"), F.lit(-INFINITY)).otherwise(F.lit(INFINITY))
    return F.when(y == 0.0, x * infinite).otherwise(F.try_divide(x, y))


def _logarithm(name: str, x) -> Column:
    x = _column(x).cast("double")
    value = F.when(x == 0.0, F.lit(-INFINITY)).when(x < 0.0, F.lit(float("nan")))
    return value.otherwise(getattr(F, name)(x))


def ln(x) -> Column:
    """Natural logarithm: -inf at zero and NaN below, where Spark has null. Also ADQL's LOG."""
    return _logarithm("log", x)


def log2(x) -> Column:
    return _logarithm("log2", x)


def log10(x) -> Column:
    return _logarithm("log10", x)


def factorial(x) -> Column:
    """Of 0 to 20. Past that a bigint cannot hold it, which is refused and not null."""
    x = _column(x)
    refused = F.raise_error(F.concat(F.lit("factorial of "), x.cast("string"), F.lit(" overflows")))
    return F.when(x > 20, refused.cast("bigint")).otherwise(F.factorial(F.greatest(x, F.lit(0)).cast("int")))


# Euclid halves the larger number at least every two steps, so 92 reach any pair of bigints.
_EUCLID_STEPS = 92


def gcd(x, y) -> Column:
    x, y = (F.abs(_column(v).cast("bigint")) for v in (x, y))
    pair = F.struct(x.alias("a"), y.alias("b"))

    def step(state: Column, _: Column) -> Column:
        a, b = state["a"], state["b"]
        return F.struct(
            F.when(b == 0, a).otherwise(b).alias("a"),
            F.when(b == 0, b).otherwise(F.try_mod(a, b)).alias("b"),
        )

    steps = F.sequence(F.lit(1), F.lit(_EUCLID_STEPS))
    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(steps, pair, step, lambda state: state["a"]))


def lcm(x, y) -> Column:
    a, b = _column(x).cast("bigint"), _column(y).cast("bigint")
    zero = (a == 0) | (b == 0)
    return F.when(zero, F.lit(0).cast("bigint")).otherwise(F.abs(F.try_divide(a, gcd(x, y)).cast("bigint") * b))


def iszero(x) -> Column:
    return _column(x) == 0


def rand(seed=None) -> Column:
    """A random double. A seed is accepted and not used."""
    return F.rand()
