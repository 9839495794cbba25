"""The geometry as functions of SQL text. Each is an expression that Catalyst inlines, so over
written-out numbers its coordinate bounds are constants and reach the scan.

`sky_buckets` and `sky_bucket` make a crossmatch in SQL text an equi-join: a row of one side is
written out for every bucket its disk can touch, and meets the rows of the other side there.

    SELECT a.id, b.id FROM a, LATERAL sky_buckets(a.ra, a.dec, 0.5) k
    JOIN b ON k.bucket = sky_bucket(b.ra, b.dec, 0.5) AND sky_in_circle(b.ra, b.dec, a.ra, a.dec, 0.5)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from skyframe.functions.geometry import NEAR_ONE, PAD
from skyframe.functions.healpix import MAX_ORDER
from skyframe.operators.crossmatch import FINEST_ZONE

_HAVERSINE = (
    "pow(sin(radians(dec_a - dec_b) / 2), 2D) + "
    "cos(radians(dec_a)) * cos(radians(dec_b)) * pow(sin(radians(ra_a - ra_b) / 2), 2D)"
)
_RATIO = "sin(radians(radius)) / cos(radians(dec_b))"
_FREE = f"(abs(dec_b) + radius >= 90D OR {_RATIO} > 1D - {NEAR_ONE}D)"
_REACH = f"(degrees(asin(least(1D, {_RATIO}))) + {PAD}D)"
_ARCS = " OR ".join(
    f"ra_a BETWEEN pmod(ra_b - {_REACH}, 360D) + {turn}D AND pmod(ra_b - {_REACH}, 360D) + 2 * {_REACH} + {turn}D"
    for turn in (-360, 0, 360)
)

FUNCTIONS = {
    "sky_distance": (
        "ra_a DOUBLE, dec_a DOUBLE, ra_b DOUBLE, dec_b DOUBLE",
        "DOUBLE",
        f"degrees(2 * asin(sqrt(if({_HAVERSINE} > 1D, 1D, {_HAVERSINE}))))",
    ),
    # Whether a is in the circle about b. Bounds first: they are what prunes.
    "sky_in_circle": (
        "ra_a DOUBLE, dec_a DOUBLE, ra_b DOUBLE, dec_b DOUBLE, radius DOUBLE",
        "BOOLEAN",
        f"dec_a BETWEEN dec_b - radius - {PAD}D AND dec_b + radius + {PAD}D AND ({_FREE} OR {_ARCS}) "
        f"AND {_HAVERSINE} <= pow(sin(radians(radius) / 2), 2D)",
    ),
    # Inclusive in both; ra runs eastward from the first to the second.
    "sky_in_zone": (
        "ra_a DOUBLE, dec_a DOUBLE, ra_from DOUBLE, ra_to DOUBLE, dec_from DOUBLE, dec_to DOUBLE",
        "BOOLEAN",
        "dec_a BETWEEN dec_from AND dec_to AND (ra_to - ra_from >= 360D OR "
        + " OR ".join(
            f"ra_a BETWEEN pmod(ra_from, 360D) + {turn}D "
            f"AND pmod(ra_from, 360D) + pmod(ra_to - ra_from, 360D) + {turn}D"
            for turn in (-360, 0, 360)
        )
        + ")",
    ),
    "sky_trunc": ("x DOUBLE, digits INT", "DOUBLE",
                  "CAST(if(x < 0, ceil(x * pow(10D, digits)), floor(x * pow(10D, digits))) AS DOUBLE) / pow(10D, digits)"),
}




# ---- mocs ----

# A moc's text with one space between tokens, in front and behind, and orders as `3/`; JSON as well.
_MOC = "concat(' ', regexp_replace(regexp_replace(translate(moc, '{}[]\",:', '      /'), '[ \\\\s]+', ' '), ' ?/ ?', '/'), ' ')"


def _moc_cells(order: int) -> str:
    """What a moc's text lists at an order: cells and ranges of cells, with a space between."""
    return f"trim(array_join(regexp_extract_all({_MOC}, ' {order}/([0-9 -]*?)(?= [0-9]+/| $|$)', 1), ' '))"


def _moc_ends(order: int, which: str) -> str:
    """The first (or last) cells of the ranges at an order, ascending: folded once, before any row.
    Null where there are none."""
    cut = "-[0-9]+" if which == "first" else "[0-9]+-"
    cells = _moc_cells(order)
    return f"sort_array(CAST(split(regexp_replace(nullif({cells}, ''), '{cut}', ''), ' +') AS ARRAY<BIGINT>))"


def _up_to(numbers: str, value: str) -> str:
    """How many of ascending numbers are no greater than a value, by binary search."""
    return (
        f"aggregate(sequence(CAST(log2(size({numbers})) AS INT), 0, -1), 0, (n, k) -> "
        f"if(n + shiftleft(1, k) <= size({numbers}) AND get({numbers}, n + shiftleft(1, k) - 1) <= {value}, "
        "n + shiftleft(1, k), n))"
    )


def _in_moc() -> str:
    """Whether an order-29 cell is in a moc: at some order, more ranges begin by its ancestor than
    end before it. Orders that the moc does not have fold away."""
    tests, lows, highs = [], [], []
    for order in range(MAX_ORDER + 1):
        shift = 2 * (MAX_ORDER - order)
        first, last = _moc_ends(order, "first"), _moc_ends(order, "last")
        own = f"shiftright(cell, {shift})"
        tests.append(
            f"CASE WHEN {_moc_cells(order)} = '' THEN false ELSE "
            f"element_at(transform(array(named_struct('f', {first}, 'l', {last})), "
            f"m -> {_up_to('m.f', own)} > {_up_to('m.l', f'{own} - 1')}), 1) END"
        )
        lows.append(f"shiftleft(array_min({first}), {shift})")
        highs.append(f"shiftleft(array_max({last}) + 1, {shift}) - 1")
    known = (
        f"rlike({_MOC}, '^ *[0-9]+/') AND NOT rlike({_MOC}, ' (3[0-9]|[4-9][0-9]|[0-9]{{3,}})/') "
        f"AND regexp_replace({_MOC}, '[0-9]+-[0-9]+|[0-9]+|/| ', '') = ''"
    )
    return (
        f"if({known}, cell BETWEEN least({', '.join(lows)}) AND greatest({', '.join(highs)}) AND ({' OR '.join(tests)}), "
        "CAST(raise_error(concat('not a moc: ', left(moc, 60))) AS BOOLEAN))"
    )



# ---- buckets ----

_OVER = "pmod(dec + 90D, 360D)"
# A position in 0..360 and -90..90; past a pole lies the far side of it.
_RA = f"pmod(if(abs(dec) <= 90D OR {_OVER} <= 180D, ra, ra + 180D), 360D)"
_DEC = f"CASE WHEN abs(dec) <= 90D THEN dec WHEN {_OVER} <= 180D THEN {_OVER} - 90D ELSE 270D - {_OVER} END"
_FINITE = "abs(ra) < double('Infinity') AND abs(dec) < double('Infinity')"


def _count(zone: str, height: str) -> str:
    """How many buckets a zone has: about as wide as it is high, one at a pole."""
    low = f"({zone} * {height} - 90D)"
    widest = f"least(90D, greatest(abs({low}), abs({low} + {height})))"
    return f"greatest(1L, floor(360D * cos(radians({widest})) / {height}))"


def _number(zone: str, bucket: str) -> str:
    return f"{zone} * 268435456L + {bucket}"


_GRID = f"greatest(2D * coalesce(grid, radius), {FINEST_ZONE!r}D)"
_PLACE = f"array(named_struct('ra', {_RA}, 'dec', {_DEC}, 'h', {_GRID}))"
_HOME = (
    f"element_at(transform({_PLACE}, p -> element_at(transform(array(floor((p.dec + 90D) / p.h)), z -> "
    + _number("z", f"least({_count('z', 'p.h')} - 1, floor(p.ra * {_count('z', 'p.h')} / 360D))")
    + "), 1)), 1)"
)
_WIDE = f"sin(radians(radius)) / cos(radians({_DEC}))"
_PROBE_REACH = (
    f"if(abs({_DEC}) + radius >= 90D OR {_WIDE} > {1 - NEAR_ONE}D, 180D, degrees(asin(least(1D, {_WIDE})))) + {2 * PAD!r}D"
)
_PROBE = (
    f"flatten(transform(if({_FINITE} AND radius >= 0D AND NOT isnan(radius), "
    f"array(named_struct('ra', {_RA}, 'dec', {_DEC}, 'h', {_GRID}, 'r', {_PROBE_REACH})), array()), p -> "
    f"flatten(transform(sequence(floor((greatest(-90D, p.dec - radius - {PAD}D) + 90D) / p.h), "
    f"floor((least(90D, p.dec + radius + {PAD}D) + 90D) / p.h)), z -> "
    f"flatten(transform(array({_count('z', 'p.h')}), n -> transform(sequence(floor((p.ra - p.r) * n / 360D), "
    "least(floor((p.ra + p.r) * n / 360D), floor((p.ra - p.r) * n / 360D) + n - 1)), s -> "
    + _number("z", "pmod(s, n)")
    + ")))))))"
)

FUNCTIONS |= {
    # Whether an order-29 cell is in a moc, as text: `3/64-66 5/19`, or `{"3": [64, 65]}`.
    "sky_in_moc": ("cell BIGINT, moc STRING", "BOOLEAN", _in_moc()),
    # The one bucket of a position, on the grid for a radius, or for a `grid` of its own.
    "sky_bucket": (
        "ra DOUBLE, dec DOUBLE, radius DOUBLE, grid DOUBLE DEFAULT NULL", "BIGINT", f"CASE WHEN {_FINITE} THEN {_HOME} END"
    ),
}
# Every bucket on that grid that the disk about a position can touch, each once. With a `grid` the
# radius may be each row's own.
TABLES = {
    "sky_buckets": ("ra DOUBLE, dec DOUBLE, radius DOUBLE, grid DOUBLE DEFAULT NULL", "bucket BIGINT", f"SELECT explode({_PROBE})")
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL, once; their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (arguments, columns, body) in TABLES.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    return [*FUNCTIONS, *TABLES]
