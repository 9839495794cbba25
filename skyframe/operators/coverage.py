"""Coverings: shapes as HEALPix cells, by refining a table of cells.

Every cell is classified against a shape by its centre and a bound on its radius, which makes
Outside and Inside certain and leaves the rest to Boundary. Boundary cells are replaced by their
descendants until the shape's depth, so the union of the Inside cells is a subset of the shape
and the union of all cells kept is a superset.
"""

from __future__ import annotations

import math
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from skyframe.functions.geometry import PAD
from skyframe.functions.healpix import CELL_RADIUS, MAX_ORDER
from skyframe.operators.regions import Circle, Moc, Shape, Zone, merged

OUTSIDE, BOUNDARY, INSIDE = 0, 1, 2
# How many ranges a row filter carries. More cost more per row and skip no more row groups.
RANGE_BUDGET = 16
MAX_DEPTH = 20
# Cells of a shape's covering, about: what comes to the driver, whatever the catalog's orders.
CELL_BUDGET = 1_000
# Orders refined per step: 256 descendants of a cell at once keep the plan to a few steps.
STEP = 4

SHAPE_COLUMNS = "shape, depth, kind, ra, dec, radius, ra_from, width, dec_from, dec_to"


def row_depth(shape: Shape, floor: int = 0) -> int:
    """Two orders past the one at which about RANGE_BUDGET cells span a shape's boundary: fine
    enough to have cells inside, and closed up to the budget afterwards. Finer, down to `floor`, as
    long as the covering stays within about CELL_BUDGET cells."""
    if shape.perimeter <= 0:
        return MAX_DEPTH
    side = math.degrees(math.sqrt(4 * math.pi / 12))
    wanted = 2 + math.floor(math.log2(side * RANGE_BUDGET / shape.perimeter))
    # At order k a boundary meets about 2 ** k * perimeter / side cells, and the cells inside that
    # it leaves on its way are some times as many.
    kept = math.floor(math.log2(side * CELL_BUDGET / (10 * shape.perimeter)))
    return max(0, min(MAX_DEPTH, max(wanted, min(floor, kept))))


def shape_rows(listed: list[Circle | Zone], depths: list[int]) -> str:
    """Circles and zones as an inline table, for covering any number of them in one job."""
    rows = []
    for number, (shape, depth) in enumerate(zip(listed, depths, strict=True)):
        if isinstance(shape, Circle):
            values = ["'circle'", shape.ra, shape.dec, shape.radius, "NULL", "NULL", "NULL", "NULL"]
        else:
            values = ["'zone'", "NULL", "NULL", "NULL", shape.ra[0] % 360.0, shape.width, *shape.dec]
        written = [value if isinstance(value, str) else f"{value!r}D" for value in values]
        rows.append(f"({number}, {depth}, {', '.join(written)})")
    return f"(VALUES {', '.join(rows)} AS shapes({SHAPE_COLUMNS}))"


# The steps below are SQL text: one parse, where the same in Column calls is a call into the JVM
# per operator, which for formulas of this size is most of the planning time.


def _distance(ra_a: str, dec_a: str, ra_b: str, dec_b: str) -> str:
    return (
        f"degrees(2 * asin(sqrt(least(1D, pow(sin(radians({dec_a} - {dec_b}) / 2), 2D) + "
        f"cos(radians({dec_a})) * cos(radians({dec_b})) * pow(sin(radians({ra_a} - {ra_b}) / 2), 2D)))))"
    )


def circle_cover(ra: str, dec: str, radius: str, reach: str = "reach") -> str:
    """How the cap of radius `reach` about (cell_ra, cell_dec) lies to a circle."""
    apart = _distance("cell_ra", "cell_dec", ra, dec)
    return (
        f"CASE WHEN {apart} > {radius} + {reach} + {PAD}D THEN {OUTSIDE} "
        f"WHEN {radius} >= 180D OR {apart} + {reach} + {PAD}D <= {radius} THEN {INSIDE} ELSE {BOUNDARY} END"
    )


def zone_cover(ra_from: str, width: str, dec_from: str, dec_to: str, reach: str = "reach") -> str:
    """How the same cap lies to a zone. `aside` is the cap's own reach in right ascension."""
    low, high = f"cell_dec - {reach} - {PAD}D", f"cell_dec + {reach} + {PAD}D"
    offset = f"pmod(cell_ra - {ra_from}, 360D)"
    return (
        f"CASE WHEN {high} < {dec_from} OR {low} > {dec_to} THEN {OUTSIDE} "
        f"WHEN {width} < 360D AND {offset} > {width} + aside AND {offset} < 360D - aside THEN {OUTSIDE} "
        f"WHEN {dec_from} < {dec_to} AND ({low} >= {dec_from} OR {dec_from} <= -90D) "
        f"AND ({high} <= {dec_to} OR {dec_to} >= 90D) "
        f"AND ({width} >= 360D OR ({offset} >= aside AND {offset} + aside <= {width})) THEN {INSIDE} "
        f"ELSE {BOUNDARY} END"
    )


# The greatest ra offset inside the cap, 180 where it holds or nears a pole.
ASIDE = (
    f"CASE WHEN abs(cell_dec) + reach >= 90D OR sin(radians(reach)) > 0.999999D * cos(radians(cell_dec)) "
    f"THEN 180D ELSE degrees(asin(sin(radians(reach)) / cos(radians(cell_dec)))) END + {PAD}D"
)


def shape_cover(shape: Circle | Zone) -> str:
    """The cover of a known shape, over cell_ra, cell_dec, reach and aside."""
    if isinstance(shape, Circle):
        return circle_cover(*(f"({value!r}D)" for value in (shape.ra, shape.dec, shape.radius)))
    values = (shape.ra[0] % 360.0, shape.width, *shape.dec)
    return zone_cover(*(f"({value!r}D)" for value in values))


def cap_steps(source: str, carried: str, name: str) -> str:
    """CTEs that end in `name`: the cells of `source`, given by face coordinates `face`, `east`,
    `west` out of `side`, with the cap around each: its centre, its radius `reach`, and `aside`."""
    return (
        f"{name}_plane AS (SELECT {carried}, {CELL_RADIUS!r}D / side AS reach, "
        "2 * (face % 4) + if(face div 4 = 1, 0, 1) AS face_x, (east - west) / side AS across, "
        f"(east + west + 1) / side - face div 4 AS y FROM {source}), "
        f"{name}_centre AS (SELECT {carried}, reach, "
        "pmod(45D * (face_x + across / least(1D, 2D - abs(y))), 360D) AS cell_ra, "
        "CASE WHEN abs(y) > 1 THEN signum(y) * (90D - degrees(2 * asin((2D - abs(y)) / sqrt(6D)))) "
        f"ELSE degrees(asin(y / 1.5D)) END AS cell_dec FROM {name}_plane), "
        f"{name} AS (SELECT {carried}, reach, cell_ra, cell_dec, {ASIDE} AS aside FROM {name}_centre)"
    )


def _classified(source: str, name: str) -> str:
    """CTEs that bring `cover` up to date; a cell settled earlier is passed through."""
    cell = f"{SHAPE_COLUMNS}, level, side, face, east, west"
    fresh = (
        f"CASE WHEN kind = 'circle' THEN {circle_cover('ra', 'dec', 'radius')} "
        f"ELSE {zone_cover('ra_from', 'width', 'dec_from', 'dec_to')} END"
    )
    return (
        f"{cap_steps(source, f'{cell}, cover', f'{name}_cap')}, {name} AS (SELECT {cell}, "
        f"CASE WHEN cover = {BOUNDARY} THEN {fresh} ELSE cover END AS cover FROM {name}_cap)"
    )


def covering(spark: SparkSession, shape_table: str, deepest: int) -> DataFrame:
    """The covering of every shape of a table: `(shape, Norder, Npix, lo, hi, inside)`.

    A cell is carried by its face coordinates, since the descendants of one are then plain
    arithmetic and no step undoes the interleaving of the step before.
    """
    # A statement a step: one for all of them, five levels deep, takes the analyzer more rounds than
    # it is given.
    start = (
        f"start AS (SELECT *, 0 AS level, 1L AS side, 0L AS east, 0L AS west, {BOUNDARY} AS cover, "
        f"explode(sequence(0L, 11L)) AS face FROM {shape_table})"
    )
    cells = spark.sql(f"WITH {start}, {_classified('start', 'cells')} SELECT * FROM cells")
    for _ in range(-(-deepest // STEP)):
        # No descendants at all for a cell outside, which drops it here without a filter.
        steps = [
            f"jump AS (SELECT *, if(cover = {BOUNDARY}, least({STEP}, depth - level), 0) AS jump FROM {{cells}})",
            f"child AS (SELECT *, explode(if(cover = {OUTSIDE}, NULL, "
            "sequence(0L, shiftleft(1L, 2 * jump) - 1))) AS child FROM jump)",
            f"next AS (SELECT {SHAPE_COLUMNS}, level + jump AS level, shiftleft(side, jump) AS side, face, cover, "
            "shiftleft(east, jump) + child % shiftleft(1L, jump) AS east, "
            "shiftleft(west, jump) + child div shiftleft(1L, jump) AS west FROM child)",
            _classified("next", "found"),
        ]
        cells = spark.sql(f"WITH {', '.join(steps)} SELECT * FROM found", cells=cells)
    # Binary digits read in base 4 are the bits spread over the even places.
    spread = "CAST(conv(conv(CAST({} AS STRING), 10, 2), 4, 10) AS BIGINT)"
    pixel = f"shiftleft(face, 2 * level) + {spread.format('east')} + 2 * {spread.format('west')}"
    return spark.sql(
        f"WITH kept AS (SELECT shape, level AS Norder, {pixel} AS Npix, "
        f"explode(if(cover = {OUTSIDE}, NULL, array(cover = {INSIDE}))) AS inside FROM {{cells}}) "
        f"SELECT shape, Norder, Npix, shiftleft(Npix, 2 * ({MAX_ORDER} - Norder)) AS lo, "
        f"shiftleft(Npix + 1, 2 * ({MAX_ORDER} - Norder)) AS hi, inside FROM kept",
        cells=cells,
    )


# Spans of cells by shapes and depths, the latest last: a covering follows from those alone, and a
# selection, or a query that is asked again, needs the same one more than once.
_covered: OrderedDict[tuple, list[tuple[int, int, bool]]] = OrderedDict()
KEPT_COVERINGS = 200


def _spans(spark: SparkSession, drawn: tuple[Shape, ...], depths: tuple[int, ...]) -> list[tuple[int, int, bool]]:
    key = (drawn, depths)
    if key not in _covered:
        found = covering(spark, shape_rows(list(drawn), list(depths)), max(depths)).collect()
        _covered[key] = [(row.lo, row.hi, row.inside) for row in found]
        while len(_covered) > KEPT_COVERINGS:
            _covered.popitem(last=False)
    _covered.move_to_end(key)
    return _covered[key]


def ranges_of(spark: SparkSession, listed: list[Shape], floor: int = 0, budget: int = RANGE_BUDGET):
    """(inner, outer) order-29 ranges of a union of shapes, at most `budget` of each.

    The number of cells follows from the depth and not from any data, and the depth is held back
    by CELL_BUDGET, so what is collected is that many small rows per shape.
    """
    inner = [span for shape in listed if isinstance(shape, Moc) for span in shape.ranges]
    outer = list(inner)
    drawn = [shape for shape in listed if not isinstance(shape, Moc)]
    if drawn:
        for low, high, inside in _spans(spark, tuple(drawn), tuple(row_depth(shape, floor) for shape in drawn)):
            outer.append((low, high))
            if inside:
                inner.append((low, high))
    return largest(merged(inner), budget), closed_up(merged(outer), budget)


def closed_up(ranges, budget: int):
    """A superset in at most `budget` ranges: the narrowest gaps are filled."""
    if len(ranges) <= budget:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda at: ranges[at][0] - ranges[at - 1][1])
    filled = set(gaps[: len(ranges) - budget])
    joined = []
    for at, (low, high) in enumerate(ranges):
        if at in filled:
            joined[-1] = (joined[-1][0], high)
        else:
            joined.append((low, high))
    return joined


def largest(ranges, budget: int):
    """A subset in at most `budget` ranges: the widest are kept."""
    return sorted(sorted(ranges, key=lambda r: r[0] - r[1])[:budget])


def on_index_order(ranges, order: int, outward: bool):
    """Order-29 ranges as ranges of a coarser index: outward for a superset, else inward."""
    shift = 2 * (MAX_ORDER - order)
    if outward:
        spans = [(low >> shift, -(-high >> shift)) for low, high in ranges]
    else:
        spans = [(-(-low >> shift), high >> shift) for low, high in ranges]
    return merged([(low, high) for low, high in spans if low < high])
