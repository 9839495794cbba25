"""Region tests as filters over a table with two coordinate columns and maybe a cell column.

A test is one SQL expression: thousands of shapes are one parse, and Spark's parser balances the
OR of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.geometry import (
    PAD,
    all_sql,
    any_of,
    any_sql,
    column_type,
    dec_between,
    haversine,
    haversine_sql,
    quoted,
    ra_between,
    ra_reach,
    separated_by_at_most,
)
from skyframe.functions.healpix import DEFAULT_INDEX, MAX_ORDER, cell_count, healpix_index, shift_right
from skyframe.operators.coverage import (
    MAX_DEPTH,
    RANGE_BUDGET,
    STEP,
    closed_up,
    covering,
    on_index_order,
    ranges_of,
    shape_rows,
)
from skyframe.operators.crossmatch import where_any_circle
from skyframe.operators.regions import Circle, Moc, Shape, Zone, merged, shapes
from skyframe.operators.skew import BROADCAST_ROWS, small
from skyframe.sources.files import kept

# A covering is worth a job of its own for a handful of shapes; past this many, the coordinate
# bounds alone go in front of the test, and circles are joined as a table.
COVERED_SHAPES = 64
# Ranges of a moc written out as comparisons; a longer one is joined as a table of cells.
LITERAL_RANGES = 64
_CAPACITY = {"byte": 2**7, "short": 2**15, "integer": 2**31, "long": 2**63}


class SpatialIndex:
    """A cell column and the order its values are at. The order is told, never read off a name;
    only `_healpix_29`, whose name is its order by convention, is found unasked."""

    def __init__(self, df: DataFrame, column: str, order: int):
        if not 0 <= order <= MAX_ORDER:
            raise ValueError(f"{order} is not a HEALPix order")
        type_ = column_type(df, column)
        # An unsigned 64-bit index arrives as decimal(20, 0), which holds any cell.
        if not type_.typeName().startswith("decimal"):
            capacity = _CAPACITY.get(type_.typeName())
            if capacity is None or capacity < cell_count(order):
                raise ValueError(f"{column} is {type_.simpleString()}, too narrow for order {order}")
        self.column, self.order = column, order

    @classmethod
    def of(cls, df: DataFrame, column: str | None, order: int | None) -> SpatialIndex | None:
        if column is not None:
            return cls(df, column, MAX_ORDER if order is None else order)
        if DEFAULT_INDEX not in df.columns:
            return None
        try:
            return cls(df, DEFAULT_INDEX, MAX_ORDER)
        except ValueError:
            return None

    def between(self, ranges, outward: bool) -> str | None:
        own = on_index_order(ranges, self.order, outward)
        if not own:
            return None
        return any_sql([f"{quoted(self.column)} BETWEEN {low}L AND {high - 1}L" for low, high in own])


def coordinate_bounds(df: DataFrame, shape: Circle | Zone, ra: str, dec: str) -> str | None:
    """Plain comparisons on the stored columns that hold wherever the shape does."""
    if isinstance(shape, Circle):
        reach = ra_reach(shape.dec, shape.radius)
        parts = [
            dec_between(df, dec, shape.dec - shape.radius - PAD, shape.dec + shape.radius + PAD),
            ra_between(df, ra, shape.ra - reach, 2.0 * reach),
        ]
    else:
        parts = [dec_between(df, dec, *shape.dec), ra_between(df, ra, shape.ra[0], shape.width)]
    parts = [part for part in parts if part is not None]
    return all_sql(parts) if parts else None


def exact_test(shape: Circle | Zone, ra: str, dec: str) -> str:
    """What the bounds leave to be tested: nothing of a zone, which is its bounds."""
    if isinstance(shape, Zone):
        return "true"
    # Inclusive: a point exactly the radius away is inside.
    limit = math.sin(math.radians(shape.radius) / 2) ** 2
    return f"{haversine_sql(ra, dec, shape.ra, shape.dec)} <= {limit!r}D"


def region_sql(
    df: DataFrame,
    regions,
    ra: str | None = "ra",
    dec: str | None = "dec",
    *,
    healpix: str | None = None,
    healpix_order: int | None = None,
    prefilter: bool = True,
    floor: int = 0,
    budget: int = RANGE_BUDGET,
) -> str:
    """Whether a row is in any of the regions, in a form whose conjuncts reach the scan.

    `bounds AND outer AND (inner OR exact)`: the same rows as `inner OR (outer AND exact)`, since
    inner lies inside outer and both inside the bounds, but with conjuncts of plain comparisons
    that parquet statistics can use. Several shapes repeat their bounds as a conjunct of their
    own, because an OR that holds trigonometry is never pushed down. `budget` is how many ranges
    of cells may be written out; `floor` the least order they are found at.
    """
    listed = shapes(regions)
    drawn = [shape for shape in listed if not isinstance(shape, Moc)]
    mocs = [shape for shape in listed if isinstance(shape, Moc)]
    if drawn and (ra is None or dec is None):
        raise ValueError("a circle or a zone needs a ra and a dec column")
    index = SpatialIndex.of(df, healpix, healpix_order)
    if mocs and index is None:
        raise ValueError("a moc is tested against a HEALPix column; name one and its order")

    bounds = [coordinate_bounds(df, shape, ra, dec) for shape in drawn]
    if len(listed) == 1 and drawn:
        fronts, tests = [bounds[0] or "true"], [exact_test(drawn[0], ra, dec)]
    else:
        fronts = [any_sql(bounds)] if drawn and not mocs and all(bounds) else []
        tests = [
            all_sql([bound, exact_test(shape, ra, dec)]) if bound else exact_test(shape, ra, dec)
            for bound, shape in zip(bounds, drawn, strict=True)
        ]
    # Inward on a coarser column: a cell only partly in a moc has rows that are not.
    tests += [index.between(moc.ranges, outward=False) or "false" for moc in mocs]
    exact = any_sql(tests)
    if drawn and index is not None and prefilter and len(listed) <= COVERED_SHAPES:
        inner, outer = ranges_of(df.sparkSession, listed, floor, budget)
        if outer != [(0, cell_count(MAX_ORDER))]:
            fronts.append(index.between(outer, outward=True) or "false")
        sure = index.between(inner, outward=False)
        if sure is not None:
            exact = any_sql([sure, exact])
    return all_sql([*fronts, exact])


def _long_moc(listed: list[Shape]) -> Moc | None:
    """The mocs of a list as one, if that has more ranges than are written out."""
    ranges = merged([span for shape in listed if isinstance(shape, Moc) for span in shape.ranges])
    return Moc(tuple(ranges)) if len(ranges) > LITERAL_RANGES else None


def region_column(df: DataFrame, regions, ra: str | None = "ra", dec: str | None = "dec", **options) -> Column:
    """The region test as a condition. See `region_sql` for the options.

    A long moc is looked up in a table of its cells, which Spark allows in a `where` only.
    """
    listed = shapes(regions)
    moc = _long_moc(listed)
    if moc is None:
        return F.expr(region_sql(df, listed, ra, dec, **options))
    inside = _in_moc(df, moc, options.get("healpix"), options.get("healpix_order"))
    drawn = [shape for shape in listed if not isinstance(shape, Moc)]
    return inside | F.expr(region_sql(df, drawn, ra, dec, **options)) if drawn else inside


def where_region(df: DataFrame, regions, ra: str | None = "ra", dec: str | None = "dec", **options) -> DataFrame:
    """The rows of `df` in any of the regions. See `region_sql` for the options.

    Past a number of shapes they are joined as a table: circles alone by position, and where there
    are others by the cells that cover them.
    """
    listed = shapes(regions)
    drawn = [shape for shape in listed if not isinstance(shape, Moc)]
    circles = [shape for shape in drawn if isinstance(shape, Circle)]
    if len(drawn) <= COVERED_SHAPES or not circles:
        moc = _long_moc(listed)
        if moc is not None and not drawn:
            return where_moc(df, moc, options.get("healpix"), options.get("healpix_order"))
        return df.where(region_column(df, listed, ra, dec, **options))
    if len(circles) == len(listed):
        rows = [(shape.ra, shape.dec, shape.radius) for shape in circles]
        table = df.sparkSession.createDataFrame(rows, "ra double, dec double, radius double")
        return where_any_circle(df, table, position=(ra, dec))
    return where_any_shape(df, listed, ra, dec, healpix=options.get("healpix"), healpix_order=options.get("healpix_order"))


# Cells of a boundary that a shape of very many may have, about.
_CELLS_EACH = 64


def _depth_of_many(shape: Circle | Zone) -> int:
    """The order that one of very many shapes is covered to, one of the few that they share."""
    if shape.perimeter <= 0:
        return MAX_DEPTH
    side = math.degrees(math.sqrt(4 * math.pi / 12))
    depth = math.floor(math.log2(_CELLS_EACH * side / shape.perimeter))
    return max(0, min(MAX_DEPTH, depth)) // STEP * STEP


def where_any_shape(
    df: DataFrame, regions, ra: str = "ra", dec: str = "dec", *, healpix: str | None = None, healpix_order: int | None = None
) -> DataFrame:
    """The rows of `df` in any of very many circles, zones and mocs, each row once, in one scan.

    The shapes are one table, of the cells that cover each, at a few orders. For each of these a row
    is looked up by its ancestor there, a semi-join on an equality; in a cell on a shape's boundary
    the shape itself is tested. A table that measures small is handed out, and then no row moves. A
    row without a cell column has its cell computed.
    """
    listed = shapes(regions)
    drawn = [shape for shape in listed if not isinstance(shape, Moc)]
    mocs = merged([span for shape in listed if isinstance(shape, Moc) for span in shape.ranges])
    index, own = SpatialIndex.of(df, healpix, healpix_order), df.columns
    depths = [_depth_of_many(shape) for shape in drawn]
    tests = [_in_moc(df, Moc(tuple(mocs)), healpix, healpix_order)] if mocs else []
    if drawn:
        if index is None or index.order < max(depths):
            df = df.withColumn("__cell", healpix_index(ra, dec))
            index = SpatialIndex(df, "__cell", MAX_ORDER)
        tests += _shape_tests(df, drawn, depths, index, ra, dec)
        span = dec_between(df, dec, *_declinations(drawn)) if not mocs else None
        df = df if span is None else df.where(span)
    return df.where(any_of(tests)).select(*[F.col(f"`{name}`") for name in own])


def _declinations(drawn: list[Circle | Zone]) -> tuple[float, float]:
    lows = [s.dec - s.radius if isinstance(s, Circle) else s.dec[0] for s in drawn]
    highs = [s.dec + s.radius if isinstance(s, Circle) else s.dec[1] for s in drawn]
    return min(lows) - PAD, max(highs) + PAD


def _shape_tests(df: DataFrame, drawn, depths: list[int], index: SpatialIndex, ra: str, dec: str) -> list[Column]:
    """For each order in use, whether a row's cell is one of a shape's that the row is in."""
    spark = df.sparkSession
    rows = []
    for number, shape in enumerate(drawn):
        if isinstance(shape, Circle):
            rows.append((number, shape.ra, shape.dec, math.sin(math.radians(shape.radius) / 2) ** 2, None, None, None, None))
        else:
            rows.append((number, None, None, None, shape.ra[0] % 360.0, shape.width, *shape.dec))
    names = ["shape", "s_ra", "s_dec", "s_limit", "s_from", "s_width", "s_south", "s_north"]
    told = spark.createDataFrame(rows, "shape int, " + ", ".join(f"{name} double" for name in names[1:]))
    cells = covering(spark, shape_rows(drawn, depths), max(depths)).select("shape", "Norder", "Npix", "inside")
    table = kept(cells.join(F.broadcast(told), "shape").drop("shape"), "shapes")
    few = small(table)
    own_ra, own_dec = (F.col(name).outer().cast("double") for name in (ra, dec))
    limit, west = F.col("s_limit"), F.col("s_from")
    in_circle = haversine(own_ra, own_dec, F.col("s_ra"), F.col("s_dec")) <= limit
    arcs = [own_ra.between(west + turn, west + F.col("s_width") + turn) for turn in (-360.0, 0.0, 360.0)]
    in_zone = own_dec.between(F.col("s_south"), F.col("s_north")) & ((F.col("s_width") >= 360.0) | any_of(arcs))
    exact = F.col("inside") | F.when(limit.isNotNull(), in_circle).otherwise(in_zone)
    tests = []
    for order in range(0, max(depths) + 1, STEP):
        at = table.where(F.col("Norder") == order)
        at = F.broadcast(at) if few else at
        cell = shift_right(F.col(index.column).outer().cast("bigint"), 2 * (index.order - order))
        tests.append(at.where((F.col("Npix") == cell) & exact).exists())
    return tests


def _cells_of(moc: Moc, index: SpatialIndex) -> dict[int, list[int]]:
    """A moc as whole cells no finer than the index, by order."""
    shift = 2 * (MAX_ORDER - index.order)
    own = on_index_order(moc.ranges, index.order, outward=False)
    cells: dict[int, list[int]] = {}
    for order, cell in Moc(tuple((low << shift, high << shift) for low, high in own)).cells() if own else []:
        cells.setdefault(order, []).append(cell)
    return cells


def _in_moc(df: DataFrame, moc: Moc, healpix: str | None = None, healpix_order: int | None = None) -> Column:
    """Whether a row's cell is in a moc of any length: for each order that the moc has, whether
    the row's ancestor there is one of its cells. Null without a cell.

    The cells come out of the caller's own text. Their number is known, and up to BROADCAST_ROWS of
    them are handed out, so that no row is shuffled or copied.
    """
    index = SpatialIndex.of(df, healpix, healpix_order)
    if index is None:
        raise ValueError("a moc is tested against a HEALPix column; name one and its order")
    tests = []
    for order, cells in sorted(_cells_of(moc, index).items()):
        table = df.sparkSession.createDataFrame([(cell,) for cell in cells], f"__moc{order} bigint")
        table = F.broadcast(table) if len(cells) <= BROADCAST_ROWS else table
        own = shift_right(F.col(index.column).outer().cast("bigint"), 2 * (index.order - order))
        tests.append(table.where(F.col(f"__moc{order}") == own).exists())
    found = any_of(tests) if tests else F.lit(False)
    return F.when(F.col(f"`{index.column}`").isNotNull(), found)


def where_moc(df: DataFrame, moc: Moc, healpix: str | None = None, healpix_order: int | None = None) -> DataFrame:
    """The rows whose cell is in a moc, for a moc of any length."""
    index = SpatialIndex.of(df, healpix, healpix_order)
    inside = _in_moc(df, moc, healpix, healpix_order)
    # A few ranges around the whole moc, so that the scan still skips row groups.
    reach = index.between(closed_up(list(moc.ranges), 16), outward=True)
    return df.where(reach or "false").where(inside)


def contains(df: DataFrame, position: tuple[str, str], shape: Shape, **options) -> Column:
    """`CONTAINS(POINT, shape)` as a condition; negate it with `~`."""
    return region_column(df, [shape], *position, **options)


def intersects(df: DataFrame, one, other, **options) -> Column:
    """`INTERSECTS` of a position and a shape, in either order."""
    if isinstance(one, tuple) == isinstance(other, tuple):
        raise ValueError("a position, as a pair of columns, is tested against a shape")
    position, shape = (one, other) if isinstance(one, tuple) else (other, one)
    return contains(df, position, shape, **options)


def within_distance(df: DataFrame, a: tuple, b: tuple, radius: float, **options) -> Column:
    """`DISTANCE(a, b) < r` with one side written out: a circle, so that it prunes. The strict
    and the non-strict comparison both take the edge in."""
    constant = [all(not isinstance(v, (str, Column)) for v in side) for side in (a, b)]
    if constant[0] == constant[1]:
        return separated_by_at_most(a, b, radius)
    centre, position = (a, b) if constant[0] else (b, a)
    return contains(df, position, Circle(float(centre[0]), float(centre[1]), radius), **options)
