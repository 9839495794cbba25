"""HEALPix nested-scheme cells as Column arithmetic (Gorski et al. 2005; the projection-plane
form of Calabretta and Roukema 2007).

In the projection plane x counts eighths of a turn and y runs -2..2. A base face is a unit
diamond in it, so a cell's two face coordinates are fractions of (x + y) / 2 and (x - y) / 2,
and interleaving their bits gives the cell number. The expressions are kept small on purpose:
Catalyst inlines them into any filter it pushes down, so a subexpression used twice is paid
for twice there, and the usual five shift-and-mask steps would be paid for 32 times.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions.geometry import finite, number

MAX_ORDER = 29
# Largest centre-to-corner angle of any cell, in degrees, times 2^order.
CELL_RADIUS = math.degrees(1.07)
DEFAULT_INDEX = "_healpix_29"


def cell_count(order: int) -> int:
    return 12 << (2 * order)


def shift_left(value: Column, bits) -> Column:
    return F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))


def shift_right(value: Column, bits) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


# Built by rule: bit i of a byte moved to bit 2i.
@cache
def _spread_table() -> Column:
    entries = [sum(((byte >> i) & 1) << (2 * i) for i in range(8)) for byte in range(256)]
    return F.lit(np.array(entries, dtype=np.int64))


def _spread(value: Column, order: int) -> Column:
    """The low `order` bits of a bigint moved to the even bits, a byte at a time."""
    parts = []
    for at in range(max(1, -(-order // 8))):
        byte = shift_right(value, 8 * at).bitwiseAND(F.lit(255)).cast("int")
        parts.append(shift_left(F.get(_spread_table(), byte), 16 * at))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def healpix_index(ra, dec, order: int = MAX_ORDER) -> Column:
    """The nested cell of a position at `order`. A position that is not one gives null."""
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"order {order} is not one of HEALPix's 0..{MAX_ORDER}")
    ra, dec = number(ra), number(dec)
    nside = 1 << order

    x = F.pmod(ra, F.lit(360.0)) / 45.0
    # sin(dec) = 2/3 is where the polar caps meet the equatorial belt.
    edge = math.degrees(math.asin(2.0 / 3.0))
    north, south = dec > edge, dec < -edge
    # Caps. sqrt(3 (1 - |z|)) is written as a half-angle sine, since 1 - |z| loses its digits
    # near a pole. The facet is clamped because pmod can round up to a whole turn.
    cap = math.sqrt(6.0) * F.sin(F.radians(90.0 - F.abs(dec)) / 2)
    facet = F.least(F.floor(x / 2), F.lit(3).cast("bigint"))
    along = x / 2 - facet
    near, far = cap * (1 - along), cap * along
    # Belt.
    slope = 0.75 * F.sin(F.radians(dec))
    falling, rising = 0.5 + x / 2 - slope, 0.5 + x / 2 + slope
    low, high = F.floor(falling), F.floor(rising)

    last = F.lit(nside - 1).cast("bigint")

    def step(north_at: Column, south_at: Column, belt_at: Column) -> Column:
        fraction = F.when(north, north_at).when(south, south_at).otherwise(belt_at)
        return F.greatest(F.lit(0).cast("bigint"), F.least(last, F.floor(fraction * nside)))

    # What falls is counted from the far end, and after it is cut to whole steps: a position on the
    # edge of two cells is then in the one that HEALPix gives it.
    east, west = step(near, far, rising - high), step(far, near, falling - low)

    face = (
        F.when(north, facet)
        .when(south, facet + 8)
        .when(low == high, low.bitwiseAND(F.lit(3)) + 4)
        .when(low < high, low.bitwiseAND(F.lit(3)))
        .otherwise(high.bitwiseAND(F.lit(3)) + 8)
    )
    # The guard is added rather than wrapped around: inside a branch the shared steps would be
    # evaluated at every use, outside one they are evaluated once.
    known = F.when(finite(ra) & finite(dec) & (F.abs(dec) <= 90.0), F.lit(0).cast("bigint"))
    return (
        shift_left(face.cast("bigint"), 2 * order)
        + _spread(F.when(north, last - east).otherwise(east), order)
        + 2 * _spread(F.when(south, west).otherwise(last - west), order)
        + known
    )


def cell_center(order: Column, pixel: Column) -> tuple[Column, Column]:
    """(ra, dec) of a cell's centre, for cells of any mix of orders.

    Meant for tables of cells, not of rows: a cell number's base-4 digits hold one bit of each
    face coordinate, so both come out by reading the digits back as binary.
    """
    nside = shift_left(F.lit(1).cast("bigint"), order)
    face = shift_right(pixel, 2 * order)
    digits = F.conv((pixel - shift_left(face, 2 * order)).cast("string"), 10, 4)
    east = F.conv(F.translate(digits, "0123", "0101"), 2, 10).cast("bigint")
    west = F.conv(F.translate(digits, "0123", "0011"), 2, 10).cast("bigint")

    band = F.floor(face / 4)
    face_x = 2 * (face - 4 * band) + F.when(band == 1, 0).otherwise(1)
    across = (east - west) / nside
    y = (east + west + 1) / nside - band
    polar = F.abs(y) > 1
    cap = F.when(polar, 2.0 - F.abs(y)).otherwise(F.lit(1.0))
    cap_dec = F.signum(y) * (90.0 - F.degrees(2 * F.asin(cap / math.sqrt(6.0))))
    belt_dec = F.degrees(F.asin(y / 1.5))
    return (
        F.pmod(45.0 * (face_x + across / cap), F.lit(360.0)),
        F.when(polar, cap_dec).otherwise(belt_dec),
    )


def cell_radius(order: Column) -> Column:
    """An upper bound, in degrees, on the distance from a cell's centre to any point of it."""
    return CELL_RADIUS / shift_left(F.lit(1).cast("bigint"), order)


def first_index(order: Column, pixel: Column) -> Column:
    """Start of a cell's span of order-29 indices."""
    return shift_left(pixel, 2 * (MAX_ORDER - order))


def end_index(order: Column, pixel: Column) -> Column:
    """One past the end of a cell's span of order-29 indices."""
    return shift_left(pixel + 1, 2 * (MAX_ORDER - order))
