"""Positional joins: the zones algorithm (Gray, Nieto-Santisteban, Szalay 2006) as an equi-join.

The sky is cut into zones of declination and each zone into buckets of right ascension. A row of
the home side lies in one bucket; a row of the probe side is copied to every bucket its disk
touches. Joined on the bucket, with the exact separation as residual, a pair is met once. The
home side is never copied, and the probe side about four times at most. Where radii come from a
column and a few disks are far wider than the rest, those few are handed out on a grid of their own,
so that they do not coarsen the grid of the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.geometry import (
    NEAR_ONE,
    PAD,
    any_of,
    dec_between,
    distance,
    number,
    quoted,
    separated_by_at_most,
)
from skyframe.operators.skew import BROADCAST_ROWS, HOT_ROWS, HotKeys, handed_out, hot_keys, salted, small, split_join
from skyframe.sources.files import kept

# The finest zone, in degrees. Finer ones would copy more probe rows and spare few candidates.
FINEST_ZONE = 10.0 / 3600.0
# Buckets that a disk meets on its grid, off the poles: two zones, and three buckets in each.
PROBED = 6
_KEY, _HERE = "__bucket", ("__ra", "__dec")


# The steps are SQL text: one parse a side, where the same in Column calls is a call into the JVM
# per operator.


def _placed(df: DataFrame, ra: str, dec: str) -> DataFrame:
    """`df` with its position in 0..360 and -90..90; a row without one is in no pair and leaves.

    A dec past a pole is the far side of it, which is the point the haversine measures from too.
    """
    ra, dec = f"CAST({quoted(ra)} AS DOUBLE)", f"CAST({quoted(dec)} AS DOUBLE)"
    over, finite = f"pmod({dec} + 90D, 360D)", "abs({0}) < double('Infinity')"
    return df.sparkSession.sql(
        f"""SELECT *, pmod(if(abs({dec}) <= 90D OR {over} <= 180D, {ra}, {ra} + 180D), 360D) AS {_HERE[0]},
            CASE WHEN abs({dec}) <= 90D THEN {dec} WHEN {over} <= 180D THEN {over} - 90D
                ELSE 270D - {over} END AS {_HERE[1]}
        FROM {{df}} WHERE {finite.format(ra)} AND {finite.format(dec)}""",
        df=df,
    )


def _height(finest: float) -> str:
    """The height of a level's zones."""
    return f"({finest!r}D * pow(4D, __level))"


def _buckets(finest: float) -> str:
    """How many buckets a zone has: about as wide as the zone is high, one at a pole."""
    low, height = f"(__zone * {_height(finest)} - 90D)", _height(finest)
    widest = f"least(90D, greatest(abs({low}), abs({low} + {height})))"
    return f"greatest(1L, floor(360D * cos(radians({widest})) / {height}))"


# A level, a zone and a bucket in one number.
_PACKED = "((CAST(__level AS BIGINT) * 268435456L + __zone) * 268435456L + {bucket})"


def _home(df: DataFrame, finest: float, level: int) -> DataFrame:
    """Every row with its one bucket, on the grid of a level."""
    ra, dec = _HERE
    bucket = _PACKED.format(bucket=f"least(__of - 1, floor({ra} * __of / 360D))")
    # Exploded, though it is one: a semi-join is moved below a projection and its keys are
    # written out again for every use, and below a generator it is not.
    return df.sparkSession.sql(
        f"""WITH levels AS (SELECT *, {level} AS __level FROM {{df}}),
        zones AS (SELECT *, floor(({dec} + 90D) / {_height(finest)}) AS __zone FROM levels),
        counts AS (SELECT *, {_buckets(finest)} AS __of FROM zones)
        SELECT * EXCEPT (__level, __zone, __of), explode(array({bucket})) AS {_KEY} FROM counts""",
        df=df,
    )


def _probe(df: DataFrame, finest: float, keep_level: bool = False) -> DataFrame:
    """A copy of the row for every bucket that its disk, `__radius` at `__level`, can touch."""
    ra, dec = _HERE
    height = _height(finest)
    ratio = f"sin(radians(__radius)) / cos(radians({dec}))"
    working = "__zone, __of, __west, __east, __step, __reach" + ("" if keep_level else ", __level")
    # Once round is every bucket; more would meet the first ones again.
    return df.sparkSession.sql(
        f"""WITH zones AS (
            SELECT *, if(abs({dec}) + __radius >= 90D OR {ratio} > {1 - NEAR_ONE}D, 180D,
                degrees(asin(least(1D, {ratio})))) + 2 * {PAD}D AS __reach,
                explode(sequence(floor((greatest(-90D, {dec} - __radius - {PAD}D) + 90D) / {height}),
                    floor((least(90D, {dec} + __radius + {PAD}D) + 90D) / {height}))) AS __zone
            FROM {{df}}),
        counts AS (SELECT *, {_buckets(finest)} AS __of FROM zones),
        arcs AS (SELECT *, floor(({ra} - __reach) * __of / 360D) AS __west,
            floor(({ra} + __reach) * __of / 360D) AS __east FROM counts),
        steps AS (SELECT *, explode(sequence(__west, least(__east, __west + __of - 1))) AS __step FROM arcs)
        SELECT * EXCEPT ({working}), {_PACKED.format(bucket='pmod(__step, __of)')} AS {_KEY} FROM steps""",
        df=df,
    )


def _with_radius(df: DataFrame, radius) -> tuple[float, list[tuple[DataFrame, int, bool]]]:
    """The finest zone, and the probe side in parts: rows with `__radius` and `__level`, the grid
    that a part is on, and whether it is so few rows that they are handed out.

    A level's zones are four times as high as the one below's, and a disk needs one whose zones are
    at least twice its radius high. On a higher one it has more candidates, sixteen times as many
    a level; so disks up to some level share its grid, and those above it, if they are few, the
    highest. The cut that leaves the fewest candidates is taken, out of the rows of each of the ten
    levels there can be, which is what is collected.
    """
    if isinstance(radius, (int, float)):
        if not math.isfinite(radius) or radius < 0:
            raise ValueError("a radius is a number of degrees, not negative")
        finest = max(2.0 * radius, FINEST_ZONE)
        return finest, [(df.withColumns({"__radius": F.lit(float(radius)), "__level": F.lit(0)}), 0, False)]
    df = _leveled(df, number(radius))
    rows = dict(df.groupBy("__level").count().collect())
    top = max(rows, default=0)

    def candidates(cut: int) -> float:
        few = sum(n for level, n in rows.items() if level > cut)
        if few * PROBED > BROADCAST_ROWS:
            return math.inf
        return sum(n * 16.0**cut for level, n in rows.items() if level <= cut) + few * 16.0**top

    cut = min(rows, key=lambda level: (candidates(level), -level), default=0)
    parts = [(df.where(F.col("__level") <= cut).withColumn("__level", F.lit(cut)), cut, False)]
    if cut < top:
        parts.append((df.where(F.col("__level") > cut).withColumn("__level", F.lit(top)), top, True))
    return FINEST_ZONE, parts


def _leveled(df: DataFrame, radius: Column) -> DataFrame:
    """`df` with a radius from a column and its level, without the rows that have none."""
    # Neither null nor NaN, which `least` passes over and a comparison takes for large.
    df = df.withColumn("__radius", F.least(radius, F.lit(180.0))).where((radius >= 0.0) & ~F.isnan(radius))
    doublings = F.log2(F.greatest(2.0 * F.col("__radius"), F.lit(FINEST_ZONE)) / FINEST_ZONE)
    return df.withColumn("__level", F.ceil(doublings / 2.0).cast("int"))


def _unique(names: list[str], taken: list[str], suffix: str) -> dict[str, str]:
    return {name: f"{name}{suffix}" if name in taken else name for name in names}


def crossmatch(
    left: DataFrame,
    right: DataFrame,
    radius,
    *,
    left_position: tuple[str, str] = ("ra", "dec"),
    right_position: tuple[str, str] = ("ra", "dec"),
    suffix: str = "_2",
    separation: str | None = "separation",
    strict: bool = False,
    split_hot: bool = True,
    hot_rows: int = HOT_ROWS,
    small_left: bool = False,
) -> DataFrame:
    """Every pair of a left and a right row within `radius` degrees of each other.

    `radius` is a number or a column of the left side. `strict` leaves the edge out, which is
    what a `DISTANCE(a, b) < r` between two tables asks. `small_left` says that the left side is
    a list: once measured to be one, it is handed to every executor and the right side is not
    shuffled. A right column whose name the left side has gets `suffix`.
    """
    return _matched(left, right, radius, left_position, right_position, suffix, separation, strict, split_hot, hot_rows, small_left)


def _matched(
    left: DataFrame, right: DataFrame, radius, left_position=("ra", "dec"), right_position=("ra", "dec"), suffix="_2",
    separation="separation", strict=False, split_hot=True, hot_rows=HOT_ROWS, small_left=False, small_right=False,
) -> DataFrame:
    names = _unique(right.columns, left.columns, suffix)
    finest, parts = _with_radius(left, radius)
    columns = [F.col(f"`{name}`") for name in left.columns]
    columns += [F.col(f"`__h_{name}`").alias(names[name]) for name in right.columns]
    if separation is not None:
        columns.append(distance([F.col(name) for name in _HERE], [F.col(f"__h{name}") for name in _HERE]).alias(separation))
    pairs = None
    for part, level, few in parts:
        probe = _probe(_placed(part, *left_position), finest)
        home = _home(_placed(right, *right_position), finest, level)
        # Measured as it would be handed out, every copy counted.
        listed = few or (small_left and small(probe))
        spread = not listed and small_right and small(home)
        found = _joined(probe, home, right.columns, listed, split_hot, hot_rows, strict, spread).select(*columns)
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def _joined(
    probe: DataFrame, home: DataFrame, columns: list[str], listed: bool, split_hot: bool, hot_rows: int, strict: bool, spread: bool = False
) -> DataFrame:
    """The pairs of one part, the right side's columns under names that keep out of the way."""
    streamed = probe.isStreaming and not home.isStreaming
    hot = HotKeys()
    # A limit below the usual one is kept whatever the tables' sizes.
    spared = hot_rows >= HOT_ROWS and (handed_out(home) or (not streamed and handed_out(probe)))
    if split_hot and not listed and not spread and not spared and not home.isStreaming:
        # What arrives cannot be counted beforehand; the table that it meets can.
        hot = hot_keys(home.limit(0) if streamed else probe, home, _KEY, hot_rows)
    salts = []
    if streamed and hot:
        probe, home = salted(probe, _KEY, hot, "left"), salted(home, _KEY, hot, "right")
        salts = ["__lsalt", "__rsalt"]
    home = home.select(
        *[F.col(name).alias(f"__h{name}") for name in (_KEY, *_HERE, *salts)],
        *[F.col(f"`{name}`").alias(f"__h_{name}") for name in columns],
    )
    a, b = [F.col(name) for name in _HERE], [F.col(f"__h{name}") for name in _HERE]
    if salts:
        # A row that arrives meets every part of a hot bucket, each in another task.
        on = _residual(a, b, strict)
        for name in (_KEY, *salts):
            on = on & (F.col(name) == F.col(f"__h{name}"))
        return probe.join(home, on)
    probe = F.broadcast(probe) if listed else probe
    # A right side that measured small goes to the left rows, which then need not meet in a bucket's task.
    home = F.broadcast(home) if spread else home
    return split_join(probe, home, _KEY, f"__h{_KEY}", _residual(a, b, strict), hot)


def _residual(a, b, strict: bool) -> Column:
    # A difference in dec is the cheapest lower bound on a separation, and rejects most of a
    # bucket before any sine is taken.
    near = F.abs(a[1] - b[1]) <= F.col("__radius") + PAD
    if strict:
        return near & (distance(a, b) < F.col("__radius"))
    return near & separated_by_at_most(a, b, F.col("__radius"))


# The whole sphere in square degrees.
_SKY = 360.0 * 360.0 / math.pi
# Zones across the radius of a ring, when one row stands for those of a bucket; a bucket is no wider
# than three of its zones are high.
_ACROSS = 8


# Rings after which what has found nothing is far from all right rows, and the share of the last
# ring within which a right row is looked at for others around it.
_NEAR_RINGS, _AROUND = 4, 0.4
# Six sectors around a position: another one in each, in bits.
_ENCLOSED = 63


def _reach_of(left: DataFrame, right: DataFrame, left_position, right_position, limit: float = 180.0) -> list[tuple[DataFrame, DataFrame | None]]:
    """Parts (`at_ra`, `at_dec`, `__near`): for every position of the left side a radius within which
    it has a right row, and not much more than it takes. With a part are the positions of the right
    rows that can be nearest to one of it; none is all of them.

    Rings widen twofold from the mean distance of right rows, and only positions that have found
    nothing go into the next. In a ring one right row stands for those in each of its buckets, an
    eighth of the ring wide, so that a position meets a bounded number of them however crowded
    they are. A position at distance d from its nearest row is done once a ring is 1.6 d wide: after
    as many rounds as the logarithm of the widest gap over the mean one. Positions without a row
    within `limit` may be left out. What is far from all rows has only those on their outskirts to
    choose from, see `_exposed`.
    """
    spark = left.sparkSession
    at = ["at_ra", "at_dec"]
    todo = kept(_placed(left.select(*map(_quoted, left_position)), *left_position).select(*_HERE).distinct().toDF(*at), "unmatched")
    spots = kept(_placed(right.select(*map(_quoted, right_position)), *right_position).select(*_HERE).distinct(), "spots")
    number = spots.count()
    close = spark.createDataFrame([], "at_ra double, at_dec double, __near double")
    if not number:
        return [(close, None)]
    parts, rings, widest = [], 0, min(180.0, max(FINEST_ZONE, 2.0 * limit))
    radius = min(widest, max(FINEST_ZONE, 2.0 * math.sqrt(_SKY / number)))
    while not todo.isEmpty():
        few = _home(spots, radius / _ACROSS, 0).groupBy(_KEY).agg(F.min(F.struct(*_HERE)).alias("spot"))
        few = kept(few.select(F.col("spot")[_HERE[0]].alias("ra"), F.col("spot")[_HERE[1]].alias("dec")), "ring")
        near = crossmatch(todo, few, radius, left_position=at, separation="__near")
        # Wider by a rounding, so that the row itself is within.
        near = near.groupBy(*at).agg((F.min("__near") * (1 + 1e-12) + PAD).alias("__near"))
        near = kept(near, "reach")
        rings += 1
        if rings <= _NEAR_RINGS:
            close = close.unionByName(near)
        elif not near.isEmpty():
            # On a grid of its own, as wide as the ring.
            parts.append((near, spots))
        if radius >= widest:
            break
        todo = kept(todo.join(near, at, "left_anti"), "unmatched")
        if rings == _NEAR_RINGS and not todo.isEmpty():
            spots = kept(_exposed(spots, _AROUND * radius), "exposed")
        radius = min(widest, 2.0 * radius)
    return [(close, None), *parts]


def _exposed(spots: DataFrame, around: float) -> DataFrame:
    """The positions that have no other one, within `around`, in each of the six sectors of a sixth
    of a turn about them.

    The others are not the nearest to anything further away than `around`: whatever way that is,
    another position lies in its sector, at most a sixth of a turn off its direction and not as far,
    and so is nearer to it. One position stands for those of a bucket, which leaves out none that
    should stay, and bounds what a position meets.
    """
    few = _home(spots, around / 4, 0).groupBy(_KEY).agg(F.min(F.struct(*_HERE)).alias("spot"))
    few = kept(few.select(*[F.col("spot")[name].alias(name) for name in _HERE]), "ring")
    finest, [(few, level, _)] = _with_radius(few, around)
    pairs = _joined(_probe(few, finest), _home(spots, finest, level), [], False, True, HOT_ROWS, False)
    (ra, dec), (at_ra, at_dec) = [f"__h{name}" for name in _HERE], _HERE
    turn, low, high = f"radians({at_ra} - {ra})", f"radians({dec})", f"radians({at_dec})"
    north = f"sin({high} - {low}) + 2 * sin({low}) * cos({high}) * pow(sin({turn} / 2), 2)"
    sector = f"CAST(floor(pmod(degrees(atan2(sin({turn}) * cos({high}), {north})), 360D) / 60D) AS INT) % 6"
    # What is hardly apart has no direction.
    apart = distance(_HERE, (ra, dec)) > 1e-6
    seen = pairs.where(apart).groupBy(ra, dec).agg(F.expr(f"bit_or(shiftleft(1, {sector}))").alias("sectors"))
    inner = seen.where(f"sectors = {_ENCLOSED}").toDF(*_HERE, "sectors")
    return spots.join(inner, list(_HERE), "left_anti")


def _quoted(name: str) -> Column:
    return F.col(quoted(name))


def _within_reach(left: DataFrame, right: DataFrame, radius, **options) -> DataFrame:
    """The pairs of every left row with right rows, within `radius` if there is one, among which its
    nearest is, and few others."""
    at, there = options.get("left_position", ("ra", "dec")), options.get("right_position", ("ra", "dec"))
    limit, most = 180.0, "__near"
    if isinstance(radius, (int, float)):
        if not math.isfinite(radius) or radius < 0:
            raise ValueError("a radius is a number of degrees, not negative")
        limit, most = min(180.0, float(radius)), f"least(__near, {float(radius)!r}D)"
    elif radius is not None:
        own = number(radius)
        left = left.withColumn("__own", F.when((own >= 0.0) & ~F.isnan(own), F.least(own, F.lit(180.0)))).where("__own IS NOT NULL")
        limit, most = left.agg(F.max("__own")).first()[0] or 0.0, "least(__near, __own)"
    names = [name for name in left.columns if name != "__own"]
    pairs = None
    for reach, spots in _reach_of(left, right, at, there, limit):
        same = [F.col(f"placed.{here}") == F.col(f"reach.{found}") for here, found in zip(_HERE, ("at_ra", "at_dec"))]
        joined = _placed(left, *at).alias("placed").join(reach.alias("reach"), same[0] & same[1])
        rows = joined.withColumn("__near", F.expr(most)).select(*[F.col(f"placed.`{name}`") for name in names], "__near")
        near = right
        if spots is not None:
            near = _placed(right, *there).join(spots, list(_HERE), "left_semi").select(*map(_quoted, right.columns))
        if spots is None:
            found = crossmatch(rows, near, "__near", **options).drop("__near")
        else:
            found = _matched(rows, near, "__near", small_right=True, **options).drop("__near")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def nearest_match(
    left: DataFrame,
    right: DataFrame,
    radius=None,
    *,
    key: list[str] | str,
    tie: str,
    separation: str = "separation",
    suffix: str = "_2",
    **options,
) -> DataFrame:
    """The nearest right row of every left row that has one, ties to the smallest `tie`.

    `radius` is a number or a column of the left side; without one the nearest row is found at any
    distance. Either way widening rings tell first how far a row has to look, so that its pairs are
    a few whatever number of rows is within the radius. A minimum over a struct, and not a window:
    partial minima are taken before the shuffle, so a left row with very many right rows in one place
    never has them all in one task. `key`
    need not tell the left rows apart: rows that share it are kept apart by their other columns, and
    copies of a row are counted first and written out again. Maps among the left columns are refused.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in left.schema.fields):
        raise ValueError("a left row with a map in it cannot be told from its copies")
    own = left.columns
    left = left.groupBy(*[F.col(f"`{name}`") for name in left.columns]).agg(F.count("*").alias("__copies"))
    if radius is None or not options.get("small_left"):
        pairs = _within_reach(left, right, radius, separation=separation, suffix=suffix, **options)
    else:
        pairs = crossmatch(left, right, radius, separation=separation, suffix=suffix, **options)
    names = _unique(right.columns, left.columns, suffix)
    first = [separation, names[tie]]
    rest = [name for name in names.values() if name not in first]
    best = F.min(F.struct(*[F.col(f"`{name}`") for name in first + rest])).alias("__best")
    apart = F.xxhash64(*[F.col(f"`{name}`") for name in left.columns]).alias("__row")
    others = [F.first(F.col(f"`{name}`")).alias(name) for name in left.columns if name not in keys]
    grouped = pairs.groupBy(*[F.col(f"`{name}`") for name in keys], apart).agg(*others, best)
    return grouped.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(
        *[F.col(f"`{name}`") for name in own],
        *[F.col(f"__best.`{names[name]}`").alias(names[name]) for name in right.columns],
        F.col(f"__best.`{separation}`").alias(separation),
    )


def where_any_circle(
    df: DataFrame,
    circles: DataFrame,
    *,
    position: tuple[str, str] = ("ra", "dec"),
    circle: tuple[str, str, str] = ("ra", "dec", "radius"),
    split_hot: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of `df` in any circle of a table of circles, each row once.

    A semi-join, so `df` is the side with one bucket per row. A hot bucket of `df` is split; the
    circles are copied to its parts. Only three numbers of a circle travel, so a list of them
    that measures small is broadcast and `df` is not shuffled at all. Where radii differ by so
    much that they need several levels, the test is an OR of EXISTS, one per level, in one pass.
    """
    ra, dec, radius = circle
    given = circles.select(
        number(ra).alias("__cra"), number(dec).alias("__cdec"), number(radius).alias("__cradius")
    ).distinct()
    finest = FINEST_ZONE
    disks = _placed(_leveled(given, number("__cradius")), "__cra", "__cdec")
    # One job says all that is to be known of the circles.
    south, north = F.col(_HERE[1]) - F.col("__radius"), F.col(_HERE[1]) + F.col("__radius")
    seen = disks.agg(
        F.count("*").alias("n"),
        F.collect_set("__level").alias("levels"),
        F.min(south).alias("south"),
        F.max(north).alias("north"),
        F.max(F.abs(F.col(_HERE[1])) + F.col("__radius")).alias("polar"),
    ).first()
    levels = sorted(seen.levels) or [0]
    probe = _probe(disks, finest, keep_level=True)
    listed = seen.n * PROBED <= BROADCAST_ROWS if (seen.polar or 0.0) < 80.0 else small(probe)
    # No position past what the circles span; one written past a pole is left to the test.
    if seen.n:
        low, high = seen.south - PAD, seen.north + PAD
        span = dec_between(df, dec_of := position[1], low, high)
        if span is not None:
            df = df.where(f"({span}) OR {quoted(dec_of)} > 90 OR {quoted(dec_of)} < -90")
    # Named apart from the circles' own: an outer reference whose name the subquery also knows,
    # even in a projection further down, would be resolved to that.
    home = _placed(df, *position).selectExpr("*", f"{_HERE[0]} AS __at_ra", f"{_HERE[1]} AS __at_dec")
    tests = []
    for level in levels:
        here = _home(home, finest, level)
        at = probe.where(F.col("__level") == level)
        hot = HotKeys()
        if split_hot and not listed and not df.isStreaming:
            hot = hot_keys(at.limit(0), here, _KEY, hot_rows)
        at = salted(at, _KEY, hot, "left")
        own = [f"__key{level}", f"__salt{level}", "__at_ra", "__at_dec"]
        home = salted(here, _KEY, hot, "right").withColumnsRenamed(
            {_KEY: own[0], "__rsalt": own[1]}
        ).drop("__lsalt")
        key, salt, here_ra, here_dec = (F.col(name).outer() for name in own)
        at = at.select(*[F.col(n).alias(f"__c{n}") for n in (_KEY, "__rsalt", *_HERE)], "__radius")
        disk = [F.col(f"__c{name}") for name in _HERE]
        on = (F.col(f"__c{_KEY}") == key) & _residual(disk, (here_ra, here_dec), False)
        if hot:
            on = on & (F.col("__c__rsalt") == salt)
        tests.append((F.broadcast(at) if listed else at).where(on).exists())
    return home.where(any_of(tests)).select(*[F.col(f"`{name}`") for name in df.columns])
