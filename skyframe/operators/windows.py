"""Window functions that no one group can hold up.

Spark's own window gives a whole group to one task. That is what is used while no group is hot.
Where one holds more rows than a task should, rows are cut by range of (group, order) into pieces,
the window runs inside each piece, and a summary of the pieces, one row each, supplies what came
before. That numbers the rows. A function that looks a bounded number of rows back and ahead then
runs in stretches of numbers, each with as many of its neighbours' rows as the function can see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyframe.operators.skew import HOT_ROWS, lookup
from skyframe.sources.files import shared_folder


def has_hot_group(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether a group holds more rows than one task should be given. Counted before the shuffle."""
    return not df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).isEmpty()


def windowed(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    columns: dict[str, Callable[[WindowSpec], Column]],
    frame: tuple[int, int] | None = None,
    reach: tuple[int, int] = (0, 0),
    ends: dict[str, tuple[str, str]] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`df` with, for each name, what a function makes of a window over the group in `order`.

    `frame` is ROWS BETWEEN these offsets, negative before the row. Without one, `reach` says how
    many rows before and after it the functions look at, as LAG and LEAD do. `ends` names columns
    that hold the first or last value of the group: name to ("first" or "last", value). Any order
    keys, directions and null order; the order has to tell the rows of a group apart.
    """
    ends = ends or {}
    before, after = reach if frame is None else (max(0, -frame[0]), max(0, frame[1]))
    if not has_hot_group(df, keys, hot_rows):
        plain = Window.partitionBy(*keys).orderBy(*order)
        whole = plain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = plain if frame is None else plain.rowsBetween(*frame)
        at = {"first": F.first, "last": F.last}
        made = {name: make(own) for name, make in columns.items()}
        return df.withColumns({**made, **{name: at[which](value).over(whole) for name, (which, value) in ends.items()}})
    rows = numbered(df, keys, order, "__rn", hot_rows)
    # A stretch of numbers, and every stretch that can see the row.
    stretch = lambda shift: F.floor((F.col("__rn") - 1 + shift) / hot_rows)
    seen = F.sequence(F.greatest(stretch(-after), F.lit(0).cast("bigint")), stretch(before))
    parts = rows.withColumns({"__own": stretch(0), "__part": F.explode(seen)})
    inside = Window.partitionBy(*keys, "__part").orderBy("__rn")
    own = inside if frame is None else inside.rowsBetween(*frame)
    done = parts.withColumns({name: make(own) for name, make in columns.items()})
    done = done.where(F.col("__part") == F.col("__own")).drop("__own", "__part")
    if ends:
        at = {"first": F.min_by, "last": F.max_by}
        values = [at[which](value, "__rn").alias(name) for name, (which, value) in ends.items()]
        done = lookup(done, rows.groupBy(*keys).agg(*values), keys, hot_rows)
    return done.drop("__rn")


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`df` with, for each name, the sum of a value over its group up to and with the row, in
    `order`. The order has to tell the rows of a group apart: rows that tie are in one piece.
    """
    if not has_hot_group(df, keys, hot_rows):
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(so_far) for name, value in sums.items()})
    names = df.columns
    rows = df.withColumns({f"__v_{name}": value for name, value in sums.items()})
    # Written, and not only planned: the cut points are drawn from the data, and both uses of the
    # pieces below have to see the same ones, also after a lost executor.
    path = shared_folder(df.sparkSession, "pieces")
    # As many as the rows ask for: adaptive execution would merge them into as many as their bytes do.
    cuts = max(2, -(-rows.count() // hot_rows))
    rows.repartitionByRange(cuts, *keys, *order).withColumn("__piece", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    at = [*keys, "__piece"]
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*at).agg(*[F.sum(f"__v_{name}").alias(name) for name in sums])
    pieces = pieces.select(
        *at, F.count("*").over(earlier).alias("__nth"), *[F.sum(name).over(earlier).alias(f"__b_{name}") for name in sums]
    )
    # Only a group that a cut goes through has a piece with another before it, so there are fewer
    # of these than there are cuts, and as few whatever the data: broadcast by that bound.
    pieces = F.broadcast(pieces.where("__nth > 0")).alias("p")
    rows = rows.withColumns({f"__i_{name}": F.sum(f"__v_{name}").over(inside) for name in sums}).alias("r")
    same = [F.col(f"r.{key}").eqNullSafe(F.col(f"p.{key}")) for key in at]
    # Null as long as no value has been seen, in this piece or before it.
    totals = [
        F.coalesce(F.col(f"__i_{name}") + F.col(f"__b_{name}"), f"__i_{name}", f"__b_{name}").alias(name) for name in sums
    ]
    return rows.join(pieces, same, "left").select(*[F.col(f"r.`{column}`") for column in names], *totals)


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    return running_sums(df, keys, order, {name: value}, hot_rows)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", hot_rows: int = HOT_ROWS) -> DataFrame:
    """`ROW_NUMBER` over the group."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, hot_rows)


def ranked(
    df: DataFrame, keys: list[str], by: Column | list[str], hot_rows: int = HOT_ROWS, order: list[Column] | None = None
) -> DataFrame:
    """`RANK` and `DENSE_RANK` of each row as `rk` and `dr`, ties in `by` alike.

    `by` is a value, ascending, or names of columns that `order` puts in an order of its own, of
    any direction and null order. Where a group is hot, ties are counted before anything is
    ordered, so however many there are they are one row.
    """
    names = by if isinstance(by, list) else ["__by"]
    df = df if isinstance(by, list) else df.withColumn("__by", by)
    order = order or [F.col(f"`{name}`") for name in names]
    if not has_hot_group(df, keys, hot_rows):
        w = Window.partitionBy(*keys).orderBy(*order)
        # As the branch below has them, so that which one ran does not show in the types.
        ranks = {"rk": F.rank().over(w).cast("bigint"), "dr": F.dense_rank().over(w).cast("bigint")}
        return df.withColumns(ranks).drop("__by")
    levels = df.groupBy(*keys, *names).agg(F.count("*").alias("__n"))
    sums = {"__upto": F.col("__n"), "dr": F.lit(1).cast("bigint")}
    levels = running_sums(levels, keys, order, sums, hot_rows)
    levels = levels.select(*keys, *names, (F.col("__upto") - F.col("__n") + 1).alias("rk"), "dr")
    return lookup(df, levels, list(dict.fromkeys([*keys, *names])), hot_rows).drop("__by")


def with_group_size(df: DataFrame, keys: list[str], name: str = "size", hot_rows: int = HOT_ROWS) -> DataFrame:
    """`COUNT(*)` over the group, counted before anything is shuffled."""
    return lookup(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys, hot_rows)


def tile(number: Column, size: Column, parts: int) -> Column:
    """`NTILE(parts)` of a row's number in a group of a size: the first tiles take the remainder."""
    least, over = F.floor(size / parts), size % parts
    wide = over * (least + 1)
    in_wide = F.floor((number - 1) / (least + 1)) + 1
    return F.when(number <= wide, in_wide).otherwise(over + F.floor((number - 1 - wide) / F.greatest(least, F.lit(1))) + 1)


def _beside(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with the column `name` of the row of `others` that has the same keys, null being one."""
    on = [F.col(f"r.`{key}`").eqNullSafe(F.col(f"o.`{key}`")) for key in keys]
    joined = rows.alias("r").join(others.alias("o"), on, "left")
    return joined.select(*[F.col(f"r.`{column}`") for column in rows.columns], F.col(f"o.`{name}`"))


def frame_sum(
    rows: DataFrame, keys: list[str], value: str, preceding: int, name: str, number: str = "rn", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`SUM(value)` over the row and the `preceding` before it, of numbered rows."""
    sums = {name: lambda w: F.sum(value).over(w)}
    return windowed(rows, keys, [F.col(number)], sums, frame=(-preceding, 0), hot_rows=hot_rows)


def range_count(
    df: DataFrame, keys: list[str], row: str, value: str, below: float, above: float, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`COUNT(*)` over the rows of the group whose value is within `below` and `above` of a row's.

    Two running counts, read where the range begins and where it ends. No row is paired with
    another: each is a point and the two ends of its own range, on one line.
    """
    ends = F.array(
        # A range begins before the points at its beginning, and ends after those at its end.
        F.struct((F.col(value) - below).alias("at"), F.lit(0).alias("kind")),
        F.struct(F.col(value).alias("at"), F.lit(1).alias("kind")),
        F.struct((F.col(value) + above).alias("at"), F.lit(2).alias("kind")),
    )
    line = df.select(*keys, row, F.explode(ends).alias("e")).select(*keys, row, "e.at", "e.kind")
    order = [F.col("at"), F.col("kind"), F.col(row)]
    points = F.when(F.col("kind") == 1, 1).otherwise(0).cast("bigint")
    line = running_sum(line, keys, order, points, "__upto", hot_rows)
    sign = F.when(F.col("kind") == 2, F.col("__upto")).when(F.col("kind") == 0, -F.col("__upto"))
    return line.groupBy(*keys, row).agg(F.sum(sign).alias(name))


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "median", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The exact median of each group: the middle of its counted values, copies counted first.

    Null is a group as any other, and a group without a value has a null median.
    """
    every = df.groupBy(*keys).agg(F.count(value).alias("__all"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    counts = running_sum(counts, keys, [F.col(value)], F.col("__n"), "__upto", hot_rows)
    counts = lookup(counts, every, keys, hot_rows)
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1

    def holds(position: Column) -> Column:
        return (F.col("__upto") >= position) & (F.col("__upto") - F.col("__n") < position)

    middle = counts.where(holds(low) | holds(high))
    weight = F.when(holds(low) & holds(high), 2).otherwise(1)
    found = middle.groupBy(*keys).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(name))
    return _beside(every.drop("__all"), found, keys, name)
