"""Windows with a group that is cut into pieces, against Spark's own."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyframe.operators import sets, skew, windows
from skyframe.operators.windows import (
    frame_sum,
    group_median,
    has_hot_group,
    numbered,
    range_count,
    ranked,
    running_sum,
    tile,
    windowed,
    with_group_size,
)
from skyframe.sources.files import shared_folder

HOT = 40


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, one group of nulls, and values that tie."""
    return spark.range(0, 900).selectExpr(
        "id", "if(id % 3 = 0, -1L, nullif(id % 11, 4)) AS k", "(id * 37) % 50 AS v", "id % 5 AS w"
    )


def table(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=str)


def test_a_hot_group_is_seen(rows):
    assert has_hot_group(rows, ["k"], HOT)
    assert not has_hot_group(rows, ["k"], 1000)
    assert not has_hot_group(rows.limit(0), ["k"], HOT)


@pytest.mark.parametrize("hot_rows", [HOT, 10_000])
def test_running_sums_and_numbers(rows, hot_rows):
    order = [F.col("v").desc(), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = rows.select("id", F.sum("w").over(w).alias("s"))
    assert table(running_sum(rows, ["k"], order, F.col("w"), "s", hot_rows), "id", "s") == table(wanted, "id", "s")
    number = rows.select("id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).alias("rn"))
    assert table(numbered(rows, ["k"], order, hot_rows=hot_rows), "id", "rn") == table(number, "id", "rn")


@pytest.mark.parametrize("hot_rows", [HOT, 5, 10_000])
def test_ranks_with_ties(rows, hot_rows):
    w = Window.partitionBy("k").orderBy("v")
    wanted = rows.select("id", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))
    assert table(ranked(rows, ["k"], F.col("v"), hot_rows), "id", "rk", "dr") == table(wanted, "id", "rk", "dr")


@pytest.mark.parametrize("hot_rows", [HOT, 10_000])
def test_neighbours_and_frames(rows, hot_rows):
    order = [F.col("v"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    wanted = rows.select(
        "id",
        F.sum("w").over(w.rowsBetween(-3, 0)).alias("frame"),
        F.ntile(7).over(w).alias("tile"),
    )
    got = numbered(rows, ["k"], order, hot_rows=hot_rows)
    got = frame_sum(got, ["k"], "w", 3, "frame")
    got = with_group_size(got, ["k"], hot_rows=hot_rows)
    got = got.withColumn("tile", tile(F.col("rn"), F.col("size"), 7))
    names = ["id", "frame", "tile"]
    assert table(got, *names) == table(wanted, *names)


@pytest.mark.parametrize("hot_rows", [HOT, 10_000])
def test_counts_over_a_range_of_values(rows, hot_rows):
    w = Window.partitionBy("k").orderBy("v").rangeBetween(-4, 6)
    wanted = rows.select("id", F.count("*").over(w).alias("n"))
    got = range_count(rows, ["k"], "id", "v", 4, 6, "n", hot_rows)
    assert table(got, "id", "n") == table(wanted, "id", "n")


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_medians(rows, hot_rows):
    rows = rows.selectExpr("id", "k", "if(k = 5, NULL, v) AS v", "w")
    wanted = rows.groupBy("k").agg(F.median("v").alias("m"))
    assert table(group_median(rows, ["k"], "v", "m", hot_rows), "k", "m") == table(wanted, "k", "m")


@pytest.mark.parametrize("hot_rows", [HOT, 10_000])
@pytest.mark.parametrize("frame", [(-3, 0), (1, 4), (-2, 2), (-7, -3)])
def test_any_function_and_frame(rows, hot_rows, frame):
    order = [F.col("w").desc(), F.expr("nullif(v, 7)").asc_nulls_last(), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    inside = w.rowsBetween(*frame)
    wanted = rows.select(
        "id",
        F.max("v").over(inside).alias("high"),
        F.collect_list("id").over(inside).alias("seen"),
        F.lag("v", 3).over(w).alias("before"),
        F.lead("v", 2).over(w).alias("after"),
        F.first("id").over(w).alias("first"),
        F.last("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
    )
    framed = {"high": lambda x: F.max("v").over(x), "seen": lambda x: F.collect_list("id").over(x)}
    shifts = {"before": lambda x: F.lag("v", 3).over(x), "after": lambda x: F.lead("v", 2).over(x)}
    ends = {"first": ("first", "id"), "last": ("last", "id")}
    got = windowed(rows, ["k"], order, framed, frame=frame, hot_rows=hot_rows)
    got = windowed(got, ["k"], order, shifts, reach=(3, 2), ends=ends, hot_rows=hot_rows)
    names = ["id", "high", "seen", "before", "after", "first", "last"]
    assert table(got, *names) == table(wanted, *names)


def test_without_a_hot_group_it_is_one_exchange(rows):
    shifts = {"before": lambda x: F.lag("v").over(x), "after": lambda x: F.lead("v").over(x)}
    got = windowed(rows, ["k"], [F.col("id")], shifts, reach=(1, 1), ends={"first": ("first", "id")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_running_sums_of_nulls_are_alike_in_pieces(spark):
    rows = spark.range(0, 2000).selectExpr("id", "if(id % 4 = 1, NULL, id % 2) AS k", "if(id < 900 OR id % 3 = 0, NULL, id) AS v")
    order = [F.col("id")]
    plain = running_sum(rows, ["k"], order, F.col("v"), "s", 10_000)
    pieces = running_sum(rows, ["k"], order, F.col("v"), "s", 100)
    assert table(pieces, "id", "s") == table(plain, "id", "s")
    assert pieces.where("s IS NULL").count() >= 900


def test_a_hot_group_is_cut_into_pieces(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(windows, "shared_folder", lambda s, name: paths.append(shared_folder(s, name)) or paths[-1])
    rows = spark.range(0, 1000).selectExpr("id", "0 AS k")
    running_sum(rows, ["k"], [F.col("id")], F.lit(1), "n", 100)
    sizes = [r["count"] for r in spark.read.parquet(paths[0]).groupBy("__piece").count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= 400


@pytest.mark.parametrize("hot_rows", [5, 10_000])
@pytest.mark.parametrize("direction", ["desc", "asc_nulls_last", "desc_nulls_first"])
def test_ranks_in_any_direction(rows, hot_rows, direction):
    rows = rows.selectExpr("id", "k", "nullif(v, 3) AS v", "w")
    order = [getattr(F.col("v"), direction)(), F.col("w").desc()]
    w = Window.partitionBy("k").orderBy(*order)
    wanted = rows.select("id", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))
    got = ranked(rows, ["k"], ["v", "w"], hot_rows, order)
    assert table(got, "id", "rk", "dr") == table(wanted, "id", "rk", "dr")


def test_copies_under_a_hot_key_are_split(spark, monkeypatch):
    """A hundred thousand equal rows, and the largest task that a split of them has."""
    rows = spark.range(0, 100_000, 1, 8).selectExpr("7L AS k")
    other = spark.createDataFrame([(7, "seven"), (8, "eight")], "k long, name string")
    largest = []
    plain = skew.salted

    def watched(df, key, hot, side, own=None):
        out = plain(df, key, hot, side, own)
        if side == "left":
            largest.append(out.groupBy("__lsalt").agg(F.sum("__copies").alias("n")).collect())
        return out

    monkeypatch.setattr(skew, "salted", watched)
    found = skew.lookup(rows, other, ["k"], hot_rows=1000)
    assert found.groupBy("k", "name").count().collect() == [(7, "seven", 100_000)]
    assert len(largest[0]) == 100 and max(r.n for r in largest[0]) <= 1000


def test_many_keys_are_hot_at_once(spark):
    rows = spark.range(0, 300_000).selectExpr("id % 200 AS k")
    found = skew.hot_keys(rows, rows.limit(0), "k", hot_rows=10)
    ways = found.table.agg(F.count("*"), F.min("__lways"), F.max("__lways")).first()
    assert tuple(ways) == (200, 150, 150)


def test_comparisons_with_sets(spark):
    values = spark.createDataFrame([(v,) for v in (None, -1, 0, 3, 9)], "v int")
    for members in ([], [1], [1, 5], [1, None], [None], [5, 5, None]):
        chosen = spark.createDataFrame([(m,) for m in members], "m int")
        for sign in ("<", "<=", ">", ">="):
            for quantifier in ("ALL", "ANY"):
                got = [r[0] for r in values.select(sets.compared(F.col("v"), sign, quantifier, chosen)).collect()]
                for (v,), answer in zip(values.collect(), got):
                    each = [None if v is None or m is None else eval(f"{v} {sign} {m}") for m in members]
                    stop = quantifier == "ANY"
                    wanted = stop if stop in each else None if None in each else not stop
                    assert answer == wanted, (v, sign, quantifier, members)


def test_sets_with_copies(spark, rows, monkeypatch):
    monkeypatch.setattr(sets, "COPIES", 7)
    left, right = rows.select("k", "w"), rows.where("id % 2 = 0").selectExpr("k AS a", "(w + 1) % 5 AS b")
    for ours, theirs in (
        (sets.except_all(left, right), left.exceptAll(right)),
        (sets.intersect_all(left, right), left.intersectAll(right)),
        (sets.except_(left, right.where("a > 3")), left.subtract(right.where("a > 3"))),
        (sets.intersect(left, right), left.intersect(right)),
    ):
        assert table(ours, *ours.columns) == table(theirs, *theirs.columns)


@pytest.mark.parametrize("handed_out", [True, False])
def test_not_in_follows_nulls(spark, rows, monkeypatch, handed_out):
    monkeypatch.setattr(sets, "small", lambda _: handed_out)
    none, some = spark.sql("SELECT 1L AS x WHERE false"), spark.sql("SELECT 1L AS x")
    unknown = spark.sql("SELECT * FROM VALUES (1L), (NULL) AS t(x)")
    assert sets.not_in(rows, "k", none).count() == 900
    assert sets.not_in(rows, "k", unknown).count() == 0
    assert sets.not_in(rows, "k", some).count() == rows.where("k <> 1").count()
    assert sets.in_(rows, "k", unknown).count() == rows.where("k = 1").count()
    assert sets.in_(rows, "k", unknown).columns == rows.columns
