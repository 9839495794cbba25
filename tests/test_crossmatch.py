from __future__ import annotations

import math

import pytest
from conftest import awkward_points, known, separation
from pyspark.sql import functions as F

from skyframe.operators import crossmatch as module
from skyframe.operators import skew
from skyframe.operators.crossmatch import crossmatch, nearest_match, where_any_circle
from skyframe.operators.skew import hot_keys, salted, small

LEFT = awkward_points(120, seed=1)
RIGHT = [(1000 + i, p) for i, p in awkward_points(120, seed=2)] + [(9000, (10.0, 95.0)), (9001, (190.0, 85.0))]


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(i, *p) for i, p in LEFT], "id int, ra double, dec double")
    right = spark.createDataFrame([(i, *p) for i, p in RIGHT], "rid int, ra double, dec double")
    return left, right


def brute(radius_of, left=LEFT, right=RIGHT):
    pairs = set()
    for i, a in left:
        for j, b in right:
            if known(a) and known(b) and separation(a, b) <= radius_of(i):
                pairs.add((i, j))
    return pairs


def pairs_of(df):
    rows = [(row.id, row.rid) for row in df.select("id", "rid").collect()]
    assert len(rows) == len(set(rows)), "a pair came out twice"
    return set(rows)


@pytest.mark.parametrize("radius", [0.3, 1.5, 25.0])
def test_pairs_are_those_of_every_pair(sides, radius):
    assert pairs_of(crossmatch(*sides, radius)) == brute(lambda _: radius)


@pytest.mark.parametrize("hot_rows", [1, 7])
def test_splitting_hot_buckets_changes_nothing(sides, hot_rows):
    assert pairs_of(crossmatch(*sides, 1.5, hot_rows=hot_rows)) == brute(lambda _: 1.5)


def test_radius_from_a_column(sides):
    left, right = sides
    radii = F.expr("CASE WHEN id % 50 = 0 THEN 30D WHEN id % 3 = 0 THEN 0D ELSE 0.01D * (id % 40) END")
    wanted = brute(lambda i: 30.0 if i % 50 == 0 else 0.0 if i % 3 == 0 else 0.01 * (i % 40))
    assert pairs_of(crossmatch(left.withColumn("r", radii), right, "r")) == wanted
    assert pairs_of(crossmatch(left.withColumn("r", radii), right, "r", hot_rows=3)) == wanted


def test_a_list_measured_small_is_broadcast(sides, monkeypatch):
    listed = crossmatch(*sides, 1.5, small_left=True)
    assert "BroadcastHashJoin" in listed._jdf.queryExecution().executedPlan().toString()
    assert pairs_of(listed) == brute(lambda _: 1.5)
    monkeypatch.setattr(module, "small", lambda *a, **k: False)
    assert pairs_of(crossmatch(*sides, 1.5, small_left=True)) == brute(lambda _: 1.5)


def test_a_third_of_all_rows_in_one_place(spark):
    left = spark.range(0, 600).selectExpr("id", "if(id % 3 = 0, 10D, id * 0.59D) AS ra", "if(id % 3 = 0, 5D, id * 0.1D) AS dec")
    right = spark.range(0, 900).selectExpr("id AS rid", "if(id % 3 = 0, 10D, id * 0.4D) AS ra", "if(id % 3 = 0, 5D, id * 0.1D) AS dec")
    plain = crossmatch(left, right, 0.5, split_hot=False).count()
    split = crossmatch(left, right, 0.5, hot_rows=50)
    assert plain == split.count() and plain > 60_000
    assert split.select("id", "rid").distinct().count() == plain


def test_copies_of_a_row_are_parted_and_all_there(spark, monkeypatch):
    """Nothing tells a third of the rows apart, on either side."""
    monkeypatch.setattr(skew, "COPIES", 20)
    left = spark.range(0, 300).selectExpr("if(id % 3 = 0, -1L, id) AS id", "if(id % 3 = 0, 10D, id * 0.59D) AS ra", "5D AS dec")
    right = spark.range(0, 240).selectExpr("if(id % 3 = 0, -1L, id) AS rid", "if(id % 3 = 0, 10D, id * 0.4D) AS ra", "5D AS dec")
    plain = crossmatch(left, right, 0.3, split_hot=False)
    split = crossmatch(left, right, 0.3, hot_rows=15)
    wanted = {tuple(row) for row in plain.groupBy("id", "rid").count().collect()}
    assert (-1, -1, 8000) in wanted
    assert {tuple(row) for row in split.groupBy("id", "rid").count().collect()} == wanted
    assert split.columns == plain.columns and split.schema == plain.schema


def test_a_hot_key_is_found_and_split(spark):
    df = spark.range(0, 9000).selectExpr("id", "if(id % 3 = 0, -1L, id) AS k")
    found = hot_keys(df, df, "k", hot_rows=500)
    assert [tuple(r) for r in found.table.select("key", "__lways", "__rways").collect()] == [(-1, 6, 6)]
    left, right = salted(df, "k", found, "left"), salted(df, "k", found, "right")
    assert left.where("k = -1").select("__lsalt").distinct().count() == 6
    largest = left.where("k = -1").groupBy("__lsalt", "__rsalt").count().agg(F.max("count")).first()[0]
    assert largest < 800
    joined = left.alias("a").join(right.alias("b"), ["k", "__lsalt", "__rsalt"])
    assert joined.count() == 3000 * 3000 + 6000


def test_strict_leaves_the_edge_out(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "id int, ra double, dec double")
    right = spark.createDataFrame([(2, 0.0, 0.0), (3, 0.0, 0.5)], "rid int, ra double, dec double")
    assert pairs_of(crossmatch(left, right, 0.0)) == {(1, 2)}
    assert pairs_of(crossmatch(left, right, 0.0, strict=True)) == set()


def test_nearest(sides):
    best = {}
    for i, a in LEFT:
        for j, b in RIGHT:
            if known(a) and known(b) and (d := separation(a, b)) <= 3.0:
                best[i] = min(best.get(i, math.inf), d)
    got = nearest_match(*sides, 3.0, key="id", tie="rid").collect()
    assert {row.id for row in got} == set(best)
    assert all(abs(row.separation - best[row.id]) < 1e-9 for row in got)


def test_columns_that_both_sides_have(sides):
    assert crossmatch(*sides, 1.0).columns == ["id", "ra", "dec", "rid", "ra_2", "dec_2", "separation"]


@pytest.mark.parametrize("listed", [True, False])
@pytest.mark.parametrize("hot_rows", [2, 100_000])
def test_any_of_many_circles(sides, spark, monkeypatch, listed, hot_rows):
    if not listed:
        monkeypatch.setattr(module, "small", lambda *a, **k: False)
    _, right = sides
    circles = [(p[0], p[1], 0.2 if i % 9 else 12.0) for i, p in LEFT if known(p)]
    table = spark.createDataFrame(circles * 2, "ra double, dec double, radius double")
    got = [row.rid for row in where_any_circle(right, table, hot_rows=hot_rows).select("rid").collect()]
    assert len(got) == len(set(got))
    wanted = {j for j, b in RIGHT if known(b) and any(separation((ra, dec), b) <= r for ra, dec, r in circles)}
    assert set(got) == wanted


def test_small_measures_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text")
    assert small(df)
    assert not small(df, max_rows=99)
    assert not small(df, max_bytes=50_000)


@pytest.mark.parametrize("wide", [5, 0])
def test_radii_of_all_sizes(sides, spark, monkeypatch, wide):
    """A few wide disks are handed out on a grid of their own; with none allowed, all share one."""
    monkeypatch.setattr(module, "BROADCAST_ROWS", wide * module.PROBED)
    left, right = sides
    radius = lambda i: 40.0 if i in (3, 77) else 0.002 * (i % 300)
    given = left.withColumn("r", F.expr("if(id IN (3, 77), 40D, 0.002D * (id % 300))"))
    assert pairs_of(crossmatch(given, right, "r")) == brute(radius)


def test_the_right_side_is_not_copied(spark):
    df = spark.range(0, 500).selectExpr("id", "id * 0.7D AS ra", "id * 0.1D AS dec")
    for level in (0, 4, 9):
        home = module._home(module._placed(df, "ra", "dec"), module.FINEST_ZONE, level)
        assert home.count() == 500 and home.select("id").distinct().count() == 500


def test_left_rows_that_share_a_key_or_all(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0, "a"), (1, 20.0, 0.0, "b"), (1, 20.0, 0.0, "b"), (2, 50.0, 0.0, "c")], "id int, ra double, dec double, tag string")
    right = spark.createDataFrame([(7, 10.1, 0.0), (8, 20.2, 0.0), (9, 20.1, 0.0)], "rid int, ra double, dec double")
    got = nearest_match(left, right, 1.0, key="id", tie="rid")
    assert sorted((r.id, r.tag, r.rid) for r in got.collect()) == [(1, "a", 7), (1, "b", 9), (1, "b", 9)]
    assert got.columns == ["id", "ra", "dec", "tag", "rid", "ra_2", "dec_2", "separation"]


def test_a_row_without_a_radius_is_in_no_pair(sides):
    left, right = sides
    radii = F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') WHEN 2 THEN -1D ELSE 1D END")
    wanted = brute(lambda i: 1.0 if i % 4 == 3 else -1.0)
    assert pairs_of(crossmatch(left.withColumn("r", radii), right, "r")) == wanted


def test_a_negative_radius_is_refused(sides):
    with pytest.raises(ValueError):
        crossmatch(*sides, -1.0)


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 7])
def test_the_nearest_at_any_distance(spark, sides, hot_rows):
    """Isolated rows, poles, the seam and crowded fields; copies, and rows without a position."""
    left, right = sides
    far = [(i, p) for i, p in RIGHT if known(p) and p[1] > 84 and abs(p[0] % 360 - 10) < 4] + [(5000, (120.0, 20.0)), (5001, (120.0, 20.0))]
    for rows in (RIGHT, far):
        table = spark.createDataFrame([(i, *p) for i, p in rows], "rid int, ra double, dec double")
        got = nearest_match(left.union(left.where("id < 9")), table, key="id", tie="rid", hot_rows=hot_rows).collect()
        want = {}
        for i, a in LEFT:
            if known(a):
                want[i] = min((round(separation(a, b), 9), j) for j, b in rows if known(b))
        assert len(got) == len(want) + sum(i < 9 for i in want)
        for row in got:
            assert abs(row.separation - want[row.id][0]) < 2e-9
            tied = [j for j, b in rows if known(b) and abs(separation(dict(LEFT)[row.id], b) - row.separation) < 1e-9]
            assert row.rid in tied
    none = right.limit(0)
    assert nearest_match(left, none, key="id", tie="rid").count() == 0
    assert nearest_match(left.limit(0), right, key="id", tie="rid").count() == 0


def test_rings_are_as_many_as_the_gap_has_doublings(spark, sides, monkeypatch):
    """Ten thousand rows in one field, looked for from the other side of the sky."""
    field = spark.range(10_000).selectExpr("CAST(id AS INT) AS rid", "120 + (id % 100) * 0.01D AS ra", "20 + floor(id / 100) * 0.01D AS dec")
    left = spark.createDataFrame([(1, 300.0, -20.0), (2, 120.001, 20.001), (3, 125.0, 20.0)], "id int, ra double, dec double")
    rounds, pairs = [], module.crossmatch

    def counted(one, other, radius, **options):
        rounds.append(radius)
        found = pairs(one, other, radius, **options)
        if isinstance(radius, float):
            assert found.count() <= 3 * 1000
        return found

    monkeypatch.setattr(module, "crossmatch", counted)
    got = {row.id: (row.rid, round(row.separation, 6)) for row in nearest_match(left, field, key="id", tie="rid").collect()}
    assert got[2] == (0, round(separation((120.001, 20.001), (120.0, 20.0)), 6))
    every = [(i, (120 + (i % 100) * 0.01, 20 + (i // 100) * 0.01)) for i in range(10_000)]
    for i, at in ((1, (300.0, -20.0)), (3, (125.0, 20.0))):
        assert abs(got[i][1] - min(separation(at, p) for _, p in every)) < 1e-5
    assert len(rounds) <= 3 + math.log2(180 / rounds[0])


@pytest.mark.parametrize("radius", [2.0, "r"])
def test_the_nearest_within_a_radius_meets_few_of_very_many(spark, monkeypatch, radius):
    """Two thousand rows are within the radius of each row; one is too far from all of them."""
    field = spark.range(2_000).selectExpr("CAST(id AS INT) AS rid", "120 + (id % 50) * 0.01D AS ra", "20 + floor(id / 50) * 0.01D AS dec")
    left = spark.createDataFrame([(i, 120.2 + i * 0.003, 20.1, 2.0) for i in range(5)] + [(9, 125.0, 20.0, 2.0)], "id int, ra double, dec double, r double")
    pairs, most = module.crossmatch, []

    def counted(*given, **options):
        found = pairs(*given, **options)
        most.append(found.count())
        return found

    monkeypatch.setattr(module, "crossmatch", counted)
    got = {row.id: row.separation for row in nearest_match(left, field, radius, key="id", tie="rid").collect()}
    every = [(120 + (i % 50) * 0.01, 20 + (i // 50) * 0.01) for i in range(2_000)]
    assert sorted(got) == [0, 1, 2, 3, 4] and max(most) < 5 * 1_000
    assert all(abs(got[i] - min(separation((120.2 + i * 0.003, 20.1), p) for p in every)) < 1e-9 for i in got)
