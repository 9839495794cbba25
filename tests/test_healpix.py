from __future__ import annotations

import math

import pytest
from conftest import awkward_points, known
from pyspark.sql import functions as F

from skyframe.functions.geometry import distance
from skyframe.functions.healpix import (
    cell_center,
    cell_count,
    cell_radius,
    end_index,
    first_index,
    healpix_index,
)
from skyframe.plans.inputs import sky_sql, with_position


@pytest.mark.parametrize("order", [0, 1, 2, 5])
def test_centres_are_in_their_cells(spark, order):
    cells = spark.range(cell_count(order)).withColumn("order", F.lit(order))
    ra, dec = cell_center(F.col("order"), F.col("id"))
    again = cells.select("id", ra.alias("ra"), dec.alias("dec")).withColumn("cell", healpix_index("ra", "dec", order))
    assert again.where("id <> cell").count() == 0
    assert again.where("cell IS NULL").count() == 0


def test_a_parent_is_two_bits_shorter_and_cells_are_of_equal_area(spark):
    sky = spark.range(0, 120_000).selectExpr(
        "360D * ((id * 0.5698402909980532D) % 1D) AS ra",
        "degrees(asin(2D * ((id * 0.7548776662466927D) % 1D) - 1D)) AS dec",
    )
    cells = sky.select(*[healpix_index("ra", "dec", order).alias(f"h{order}") for order in (0, 3, 29)])
    assert cells.where("shiftright(h29, 52) <> h3 OR shiftright(h3, 6) <> h0").count() == 0
    counts = [row["count"] for row in cells.groupBy("h0").count().collect()]
    assert len(counts) == 12 and max(counts) - min(counts) < 100


def test_a_point_is_within_the_cell_radius_of_its_cells_centre(spark):
    points = [(i, *p) for i, p in awkward_points(300) if known(p)]
    df = spark.createDataFrame(points, "id int, ra double, dec double")
    for order in (0, 2, 7):
        placed = df.withColumns({"cell": healpix_index("ra", "dec", order), "order": F.lit(order)}).checkpoint()
        ra, dec = cell_center(F.col("order"), F.col("cell"))
        placed = placed.select("order", "ra", "dec", ra.alias("cra"), dec.alias("cdec"))
        far = placed.where(distance(("ra", "dec"), ("cra", "cdec")) > cell_radius(F.col("order")))
        assert far.count() == 0


def test_known_cells_at_the_poles_and_the_seam(spark):
    df = spark.createDataFrame(
        [(0.0, 90.0), (0.0, -90.0), (360.0, 10.0), (0.0, 10.0), (-90.0, 45.0), (270.0, 45.0), (-1e-20, 0.0)],
        "ra double, dec double",
    )
    found = [row[0] for row in df.select(healpix_index("ra", "dec", 3)).collect()]
    assert found[0] == 63 and found[1] == 512
    assert found[2] == found[3] and found[4] == found[5]
    assert 0 <= found[6] < cell_count(3)


def test_what_is_not_a_position_has_no_cell(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, 91.0), (float("inf"), 0.0)], "ra double, dec double"
    )
    assert df.where(healpix_index("ra", "dec").isNotNull()).count() == 0


def test_spans_tile_the_parent(spark):
    df = spark.createDataFrame([(3, 65)], "o int, p bigint").select(
        first_index(F.col("o"), F.col("p")).alias("lo"), end_index(F.col("o"), F.col("p")).alias("hi")
    )
    row = df.first()
    assert (row.lo, row.hi) == (65 << 52, 66 << 52)


def test_an_order_that_healpix_has_not(spark):
    with pytest.raises(ValueError):
        healpix_index("ra", "dec", 30)


@pytest.mark.parametrize("order,ra,dec,cell", [(1, 90.0, 0.0, 21), (2, 90.0, 0.0, 86), (1, 270.0, 0.0, 29)])
def test_the_edge_of_two_cells_belongs_to_the_one_that_healpix_says(spark, order, ra, dec, cell):
    """The coordinate that falls is cut to whole steps before it is counted from the far end."""
    df = spark.createDataFrame([(ra, dec)], "ra double, dec double")
    assert df.select(healpix_index("ra", "dec", order).alias("cell")).first().cell == cell


def test_positions_are_those_of_their_sql(spark, duck):
    """To the last bit, of which a cell is cut; a null key has none, nor has one beyond the sphere."""
    keys = spark.range(2_000).select(F.col("id").alias("event_id"))
    got = {row.event_id: (row.ra, row.dec) for row in with_position(keys, "event_id").collect()}
    sql = f"SELECT event_id, {sky_sql('event_id')} FROM (SELECT range AS event_id FROM range(2000))"
    assert got == {key: (ra, dec) for key, ra, dec in duck.execute(sql).fetchall()}
    none, beyond = with_position(spark.createDataFrame([(None,), (-1,)], "k bigint"), "k").collect()
    assert none.dec is None and math.isnan(beyond.dec)
