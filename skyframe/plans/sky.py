"""Region, crossmatch and HEALPix queries over the derived sky."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions.geometry import distance, haversine, point
from skyframe.functions.healpix import healpix_index
from skyframe.functions.sql import register
from skyframe.operators.crossmatch import crossmatch, nearest_match, where_any_circle
from skyframe.operators.limits import top
from skyframe.operators.projection import select_columns, where_text
from skyframe.operators.region_filter import (
    contains,
    intersects,
    region_column,
    where_moc,
    where_region,
    within_distance,
)
from skyframe.operators.regions import Circle, Moc, Zone
from skyframe.plans.inputs import (
    BEACONS,
    DETECTIONS,
    STARS,
    TARGETS,
    beacons,
    cell_sql,
    detections,
    distance_sql,
    in_circle_sql,
    indexed_stars,
    rounded,
    star_pyramid,
    stars,
    targets,
)
from skyframe.plans.registry import query
from skyframe.sources.pyramid import distinct_count, quantile

_SHOWN = "SELECT event_id, round(ra, 6) AS ra, round(dec, 6) AS dec, value"


def _shown(df):
    return df.select("event_id", rounded("ra").alias("ra"), rounded("dec").alias("dec"), "value")


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE {in_circle_sql(45, -20, 5)} AND value > 20 ORDER BY event_id LIMIT 50")
def circle(spark, sf_dir):
    found = where_text(where_region(stars(spark, sf_dir), Circle(45, -20, 5)), "value > 20")
    return top(_shown(found).orderBy("event_id"), 50)


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE {in_circle_sql(10, 89.5, 6)}")
def circle_polar(spark, sf_dir):
    return _shown(where_region(stars(spark, sf_dir), Circle(10, 89.5, 6)))


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE {in_circle_sql(0.2, 0, 5)}")
def circle_seam(spark, sf_dir):
    return _shown(where_region(stars(spark, sf_dir), Circle(0.2, 0, 5)))


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE {in_circle_sql(200, -88, 120)}")
def circle_over_hemisphere(spark, sf_dir):
    return _shown(where_region(stars(spark, sf_dir), Circle(200, -88, 120)))


@query(
    f"WITH {STARS} {_SHOWN} FROM stars WHERE "
    + in_circle_sql(45, -20, 5).replace("(ra)::DOUBLE", "ra::FLOAT::DOUBLE").replace("(dec)::DOUBLE", "dec::FLOAT::DOUBLE")
)
def circle_narrow_columns(spark, sf_dir):
    narrow = stars(spark, sf_dir).withColumns(
        {"ra4": F.col("ra").cast("float"), "dec4": F.col("dec").cast("float")}
    )
    return _shown(where_region(narrow, Circle(45, -20, 5), "ra4", "dec4"))


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE ra BETWEEN 100 AND 140 AND dec BETWEEN -10 AND 12.5")
def zone(spark, sf_dir):
    return _shown(where_region(stars(spark, sf_dir), Zone((100, 140), (-10, 12.5))))


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE (ra >= 350 OR ra <= 10) AND dec BETWEEN -20 AND -10")
def zone_wrap(spark, sf_dir):
    return _shown(where_region(stars(spark, sf_dir), Zone((350, 10), (-20, -10))))


@query(
    f"WITH {STARS} {_SHOWN} FROM stars WHERE {in_circle_sql(45, -20, 5)} OR {in_circle_sql(10, 89.5, 6)} "
    "OR (ra BETWEEN 40 AND 60 AND dec BETWEEN -22 AND -18)"
)
def region_union(spark, sf_dir):
    shapes = [Circle(45, -20, 5), Circle(10, 89.5, 6), Zone((40, 60), (-22, -18))]
    return _shown(where_region(stars(spark, sf_dir), shapes))


@query(
    f"WITH {STARS}, {BEACONS} {_SHOWN} FROM stars WHERE EXISTS (SELECT 1 FROM beacons b WHERE "
    f"{in_circle_sql('stars.ra', 'stars.dec', '1.5', 'b.')})"
)
def region_many(spark, sf_dir):
    circles = beacons(spark, sf_dir).select("ra", "dec", F.lit(1.5).alias("radius"))
    return _shown(where_any_circle(stars(spark, sf_dir), circles))


_OWN_RADIUS = "CASE WHEN s_suppkey % 10 = 0 THEN 4.0::DOUBLE ELSE 0.05::DOUBLE * (s_suppkey % 10) END"


@query(
    f"WITH {STARS}, {BEACONS} {_SHOWN} FROM stars WHERE EXISTS (SELECT 1 FROM beacons b WHERE "
    f"{in_circle_sql('stars.ra', 'stars.dec', _OWN_RADIUS, 'b.')})"
)
def region_many_radii(spark, sf_dir):
    radius = F.expr("CASE WHEN s_suppkey % 10 = 0 THEN 4D ELSE 0.05D * (s_suppkey % 10) END")
    circles = beacons(spark, sf_dir).select("ra", "dec", radius.alias("radius"))
    return _shown(where_any_circle(stars(spark, sf_dir), circles))


@query(
    f"WITH {STARS}, {BEACONS} {_SHOWN} FROM stars WHERE dec BETWEEN -40 AND -30 OR EXISTS (SELECT 1 FROM beacons b WHERE "
    f"{in_circle_sql('stars.ra', 'stars.dec', 0.7, 'b.')})"
)
def region_many_mixed(spark, sf_dir):
    """Many circles written out, as a join, beside a zone, which is not."""
    circles = [Circle(row.ra % 360, row.dec, 0.7) for row in beacons(spark, sf_dir).select("ra", "dec").collect()]
    circles += [Circle(0.5 * k, 85.0, 1e-9) for k in range(100)]
    return _shown(where_region(stars(spark, sf_dir), [*circles, Zone((0, 360), (-40, -30))]))


_THOUSAND = (
    "circles AS (SELECT 0.36::DOUBLE * range AS ra, -80 + 0.16::DOUBLE * range AS dec, 0.1 + 0.0005::DOUBLE * range AS r FROM range(1000)), "
    "zones AS (SELECT 3.6::DOUBLE * range AS west, 3.6::DOUBLE * range + 1.5 AS east, -85 + 1.7::DOUBLE * range AS south FROM range(100))"
)


@query(
    f"WITH {STARS}, {_THOUSAND} {_SHOWN} FROM stars WHERE EXISTS (SELECT 1 FROM circles b WHERE "
    f"abs(stars.dec - b.dec) <= 1 AND {in_circle_sql('stars.ra', 'stars.dec', 'b.r', 'b.')}) "
    "OR EXISTS (SELECT 1 FROM zones z WHERE stars.ra BETWEEN west AND east AND stars.dec BETWEEN south AND south + 0.4)"
)
def region_thousand_shapes(spark, sf_dir):
    """A thousand circles and a hundred zones in one scan."""
    listed = [Circle(0.36 * k, -80 + 0.16 * k, 0.1 + 0.0005 * k) for k in range(1000)]
    listed += [Zone((3.6 * k, 3.6 * k + 1.5), (-85 + 1.7 * k, -85 + 1.7 * k + 0.4)) for k in range(100)]
    return _shown(where_region(indexed_stars(spark, sf_dir), listed))


@query(f"WITH {STARS} SELECT event_type, count(*) AS n FROM stars WHERE NOT ({in_circle_sql(45, -20, 60)}) GROUP BY 1")
def not_contains(spark, sf_dir):
    df = stars(spark, sf_dir)
    outside = df.where(~contains(df, ("ra", "dec"), Circle(45, -20, 60)))
    return outside.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    f"WITH {STARS} SELECT (SELECT count(*) FROM stars WHERE {in_circle_sql(45, -20, 5)}) AS point_first, "
    f"(SELECT count(*) FROM stars WHERE {in_circle_sql(45, -20, 5)}) AS shape_first, "
    f"(SELECT count(*) FROM stars WHERE {in_circle_sql(45, -20, 5)}) AS bounded"
)
def contains_spellings(spark, sf_dir):
    df, shape, at = stars(spark, sf_dir), Circle(45, -20, 5), ("ra", "dec")
    return df.agg(
        F.count_if(intersects(df, at, shape)).alias("point_first"),
        F.count_if(intersects(df, shape, at)).alias("shape_first"),
        F.count_if(within_distance(df, (45.0, -20.0), at, 5.0)).alias("bounded"),
    )


@query(f"WITH {STARS} SELECT event_id, round({distance_sql('ra', 'dec', 45, -20)}, 6) AS separation FROM stars")
def distance_value(spark, sf_dir):
    separation = distance(point("ra", "dec"), point(45.0, -20.0))
    return stars(spark, sf_dir).select("event_id", rounded(separation).alias("separation"))


@query(
    f"WITH {STARS} SELECT event_id, round({distance_sql('ra', 'dec', 45, -20)}, 6) AS separation FROM stars "
    f"WHERE event_type = 'click' ORDER BY {distance_sql('ra', 'dec', 45, -20)}, event_id LIMIT 25"
)
def distance_topk(spark, sf_dir):
    separation = distance(point("ra", "dec"), point(45.0, -20.0))
    near = stars(spark, sf_dir).where("event_type = 'click'").withColumn("exact", separation)
    near = top(near.orderBy("exact", "event_id"), 25)
    return near.select("event_id", rounded("exact").alias("separation"))


@query(
    f"WITH {STARS} SELECT event_id FROM stars WHERE "
    f"{distance_sql('ra', 'dec', 300, 40)} < 7 AND value < 50"
)
def distance_bound(spark, sf_dir):
    df = stars(spark, sf_dir)
    return df.where(within_distance(df, ("ra", "dec"), (300.0, 40.0), 7.0) & (F.col("value") < 50)).select("event_id")


_MOC = "2/3 10 17-19 3/100-140 5/19 4000-4300"
_IN_MOC = (
    "(cell >> 54) IN (3, 10, 17, 18, 19) OR (cell >> 52) BETWEEN 100 AND 140 "
    "OR (cell >> 48) = 19 OR (cell >> 48) BETWEEN 4000 AND 4300"
)
_CELLS = f"{STARS}, {cell_sql('stars', 29)}"


@query(f"WITH {_CELLS} SELECT event_id FROM celld WHERE {_IN_MOC}")
def moc_select(spark, sf_dir):
    return where_region(indexed_stars(spark, sf_dir), Moc.from_ascii(_MOC)).select("event_id")


@query(f"WITH {STARS}, {cell_sql('stars', 5)} SELECT event_id FROM celld WHERE (cell >> 6) = 10 OR cell BETWEEN 4000 AND 4300")
def moc_coarse_index(spark, sf_dir):
    """A moc against an index of its own order, which the caller has to name."""
    df = indexed_stars(spark, sf_dir).withColumn("cell", F.shiftright("_healpix_29", 48)).drop("_healpix_29")
    return where_region(df, Moc.from_ascii("2/10 5/4000-4300"), healpix="cell", healpix_order=5).select("event_id")


def _scattered() -> Moc:
    """A moc of sixteen thousand ranges."""
    return Moc.of_cells((6, cell, cell) for cell in range(0, 12 << 12, 3))


@query(f"WITH {_CELLS} SELECT event_id FROM celld WHERE (cell >> 46) % 3 = 0")
def moc_many_ranges(spark, sf_dir):
    return where_moc(indexed_stars(spark, sf_dir), _scattered()).select("event_id")


@query(f"WITH {_CELLS} SELECT event_type, count(*) AS n FROM celld WHERE (cell >> 46) % 3 <> 0 GROUP BY event_type")
def not_in_long_moc(spark, sf_dir):
    df = indexed_stars(spark, sf_dir)
    return df.where(~contains(df, ("ra", "dec"), _scattered())).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_CELLS} SELECT event_id FROM celld WHERE (cell >> 46) % 3 = 0 OR {in_circle_sql(45, -20, 5)}")
def moc_with_circle(spark, sf_dir):
    return where_region(indexed_stars(spark, sf_dir), [_scattered(), Circle(45, -20, 5)]).select("event_id")


@query(f"WITH {STARS} {_SHOWN} FROM stars WHERE {in_circle_sql(45, -20, 5)}")
def circle_indexed(spark, sf_dir):
    """The circle again, with the cell column's ranges in front of it."""
    return _shown(where_region(indexed_stars(spark, sf_dir), Circle(45, -20, 5)))


@query(
    f"WITH {STARS}, {cell_sql('stars', 3)} SELECT cell, count(*) AS n, min(event_id) AS first_id FROM celld GROUP BY cell"
)
def healpix_index_counts(spark, sf_dir):
    cells = stars(spark, sf_dir).withColumn("cell", healpix_index("ra", "dec", 3))
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"WITH {STARS}, {cell_sql('stars', 29)} SELECT event_id, cell FROM celld")
def healpix_index_values(spark, sf_dir):
    return stars(spark, sf_dir).select("event_id", healpix_index("ra", "dec").alias("cell"))


@query(
    f"WITH {STARS} SELECT count(*) AS plain, count(*) AS prefiltered FROM stars "
    f"WHERE {in_circle_sql(45, -20, 25)} OR (ra BETWEEN 200 AND 260 AND dec BETWEEN 30 AND 31)"
)
def prefilter_equivalence(spark, sf_dir):
    df = indexed_stars(spark, sf_dir)
    shapes = [Circle(45, -20, 25), Zone((200, 260), (30, 31))]
    return df.agg(
        F.count_if(region_column(df, shapes, prefilter=False)).alias("plain"),
        F.count_if(region_column(df, shapes)).alias("prefiltered"),
    )


@query(
    f"WITH {STARS} SELECT event_id, round({distance_sql('ra', 'dec', 0, 90)}, 6) AS from_pole FROM stars "
    f"WHERE {in_circle_sql(0.2, 0, 5)} OR ((ra >= 355 OR ra <= 5) AND dec BETWEEN 60 AND 80)"
)
def sql_functions(spark, sf_dir):
    register(spark)
    return spark.sql(
        "SELECT event_id, round(sky_distance(ra, dec, 0D, 90D), 6) AS from_pole FROM {stars} "
        "WHERE sky_in_circle(ra, dec, 0.2D, 0D, 5D) OR sky_in_zone(ra, dec, 355D, 5D, 60D, 80D)",
        stars=stars(spark, sf_dir),
    )


def _written(moc: Moc) -> str:
    """A moc as text."""
    by_order: dict[int, list[str]] = {}
    for order, cell in moc.cells():
        by_order.setdefault(order, []).append(str(cell))
    return " ".join(f"{order}/{' '.join(cells)}" for order, cells in sorted(by_order.items()))


@query(f"WITH {_CELLS} SELECT event_id FROM celld WHERE {_IN_MOC}")
def sql_moc(spark, sf_dir):
    """A moc in the text of a statement."""
    register(spark)
    statement = f"SELECT event_id FROM {{stars}} WHERE sky_in_moc(_healpix_29, '{_MOC}')"
    return spark.sql(statement, stars=indexed_stars(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT event_type, count(*) AS n FROM celld WHERE (cell >> 46) % 3 = 0 OR event_id % 100 = 0 GROUP BY 1")
def sql_moc_many_ranges(spark, sf_dir):
    """A moc of sixteen thousand ranges beside another condition."""
    register(spark)
    statement = (
        "SELECT event_type, count(*) AS n FROM {stars} "
        f"WHERE sky_in_moc(_healpix_29, '{_written(_scattered())}') OR event_id % 100 = 0 GROUP BY event_type"
    )
    return spark.sql(statement, stars=indexed_stars(spark, sf_dir))


# ---- crossmatch ----

_PAIR = "a.event_id, b.o_orderkey"


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT {_PAIR}, round({distance_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 6) AS separation "
    f"FROM stars a JOIN detections b ON abs(a.dec - b.dec) <= 0.6 AND {in_circle_sql('b.ra', 'b.dec', 0.5, 'a.')}"
)
def match_pairs(spark, sf_dir):
    left = stars(spark, sf_dir).select("event_id", "ra", "dec")
    right = detections(spark, sf_dir).select("o_orderkey", "ra", "dec")
    return crossmatch(left, right, 0.5).select("event_id", "o_orderkey", rounded("separation").alias("separation"))


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT {_PAIR} FROM stars a JOIN detections b "
    f"ON {distance_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} < 0.4"
)
def match_by_distance(spark, sf_dir):
    left = stars(spark, sf_dir).select("event_id", "ra", "dec")
    right = detections(spark, sf_dir).select("o_orderkey", "ra", "dec")
    return crossmatch(left, right, 0.4, strict=True, separation=None).select("event_id", "o_orderkey")


_ROW_RADIUS = "CASE WHEN a.event_id % 1000 = 0 THEN 6::DOUBLE ELSE 0.01::DOUBLE * (a.event_id % 20) END"


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT {_PAIR} FROM stars a JOIN detections b "
    f"ON {in_circle_sql('b.ra', 'b.dec', _ROW_RADIUS, 'a.')}"
)
def match_row_radius(spark, sf_dir):
    radius = F.expr("CASE WHEN event_id % 1000 = 0 THEN 6D ELSE 0.01D * (event_id % 20) END")
    left = stars(spark, sf_dir).select("event_id", "ra", "dec", radius.alias("radius"))
    right = detections(spark, sf_dir).select("o_orderkey", "ra", "dec")
    return crossmatch(left, right, "radius", separation=None).select("event_id", "o_orderkey")


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT {_PAIR} FROM stars a JOIN detections b ON {in_circle_sql('b.ra', 'b.dec', 2, 'a.')} "
    f"WHERE {in_circle_sql(45, -20, 20, 'a.')} AND b.dec BETWEEN -30 AND -10 AND b.ra BETWEEN 30 AND 60"
)
def match_regions(spark, sf_dir):
    left = where_region(stars(spark, sf_dir).select("event_id", "ra", "dec"), Circle(45, -20, 20))
    right = detections(spark, sf_dir).select("o_orderkey", "ra", "dec")
    right = where_region(right, Zone((30, 60), (-30, -10)))
    return crossmatch(left, right, 2.0).select("event_id", "o_orderkey")


@query(
    f"WITH {BEACONS}, {STARS} SELECT a.s_suppkey, b.event_id FROM beacons a JOIN stars b "
    f"ON {in_circle_sql('b.ra', 'b.dec', 1, 'a.')}"
)
def match_small_list(spark, sf_dir):
    listed = beacons(spark, sf_dir).select("s_suppkey", "ra", "dec")
    right = stars(spark, sf_dir).select("event_id", "ra", "dec")
    return crossmatch(listed, right, 1.0, small_left=True).select("s_suppkey", "event_id")


@query(
    f"WITH {STARS} SELECT a.event_id AS a_id, b.event_id AS b_id FROM stars a JOIN stars b "
    f"ON a.event_id < b.event_id AND abs(a.dec - b.dec) <= 0.6 AND {in_circle_sql('b.ra', 'b.dec', 0.5, 'a.')}"
)
def match_self(spark, sf_dir):
    df = stars(spark, sf_dir).select("event_id", "ra", "dec")
    pairs = crossmatch(df, df, 0.5, separation=None)
    return pairs.where("event_id < event_id_2").selectExpr("event_id AS a_id", "event_id_2 AS b_id")


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT {_PAIR}, round({distance_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 6) AS separation "
    f"FROM stars a JOIN detections b ON abs(a.dec - b.dec) <= 0.6 AND {in_circle_sql('b.ra', 'b.dec', 0.5, 'a.')}"
)
def sql_match_pairs(spark, sf_dir):
    """A crossmatch in the text of a statement, an equi-join on buckets."""
    register(spark)
    return spark.sql(
        "SELECT a.event_id, b.o_orderkey, round(sky_distance(a.ra, a.dec, b.ra, b.dec), 6) AS separation "
        "FROM {stars} a, LATERAL sky_buckets(a.ra, a.dec, 0.5D) k JOIN {detections} b "
        "ON k.bucket = sky_bucket(b.ra, b.dec, 0.5D) AND sky_in_circle(b.ra, b.dec, a.ra, a.dec, 0.5D)",
        stars=stars(spark, sf_dir),
        detections=detections(spark, sf_dir),
    )


@query(
    f"WITH {STARS}, {DETECTIONS} SELECT o_orderpriority, count(*) AS pairs FROM stars a JOIN detections b "
    f"ON {in_circle_sql('b.ra', 'b.dec', '0.01::DOUBLE * (a.event_id % 50)', 'a.')} WHERE a.value > 20 AND a.event_id % 50 > 0 GROUP BY 1"
)
def sql_match_row_radius(spark, sf_dir):
    """Every row with a radius of its own, on the grid of the widest."""
    register(spark)
    return spark.sql(
        "SELECT o_orderpriority, count(*) AS pairs FROM (SELECT *, 0.01D * (event_id % 50) AS r FROM {stars} "
        "WHERE value > 20 AND event_id % 50 > 0) a, LATERAL sky_buckets(a.ra, a.dec, a.r, 0.5D) k JOIN {detections} b "
        "ON k.bucket = sky_bucket(b.ra, b.dec, 0.5D, 0.5D) AND sky_in_circle(b.ra, b.dec, a.ra, a.dec, a.r) GROUP BY o_orderpriority",
        stars=stars(spark, sf_dir),
        detections=detections(spark, sf_dir),
    )


@query(
    f"WITH {TARGETS}, {STARS} SELECT c_custkey, event_id, separation FROM (SELECT c_custkey, event_id, "
    "round(d, 6) AS separation, row_number() OVER (PARTITION BY c_custkey ORDER BY d, event_id) AS rn "
    f"FROM (SELECT a.c_custkey, b.event_id, {distance_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS d "
    f"FROM targets a JOIN stars b ON {in_circle_sql('b.ra', 'b.dec', 2, 'a.')})) WHERE rn = 1"
)
def match_nearest(spark, sf_dir):
    left = targets(spark, sf_dir).select("c_custkey", "ra", "dec")
    right = stars(spark, sf_dir).select("event_id", "ra", "dec")
    best = nearest_match(left, right, 2.0, key="c_custkey", tie="event_id")
    return best.select("c_custkey", "event_id", rounded("separation").alias("separation"))


@query(
    f"WITH {TARGETS}, {STARS} SELECT c_custkey, event_id, separation FROM (SELECT c_custkey, event_id, "
    "round(d, 6) AS separation, row_number() OVER (PARTITION BY c_custkey ORDER BY d, event_id) AS rn "
    f"FROM (SELECT a.c_custkey, b.event_id, {distance_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS d "
    "FROM targets a JOIN stars b ON b.dec > -30 AND b.event_type = 'click')) WHERE rn = 1"
)
def match_nearest_any_distance(spark, sf_dir):
    """The nearest row however far it is: a third of the sky has none."""
    left = targets(spark, sf_dir).select("c_custkey", "ra", "dec")
    right = stars(spark, sf_dir).where("dec > -30 AND event_type = 'click'").select("event_id", "ra", "dec")
    best = nearest_match(left, right, key="c_custkey", tie="event_id")
    return best.select("c_custkey", "event_id", rounded("separation").alias("separation"))


@query(
    f"WITH {TARGETS}, {STARS}, twice AS (SELECT c_nationkey AS nation, ra, dec FROM targets UNION ALL SELECT c_nationkey, ra, dec FROM targets WHERE c_custkey % 2 = 0), "
    f"one AS (SELECT DISTINCT nation, ra, dec FROM twice), best AS (SELECT nation, ra, dec, event_id FROM (SELECT a.*, b.event_id, row_number() OVER "
    f"(PARTITION BY a.nation, a.ra, a.dec ORDER BY {distance_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')}, b.event_id) AS rn "
    f"FROM one a JOIN stars b ON {in_circle_sql('b.ra', 'b.dec', 2, 'a.')}) WHERE rn = 1) "
    "SELECT t.nation, b.event_id, count(*) AS n FROM twice t JOIN best b ON t.nation = b.nation AND t.ra = b.ra AND t.dec = b.dec GROUP BY 1, 2"
)
def match_nearest_repeated_key(spark, sf_dir):
    """A key that many left rows share, and left rows that are there twice."""
    once = targets(spark, sf_dir).selectExpr("c_custkey", "c_nationkey AS nation", "ra", "dec")
    left = once.drop("c_custkey").unionByName(once.where("c_custkey % 2 = 0").drop("c_custkey"))
    right = stars(spark, sf_dir).select("event_id", "ra", "dec")
    best = nearest_match(left, right, 2.0, key="nation", tie="event_id")
    return best.groupBy("nation", "event_id").agg(F.count("*").alias("n"))


@query(
    f"WITH {STARS} SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, "
    f"round(avg(value), 6) AS mean FROM stars WHERE {in_circle_sql(45, -20, 30)} GROUP BY 1 HAVING count(*) > 1"
)
def region_aggregate(spark, sf_dir):
    found = where_region(stars(spark, sf_dir), Circle(45, -20, 30))
    grouped = found.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        rounded(F.avg("value")).alias("mean"),
    )
    return grouped.where("n > 1")


_WIDE = [Circle(45, -20, 30), Zone((200, 260), (-30, 60))]
_WIDE_SQL = f"({in_circle_sql(45, -20, 30)} OR (ra BETWEEN 200 AND 260 AND dec BETWEEN -30 AND 60))"


@query(
    f"WITH {STARS} SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, "
    f"true AS spared FROM stars WHERE {_WIDE_SQL} GROUP BY 1"
)
def region_aggregate_stored(spark, sf_dir):
    """Aggregates over regions out of stored summaries and the rows along the boundary, which are
    fewer than half of those inside."""
    pyramid = star_pyramid(spark, sf_dir)
    found = pyramid.summary(_WIDE)
    edge = pyramid.pieces(_WIDE)[1].agg(F.count("*").alias("edge"))
    whole = found.agg(F.sum("n").alias("whole"))
    spared = edge.join(whole).select((F.col("edge") * 2 < F.col("whole")).alias("spared"))
    mean = F.round(F.col("sum_value") / F.col("n_value"), 6)
    shown = found.select("event_type", "n", F.col("min_value").alias("low"), F.col("max_value").alias("high"), mean.alias("mean"))
    return shown.join(F.broadcast(spared))


@query(
    f"WITH {STARS} SELECT event_type, count(*) AS n, true AS users_close, true AS median_close FROM stars WHERE {_WIDE_SQL} GROUP BY 1"
)
def region_sketches(spark, sf_dir):
    """Distinct users and the median value of regions by united sketches, held against exact ones:
    within five in a hundred, and between the values at ranks 0.48 and 0.52."""
    found = star_pyramid(spark, sf_dir).summary(_WIDE)
    found = found.select("event_type", "n", distinct_count("user_id").alias("users"), quantile("value", 0.5).alias("median"))
    exact = where_region(indexed_stars(spark, sf_dir), _WIDE).groupBy(F.col("event_type").alias("kind")).agg(
        F.count_distinct("user_id").alias("exact"), F.percentile("value", F.array(F.lit(0.48), F.lit(0.52))).alias("around")
    )
    return found.join(exact, F.col("event_type") == F.col("kind")).select(
        "event_type",
        "n",
        (F.abs(F.col("users") / F.col("exact") - 1) <= 0.05).alias("users_close"),
        F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("median_close"),
    )


@query(
    f"WITH {STARS} SELECT floor(dec / 10)::BIGINT AS band, count(*) AS n, "
    "round(max(pow(sin(radians(dec) / 2), 2)), 9) AS top FROM stars GROUP BY 1"
)
def zone_histogram(spark, sf_dir):
    df = stars(spark, sf_dir)
    return df.groupBy(F.floor(F.col("dec") / 10).alias("band")).agg(
        F.count("*").alias("n"), F.round(F.max(haversine("ra", "dec", "ra", 0.0)), 9).alias("top")
    )


@query(
    f"WITH {STARS} SELECT event_id, user_id, value FROM stars WHERE dec > 80 AND event_type <> 'click'"
)
def projection_order(spark, sf_dir):
    """Columns in the caller's order; the predicate names one that is not among them."""
    found = where_text(stars(spark, sf_dir), "dec > 80 AND event_type <> 'click'")
    return select_columns(found, ["value", "event_id", "user_id"])
