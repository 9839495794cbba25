"""Queries over the stars as a partitioned catalog with secondary indexes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.healpix import cell_center, healpix_index
from skyframe.functions.sql import register
from skyframe.operators.coverage import BOUNDARY, INSIDE, OUTSIDE
from skyframe.operators.crossmatch import crossmatch
from skyframe.operators.limits import with_overflow
from skyframe.operators.regions import Circle, Moc, Zone
from skyframe.plans.inputs import (
    BEACONS,
    DETECTIONS,
    STARS,
    beacons,
    cell_sql,
    detections,
    distance_sql,
    in_circle_sql,
    star_catalog,
    stars,
    table,
)
from skyframe.plans.registry import query
from skyframe.sources import partitions as tables
from skyframe.sources.catalog import open_catalog
from skyframe.sources.files import first_rows, shared_folder
from skyframe.sources.index import files_with, read_index

# Every star with its order-29 cell and the partition it is in, by the checking SQL's own formula.
_PLACED = (
    f"{STARS}, {cell_sql('stars', 29)}, placed AS (SELECT *, (1 + (cell >> 58) % 2)::INTEGER AS Norder, "
    "(cell >> (2 * (28 - (cell >> 58) % 2))) AS Npix FROM celld)"
)
_CELL = "SELECT event_id, cell AS _healpix_29"


@query(
    f"WITH {_PLACED} SELECT Norder, Npix, Npix << (2 * (29 - Norder)) AS lo, (Npix + 1) << (2 * (29 - Norder)) AS hi, "
    "count(*) AS rows FROM placed GROUP BY Norder, Npix"
)
def partition_table(spark, sf_dir):
    catalog = star_catalog(spark, sf_dir)
    found = tables.from_data(spark, catalog.root, catalog.suffix)
    return found.select("Norder", "Npix", "lo", "hi", F.col("rows").cast("bigint").alias("rows"))


@query(f"WITH {_PLACED} SELECT Norder, Npix, true AS listed, true AS named FROM placed GROUP BY Norder, Npix")
def partition_sources(spark, sf_dir):
    """The listing and partition_info.csv name the same partitions."""
    catalog = star_catalog(spark, sf_dir)
    listed = tables.from_listing(spark, catalog.root, catalog.suffix).select("Norder", "Npix", F.lit(True).alias("listed"))
    named = tables.from_partition_info(spark, catalog.root, catalog.suffix).select(
        "Norder", "Npix", F.lit(True).alias("named")
    )
    return listed.join(named, ["Norder", "Npix"], "full")


@query(
    f"WITH {_PLACED} SELECT count(DISTINCT (Norder, Npix)) AS partitions, 0::BIGINT AS tested, count(*) AS rows, true AS sized FROM placed"
)
def partition_estimate(spark, sf_dir):
    catalog = open_catalog(spark, star_catalog(spark, sf_dir).root, partitions_from="data")
    return catalog.estimate().select("partitions", "tested", "rows", (F.col("bytes") > 0).alias("sized"))


_PLAN = [Circle(45, -20, 25), Zone((200, 260), (30, 60)), Moc.from_ascii("3/64-66")]
_PLAN_SQL = (
    f"({in_circle_sql(45, -20, 25)} OR (ra BETWEEN 200 AND 260 AND dec BETWEEN 30 AND 60) "
    "OR (cell >> 52) BETWEEN 64 AND 66)"
)


@query(
    f"WITH {_PLACED} SELECT Norder, Npix, count(*) AS n, count(*) FILTER ({_PLAN_SQL}) AS in_region, true AS fits, true AS pruned "
    "FROM placed GROUP BY Norder, Npix"
)
def partition_plan(spark, sf_dir):
    """Every partition, with its rows in the region by brute force, and whether its cover fits them:
    none where it is left out, all where it is inside. Half of those without rows are left out."""
    catalog = star_catalog(spark, sf_dir)
    cover = catalog.plan(_PLAN).select("Norder", "Npix", "cover")
    index = F.col("_healpix_29")
    placed = catalog.read().select("ra", "dec", "_healpix_29", F.expr(_IN_PLAN).alias("hit"))
    placed = placed.withColumn("Norder", (1 + F.shiftright(index, 58) % 2).cast("int"))
    placed = placed.withColumn("Npix", F.call_function("shiftright", index, 2 * (29 - F.col("Norder"))))
    counted = placed.groupBy("Norder", "Npix").agg(F.count("*").alias("n"), F.count_if("hit").alias("in_region"))
    judged = counted.join(cover, ["Norder", "Npix"], "left").withColumn("cover", F.coalesce("cover", F.lit(OUTSIDE)))
    fits = (F.col("cover") == BOUNDARY) | F.when(F.col("cover") == INSIDE, F.col("in_region") == F.col("n")).otherwise(F.col("in_region") == 0)
    bare = judged.agg(F.count_if(F.col("in_region") == 0).alias("bare"), F.count_if(F.col("cover") == OUTSIDE).alias("out"))
    judged = judged.join(F.broadcast(bare))
    return judged.select("Norder", "Npix", "n", "in_region", fits.alias("fits"), (F.col("out") * 2 >= F.col("bare")).alias("pruned"))


# The planned region as plain formulas, not the tests that are checked here.
_IN_PLAN = (
    "pow(sin(radians(dec + 20) / 2), 2) + cos(radians(dec)) * cos(radians(-20D)) * pow(sin(radians(ra - 45) / 2), 2) "
    "<= pow(sin(radians(25D) / 2), 2) OR (ra BETWEEN 200 AND 260 AND dec BETWEEN 30 AND 60) "
    "OR shiftright(_healpix_29, 52) BETWEEN 64 AND 66"
)


@query(f"WITH {_PLACED} SELECT 0::BIGINT AS wrong, 0::BIGINT AS lost, count(*) AS n FROM placed")
def partition_plan_is_sure(spark, sf_dir):
    """Rows outside the region in partitions called inside, and in it in those left out."""
    catalog = star_catalog(spark, sf_dir)
    cover = catalog.plan(_PLAN).select("path", "cover")
    rows = catalog.read().withColumn("hit", catalog.contains(_PLAN))
    parts = rows.withColumn("path", F.regexp_extract("_metadata.file_path", r"(.*)/[^/]*$", 1))
    bare = F.regexp_replace("path", "^file:/*", "/")
    parts = parts.select(bare.alias("path"), "hit")
    judged = parts.join(cover.withColumn("path", bare), "path", "left")
    return judged.agg(
        F.count_if((F.col("cover") == 2) & ~F.col("hit")).alias("wrong"),
        F.count_if(F.col("cover").isNull() & F.col("hit")).alias("lost"),
        F.count("*").alias("n"),
    )


@query(f"WITH {_PLACED} {_CELL}, round(value, 6) AS value FROM placed WHERE {in_circle_sql(45, -20, 25)} AND value > 10")
def catalog_cone(spark, sf_dir):
    found = star_catalog(spark, sf_dir).select(
        Circle(45, -20, 25), where="value > 10", columns=["event_id", "_healpix_29", "value"]
    )
    return found.withColumn("value", F.round("value", 6))


@query(f"WITH {_PLACED} {_CELL} FROM placed WHERE {_PLAN_SQL}")
def catalog_union(spark, sf_dir):
    return star_catalog(spark, sf_dir).select(_PLAN, columns=["event_id", "_healpix_29"])


@query(
    f"WITH {_PLACED}, {BEACONS} {_CELL} FROM placed WHERE value > 20 AND EXISTS (SELECT 1 FROM beacons b WHERE "
    f"{in_circle_sql('placed.ra', 'placed.dec', '1.5', 'b.')})"
)
def catalog_many_circles(spark, sf_dir):
    circles = beacons(spark, sf_dir).select("ra", "dec", F.lit(1.5).alias("radius"))
    return star_catalog(spark, sf_dir).select_circles(circles, "value > 20", ["event_id", "_healpix_29"])


@query(
    f"WITH {_PLACED} {_CELL} FROM placed WHERE cell BETWEEN 1000000000000000000 AND 1300000000000000000"
)
def index_range(spark, sf_dir):
    """A range of the index written by hand, which chooses partitions like any region."""
    low, high = 10**18, 13 * 10**17
    catalog = star_catalog(spark, sf_dir)
    df = catalog.read(catalog.within_index_range(low, high))
    return df.where(F.col("_healpix_29").between(low, high)).select("event_id", "_healpix_29")


@query(f"WITH {_PLACED} {_CELL} FROM placed ORDER BY cell, event_id LIMIT 100")
def catalog_limit_front(spark, sf_dir):
    return star_catalog(spark, sf_dir).front(100, columns=["event_id", "_healpix_29"])


@query(
    f"WITH {_PLACED} {_CELL} FROM placed WHERE {in_circle_sql(45, -20, 40)} AND value < 60 ORDER BY cell, event_id LIMIT 100"
)
def catalog_limit_region(spark, sf_dir):
    return star_catalog(spark, sf_dir).front(
        100, Circle(45, -20, 40), "value < 60", ["event_id", "_healpix_29"]
    )


@query(f"WITH {_PLACED} {_CELL} FROM placed ORDER BY cell DESC LIMIT 40")
def order_by_index_desc(spark, sf_dir):
    return star_catalog(spark, sf_dir).ordered_by_index(40, descending=True, columns=["event_id", "_healpix_29"])


@query(f"WITH {_PLACED} {_CELL} FROM placed WHERE event_type = 'click' ORDER BY cell, value DESC, event_id LIMIT 40")
def order_by_index_then_value(spark, sf_dir):
    then = [F.col("value").desc(), F.col("event_id")]
    return star_catalog(spark, sf_dir).ordered_by_index(
        40, then=then, where="event_type = 'click'", columns=["event_id", "_healpix_29"]
    )


@query(f"WITH {_PLACED} {_CELL}, user_id FROM placed WHERE event_id IN (7, 42, 990, 123456789)")
def index_lookup(spark, sf_dir):
    return star_catalog(spark, sf_dir).select(
        identifiers={"event_id": [7, 42, 990, 123456789]}, columns=["event_id", "_healpix_29", "user_id"]
    )


@query(f"WITH {_PLACED} {_CELL}, user_id FROM placed WHERE user_id IN (3, 5, 8, 13) AND event_id IN (SELECT l_partkey FROM lineitem)")
def index_two_columns(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event_id"))
    return star_catalog(spark, sf_dir).select(
        identifiers={"user_id": [3, 5, 8, 13], "event_id": ids}, columns=["event_id", "_healpix_29", "user_id"]
    )


@query(f"WITH {_PLACED} {_CELL} FROM placed WHERE event_id IN (SELECT c_custkey FROM customer)")
def index_batch_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"))
    return star_catalog(spark, sf_dir).select(identifiers={"event_id": ids}, columns=["event_id", "_healpix_29"])


@query(f"WITH {STARS} SELECT event_id, event_type FROM stars ORDER BY event_id LIMIT 500")
def file_front(spark, sf_dir):
    """The front of a file: the rows as written, whatever the file's layout."""
    return first_rows(spark, f"{sf_dir}/events.parquet", 500, ["event_id", "event_type"])


@query(f"WITH {STARS} SELECT event_id, true AS overflow FROM stars WHERE {in_circle_sql(45, -20, 40)} ORDER BY event_id LIMIT 20")
def row_cap_overflow(spark, sf_dir):
    """A cap that cuts, in the run that delivers the rows."""
    found = star_catalog(spark, sf_dir).select(Circle(45, -20, 40), columns=["event_id"]).orderBy("event_id")
    return with_overflow(found, 20)


@query(f"WITH {STARS} SELECT event_id, false AS overflow FROM stars WHERE {in_circle_sql(45, -20, 2)}")
def row_cap_kept(spark, sf_dir):
    """A cap that does not cut."""
    found = star_catalog(spark, sf_dir).select(Circle(45, -20, 2), columns=["event_id"]).orderBy("event_id")
    return with_overflow(found, 1_000_000)


@query(
    f"WITH {STARS}, {DETECTIONS}, sa AS (SELECT * FROM stars WHERE {in_circle_sql(45, -20, 30)}) "
    "SELECT o_orderpriority, count(*) AS pairs FROM sa a JOIN detections b "
    f"ON {in_circle_sql('b.ra', 'b.dec', 1, 'a.')} GROUP BY 1"
)
def catalog_match(spark, sf_dir):
    """A crossmatch of which one side is a catalog, narrowed by its own region first."""
    left = star_catalog(spark, sf_dir).select(Circle(45, -20, 30), columns=["event_id", "ra", "dec"])
    right = detections(spark, sf_dir).select("o_orderkey", "o_orderpriority", "ra", "dec")
    pairs = crossmatch(left, right, 1.0, separation=None)
    return pairs.groupBy("o_orderpriority").agg(F.count("*").alias("pairs"))


@query(
    f"WITH {STARS}, {cell_sql('stars', 4)} SELECT count(DISTINCT cell) AS cells, "
    "count(*) AS n FROM celld"
)
def cell_centres(spark, sf_dir):
    """A cell's centre lies in the cell: rows are moved to the centres and indexed again."""
    cells = stars(spark, sf_dir).select(healpix_index("ra", "dec", 4).alias("cell"))
    cells = cells.groupBy("cell").agg(F.count("*").alias("rows"))
    ra, dec = cell_center(F.lit(4), F.col("cell"))
    moved = cells.select("cell", "rows", ra.alias("ra"), dec.alias("dec"))
    moved = moved.withColumn("again", healpix_index("ra", "dec", 4))
    return moved.agg(
        F.count_distinct(F.when(F.col("cell") == F.col("again"), F.col("cell"))).alias("cells"),
        F.sum(F.when(F.col("cell") == F.col("again"), F.col("rows"))).alias("n"),
    )


@query("SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 200")
def file_front_filtered(spark, sf_dir):
    return first_rows(spark, f"{sf_dir}/events.parquet", 200, ["event_id", "value"], where="event_type = 'click'")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100")
def file_front_partitioned(spark, sf_dir):
    """All clicks in several files under a folder whose name is a column; the front of them is asked for."""
    path = shared_folder(spark, "front")
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "event_type")
    rows.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.partitionBy("event_type").parquet(path)
    return first_rows(spark, path, 100, ["event_id", "event_type"])


@query(
    f"WITH {_PLACED}, thirds AS (SELECT DISTINCT Norder, Npix FROM placed WHERE Npix % 3 = 0) "
    f"{_CELL} FROM placed JOIN thirds USING (Norder, Npix)"
)
def catalog_read_listed(spark, sf_dir):
    """Chosen partitions past the number that is handed over as a list."""
    catalog = dataclasses.replace(star_catalog(spark, sf_dir), listed_paths=2)
    return catalog.read(catalog.partitions.where("Npix % 3 = 0")).select("event_id", "_healpix_29")


_ONE_FILE = "(SELECT count(DISTINCT (Norder, Npix)) FROM placed WHERE event_id IN (7, 42))"


@query(f"WITH {_PLACED} {_CELL}, {_ONE_FILE} AS partitions FROM placed WHERE event_id IN (7, 42) AND value > -1")
def catalog_where_index(spark, sf_dir):
    """Identifiers go through the index, beside a predicate; the partitions opened are counted."""
    found = star_catalog(spark, sf_dir).select(
        where="value > -1", identifiers={"event_id": [7, 42]}, columns=["event_id", "_healpix_29"]
    )
    return found.withColumn("partitions", F.lit(_partitions_read(found)).cast("bigint"))


def _partitions_read(df) -> int:
    """Partitions whose files a plan opens."""
    return len({path.rpartition("/")[0] for path in df.inputFiles()})


@query(f"WITH {_PLACED} {_CELL}, 0::BIGINT AS files FROM placed WHERE event_id < 0")
def index_absent(spark, sf_dir):
    """Identifiers that are not there open no file of the index and no partition."""
    catalog = star_catalog(spark, sf_dir)
    files = files_with(spark, catalog.indexes["event_id"], "event_id", [-5, 10**12], T.LongType())
    found = catalog.select(identifiers={"event_id": [-5, 10**12]}, columns=["event_id", "_healpix_29"])
    return found.withColumn("files", F.lit(len(files) + len(found.inputFiles())).cast("bigint"))


@query(
    f"WITH {_PLACED} {_CELL}, user_id, true AS few FROM placed WHERE event_id IN (SELECT event_id FROM events WHERE event_id % 200 = 3) AND value > 10"
)
def index_scattered(spark, sf_dir):
    """Identifiers from all over the index: only files that hold one of them are read."""
    catalog = star_catalog(spark, sf_dir)
    ids = [row.event_id for row in table(spark, sf_dir, "events").where("event_id % 200 = 3").select("event_id").collect()]
    root = catalog.indexes["event_id"]
    files = files_with(spark, root, "event_id", ids, T.LongType())
    listed = len(read_index(spark, root, "event_id").inputFiles())
    found = catalog.select(where="value > 10", identifiers={"event_id": ids}, columns=["event_id", "_healpix_29", "user_id"])
    return found.withColumn("few", F.lit(len(files) <= min(listed, len(ids))))


_LOW, _HIGH = 3 << 56, (3 << 56) + (1 << 55)


@query(
    f"WITH {_PLACED} {_CELL}, (SELECT count(DISTINCT (Norder, Npix)) FROM placed WHERE Npix << (2 * (29 - Norder)) <= {_HIGH} "
    f"AND (Npix + 1) << (2 * (29 - Norder)) > {_LOW}) AS partitions FROM placed WHERE cell BETWEEN {_LOW} AND {_HIGH}"
)
def catalog_where_cells(spark, sf_dir):
    """A range of cells written by hand opens the partitions it reaches and no other."""
    found = star_catalog(spark, sf_dir).select(cells=[(_LOW, _HIGH)], columns=["event_id", "_healpix_29"])
    return found.withColumn("partitions", F.lit(_partitions_read(found)).cast("bigint"))


@query(
    f"WITH {_PLACED} SELECT event_type, count(*) AS n, true AS pruned FROM placed WHERE {in_circle_sql(45, -20, 6)} GROUP BY event_type"
)
def catalog_sql_region(spark, sf_dir):
    """A statement over the partitions that a circle reaches."""
    register(spark)
    catalog = star_catalog(spark, sf_dir)
    statement = "SELECT event_type, event_id FROM {catalog} WHERE sky_in_circle(ra, dec, 45, -20, 6)"
    found = catalog.sql(statement, regions=Circle(45, -20, 6))
    pruned = _partitions_read(found) < catalog.partitions.count() / 4
    return found.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("pruned", F.lit(pruned))


@query(
    f"WITH {_PLACED} SELECT event_type, count(*) AS n FROM placed WHERE Npix << (2 * (29 - Norder)) <= {_HIGH} "
    f"AND (Npix + 1) << (2 * (29 - Norder)) > {_LOW} AND value > 10 GROUP BY event_type"
)
def catalog_view_partitions(spark, sf_dir):
    """A statement over the view, pruned by a join with the partition table."""
    star_catalog(spark, sf_dir).create_view("sky_stars")
    return spark.sql(
        "SELECT event_type, count(*) AS n FROM sky_stars s JOIN sky_stars_partitions p "
        f"ON s.Norder = p.Norder AND s.Npix = p.Npix WHERE p.lo <= {_HIGH} AND p.hi > {_LOW} AND value > 10 GROUP BY event_type"
    )


@query(
    f"WITH {STARS} SELECT event_id, round({distance_sql('ra', 'dec', 45, -20)}, 6) AS separation, true AS pruned FROM stars "
    f"ORDER BY {distance_sql('ra', 'dec', 45, -20)}, event_id LIMIT 25"
)
def catalog_nearest(spark, sf_dir):
    """The nearest rows to a point, out of the partitions that can hold them."""
    catalog = star_catalog(spark, sf_dir)
    found, opened = catalog.nearest(25, 45.0, -20.0, columns=["event_id"], then=[F.col("event_id")])
    pruned = F.lit(opened * 4 <= catalog.partitions.count())
    return found.select("event_id", F.round("separation", 6).alias("separation"), pruned.alias("pruned"))
