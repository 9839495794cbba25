"""A catalog in the file-per-partition layout, written here, against its own coordinates."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import separation
from pyspark.sql import functions as F

from skyframe.functions.healpix import cell_center, healpix_index
from skyframe.operators.regions import Circle, Moc, Zone
from skyframe.sources import catalog as module
from skyframe.sources import index as indexes
from skyframe.sources.catalog import open_catalog
from skyframe.sources.partitions import from_data, from_listing, from_partition_info

PIXELS = range(64, 68)


@pytest.fixture(scope="module")
def rows(spark):
    """64 rows in each of four cells of order 3, at the centres of its cells of order 6."""
    cells = spark.range(64 * 64, 68 * 64).withColumn("k", F.lit(6))
    ra, dec = cell_center(F.col("k"), F.col("id"))
    placed = cells.select("id", ra.alias("ra"), dec.alias("dec")).withColumn("cell", healpix_index("ra", "dec"))
    return [(n, r.ra, r.dec, r.cell) for n, r in enumerate(placed.orderBy("id").collect())]


def write(root, rows, coordinates=pa.float64(), suffix=".parquet", info=True, cells=False, common=False):
    """256 rows in row groups of eight, under the names a catalog's files have."""
    for pixel in PIXELS:
        part = [row for row in rows if row[3] >> 52 == pixel]
        folder = f"{root}/dataset/Norder=3/Dir=0"
        table = pa.table(
            {
                "id": pa.array([r[0] for r in part], pa.int64()),
                "ra": pa.array([r[1] for r in part]).cast(coordinates, safe=False),
                "dec": pa.array([r[2] for r in part]).cast(coordinates, safe=False),
                "_healpix_29": pa.array([r[3] for r in part], pa.int64()),
            }
        )
        if cells:
            for name, value, kind in (("Norder", 3, pa.uint8()), ("Dir", 0, pa.uint64()), ("Npix", pixel, pa.uint64())):
                table = table.append_column(name, pa.array([value] * len(part), kind))
        os.makedirs(folder, exist_ok=True)
        if common:
            pq.write_metadata(table.schema, f"{root}/dataset/_common_metadata")
        if suffix.endswith("/"):
            os.makedirs(f"{folder}/Npix={pixel}", exist_ok=True)
            pq.write_table(table.slice(0, 40), f"{folder}/Npix={pixel}/a.parquet", row_group_size=8)
            pq.write_table(table.slice(40), f"{folder}/Npix={pixel}/b.parquet", row_group_size=8)
        else:
            os.makedirs(folder, exist_ok=True)
            pq.write_table(table, f"{folder}/Npix={pixel}{suffix}", row_group_size=8)
    lines = ["# a comment", "obs_collection=small", "hats_col_ra=ra", "hats_col_dec=dec", f"hats_npix_suffix={suffix}"]
    with open(f"{root}/hats.properties", "w") as out:
        out.write("\n".join(lines) + "\n")
    if info:
        with open(f"{root}/partition_info.csv", "w") as out:
            out.write("extra, Norder , Npix\n" + "".join(f"x,3,{p}\n" for p in [*reversed(PIXELS), PIXELS[0]]))
    return str(root)


@pytest.fixture(scope="module")
def plain(spark, rows, tmp_path_factory):
    return open_catalog(spark, write(tmp_path_factory.mktemp("plain"), rows))


@pytest.fixture(scope="module")
def centre(spark):
    ra, dec = cell_center(F.lit(3), F.lit(64).cast("bigint"))
    return tuple(spark.range(1).select(ra, dec).first())


def ids(df):
    return sorted(row.id for row in df.select("id").collect())


@pytest.mark.parametrize("radius", [1, 6, 60])
def test_circles_reach_one_some_and_all_partitions(plain, rows, centre, radius):
    wanted = [r[0] for r in rows if separation(centre, r[1:3]) <= radius]
    assert wanted and ids(plain.select(Circle(*centre, radius))) == wanted
    assert plain.plan(Circle(*centre, radius)).count() <= 4
    assert ids(plain.select(Circle(*centre, radius), where="id % 2 = 0", columns=["id"])) == [i for i in wanted if i % 2 == 0]


def test_many_circles_choose_partitions(plain, rows, centre):
    many = [Circle(centre[0] + 0.01 * i, centre[1] + 0.01 * (i % 9), 0.3 + 0.001 * i) for i in range(90)]
    many += [Circle(200.0 + i, -60.0, 1.0) for i in range(30)]
    wanted = [r[0] for r in rows if any(separation((c.ra, c.dec), r[1:3]) <= c.radius for c in many)]
    assert wanted and ids(plain.select(many)) == wanted
    assert plain.plan(many).count() < 4
    assert ids(plain.select([*many, Zone((0.0, 360.0), (-90.0, 90.0))])) == [r[0] for r in rows]


def test_partitions_far_off_are_not_read(plain, centre):
    near = plain.plan(Circle(*centre, 0.5)).collect()
    assert [row.Npix for row in near] == [64]
    assert plain.plan(Circle(200.0, -60.0, 5.0)).count() == 0
    assert plain.select(Circle(200.0, -60.0, 5.0)).count() == 0
    sure = plain.plan(Circle(*centre, 60.0)).collect()
    assert len(sure) == 4 and not any(row.needs_test for row in sure)
    assert [row.lo for row in sure] == sorted(row.lo for row in sure)


@pytest.mark.parametrize("layout", [{"suffix": "/"}, {"coordinates": pa.float32()}, {"info": False}, {"suffix": ".pq"}, {"cells": True}, {"common": True}])
def test_layouts_answer_alike(spark, rows, centre, tmp_path, layout):
    catalog = open_catalog(spark, write(tmp_path, rows, **layout))
    narrow = layout.get("coordinates") is not None
    at = [(r[0], (float(np.float32(r[1])), float(np.float32(r[2]))) if narrow else r[1:3]) for r in rows]
    for radius in (1, 6):
        assert ids(catalog.select(Circle(*centre, radius))) == [i for i, p in at if separation(centre, p) <= radius]
    assert ids(catalog.select()) == [r[0] for r in rows]


def test_partition_tables_agree(spark, plain):
    named = from_partition_info(spark, plain.root)
    listed = from_listing(spark, plain.root)
    counted = from_data(spark, plain.root)
    spans = [[(r.Norder, r.Npix, r.lo, r.hi) for r in t.orderBy("lo").collect()] for t in (named, listed, counted)]
    assert spans[0] == spans[1] == spans[2] == [(3, p, p << 52, (p + 1) << 52) for p in PIXELS]
    assert {r.rows for r in counted.collect()} == {64}
    assert all(r.bytes > 0 for r in listed.collect())
    assert named.select("path").first().path.endswith(".parquet")


def test_an_estimate_is_whole_or_not_given(spark, plain, centre):
    assert tuple(plain.estimate(Circle(*centre, 60.0)).first()) == (4, 0, None, None)
    sized = open_catalog(spark, plain.root, partitions_from="listing").estimate().first()
    assert sized.partitions == 4 and sized.rows is None and sized.bytes > 1000
    counted = open_catalog(spark, plain.root, partitions_from="data")
    assert counted.estimate().first().rows == 256
    assert counted.estimate(Circle(*centre, 0.5)).first().rows == 64
    assert counted.estimate(Circle(200.0, -60.0, 1.0)).first().rows == 0


def test_a_cell_that_is_none_is_refused(spark, tmp_path):
    for text in ("Norder,Npix\n3,768\n", "Norder,Npix\n30,1\n", "Norder,Npix\n1,\n"):
        (tmp_path / "partition_info.csv").write_text(text)
        with pytest.raises(Exception, match="HEALPix cell|without Norder"):
            from_partition_info(spark, str(tmp_path)).collect()
    (tmp_path / "partition_info.csv").write_text("order,pixel\n3,1\n")
    with pytest.raises(ValueError, match="Norder"):
        from_partition_info(spark, str(tmp_path))


def test_zones_and_mocs_choose_partitions(plain, rows):
    low = min(r[2] for r in rows)
    zone = Zone((0.0, 360.0), (low, low + 2.0))
    assert ids(plain.select(zone)) == [r[0] for r in rows if low <= r[2] <= low + 2.0]
    moc = Moc.of_cells([(3, 65, 65), (6, 66 * 64, 66 * 64 + 9)])
    planned = {row.Npix: row.needs_test for row in plain.plan(moc).collect()}
    assert planned == {65: False, 66: True}
    assert ids(plain.select(moc)) == [r[0] for r in rows if any(a <= r[3] < b for a, b in moc.ranges)]
    assert {row.Npix for row in plain.plan([moc, Circle(200.0, 0.0, 1.0)]).collect()} == {65, 66}
    assert [row.Npix for row in plain.within_index_range(65 << 52, (66 << 52) + 5).collect()] == [65, 66]


def test_front_of_the_catalog(plain, rows, centre):
    by_cell = sorted(rows, key=lambda r: r[3])
    assert [r.id for r in plain.front(70).collect()] == [r[0] for r in by_cell[:70]]
    assert plain.front(0).columns == ["id", "ra", "dec", "_healpix_29"]
    odd = [r[0] for r in by_cell if r[0] % 2 and separation(centre, r[1:3]) <= 6]
    got = plain.front(20, Circle(*centre, 6.0), "id % 2 = 1", ["id"])
    assert [r.id for r in got.collect()] == odd[:20]
    assert plain.front(10_000).count() == 256


@pytest.mark.parametrize("descending", [True, False])
def test_order_by_the_index(plain, rows, descending):
    ordered = sorted(rows, key=lambda r: r[3], reverse=descending)
    got = plain.ordered_by_index(100, descending, then=[F.col("id")])
    assert [r.id for r in got.collect()] == [r[0] for r in ordered[:100]]


@pytest.mark.parametrize("suffix", [".parquet", "/"])
def test_more_partitions_than_are_listed(spark, rows, centre, monkeypatch, tmp_path, suffix):
    """Exactly the chosen rows, and none of a file that the partition table does not name."""
    write(tmp_path, rows, suffix=suffix)
    catalog = open_catalog(spark, str(tmp_path))
    three = catalog.partitions.where("Npix <> 66")
    within = [r[0] for r in rows if separation(centre, r[1:3]) <= 6]
    for most in (20_000, 2, 0):
        monkeypatch.setattr(module, "LISTED_PATHS", most)
        assert ids(catalog.read(three)) == [r[0] for r in rows if r[3] >> 52 != 66]
        low, high = rows[70][3], rows[130][3]
        cells = catalog.read(catalog.within_index_range(low, high)).where(F.col("_healpix_29").between(low, high))
        assert ids(cells) == [r[0] for r in rows if low <= r[3] <= high]
        assert ids(catalog.select(Circle(*centre, 6.0))) == within
        assert ids(catalog.select(Circle(*centre, 60.0))) == [r[0] for r in rows]
        assert ids(catalog.select(cells=[(low, high)])) == [r[0] for r in rows if low <= r[3] <= high]


def opened(df) -> set[str]:
    return {path.rpartition("Npix=")[2].partition(".")[0].partition("/")[0] for path in df.inputFiles()}


def test_ranges_of_cells_choose_partitions(plain, rows):
    low, high = rows[70][3], rows[130][3]
    wanted = {str(r[3] >> 52) for r in rows if low <= r[3] <= high}
    found = plain.select(cells=[(low, high)])
    assert ids(found) == [r[0] for r in rows if low <= r[3] <= high] and opened(found) == wanted
    found = plain.select(cells=[(c, c) for c in (rows[3][3], rows[250][3])], where="id < 100")
    assert ids(found) == [3] and opened(found) == {str(rows[k][3] >> 52) for k in (3, 250)}
    for nothing in ([(-5, -1)], [(high, low)], []):
        assert plain.select(cells=nothing).count() == 0
    assert ids(plain.select(where=f"_healpix_29 >= {low} OR id < 5")) == sorted({r[0] for r in rows if r[3] >= low or r[0] < 5})


def test_statements_read_what_is_selected(spark, plain, rows, centre):
    from skyframe.functions.sql import register

    register(spark)
    ra, dec = rows[5][1:3]
    near = [r[0] for r in rows if separation((ra, dec), r[1:3]) <= 0.5]
    found = plain.sql("SELECT * FROM {catalog}", regions=Circle(ra, dec, 0.5))
    assert ids(found) == near and len(opened(found)) < 4
    found = plain.sql(f"SELECT id FROM {{catalog}} WHERE sky_in_zone(ra, dec, {ra - 1}D, {ra + 1}D, {dec - 1}D, {dec + 1}D)")
    assert ids(found) == [r[0] for r in rows if abs(r[2] - dec) <= 1 and abs((r[1] - ra + 180) % 360 - 180) <= 1]
    both = plain.sql(
        "SELECT a.id FROM {catalog} a JOIN {others} o ON a.id = o.id",
        cells=[(rows[k][3], rows[k][3]) for k in (3, 250)],
        others=spark.range(100).select("id"),
    )
    assert ids(both) == [3] and len(opened(both)) == 2


def files_read(df) -> int:
    """Files that a query's scans of a dataset have opened."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        inner = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        inner += [plan.plan()] if hasattr(plan, "plan") and "QueryStage" in plan.getClass().getSimpleName() else []
        plans += inner + [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.metrics().contains("numFiles") and "/dataset]" in plan.toString().partition("PartitionFilters")[0]:
            total += plan.metrics().get("numFiles").get().value()
    return total


def test_spark_prunes_the_view(spark, rows, tmp_path):
    catalog = open_catalog(spark, write(tmp_path, rows, suffix="/"))
    catalog.create_view("pruned")
    assert spark.table("pruned").columns == ["id", "ra", "dec", "_healpix_29", "Norder", "Npix"]
    assert files_read(spark.sql("SELECT id FROM pruned")) == 8
    one = spark.sql("SELECT id FROM pruned WHERE Norder = 3 AND Npix = 65")
    assert ids(one) == [r[0] for r in rows if r[3] >> 52 == 65] and files_read(one) == 2
    low, high = rows[70][3], rows[100][3]
    joined = spark.sql(
        "SELECT /*+ BROADCAST(p) */ id FROM pruned s JOIN pruned_partitions p ON s.Norder = p.Norder AND s.Npix = p.Npix "
        f"WHERE p.lo <= {high} AND p.hi > {low}"
    )
    wanted = {r[3] >> 52 for r in rows[70:101]}
    assert ids(joined) == [r[0] for r in rows if r[3] >> 52 in wanted] and files_read(joined) == 2 * len(wanted) < 8


def test_the_view_of_files(spark, plain, rows):
    plain.create_view("small_catalog")
    assert spark.sql("SELECT count(*) AS n FROM small_catalog WHERE id < 10").first().n == 10
    one = spark.sql("SELECT id FROM small_catalog WHERE Norder = 3 AND Npix = 65")
    assert ids(one) == [r[0] for r in rows if r[3] >> 52 == 65]


@pytest.mark.parametrize("n", [1, 5, 70, 300, 0])
def test_nearest_rows(plain, rows, centre, n):
    for at in (centre, (rows[200][1], rows[200][2]), (0.0, 90.0), (359.99, -0.5)):
        by = sorted((separation(at, r[1:3]), r[0]) for r in rows)
        found, opened_ = plain.nearest(n, *at, columns=["id"], then=[F.col("id")])
        got = [(r.separation, r.id) for r in found.collect()]
        assert [round(d, 9) for d, _ in got] == [round(d, 9) for d, _ in by[:n]] and opened_ <= 4
        # Ties but for the last digit may change places.
        assert {i for _, i in got[:-1]} <= {i for _, i in by[: n + 8]}
    found, opened_ = plain.nearest(3, *centre, where="id % 2 = 1", columns=["id"])
    assert all(r.id % 2 for r in found.collect()) and opened_ < 4
    assert plain.nearest(5, *centre, where="id < 0")[0].count() == 0


def test_few_partitions_are_opened_for_the_nearest(spark, tmp_path):
    """A finer catalog: partitions opened are under a tenth of those listed."""
    cells = spark.range(0, 768 * 256, 64).withColumn("k", F.lit(7))
    ra, dec = cell_center(F.col("k"), F.col("id"))
    df = cells.select("id", ra.alias("ra"), dec.alias("dec")).withColumn("_healpix_29", healpix_index("ra", "dec"))
    df = df.withColumn("Norder", F.lit(3)).withColumn("Npix", F.shiftright("_healpix_29", 52)).withColumn("Dir", F.lit(0))
    df.repartition(4, "Npix").write.partitionBy("Norder", "Dir", "Npix").parquet(str(tmp_path / "dataset"))
    (tmp_path / "properties").write_text("hats_col_ra=ra\nhats_col_dec=dec\nhats_npix_suffix=/\n")
    catalog = open_catalog(spark, str(tmp_path))
    every = [(r.id, r.ra, r.dec) for r in df.select("id", "ra", "dec").collect()]
    for at in ((10.0, 89.9), (45.0, -20.0), (0.0, 0.0)):
        found, count = catalog.nearest(25, *at, columns=["id"], then=[F.col("id")])
        want = sorted(round(separation(at, r[1:]), 8) for r in every)[:25]
        assert [round(r.separation, 8) for r in found.collect()] == want
        assert count * 10 < catalog.partitions.count() == 768


@pytest.fixture(scope="module", params=[True, False], ids=["with cells", "without cells"])
def collection(request, spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("collection")
    os.makedirs(root / "primary")
    write(root / "primary", rows)
    for column, of in (("id", lambda r: r[0]), ("ra", lambda r: r[1])):
        os.makedirs(root / f"by_{column}" / "dataset")
        for at, part in enumerate((rows[:128], rows[128:])):
            data = {
                "Norder": pa.array([3] * len(part), pa.uint8()),
                "Npix": pa.array([r[3] >> 52 for r in part], pa.uint64()),
                column: [of(r) for r in part],
            }
            if request.param:
                data["_healpix_29"] = pa.array([r[3] for r in part], pa.int64())
            pq.write_table(pa.table(data), root / f"by_{column}" / "dataset" / f"{at}.parquet")
    (root / "collection.properties").write_text("hats_primary_table_url=primary/\nall_indexes=id by_id ra by_ra\n")
    return open_catalog(spark, str(root))


def test_identifiers_choose_partitions(collection, rows):
    assert [r.Npix for r in collection.plan(identifiers={"id": [3, 5]}).collect()] == [64]
    assert ids(collection.select(identifiers={"id": [3, 200, 5000]})) == [3, 200]
    assert collection.select(identifiers={"id": [5000]}).count() == 0
    both = {"id": [3, 200], "ra": [rows[200][1], rows[7][1]]}
    assert ids(collection.select(identifiers=both)) == [
        i for i in (3, 200) if rows[i][1] in (rows[200][1], rows[7][1])
    ]


@pytest.mark.parametrize("listed", [1_000, 2])
def test_a_table_of_identifiers(spark, collection, rows, monkeypatch, listed):
    monkeypatch.setattr(indexes, "LISTED_VALUES", listed)
    wanted = spark.createDataFrame([(i,) for i in (1, 1, 70, 255, 999)], "id int")
    assert ids(collection.select(identifiers={"id": wanted})) == [1, 70, 255]


def test_identifiers_beside_a_predicate(collection, rows):
    for wanted, where, left in (([7], "ra > -400", [7]), ([3, 200, 5000], "id < 100", [3]), (list(range(20)), None, list(range(20)))):
        found = collection.select(identifiers={"id": wanted}, where=where)
        assert ids(found) == left
        assert opened(found) == {str(rows[i][3] >> 52) for i in wanted if i < 256}
    found = collection.sql("SELECT id FROM {catalog}", identifiers={"id": [7]})
    assert ids(found) == [7] and len(opened(found)) == 1


def test_a_long_list_is_a_table(collection, monkeypatch):
    monkeypatch.setattr(indexes, "LISTED_VALUES", 5)
    monkeypatch.setattr(module, "LISTED_CELLS", 3)
    assert ids(collection.select(identifiers={"id": list(range(0, 300, 9))})) == list(range(0, 256, 9))


def test_an_index_only_narrows(collection, rows, centre):
    """A column without an index is answered all the same, and beside a region."""
    found = collection.select(Circle(*centre, 6.0), identifiers={"_healpix_29": [rows[0][3], rows[200][3]]})
    assert ids(found) == [r[0] for r in (rows[0], rows[200]) if separation(centre, r[1:3]) <= 6]


def test_what_is_not_a_catalog(spark, tmp_path):
    with pytest.raises(ValueError, match="not a catalog"):
        open_catalog(spark, str(tmp_path))
    for url in ("/etc", "../other", "s3://elsewhere"):
        (tmp_path / "collection.properties").write_text(f"hats_primary_table_url={url}\n")
        with pytest.raises(ValueError, match="inside the collection"):
            open_catalog(spark, str(tmp_path))
    (tmp_path / "collection.properties").write_text("hats_primary_table_url=a\nall_indexes=id\n")
    with pytest.raises(ValueError, match="pair"):
        open_catalog(spark, str(tmp_path))
