"""Stored summaries, filters of index files, and streams that are cut short, against whole scans."""

from __future__ import annotations

import math

import pytest
from conftest import awkward_points
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.healpix import healpix_index
from skyframe.operators.crossmatch import crossmatch
from skyframe.operators.region_filter import where_region
from skyframe.operators.regions import Circle, Moc, Zone
from skyframe.sources.catalog import open_catalog
from skyframe.sources.index import files_with, read_index, write_index
from skyframe.sources.pyramid import Measures, build_pyramid, distinct_count, quantile
from skyframe.streaming.stream import crossmatch_batches, read_stream, write_batches


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("summed"))
    points = [(i, ra, dec) for i, (ra, dec) in awkward_points(900) if ra is not None and dec is not None and math.isfinite(ra + dec)]
    df = spark.createDataFrame(points, "id long, ra double, dec double").where("abs(dec) <= 90")
    df = df.selectExpr("*", "id % 3 AS kind", "id % 97 AS user", "if(id % 11 = 0, NULL, id * 0.5D) AS value")
    df = df.withColumn("_healpix_29", healpix_index("ra", "dec")).withColumn("kind", F.expr("if(kind = 2, NULL, kind)"))
    cells = df.withColumns({"Norder": F.lit(1), "Dir": F.lit(0), "Npix": F.shiftright("_healpix_29", 56)})
    cells.repartition("Npix").sortWithinPartitions("_healpix_29").write.partitionBy("Norder", "Dir", "Npix").parquet(f"{root}/dataset")
    with open(f"{root}/properties", "w") as out:
        out.write("hats_col_ra=ra\nhats_col_dec=dec\nhats_npix_suffix=/\n")
    return open_catalog(spark, root)


@pytest.fixture(scope="module")
def pyramid(catalog):
    return build_pyramid(catalog, Measures(by=["kind"], sums=["value"], extremes=["value"], distinct=["user"], quantiles=["value"]), finest=5)


REGIONS = [
    None,
    Circle(45.0, -20.0, 60.0),
    Circle(120.0, 20.0, 0.8),
    Circle(10.0, 88.0, 5.0),
    [Circle(0.2, 0.0, 20.0), Zone((100.0, 140.0), (-30.0, 70.0)), Circle(45.0, -20.0, 170.0)],
    [Moc.from_ascii("1/3 4/100-220 9/0-700"), Circle(120.0, 20.0, 2.0)],
    Circle(275.0, 1.0, 1e-7),
]


@pytest.mark.parametrize("region", REGIONS, ids=str)
def test_a_summary_is_that_of_the_rows(catalog, pyramid, region):
    found = pyramid.summary(region).select("kind", "n", "sum_value", "n_value", "min_value", "max_value", distinct_count("user").alias("users"), quantile("value", 0.5).alias("median"))
    got = {r.kind: r for r in found.collect()}
    rows = catalog.select() if region is None else where_region(catalog.select(), region)
    want = rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.count("value").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count_distinct("user").alias("users"), F.percentile("value", F.array(F.lit(0.46), F.lit(0.54))).alias("around"),
    ).collect()
    assert got.keys() == {r.kind for r in want}
    for r in want:
        mine = got[r.kind]
        assert (mine.n, mine.n_value, mine.min_value, mine.max_value) == (r.n, r.values, r.low, r.high)
        assert (mine.sum_value or 0) == pytest.approx(r.total or 0)
        assert abs(mine.users / r.users - 1) <= 0.05
        if r["values"] > 50:
            assert r.around[0] <= mine.median <= r.around[1]
    one = pyramid.summary(region, by=[]).collect()
    assert sum(r.n for r in one) == sum(r.n for r in want)


def test_rows_are_read_along_the_boundary(pyramid):
    wide = Circle(45.0, -20.0, 80.0)
    stored, edge = pyramid.pieces(wide)
    inside = pyramid.summary(wide, by=[]).first().n
    assert edge.count() * 4 < inside and stored.agg(F.sum("n")).first()[0] + edge.count() == inside
    assert pyramid.read(0).agg(F.sum("n")).first() == pyramid.read(5).agg(F.sum("n")).first()


def test_finer_than_the_index_is_refused(catalog):
    with pytest.raises(ValueError, match="finer"):
        build_pyramid(catalog, Measures(), finest=30)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_an_absent_value_opens_no_file(spark, tmp_path, kind):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _absent_values(spark, tmp_path, kind)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _absent_values(spark, tmp_path, kind):
    rows = spark.range(0, 40_000, 2).selectExpr(f"CAST(id AS {kind}) AS v", "3 AS Norder", "id % 64 AS Npix", "id * 1000 AS _healpix_29")
    rows = rows.unionByName(rows.limit(1).withColumn("v", F.lit(None).cast(kind))).unionByName(
        spark.range(3000).selectExpr(f"CAST(8 AS {kind}) AS v", "3 AS Norder", "id % 64 AS Npix", "id AS _healpix_29")
    )
    root = str(tmp_path)
    write_index(rows.repartition(8), root, "v")
    type_ = T.LongType() if kind == "long" else T.StringType()
    value = (lambda v: v) if kind == "long" else str
    listed = len(read_index(spark, root, "v").inputFiles())
    assert listed >= 4
    there = [0, 8, 12_346, 39_998]
    for v in there:
        files = files_with(spark, root, "v", [value(v)], type_)
        held = read_index(spark, root, "v").where(F.col("v") == value(v)).select("_metadata.file_path").distinct().collect()
        assert {f.file_path for f in held} <= set(files) and len(files) < listed
    absent = [value(v) for v in range(1, 2001, 2)]
    wrong = files_with(spark, root, "v", absent, type_)
    each = sum(len(files_with(spark, root, "v", [v], type_)) for v in absent[:20])
    assert each <= 3 and len(wrong) <= listed
    assert files_with(spark, root, "v", [value(10**9), value(-7)], type_) in ([], files_with(spark, root, "v", [value(-7)], type_))
    assert files_with(spark, root, "v", [None], type_) == []
    assert files_with(spark, str(tmp_path / "none"), "v", [value(1)], type_) is None


def test_a_stream_restarted_is_the_batch(spark, tmp_path):
    source, late = str(tmp_path / "in"), tmp_path / "late"
    points = spark.range(0, 800).selectExpr("id", "(id * 7.3D) % 360 AS ra", "(id * 3.1D) % 120 - 60 AS dec", "0.5D + id % 3 AS r")
    points.where("id < 400").repartition(4).write.parquet(source)
    points.where("id >= 400").repartition(4).write.parquet(str(late))
    catalog = spark.range(300).selectExpr("id AS rid", "(id * 1.3D) % 360 AS ra", "(id * 0.7D) % 100 - 50 AS dec")
    calls = []

    def static():
        calls.append(1)
        if len(calls) == 3:
            raise OSError("gone")
        return catalog

    def run():
        stream = read_stream(spark, source, points.schema, files_per_trigger=1)
        crossmatch_batches(stream, static, "r", str(tmp_path / "out"), str(tmp_path / "progress"), separation=None).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    half = spark.read.parquet(str(tmp_path / "out")).count()
    run()
    for n, file in enumerate(sorted(late.glob("part-*"))):
        (tmp_path / "in" / f"late-{n}.parquet").write_bytes(file.read_bytes())
    run()
    got = sorted((r.id, r.rid) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.id, r.rid) for r in crossmatch(points, catalog, "r", separation=None).collect())
    assert got == want and 0 < half < len(want)


def test_batches_of_pairs_hold_the_columns_asked_for(spark, tmp_path):
    """And no others: what is written is most of what a crossmatch of many pairs costs."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    points = spark.range(200).selectExpr("id", "(id * 7.3D) % 360 AS ra", "(id * 3.1D) % 120 - 60 AS dec")
    points.repartition(2).write.parquet(source)
    catalog = spark.range(300).selectExpr("id AS rid", "(id * 1.3D) % 360 AS ra", "(id * 0.7D) % 100 - 50 AS dec")
    stream = read_stream(spark, source, points.schema, files_per_trigger=1)
    crossmatch_batches(stream, lambda: catalog, 2.0, out, str(tmp_path / "progress"), columns=["rid", "id"]).awaitTermination()
    got = spark.read.parquet(f"{out}/batch=*")
    assert got.columns == ["rid", "id"]
    want = sorted((r.id, r.rid) for r in crossmatch(points, catalog, 2.0).collect())
    assert want and sorted((r.id, r.rid) for r in got.collect()) == want


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0, 100, 1, 2).write.parquet(source)
    seen = []

    def twice(batch):
        seen.append(1)
        if len(seen) == 1:
            # Written, and then cut short before the batch was noted as done.
            batch.write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0"))
            raise OSError("lost")
        return batch

    def run():
        write_batches(read_stream(spark, source, spark.range(1).schema), str(tmp_path / "out"), str(tmp_path / "progress"), twice).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(100))
