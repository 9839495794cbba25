"""The given tables as a sky: positions derived from integer keys by the two-dimensional
plastic-number sequence, near-uniform on the sphere and the same in Spark and in DuckDB."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.healpix import healpix_index, shift_right
from skyframe.sources.catalog import Catalog, open_catalog
from skyframe.sources.files import shared_folder
from skyframe.sources.index import write_index
from skyframe.sources.pyramid import Measures, Pyramid, build_pyramid
from skyframe.sources.sinks import ranged, write_parquet

# Fixed values of the sequence.
_RA, _DEC = "0.5698402909980532", "0.7548776662466927"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@F.arrow_udf(T.DoubleType())
def _arcsine(values: pa.Array) -> pa.Array:
    """The C library's, as DuckDB's is: Java's has another last bit for one value in twenty."""
    return pa.array([v if v is None else math.asin(v) if abs(v) <= 1.0 else math.nan for v in values.to_pylist()], pa.float64())


def with_position(df: DataFrame, key: str) -> DataFrame:
    height = F.expr(f"2D * (({key} * {_DEC}D) % 1D) - 1D")
    return df.select("*", F.expr(f"360D * (({key} * {_RA}D) % 1D)").alias("ra"), F.degrees(_arcsine(height)).alias("dec"))


_stored: dict[tuple[str, str, str], str] = {}


def _sky(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A given table with a position and its cell, stored once a session in cell order.

    Stored, so that queries scan columns as a survey's table has them and their bounds prune row
    groups. Spread by range of cell and key, which cuts a crowded cell between tasks.
    """
    entry = (spark.sparkContext.applicationId, sf_dir, name)
    if entry not in _stored:
        path = shared_folder(spark, name)
        rows = with_position(table(spark, sf_dir, name), key).withColumn("_healpix_29", healpix_index("ra", "dec"))
        rows = ranged(rows, "_healpix_29", key).sortWithinPartitions("_healpix_29", key)
        write_parquet(rows, path)
        _stored[entry] = path
    return spark.read.parquet(_stored[entry])


def indexed_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sky(spark, sf_dir, "events", "event_id")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_stars(spark, sf_dir).drop("_healpix_29")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sky(spark, sf_dir, "orders", "o_orderkey").drop("_healpix_29")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sky(spark, sf_dir, "customer", "c_custkey").drop("_healpix_29")


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sky(spark, sf_dir, "supplier", "s_suppkey").drop("_healpix_29")


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested column per row, as light curves are stored."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "named_struct('mjd', array(l_quantity, l_quantity + 1, l_quantity + 2), "
        "'mag', array(l_extendedprice, l_discount, l_tax), 'band', l_returnflag) AS Lightcurve",
    )


def rounded(name: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(name) if isinstance(name, str) else name, digits)


_catalogs: dict[tuple[str, str], Catalog] = {}


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The stars as a collection with two indexes, written once a session in the shared folder.

    Cells of even base faces are at order 1 and of odd ones at order 2, so that the catalog mixes
    orders. Rows are spread by range of cell and id, which splits a crowded cell over tasks and
    files rather than giving all of it to one.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        root = shared_folder(spark, "stars")
        _write_collection(spark, indexed_stars(spark, sf_dir), root)
        _catalogs[key] = open_catalog(spark, root)
    return _catalogs[key]


_pyramids: dict[tuple[str, str], Pyramid] = {}


def star_pyramid(spark: SparkSession, sf_dir: str) -> Pyramid:
    """Summaries of the stars by cell and kind, written once a session beside the catalog."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _pyramids:
        catalog = star_catalog(spark, sf_dir)
        measures = Measures(by=["event_type"], sums=["value"], extremes=["value"], distinct=["user_id"], quantiles=["value"])
        _pyramids[key] = build_pyramid(catalog, measures, f"{catalog.root}/pyramid")
    return _pyramids[key]


def _write_collection(spark: SparkSession, rows: DataFrame, root: str) -> None:
    order = (1 + shift_right(F.col("_healpix_29"), 58) % 2).cast("int")
    rows = rows.withColumn("Norder", order)
    rows = rows.withColumn(
        "Npix", F.call_function("shiftright", F.col("_healpix_29"), 2 * (29 - F.col("Norder")))
    ).withColumn("Dir", F.floor(F.col("Npix") / 10_000) * 10_000)
    (
        ranged(rows, "_healpix_29", "event_id")
        .sortWithinPartitions("Norder", "Dir", "Npix", "_healpix_29", "event_id")
        .write.partitionBy("Norder", "Dir", "Npix")
        .parquet(f"{root}/catalog/dataset")
    )
    cells = rows.select("Norder", "Npix").distinct()
    cells.write.option("header", True).csv(f"{root}/catalog/partition_info.csv")
    for column in ("event_id", "user_id"):
        write_index(rows.select(column, "Norder", "Npix", "_healpix_29"), f"{root}/{column}_index", column)
    _write_text(
        spark,
        f"{root}/catalog/hats.properties",
        ["obs_collection=stars", "dataproduct_type=object", "hats_col_ra=ra", "hats_col_dec=dec",
         "hats_col_healpix=_healpix_29", "hats_col_healpix_order=29", "hats_npix_suffix=/"],
    )
    _write_text(
        spark,
        f"{root}/collection.properties",
        ["obs_collection=stars", "hats_primary_table_url=catalog",
         "all_indexes=event_id event_id_index user_id user_id_index"],
    )


def _write_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


# ---- the same in the SQL that checks the queries ----


def sky_sql(key: str) -> str:
    return (
        f"360::DOUBLE * (({key}::DOUBLE * {_RA}::DOUBLE) % 1::DOUBLE) AS ra, "
        f"degrees(asin(2::DOUBLE * (({key}::DOUBLE * {_DEC}::DOUBLE) % 1::DOUBLE) - 1::DOUBLE)) AS dec"
    )


STARS = f"stars AS (SELECT *, {sky_sql('event_id')} FROM events)"
DETECTIONS = f"detections AS (SELECT *, {sky_sql('o_orderkey')} FROM orders)"
TARGETS = f"targets AS (SELECT *, {sky_sql('c_custkey')} FROM customer)"
BEACONS = f"beacons AS (SELECT *, {sky_sql('s_suppkey')} FROM supplier)"


def hav_sql(ra_a, dec_a, ra_b, dec_b) -> str:
    return (
        f"(pow(sin(radians(({dec_a})::DOUBLE - ({dec_b})::DOUBLE) / 2), 2) + "
        f"cos(radians(({dec_a})::DOUBLE)) * cos(radians(({dec_b})::DOUBLE)) * "
        f"pow(sin(radians(({ra_a})::DOUBLE - ({ra_b})::DOUBLE) / 2), 2))"
    )


def distance_sql(ra_a, dec_a, ra_b, dec_b) -> str:
    return f"degrees(2 * asin(sqrt(least(1::DOUBLE, {hav_sql(ra_a, dec_a, ra_b, dec_b)}))))"


def in_circle_sql(ra, dec, radius, alias: str = "") -> str:
    return f"{hav_sql(alias + 'ra', alias + 'dec', ra, dec)} <= pow(sin(radians(({radius})::DOUBLE) / 2), 2)"


def cell_sql(source: str, order: int, name: str = "cell") -> str:
    """CTEs that add the nested cell at `order`, by the ring-free textbook branch formulas."""
    n = 1 << order
    bits = ", ".join(str(i) for i in range(order)) or "0"
    spread = "list_sum([((({v}) >> i) & 1) << (2 * i) for i in [" + bits + "]])::BIGINT"
    return (
        f"c1_{name} AS (SELECT *, sin(radians(dec)) AS z, (ra / 90) AS tt FROM {source}), "
        f"c2_{name} AS (SELECT *, abs(z) > 2::DOUBLE / 3 AS polar, least(3, floor(tt))::BIGINT AS ntt, "
        f"{n}::DOUBLE * sqrt(6) * sin(radians(90 - abs(dec)) / 2) AS tmp, "
        f"floor({n} * (0.5::DOUBLE + tt - z * 0.75))::BIGINT AS jp, "
        f"floor({n} * (0.5::DOUBLE + tt + z * 0.75))::BIGINT AS jm FROM c1_{name}), "
        f"c3_{name} AS (SELECT *, least({n - 1}, floor((tt - ntt) * tmp))::BIGINT AS pjp, "
        f"least({n - 1}, floor((1 - (tt - ntt)) * tmp))::BIGINT AS pjm, "
        f"jp // {n} AS ifp, jm // {n} AS ifm FROM c2_{name}), "
        f"c4_{name} AS (SELECT *, CASE WHEN polar AND z > 0 THEN ntt WHEN polar THEN ntt + 8 "
        "WHEN ifp = ifm THEN ifp % 4 + 4 WHEN ifp < ifm THEN ifp % 4 ELSE ifm % 4 + 8 END AS face, "
        f"CASE WHEN polar AND z > 0 THEN {n - 1} - pjm WHEN polar THEN pjp ELSE jm % {n} END AS ix, "
        f"CASE WHEN polar AND z > 0 THEN {n - 1} - pjp WHEN polar THEN pjm ELSE {n - 1} - jp % {n} END AS iy "
        f"FROM c3_{name}), "
        f"{name}d AS (SELECT *, ((face << {2 * order}) + {spread.format(v='ix')} + 2 * {spread.format(v='iy')})::BIGINT "
        f"AS {name} FROM c4_{name})"
    )
