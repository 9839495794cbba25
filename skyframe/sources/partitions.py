"""The partitions of a catalog, as a table: `Norder, Npix, lo, hi, rows, bytes, path` and the cell's
centre, `centre_ra, centre_dec`.

`lo` and `hi` are the cell's span of order-29 indices, half open. A catalog's partitions are
disjoint and the table is ordered by span wherever order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.healpix import MAX_ORDER, cell_center, end_index, first_index

PATH_CELL = r"Norder=(\d+)/(?:.*/)?Npix=(\d+)"


def _cells(df: DataFrame, order: Column, pixel: Column, **more: Column) -> DataFrame:
    """Checked cells with their spans. A pixel outside its order would claim another's sky."""
    order, pixel = order.cast("bigint"), pixel.cast("bigint")
    count = F.call_function("shiftleft", F.lit(12).cast("bigint"), (2 * order).cast("int"))
    known = order.between(0, MAX_ORDER) & (pixel >= 0) & (pixel < count)
    named = F.concat(F.lit("not a HEALPix cell: order "), order, F.lit(" pixel "), pixel)
    refused = F.raise_error(F.coalesce(named, F.lit("a partition without Norder or Npix")))
    cells = df.select(
        F.when(known, order).otherwise(refused.cast("bigint")).cast("int").alias("Norder"),
        pixel.alias("Npix"),
        *[value.alias(name) for name, value in more.items()],
    )
    return cells.withColumns(
        {"lo": first_index(F.col("Norder"), F.col("Npix")), "hi": end_index(F.col("Norder"), F.col("Npix"))}
    )


def _finished(df: DataFrame, root: str, suffix: str) -> DataFrame:
    folder = (F.floor(F.col("Npix") / 10_000) * 10_000).cast("string")
    path = F.concat(
        F.lit(f"{root}/dataset/Norder="), F.col("Norder"), F.lit("/Dir="), folder,
        F.lit("/Npix="), F.col("Npix"), F.lit(suffix.rstrip("/")),
    )
    ra, dec = cell_center(F.col("Norder"), F.col("Npix"))
    return df.select(
        "Norder", "Npix", "lo", "hi", "rows", "bytes", path.alias("path"), ra.alias("centre_ra"), dec.alias("centre_dec")
    )


def from_partition_info(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """From `partition_info.csv`: columns by name, others ignored, a cell listed twice once."""
    listed = spark.read.csv(
        f"{root}/partition_info.csv", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    by_name = {name.lower(): name for name in listed.columns}
    missing = [name for name in ("Norder", "Npix") if name.lower() not in by_name]
    if missing:
        raise ValueError(f"partition_info.csv has no {' or '.join(missing)}; it has {listed.columns}")
    unknown = F.lit(None).cast("bigint")
    cells = _cells(
        listed, F.col(f"`{by_name['norder']}`"), F.col(f"`{by_name['npix']}`"), rows=unknown, bytes=unknown
    )
    return _finished(cells.dropDuplicates(["Norder", "Npix"]), root, suffix)


def _path_cell(path: Column, **more: Column) -> dict[str, Column]:
    return {
        "order": F.regexp_extract(path, PATH_CELL, 1).try_cast("bigint"),
        "pixel": F.regexp_extract(path, PATH_CELL, 2).try_cast("bigint"),
        **more,
    }


def _files(spark: SparkSession, root: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.format("binaryFile").load(f"{root}/dataset").select("path", "length")


def from_listing(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """From the files' names. One that names no cell is not a partition, and is left out."""
    files = _files(spark, root).withColumns(_path_cell(F.col("path")))
    files = files.where(F.col("order").isNotNull() & F.col("pixel").isNotNull())
    sizes = files.groupBy("order", "pixel").agg(F.sum("length").alias("size"))
    cells = _cells(sizes, F.col("order"), F.col("pixel"), rows=F.lit(None).cast("bigint"), bytes=F.col("size"))
    return _finished(cells, root, suffix)


def from_data(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """From the data, with rows and bytes: counts alone are asked for, which footers answer."""
    data = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/dataset")
    counted = data.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns(_path_cell(F.col("file_path")))
    counted = counted.where(F.col("order").isNotNull() & F.col("pixel").isNotNull())
    totals = counted.groupBy("order", "pixel").agg(F.sum("n").alias("n"), F.sum("file_size").alias("size"))
    cells = _cells(totals, F.col("order"), F.col("pixel"), rows=F.col("n"), bytes=F.col("size"))
    return _finished(cells, root, suffix)
